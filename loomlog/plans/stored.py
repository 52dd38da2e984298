"""A fold whose results are written once and read by every report after that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.fold import Fold
from ..sources.files import shared_root

#: Frames of a fold that are kept, each after those it is made from.
KEPT = ("session_models", "subagent_models", "subagents", "_sessions_base", "sessions", "rolled_models", "turns")
NEEDS = {"subagents": ("subagent_models",), "sessions": ("session_models", "subagents", "_sessions_base"), "rolled_models": ("session_models", "subagent_models", "_sessions_base")}


class StoredFold:
    """A :class:`loomlog.operators.fold.Fold` whose :data:`KEPT` frames are written to ``folder`` when first asked for, and read from there.

    They are a row for each session, or for each of its models, children or turns. Everything else comes from the fold itself.
    """

    def __init__(self, fold: Fold, folder: str):
        self._fold, self._folder, self._read = fold, folder, {}

    def __getattr__(self, name: str):
        return self._kept(name) if name in KEPT else getattr(self._fold, name)

    def _kept(self, name: str) -> DataFrame:
        if name not in self._read:
            for part in NEEDS.get(name, ()):
                self._fold.__dict__[part] = self._kept(part)  # what the fold goes on from
            frame = getattr(self._fold, name)
            path = f"{self._folder}/{name.strip('_')}"
            frame.write.mode("overwrite").parquet(path)
            self._read[name] = frame.sparkSession.read.schema(frame.schema).parquet(path)
        return self._read[name]


def state_of(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(name, modification time, size) of the files of ``path``, in order; they are not read."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return tuple(sorted((s.getPath().toString(), s.getModificationTime(), s.getLen()) for s in found))


_FOLDS: dict[str, tuple[tuple, StoredFold]] = {}


def stored_fold(spark: SparkSession, source: str, build: Callable[[], Fold]) -> StoredFold:
    """The fold of ``source``, a table's path: built anew when the application or one of the table's files is another than last time."""
    state = (spark.sparkContext.applicationId, id(spark), state_of(spark, source))
    if source not in _FOLDS or _FOLDS[source][0] != state:
        _FOLDS[source] = state, StoredFold(build(), shared_root(spark, "fold"))
    return _FOLDS[source][1]
