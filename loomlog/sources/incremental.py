"""Incremental refresh: a manifest of (path, modification time, size) tells which files changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .growing import files

KEY = ["path", "mtime", "size"]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of all transcript files, child files included; contents are not read."""
    return files(spark, root)


def changed(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or differ in time or size."""
    return now.join(manifest.select(*KEY), KEY, "left_anti")


def pruned(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """Manifest rows of files that still exist."""
    return manifest.join(now.select("path"), "path", "left_semi")


def touched_sessions(paths: DataFrame) -> DataFrame:
    """(project_id, session_id) whose own or child files are among ``paths``: they are folded again as a whole."""
    p = F.regexp_extract("path", r"/projects/([^/]+)/", 1)
    s = F.regexp_extract("path", r"/projects/[^/]+/([^/]+?)(?:\.jsonl|/subagents/.*)$", 1)
    return paths.select(p.alias("project_id"), s.alias("session_id")).distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows replace ``old`` ones with the same keys."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__v")))
    return both.withColumn("__n", rank).filter("__n = 1").drop("__n", "__v")


def _versions(spark: SparkSession, store: str) -> list[int]:
    """Finished versions in order: those whose manifest, which is written last, has its success mark."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{store}/manifest-*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(x.getPath().getParent().getName().rpartition("-")[2]) for x in found)


def stored(spark: SparkSession, store: str, versions: list[int]) -> DataFrame:
    """The sessions as of the last of ``versions``: a row counts unless a later version touched its session."""
    with_version = lambda name: [spark.read.parquet(f"{store}/{name}-{v}").withColumn("__v", F.lit(v)) for v in versions]
    rows, *more = with_version("sessions")
    for m in more:
        rows = rows.unionByName(m, allowMissingColumns=True)
    touched, *more = with_version("touched")
    for m in more:
        touched = touched.unionByName(m)
    last = touched.groupBy("project_id", "session_id").agg(F.max("__v").alias("__last"))
    return rows.join(last, ["project_id", "session_id"], "left").filter(F.col("__v") >= F.coalesce("__last", F.lit(0))).drop("__v", "__last")


def refresh(spark: SparkSession, root: str, store: str, build, merge_every: int = 16) -> DataFrame:
    """Sessions of ``root``, kept as Parquet in ``store``; only sessions of changed files go through ``build(root, keys)``.

    A run writes what changed: the sessions built anew, the keys it touched and, last, the manifest, whose success mark makes the
    version valid; a failed run leaves the old state. Every ``merge_every`` versions the whole is written as one and what it replaces is deleted.
    """
    versions = _versions(spark, store)
    now = listing(spark, root).persist()
    try:
        version = versions[-1] + 1 if versions else 1
        if versions:
            base = max(v for v in versions if (v - 1) % merge_every == 0)
            own = [v for v in versions if v >= base]
            manifest = spark.read.parquet(f"{store}/manifest-{versions[-1]}")
            keys = touched_sessions(changed(now, manifest).unionByName(manifest.select(*KEY).join(now.select("path"), "path", "left_anti")))
            keys.write.mode("overwrite").parquet(f"{store}/touched-{version}")
            keys = spark.read.parquet(f"{store}/touched-{version}")
            fresh = build(root, keys)
            if (version - 1) % merge_every == 0:
                fresh = stored(spark, store, own).join(keys, ["project_id", "session_id"], "left_anti").unionByName(fresh, allowMissingColumns=True)
                own = []
        else:
            own, fresh = [], build(root, None)
            touched_sessions(now).limit(0).write.mode("overwrite").parquet(f"{store}/touched-{version}")
        fresh.write.mode("overwrite").parquet(f"{store}/sessions-{version}")
        now.write.mode("overwrite").parquet(f"{store}/manifest-{version}")
    finally:
        now.unpersist()
    if not own:
        _drop(spark, store, [v for v in versions if v < version])
    return stored(spark, store, [*own, version])


def _drop(spark: SparkSession, store: str, versions: list[int]) -> None:
    jvm = spark.sparkContext._jvm
    for v in versions:
        for name in ("manifest", "sessions", "touched"):
            path = jvm.org.apache.hadoop.fs.Path(f"{store}/{name}-{v}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def finished(spark: SparkSession, store: str, version: int) -> bool:
    return version in _versions(spark, store)


def write_version(spark: SparkSession, store: str, version: int, keys: DataFrame, build, merge_every: int = 16) -> tuple[DataFrame, DataFrame]:
    """Writes the sessions ``build(keys)`` as ``version`` of ``store``, which counts once :func:`finish_version` has marked it; the sessions and keys.

    For callers whose versions rise by one and may come again, such as batches of a stream: what a failed attempt has left is replaced. Every
    ``merge_every`` versions the whole is written as one. ``keys`` has project_id and session_id. A store is kept in this way or by :func:`refresh`.
    """
    keys.write.mode("overwrite").parquet(f"{store}/touched-{version}")
    keys = spark.read.schema(keys.schema).parquet(f"{store}/touched-{version}")
    fresh = build(keys)
    old = current(spark, store, merge_every)
    merged = (version - 1) % merge_every == 0 and old is not None
    rows = old.join(keys, ["project_id", "session_id"], "left_anti").unionByName(fresh, allowMissingColumns=True) if merged else fresh
    rows.write.mode("overwrite").parquet(f"{store}/sessions-{version}")
    rows = spark.read.schema(rows.schema).parquet(f"{store}/sessions-{version}")
    return (rows.join(keys, ["project_id", "session_id"], "left_semi") if merged else rows), keys


def finish_version(spark: SparkSession, store: str, version: int, keys: DataFrame, merge_every: int = 16) -> None:
    keys.write.mode("overwrite").parquet(f"{store}/manifest-{version}")
    if (version - 1) % merge_every == 0:
        _drop(spark, store, [v for v in _versions(spark, store) if v < version])


def current(spark: SparkSession, store: str, merge_every: int = 16) -> DataFrame | None:
    """The sessions of the last finished version; None if there is none."""
    finished = _versions(spark, store)
    if not finished:
        return None
    base = max(v for v in finished if (v - 1) % merge_every == 0)
    return stored(spark, store, [v for v in finished if v >= base])
