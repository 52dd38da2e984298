"""Text files at given paths, written by the executors to a folder that they share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only for local sessions that name none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="loomlog-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def write_lines(rows: DataFrame, root: str) -> int:
    """Writes ``rows`` (path, line_no, value) as one text file for each path under ``root``; the number of files.

    A file is written in one piece by the task that holds its lines, so a task that runs again writes the same file.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, lines, done = None, [], 0
        fs, at = pafs.FileSystem.from_uri(root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root)

        def flush() -> None:
            nonlocal done
            if path is not None:
                fs.create_dir(f"{at}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{at}/{path}", compression=None) as out:
                    out.write("".join(f"{x}\n" for x in lines).encode())
                done += 1

        for batch in batches:
            for p, value in zip(batch["path"], batch["value"], strict=True):
                if p != path:
                    flush()
                    path, lines = p, []
                lines.append(value)
        flush()
        yield pd.DataFrame({"files": [done]})

    sorted_rows = rows.select("path", "line_no", "value").repartition("path").sortWithinPartitions("path", "line_no")
    return sum(r["files"] for r in sorted_rows.mapInPandas(write, "files long").collect())  # a row for each task


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df``, computed once: written as Parquet to a folder of its own and read back. (A checkpoint computes its plan twice.)"""
    path = shared_root(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
