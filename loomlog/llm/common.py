"""Shared helpers of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words everywhere in this subpackage: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python by ``rows`` at a time where the session has Spark's default of 10,000.

    Texts are long: 10,000 of them fill hundreds of megabytes in the JVM and again in each worker.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only for local sessions that name none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomlog-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = f"file://{found}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the Python driver ends."""
    path = f"{shared_dir(spark)}/loomlog-{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage (a lost executor costs a re-read, not a recomputation) and computes shared
    inputs once. The files live until the Python driver ends.
    """
    return written(df, tag)[0]


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As :func:`materialise`, with the path, for callers that :func:`remove` it earlier."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def with_row_keys(docs: DataFrame, tag: str) -> DataFrame:
    """(rid, row): ``docs`` with a number of its own for every row, whatever its id is.

    Rows of files that are read as they are have their file and place in it; its files are numbered on the driver. Any other table is
    written first, because numbers that Spark gives out anew on each computation need not agree.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if docs._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            placed = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), row)
        except AnalysisException:  # no table of files
            placed = None
        if placed is not None:
            files = [(r["file"], n << 40) for n, r in enumerate(placed.select("file").distinct().orderBy("file").collect())]
            numbers = docs.sparkSession.createDataFrame(files, "file string, first long")
            return placed.join(F.broadcast(numbers), "file").select((F.col("first") + F.col("at")).alias("rid"), "row")
    return materialise(docs.select(F.monotonically_increasing_id().alias("rid"), row), tag)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: its shared folder is cleaned by its owner
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, most: int = 4096) -> DataFrame:
    """Inner join of ``rows`` with ``table``: one row for each value of ``keys``, with ``count``, how many of the ``total`` rows hold the value.

    Values that more than one in ``most`` rows hold are broadcast, so that their rows stay where they are. There are fewer than ``most``
    of them, whatever the data. The others are shuffled, and none brings more than one in ``most`` rows into a task. Keys aren't null.
    """
    often = F.broadcast(table.filter(F.col(count) > total // most))
    others = rows.join(often.select(*keys), keys, "left_anti").join(table.filter(F.col(count) <= total // most), keys)
    return rows.join(often, keys).unionByName(others)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text selects the held-out rows; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
