"""Structured Streaming over transcripts: files that grow, changed sessions pushed to a store, and event-time extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import growing
from ..sources.catalog import settings
from ..sources.incremental import finish_version, finished, touched_sessions, write_version


def stream_lines(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, value) of new session files ``projects/<project>/<session>.jsonl``; child files are routed out.

    The file source sees new paths only; :func:`loomlog.sources.growing.stream` follows files that grow in place.
    """
    raw = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_trigger).schema("value string").format("text").load(f"{root}/projects")
    return raw.select("value", F.col("_metadata.file_path").alias("path")).filter(F.col("path").rlike(r"/projects/[^/]+/[^/]+\.jsonl$"))


def stream_settings(spark: SparkSession, root: str) -> DataFrame:
    """(path, s, seen_at) of each settings file that is new under ``root``, parsed whole; writers replace a file by a new one."""
    raw = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "settings*.json").option("wholetext", "true").schema("value string").format("text").load(root)
    return settings(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))).withColumn("seen_at", F.current_timestamp())


def refold(lines: DataFrame, build: Callable[[DataFrame], DataFrame], put: Callable[[DataFrame], None], checkpoint: str, interval: str = "300 milliseconds", once: bool = False) -> StreamingQuery:
    """With ``once``, what is there now is taken up and the query ends. For each batch: the sessions it touches are folded again as a whole by ``build(keys)`` and upserted by ``put``."""

    def each(batch: DataFrame, _: int) -> None:
        put(build(touched_sessions(batch.select("path"))))

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**({"availableNow": True} if once else {"processingTime": interval})).start()


def push_batch(batch: DataFrame, number: int, root: str, store: str, build: Callable[[DataFrame], DataFrame], push: Callable[[DataFrame], None] | None = None) -> None:
    """Folds the sessions that ``batch`` (path, is_new) touches again as a whole and upserts them as version ``number`` + 1 of ``store``.

    ``build`` takes the lines of sessions and gives rows with project_id and session_id. With them, event says ``created`` for a session whose
    file was first seen in this batch, else ``updated``; events are kept in ``events-<version>`` and handed to ``push``. A batch that comes
    again changes nothing and pushes nothing; one whose first attempt was cut off may push a second time.
    """
    spark, keys, version = batch.sparkSession, ["project_id", "session_id"], number + 1
    if finished(spark, store, version):
        return
    named = batch.select(F.regexp_extract("path", r"/projects/([^/]+)/", 1).alias("project_id"), F.regexp_extract("path", r"/projects/[^/]+/([^/]+)\.jsonl$", 1).alias("session_id"), "is_new")
    touched = named.groupBy(*keys).agg(F.max("is_new").alias("is_new"))
    fresh, touched = write_version(spark, store, version, touched, lambda k: build(growing.session_lines(k, root)))
    events = fresh.join(touched, keys).withColumn("event", F.when(F.col("is_new"), "created").otherwise("updated")).drop("is_new")
    events.write.mode("overwrite").parquet(f"{store}/events-{version}")
    if push is not None:
        push(spark.read.schema(events.schema).parquet(f"{store}/events-{version}"))
    finish_version(spark, store, version, touched)


def push_sessions(lines: DataFrame, root: str, store: str, build: Callable[[DataFrame], DataFrame], checkpoint: str, push: Callable[[DataFrame], None] | None = None, interval: str = "300 milliseconds", once: bool = False) -> StreamingQuery:
    """:func:`push_batch` for every batch of ``lines`` (from :func:`loomlog.sources.growing.stream`); ``once`` as for :func:`refold`."""
    each = lambda batch, number: push_batch(batch, number, root, store, build, push)
    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**({"availableNow": True} if once else {"processingTime": interval})).start()


def daily_counts(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Extension: tumbling days in event time with a watermark for late rows."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), "kind").agg(F.count("*").alias("rows"), F.sum("input_tokens").alias("input_tokens")).select(F.col("w.start").alias("day"), "kind", "rows", "input_tokens")


def active_spans(events: DataFrame, ts: str = "ts", gap: str = "75 minutes", delay: str = "2 hours") -> DataFrame:
    """Extension: spans of a session without an idle gap, as session windows."""
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), "session_id").agg(F.count("*").alias("rows")).select("session_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("gap_end"), "rows")
