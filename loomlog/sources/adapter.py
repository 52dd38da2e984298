"""Transcript records from the ``events`` table, with the columns of :mod:`loomlog.sources.transcripts`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four projects, a session for each project and day; every 13th event belongs to one of two child agents."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    i = F.col("event_id")
    project = F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))
    kind = (
        F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "click", "carrier").when(F.col("event_type").isin("purchase", "error"), "assistant").when((F.col("event_type") == "signup") & (i % 7 == 0), "boundary").otherwise("skip")
    )
    model = F.when(i % 6 == 0, "x-opus-4-6-20250313").when(i % 6 == 1, "x-sonnet-4-5").when(i % 6 == 2, "x-haiku-4-5").when(i % 6 == 3, "x-opus-4-1").when(i % 6 == 4, "x-mystery")
    error = F.col("event_type") == "error"
    r = e.withColumn("project_id", project).withColumn("session_id", F.concat(project, F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))).withColumn("kind", kind)
    assistant = F.col("kind") == "assistant"
    tools = F.when(assistant, F.transform(F.sequence(F.lit(1), F.col("k") % 4 + 1), lambda j: F.concat(F.lit("tool"), j.cast("string"))))
    r = r.select(
        "project_id", "session_id", F.when(i % 13 == 0, F.concat(F.lit("a"), (i % 2).cast("string"))).alias("agent_id"), "event_id", "ts", "kind",
        i.cast("string").alias("uuid"), F.lit(None).cast("string").alias("slug"), F.lit(None).cast("string").alias("cwd"), F.when(assistant, model).alias("model"),
        F.when(error & (i % 4 == 3), "max_tokens").alias("stop_reason"),
        F.when(error & (i % 4 == 0), "429 rate limit").when(error & (i % 4 == 1), "unauthorized").when(error & (i % 4 == 2), "bad gateway").otherwise("").alias("text"),
        F.floor(F.col("value") * 1000).cast("long").alias("input_tokens"), F.floor(F.col("value") * 20).cast("long").alias("output_tokens"),
        F.when(i % 3 == 0, F.col("k") * 60000).otherwise(0).alias("cache_read"), F.when(i % 3 == 0, F.col("k") * 100).otherwise(0).alias("cache_5m"), F.when(i % 3 == 0, F.col("k") * 50).otherwise(0).alias("cache_1h"),
        F.when(i % 11 == 0, F.floor(F.col("value") * 20)).otherwise(0).cast("long").alias("thinking_chars"),
        F.when(assistant, F.slice(tools, F.lit(1), (F.col("k") % 4).cast("int"))).alias("tool_names"), F.lit(False).alias("tool_error"),
        F.when(F.col("kind") == "boundary", F.floor(F.col("value") * 300).cast("long")).alias("pre_tokens"),
    )
    order = W.partitionBy("project_id", "session_id", "agent_id").orderBy("ts", "event_id")
    # Dealt by session once; the windows, sums and joins of the fold keep to it.
    return r.repartition("project_id", "session_id").withColumn("line_no", F.row_number().over(order).cast("long")).drop("event_id")
