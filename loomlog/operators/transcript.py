"""Full transcripts and their exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import csv_escape
from .fold import visible
from .records import with_results

CSV_HEADER = "timestamp,role,type,text,model,inputTokens,outputTokens,cost"


def block_rows(records: DataFrame) -> DataFrame:
    """One row per content block of visible records."""
    rows = visible(records.filter("agent_id IS NULL"))
    return rows.select("session_id", "line_no", "kind", "ts_str", "model", "input_tokens", "output_tokens", F.explode("blocks").alias("b")).select("session_id", "line_no", "kind", "ts_str", "model", "input_tokens", "output_tokens", "b.*")


def csv_rows(records: DataFrame) -> DataFrame:
    """(session_id, line_no, pos, row): text, thinking and tool calls of users and assistants; cost stays empty."""
    b = block_rows(records).filter("kind IN ('user', 'assistant') AND type IN ('text', 'thinking', 'tool_use')")
    text = F.when(F.col("type") == "text", F.col("text")).when(F.col("type") == "thinking", F.col("thinking")).otherwise(F.concat_ws(": ", "name", F.coalesce("input", F.lit("{}"))))
    cells = [F.coalesce("ts_str", F.lit("")), F.col("kind"), F.col("type"), F.coalesce(text, F.lit("")), F.coalesce("model", F.lit("")), F.col("input_tokens").cast("string"), F.col("output_tokens").cast("string"), F.lit("")]
    return b.select("session_id", "line_no", "pos", F.concat_ws(",", *map(csv_escape, cells)).alias("row"))


def markdown(records: DataFrame, limit: int = 2000) -> DataFrame:
    """(session_id, document): compaction marks, texts, thinking, tool calls with results cut to ``limit`` characters, in line order."""
    b = with_results(block_rows(records)).filter("kind IN ('user', 'assistant')")  # results stand in carrier rows
    who = F.when(F.col("kind") == "user", "## User\n\n").otherwise("## Assistant\n\n")
    result = F.when(F.col("result").isNotNull(), F.concat(F.when(F.col("result_error"), "\n\nError:\n").otherwise("\n\nResult:\n"), F.substring("result", 1, limit))).otherwise("")
    part = (
        F.when(F.col("type") == "text", F.concat(who, "text"))
        .when(F.col("type") == "thinking", F.concat(F.lit("> "), F.replace("thinking", F.lit("\n"), F.lit("\n> "))))
        .when(F.col("type") == "tool_use", F.concat(F.lit("**"), "name", F.lit("** `"), F.coalesce("input", F.lit("{}")), F.lit("`"), result))
    )
    marks = visible(records.filter("agent_id IS NULL")).filter("kind = 'boundary'").select("session_id", "line_no", F.lit(0).alias("pos"), F.lit("--- compacted ---").alias("part"))
    parts = b.select("session_id", "line_no", "pos", part.alias("part")).filter("part IS NOT NULL").unionByName(marks)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "pos", "part"))), lambda x: x["part"]), "\n\n")
    return parts.groupBy("session_id").agg(F.concat(F.lit("# Session "), F.first("session_id"), F.lit("\n\n"), body, F.lit("\n")).alias("document"))


def json_documents(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, document): metadata and records as pretty JSON."""
    rows = visible(records.filter("agent_id IS NULL")).filter("kind IN ('user', 'assistant', 'boundary')")
    one = F.struct("line_no", "kind", "ts_str", "model", "text", "input_tokens", "output_tokens", "blocks")
    r = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["line_no"] < b["line_no"], -1).otherwise(1)).alias("records"))
    meta = F.struct("message_count", "cost", "input_tokens", "output_tokens", "first_ts", "last_ts")
    s = sessions.select("session_id", "project_id", "slug", meta.alias("metadata"))
    doc = F.to_json(F.struct(F.col("session_id").alias("id"), F.col("project_id").alias("projectId"), "slug", "metadata", "records"), {"pretty": "true"})
    return s.join(r, "session_id").select("session_id", doc.alias("document"))


def write_export(records: DataFrame, sessions: DataFrame, session_id: str, form: str, path: str) -> None:
    """One session's transcript as a folder of text files at ``path``: json, csv or md."""
    own, s = records.filter(F.col("session_id") == session_id), sessions.filter(F.col("session_id") == session_id)
    if form == "csv":
        head = records.sparkSession.createDataFrame([(-1, -1, CSV_HEADER)], "line_no long, pos int, row string")
        body = csv_rows(own).select("line_no", "pos", "row").unionByName(head).orderBy("line_no", "pos").select("row")
        body.coalesce(1).write.mode("overwrite").text(path)
    elif form in ("json", "md"):
        (json_documents(own, s) if form == "json" else markdown(own)).select("document").coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown export format {form!r}")


def full_metadata(records: DataFrame) -> DataFrame:
    """Counts and totals of the full view: the boundary rows don't stop, the raw cache-creation field is summed."""
    rows = visible(records.filter("agent_id IS NULL"))
    n = lambda k: F.count_if(F.col("kind") == k)
    a = F.col("kind") == "assistant"
    tot = lambda c: F.sum(F.when(a, F.col(c)).otherwise(0)).alias(c)
    return rows.groupBy("project_id", "session_id").agg(n("user").alias("user_messages"), n("assistant").alias("assistant_messages"), (n("user") + n("assistant")).alias("messages"), tot("input_tokens"), tot("output_tokens"), tot("cache_read"), tot("cache_creation_raw"), F.array_sort(F.collect_set(F.when(a, F.col("model")))).alias("models"), F.min_by("parent_uuid", F.when(F.col("parent_uuid").isNotNull(), F.col("line_no"))).alias("parent_session_id"))
