"""Session transcripts: append-only JSONL files as records.

Layout: ``<root>/projects/<project>/<session>.jsonl`` and ``<root>/projects/<project>/<session>/subagents/agent-<id>.jsonl``. Lines are read as text and
parsed leniently (blank and malformed lines go), since message content is a string in some lines and a list of blocks in
others. Line numbers, the only order that counts, are counted as a file is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .growing import all_lines

BLOCK = "array<struct<pos:int,type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"


def scan_lines(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, project_id, session_id, agent_id, line_no, value) of all transcript lines; child files named *compact* are left out."""
    return all_lines(spark, root)


def parse(lines: DataFrame) -> DataFrame:
    """``lines`` with v, the parsed line; lines that are blank or no JSON go."""
    return lines.withColumn("v", F.try_parse_json(F.trim(F.regexp_replace("value", "\r$", "")))).filter("v IS NOT NULL")


def _get(path: str, kind: str = "string", of: str = "v") -> Column:
    return F.try_variant_get(of, path, kind)


def blocks(v: str = "v") -> Column:
    """Content blocks: a string is one text block, missing content none."""
    content = F.try_variant_get(v, "$.message.content", "variant")
    kind = F.coalesce(F.schema_of_variant(content), F.lit("VOID"))
    g = lambda b, p, t="string": F.try_variant_get(b, p, t)

    def block(b: Column, i: Column) -> Column:
        inner = g(b, "$.content", "variant")
        chunks = F.try_variant_get(inner, "$", "array<variant>")
        text = F.when(F.coalesce(F.schema_of_variant(inner), F.lit("VOID")).startswith("ARRAY"), F.array_join(F.transform(chunks, lambda c: F.coalesce(g(c, "$.text"), F.lit(""))), "\n")).otherwise(g(b, "$.content"))
        return F.struct(i.cast("int").alias("pos"), g(b, "$.type").alias("type"), g(b, "$.text").alias("text"), g(b, "$.thinking").alias("thinking"), g(b, "$.id").alias("id"), g(b, "$.name").alias("name"), F.to_json(g(b, "$.input", "variant")).alias("input"), g(b, "$.tool_use_id").alias("tool_use_id"), text.alias("content"), g(b, "$.is_error", "boolean").alias("is_error"))

    array = F.transform(F.try_variant_get(content, "$", "array<variant>"), block)
    single = F.array(F.struct(F.lit(0).alias("pos"), F.lit("text").alias("type"), F.try_variant_get(content, "$", "string").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("thinking", "id", "name", "input", "tool_use_id", "content")], F.lit(None).cast("boolean").alias("is_error")))
    return F.when(kind.startswith("ARRAY"), array).when(kind == "STRING", single).otherwise(F.array()).cast(BLOCK)


def records(parsed: DataFrame) -> DataFrame:
    """The records of the session fold, with their blocks."""
    b = parsed.withColumn("blocks", blocks())
    n = lambda path: F.coalesce(_get(path, "bigint"), F.lit(0))
    true = lambda path: F.coalesce(_get(path, "boolean"), F.lit(False))
    kind_of, model = _get("$.type"), _get("$.message.model")
    carrier = (F.size("blocks") > 0) & F.forall("blocks", lambda x: F.coalesce(x["type"] == "tool_result", F.lit(False)))
    hidden = true("$.isCompactSummary") | true("$.isVisibleInTranscriptOnly") | F.coalesce(kind_of == "progress", F.lit(False))
    # A child transcript hides nothing and has no boundaries.
    parent = F.col("agent_id").isNull()
    kind = (
        F.when(parent & hidden, "skip")
        .when(parent & (_get("$.subtype") == "compact_boundary"), "boundary")
        .when((kind_of == "user") & carrier, "carrier")
        .when(kind_of == "user", "user")
        .when((kind_of == "assistant") & (model == "<synthetic>"), "synthetic")
        .when(kind_of == "assistant", "assistant")
        .otherwise("other")
    )
    of = lambda t: F.filter("blocks", lambda x: x["type"] == t)
    text = F.array_join(F.transform(F.filter(of("text"), lambda x: x["text"].isNotNull()), lambda x: x["text"]), " ")
    usage = "$.message.usage"
    return b.select(
        "project_id", "session_id", "agent_id", "line_no", kind.alias("kind"), kind_of.alias("type"), _get("$.uuid").alias("uuid"), _get("$.parentUuid").alias("parent_uuid"), _get("$.timestamp").alias("ts_str"),
        F.try_to_timestamp(_get("$.timestamp")).alias("ts"), _get("$.cwd").alias("cwd"), _get("$.slug").alias("slug"), model.alias("model"), _get("$.message.stop_reason").alias("stop_reason"), text.alias("text"),
        n(f"{usage}.input_tokens").alias("input_tokens"), n(f"{usage}.output_tokens").alias("output_tokens"), n(f"{usage}.cache_read_input_tokens").alias("cache_read"), n(f"{usage}.cache_creation_input_tokens").alias("cache_creation_raw"),
        n(f"{usage}.cache_creation.ephemeral_5m_input_tokens").alias("cache_5m"), n(f"{usage}.cache_creation.ephemeral_1h_input_tokens").alias("cache_1h"),
        F.aggregate(of("thinking"), F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(F.octet_length(F.encode(x["thinking"], "UTF-16BE")) / 2, F.lit(0)).cast("long")).alias("thinking_chars"),
        F.transform(of("tool_use"), lambda x: F.coalesce(x["name"], F.lit(""))).alias("tool_names"), F.exists("blocks", lambda x: (x["type"] == "tool_result") & F.coalesce(x["is_error"], F.lit(False))).alias("tool_error"),
        _get("$.compactMetadata.preTokens", "bigint").alias("pre_tokens"), "blocks",
    )


def read_records(spark: SparkSession, root: str) -> DataFrame:
    return records(parse(scan_lines(spark, root)))


def projects(sessions: DataFrame) -> DataFrame:
    """Projects with a session that has a last timestamp: id, path, name, session count; the latest first."""
    from ..functions.scalars import last_segment

    live = sessions.filter("last_ts IS NOT NULL")
    p = live.groupBy("project_id").agg(F.count("*").alias("session_count"), F.max("last_ts").alias("last_ts"), F.min_by("project_path", F.col("first_ts")).alias("path"))
    return p.select(F.col("project_id").alias("id"), last_segment(F.col("path")).alias("name"), "path", "session_count", "last_ts").orderBy(F.desc("last_ts"), "id")


def project_cwds(records: DataFrame) -> DataFrame:
    """(project_id, cwd): the first working directory that a project's files name, in order of file and line."""
    named = records.filter("agent_id IS NULL AND cwd <> ''")
    return named.groupBy("project_id").agg(F.min_by("cwd", F.struct("session_id", "line_no")).alias("cwd"))


def head_cwds(heads: DataFrame) -> DataFrame:
    """(project_id, cwd): as :func:`project_cwds`, from the first bytes of files (:func:`loomlog.sources.growing.heads`) alone."""
    cwd = F.try_variant_get("v", "$.cwd", "variant")
    text = F.when(F.schema_of_variant(cwd) == "STRING", F.try_variant_get("v", "$.cwd", "string"))
    named = parse(heads).select("project_id", "session_id", "line_no", text.alias("cwd")).filter("cwd <> ''")
    return named.groupBy("project_id").agg(F.min_by("cwd", F.struct("session_id", "line_no")).alias("cwd"))


def project_details(sessions: DataFrame, cwds: DataFrame) -> DataFrame:
    """id, path, name and has_cwd of each project: its working directory, else a session's path that isn't the decoded id, else that."""
    from ..functions.scalars import decode_project_id, last_segment

    decoded = decode_project_id(F.col("project_id"))
    other = F.when(F.col("project_path") != decoded, F.struct(F.col("first_ts"), F.col("session_id"), F.col("project_path").alias("p")))
    p = sessions.groupBy("project_id").agg(F.min(other).alias("o")).join(cwds, "project_id", "left")
    path = F.coalesce("cwd", "o.p", decoded)
    return p.select(F.col("project_id").alias("id"), path.alias("path"), last_segment(path).alias("name"), F.col("cwd").isNotNull().alias("has_cwd"))
