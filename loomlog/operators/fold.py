"""The session fold: what a pass over a transcript in line order yields, as window functions.

Line order is the only order that counts; clocks may run backwards. All running values of a session use one window
(session, line), so that Spark sorts each session once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.scalars import EFFORTS, ERROR_SNIPPET, IDLE_GAP_MS, MAX_TURN_MS, WORKTREE_TOOLS, decode_project_id, effort, error_class

POOLS = ("input_tokens", "output_tokens", "cache_read", "cache_5m", "cache_1h")


def visible(records: DataFrame) -> DataFrame:
    """Rows of the fold: hidden ones go first, then later lines that repeat a uuid of their session."""
    # A row without a uuid is a group of its own: it is compared with nothing.
    same = F.coalesce(F.nullif("uuid", F.lit("")), F.concat(F.lit("\0"), F.col("line_no").cast("string")))
    again = F.row_number().over(W.partitionBy("project_id", "session_id", "__same").orderBy("line_no"))
    return records.filter("kind <> 'skip'").withColumn("__same", same).withColumn("__n", again).filter("__n = 1").drop("__n", "__same")


def running(rows: DataFrame) -> DataFrame:
    """Compaction epoch, turn counts, idle gap and turn duration of every row."""
    line = W.partitionBy("project_id", "session_id").orderBy("line_no")
    upto, before = line.rowsBetween(W.unboundedPreceding, 0), line.rowsBetween(W.unboundedPreceding, -1)
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(upto)
    user, boundary = F.col("kind") == "user", F.col("kind") == "boundary"
    anchor = user | (F.col("kind") == "assistant") | ((F.col("kind") == "carrier") & F.col("ts").isNotNull())
    rows = (
        rows.withColumn("epoch", flag(boundary))
        .withColumn("turn_index", flag(user))
        .withColumn("prev_ts", F.last("ts", ignorenulls=True).over(before))
        # An anchor without a timestamp clears the one before it: hence a struct, which is not null.
        .withColumn("anchor", F.last(F.when(anchor, F.struct("ts")), ignorenulls=True).over(before))
    )
    inside = W.partitionBy("project_id", "session_id", "epoch").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    ms = F.unix_millis("ts") - F.unix_millis("anchor.ts")
    duration = F.when((F.col("kind") == "assistant") & (ms > 0) & (ms <= MAX_TURN_MS), ms)
    return (
        rows.withColumn("turns_since", F.sum(F.when(user, 1).otherwise(0)).over(inside))
        .withColumn("gap_ms", F.when(F.col("ts").isNotNull(), F.unix_millis("ts") - F.unix_millis("prev_ts")))
        .withColumn("duration_ms", duration)
        .withColumn("is_post_compaction", (F.col("epoch") > 0) & (F.col("turns_since") <= 2))
    )


@dataclass
class Fold:
    """Frames of the fold, built when first asked for."""

    records: DataFrame
    prices: DataFrame

    @cached_property
    def rows(self) -> DataFrame:
        return running(visible(self.records.filter("agent_id IS NULL")))

    @cached_property
    def assistants(self) -> DataFrame:
        a = self.rows.filter("kind = 'assistant'").withColumn("effort", effort(F.col("output_tokens"), F.col("thinking_chars"), F.col("stop_reason")))
        return a.withColumn("error", error_class(F.col("text"), F.col("stop_reason"))).withColumn("tool_count", F.coalesce(F.size("tool_names"), F.lit(0)))

    @cached_property
    def turns(self) -> DataFrame:
        return self.rows.filter("duration_ms IS NOT NULL").select("project_id", "session_id", "line_no", "turn_index", F.col("anchor.ts").alias("prev_ts"), "ts", "duration_ms", "is_post_compaction", "input_tokens", "model")

    @cached_property
    def compactions(self) -> DataFrame:
        line = W.partitionBy("project_id", "session_id").orderBy("line_no")
        user = F.sum(F.when(F.col("kind") == "user", 1).otherwise(0)).over(line.rowsBetween(W.unboundedPreceding, 0))
        b = self.rows.withColumn("users", user).filter("kind = 'boundary'")
        return b.select("project_id", "session_id", (F.col("epoch") - 1).alias("idx"), "ts", "pre_tokens", (F.col("users") - F.coalesce(F.lag("users").over(line), F.lit(0))).alias("turns_since_last"))

    @cached_property
    def parallel_groups(self) -> DataFrame:
        return self.assistants.filter("tool_count > 1").select("project_id", "session_id", "line_no", "turn_index", "ts", "tool_names", "tool_count")

    @cached_property
    def errors(self) -> DataFrame:
        told = self.assistants.filter("error IS NOT NULL").select("project_id", "session_id", "line_no", F.lit(0).alias("ord"), F.col("error").alias("classification"), "turn_index", "ts", F.substring("text", 1, ERROR_SNIPPET).alias("message"))
        tool = self.assistants.filter("tool_error").select("project_id", "session_id", "line_no", F.lit(1).alias("ord"), F.lit("toolError").alias("classification"), "turn_index", "ts", F.lit("Tool result contained an error").alias("message"))
        return told.unionByName(tool)

    def _priced(self, sums: DataFrame) -> DataFrame:
        rated = pricing.with_rates(sums.withColumn("family", pricing.model_family(F.col("model"))), self.prices)
        return rated.withColumn("cost", pricing.cost(*map(F.col, POOLS))).drop(*pricing.RATE_COLUMNS)

    @cached_property
    def session_models(self) -> DataFrame:
        """Parent tokens and cost by model; turns without a model don't count."""
        named = self.rows.filter("kind = 'assistant' AND coalesce(model, '') <> ''")
        sums = named.groupBy("project_id", "session_id", "model").agg(F.min("line_no").alias("first_line"), *[F.sum(c).alias(c) for c in POOLS], F.count("*").alias("turn_count"))
        return self._priced(sums)

    @cached_property
    def subagent_models(self) -> DataFrame:
        """Child tokens and cost by agent and model; a null model stands for turns without one, which do count. No rows are skipped or deduplicated but hidden kinds."""
        named = self.records.filter("agent_id IS NOT NULL AND kind = 'assistant'").withColumn("model", F.nullif(F.col("model"), F.lit("")))
        sums = named.groupBy("project_id", "session_id", "agent_id", "model").agg(F.max("line_no").alias("last_line"), *[F.sum(c).alias(c) for c in POOLS], F.count("*").alias("turn_count"))
        return self._priced(sums)

    @cached_property
    def subagents(self) -> DataFrame:
        keys = ["project_id", "session_id", "agent_id"]
        child = self.records.filter("agent_id IS NOT NULL")
        stamped = F.when(F.col("ts").isNotNull(), F.col("line_no"))
        base = child.groupBy(*keys).agg(F.sum(F.when(F.col("kind").isin("user", "assistant"), 1).otherwise(0)).alias("message_count"), F.min_by("ts", stamped).alias("first_ts"), F.max_by("ts", stamped).alias("last_ts"))
        # Of models that tie, the one that reached the count first: its last turn is the earliest.
        best = F.max_by("model", F.when(F.col("model").isNotNull(), F.struct("turn_count", -F.col("last_line"))))
        sums = self.subagent_models.groupBy(*keys).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), *[F.sum(F.when(F.col("model").isNotNull(), F.col(c))).alias(c) for c in ("cache_5m", "cache_1h")], best.alias("primary_model"))
        zero = {"input_tokens": 0, "output_tokens": 0, "cost": 0.0, "cache_5m": 0, "cache_1h": 0}
        return base.filter("message_count > 0").join(sums, keys, "left").fillna(zero)

    @cached_property
    def rolled_models(self) -> DataFrame:
        """Tokens, cost and turns by session and model, children included."""
        parent = self.session_models.select("project_id", "session_id", "model", "family", "first_line", *POOLS, "cost", "turn_count")
        child = self.subagent_models.filter("model IS NOT NULL").select("project_id", "session_id", "model", "family", F.lit(None).cast("long").alias("first_line"), *POOLS, "cost", "turn_count")
        named = parent.unionByName(child.join(self._sessions_base.select("project_id", "session_id"), ["project_id", "session_id"], "left_semi"))
        return named.groupBy("project_id", "session_id", "model", "family").agg(*[F.sum(c).alias(c) for c in (*POOLS, "cost", "turn_count")], F.min("first_line").alias("first_line"))

    @cached_property
    def _sessions_base(self) -> DataFrame:
        a = F.col("kind") == "assistant"
        level = effort(F.col("output_tokens"), F.col("thinking_chars"), F.col("stop_reason"))
        tools = F.when(a, F.coalesce(F.size("tool_names"), F.lit(0))).otherwise(0)
        stamped = F.when(F.col("ts").isNotNull(), F.col("line_no"))
        first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("line_no")))
        durations = F.array_sort(F.collect_list("duration_ms"))  # one session's turns
        error = F.coalesce(error_class(F.col("text"), F.col("stop_reason")), F.when(F.coalesce("tool_error", F.lit(False)), "toolError"))
        base = self.rows.groupBy("project_id", "session_id").agg(
            first("slug").alias("slug"), first("cwd").alias("cwd"), F.min_by("ts", stamped).alias("first_ts"), F.max_by("ts", stamped).alias("last_ts"),
            F.sum(F.when(F.col("kind").isin("user", "assistant"), 1).otherwise(0)).alias("parent_messages"), F.sum(F.when(F.col("kind") == "user", 1).otherwise(0)).alias("user_messages"),
            F.sum(F.when(F.col("kind") == "boundary", 1).otherwise(0)).alias("compactions"), F.sum(F.when(F.col("kind") == "boundary", F.coalesce("pre_tokens", F.lit(0))).otherwise(0)).alias("removed_tokens"),
            F.coalesce(F.bool_or(F.col("gap_ms") > IDLE_GAP_MS), F.lit(False)).alias("has_idle_gap"), durations.alias("durations"), F.max("duration_ms").alias("max_turn_ms"),
            *[F.sum(F.when(a & (level == x), 1).otherwise(0)).alias(f"effort_{x}") for x in EFFORTS],
            F.sum(tools).alias("tool_calls"), F.sum(F.when(tools > 1, 1).otherwise(0)).alias("parallel_groups"), F.max(F.when(tools > 1, tools).otherwise(0)).alias("max_degree"),
            F.bool_or(a & error.isNotNull()).alias("has_error"), F.min_by(error, F.when(a & error.isNotNull(), F.col("line_no"))).alias("first_error"),
            F.bool_or(a & F.coalesce(F.arrays_overlap("tool_names", F.array(*map(F.lit, WORKTREE_TOOLS))), F.lit(False))).alias("is_worktree"),
        )
        upper = F.try_element_at("durations", (F.floor(F.size("durations") / 2) + 1).cast("int"))
        top = F.greatest(*[F.col(f"effort_{x}") for x in EFFORTS])
        dominant = F.coalesce(*[F.when(F.col(f"effort_{x}") == top, x) for x in EFFORTS])
        return base.withColumn("median_turn_ms", upper).withColumn("dominant_effort", dominant).drop("durations")

    @cached_property
    def sessions(self) -> DataFrame:
        """One row per session. Children add tokens in and out, cache writes, cost and messages, but not cache reads."""
        keys = ["project_id", "session_id"]
        own = self.session_models.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*POOLS, "cost")], F.max_by("model", F.struct("turn_count", -F.col("first_line"))).alias("primary_model"))
        child = self.subagents.groupBy(*keys).agg(F.sum("input_tokens").alias("s_in"), F.sum("output_tokens").alias("s_out"), F.sum("cost").alias("subagent_cost"), F.sum("message_count").alias("s_msgs"), F.sum("cache_5m").alias("s_5m"), F.sum("cache_1h").alias("s_1h"), F.count("*").alias("n_subagents"))
        s = self._sessions_base.join(own, keys, "left").join(child, keys, "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        plus = lambda a, b: (zero(a) + zero(b)).alias(a)
        kept = [c for c in self._sessions_base.columns if c not in ("slug", "cwd")]
        return s.select(
            *kept, "slug", F.coalesce("slug", "session_id").alias("title"), F.coalesce("cwd", decode_project_id(F.col("project_id"))).alias("project_path"), "primary_model",
            plus("input_tokens", "s_in"), plus("output_tokens", "s_out"), zero("cache_read").alias("cache_read"), plus("cache_5m", "s_5m"), plus("cache_1h", "s_1h"),
            (zero("cache_5m") + zero("cache_1h") + zero("s_5m") + zero("s_1h")).alias("cache_creation"), (zero("cost") + zero("subagent_cost")).alias("cost"), zero("subagent_cost").alias("subagent_cost"),
            (F.col("parent_messages") + zero("s_msgs")).alias("message_count"), zero("n_subagents").alias("n_subagents"), F.when(F.col("parallel_groups") > 0, F.array(F.lit("parallel-threads"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        )
