"""Reports derived from the catalogue: insights, what-if, timeline, live statistics and turn metrics."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.scalars import date_key, effort, safe_div
from ..operators.intervals import contained
from . import reports as R

r6 = R.r6


def insights(s: DataFrame, models: DataFrame, turns: DataFrame, prices: DataFrame) -> DataFrame:
    """(id, level, value) of the threshold rules that hold, from one row of aggregates."""
    t, cache, lat, comp = R.totals(s), R.cache_totals(s, prices).select("hit_ratio"), R.latency_percentiles(turns).select("p95"), R.compaction_summary(s, prices).select("compactions", "cost_avoided")
    post, eff = R.post_vs_normal(turns).select("post_avg_ms", "normal_avg_ms"), R.effort_distribution(s)
    project = R.project_costs(s).agg(F.max("cost").alias("top_project"))
    model = R.model_efficiency(models).agg(F.max("pct_of_cost").alias("top_model_pct"))
    one = t
    for other in (cache, lat, comp, post, eff, project, model):  # one row each
        one = one.crossJoin(F.broadcast(other))
    pct = lambda x: F.floor(x * 100 + 0.5)
    turns_n = sum((F.col(c) for c in R.LEVELS), F.lit(0))
    c = F.col
    ratio = safe_div(c("post_avg_ms"), c("normal_avg_ms"))
    both = (c("post_avg_ms") > 0) & (c("normal_avg_ms") > 0)
    per = safe_div(c("compactions"), c("sessions"))
    share, ultra, avg = pct(safe_div(c("top_project"), c("cost"))), pct(safe_div(c("effort_ultrathink"), turns_n)), safe_div(c("cost"), c("sessions"))
    hit = pct(c("hit_ratio"))
    rules = [
        ("cache-good", "positive", hit >= 60, hit),
        ("cache-low", "warning", (hit < 30) & (c("tokens") > 0), hit),
        ("cost-concentration", "warning", share >= 60, share),
        ("latency-high", "warning", c("p95") > 30_000, c("p95")),
        ("ultrathink-high", "info", ultra >= 25, ultra),
        ("no-sessions", "info", c("sessions") == 0, c("sessions")),
        ("high-session-cost", "warning", avg > 1.0, avg),
        ("model-dominance", "info", c("top_model_pct") > 70, c("top_model_pct")),
        ("compaction-frequent", "warning", per >= 1, per),
        ("compaction-present", "info", (per < 1) & (c("compactions") > 0), c("compactions")),
        ("compaction-latency-spike", "warning", both & (ratio >= 1.5), ratio),
        ("compaction-latency-mild", "info", both & (ratio >= 1.2) & (ratio < 1.5), ratio),
        ("compaction-savings", "positive", c("cost_avoided") > 0.5, c("cost_avoided")),
    ]
    made = [F.when(cond, F.struct(F.lit(i).alias("id"), F.lit(level).alias("level"), r6(value.cast("double")).alias("value"))) for i, level, cond, value in rules]
    return one.select(F.explode(F.array_compact(F.array(*made))).alias("i")).select("i.*")


def what_if(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Each used family's cost, if the work had gone to each other family: scaled by input plus output rates."""
    used = R.model_efficiency(models).filter("cost > 0 AND turns > 0 AND family <> 'unknown'").select("family", "cost")
    rate = lambda p: prices.filter("family <> 'unknown'").select(F.col("family").alias(p), (F.col("rate_input") + F.col("rate_output")).alias(f"{p}_rate"))
    # Families times families: at most 17 x 17 rows.
    both = used.join(F.broadcast(rate("source")), F.col("family") == F.col("source")).crossJoin(F.broadcast(rate("target")))
    projected = F.col("cost") * F.col("target_rate") / F.col("source_rate")
    return both.filter("source <> target").select("source", "target", r6("cost").alias("cost"), r6(projected).alias("projected"), r6(projected - F.col("cost")).alias("delta"), r6((projected - F.col("cost")) / F.col("cost") * 100).alias("delta_pct"))


def project_breakdown(s: DataFrame) -> DataFrame:
    p = R.project_costs(s)
    everything = W.partitionBy(F.lit(1))
    return p.select("project_id", "cost", r6(safe_div(F.col("cost"), F.sum("cost").over(everything)) * 100).alias("cost_share"), r6(F.least(F.lit(100.0), safe_div(F.col("tokens"), F.sum("tokens").over(everything)) * 100)).alias("token_share"))


def timeline_blocks(s: DataFrame, day: str) -> DataFrame:
    """Sessions that start or end on a (UTC) day, as minutes of it, five at least."""
    base = F.to_timestamp(F.lit(day))
    minute = lambda c: (F.unix_millis(c) - F.unix_millis(base)) / 60_000
    start = F.greatest(F.lit(0.0), minute(F.col("first_ts")))
    end = F.least(F.lit(1440.0), minute(F.col("last_ts")))
    on = s.filter((date_key(F.col("first_ts")) == day) | (date_key(F.col("last_ts")) == day))
    return on.select("session_id", "project_id", r6(start).alias("start_min"), r6(F.greatest(F.lit(5.0), end - start)).alias("minutes"))


def timeline_days(s: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    first = (now - timedelta(days=days - 1)).date()
    wanted = s.sparkSession.range(days).select(F.date_format(F.date_add(F.lit(first), F.col("id").cast("int")), "yyyy-MM-dd").alias("day"))
    active = s.select(F.explode(F.array(date_key(F.col("first_ts")), date_key(F.col("last_ts")))).alias("d")).distinct()
    return wanted.join(active, F.col("day") == F.col("d"), "left").select("day", F.col("d").isNotNull().alias("active"))


def active_and_recent(s: DataFrame, now: datetime, window_s: int = 60, recent: int = 3) -> DataFrame:
    """Sessions updated within the window, and the next ``recent`` ones."""
    age = F.unix_millis(F.lit(now)) - F.unix_millis("last_ts")
    live = s.withColumn("state", F.when(age < window_s * 1000, "active").otherwise("recent")).select("session_id", "state", "last_ts")
    order = [F.desc("last_ts"), F.asc("session_id")]
    return live.filter("state = 'active'").unionByName(live.filter("state = 'recent'").orderBy(*order).limit(recent)).select("session_id", "state")


def turn_metrics(fold) -> DataFrame:
    """Per turn: effort, tools, the children that ran inside it and the time left for the model."""
    keys = ["project_id", "session_id"]
    a = fold.assistants.filter("duration_ms IS NOT NULL").select(*keys, "line_no", "effort", "tool_count", "duration_ms", F.col("anchor.ts").alias("start"), "ts")
    inside = subagents_in_turns(a, fold.subagents, F.unix_millis("start"))
    spent = inside.groupBy(*keys, "line_no").agg(F.count("agent_id").alias("agents"), F.sum(F.unix_millis("last_ts") - F.unix_millis("first_ts")).alias("agent_ms"))
    j = a.join(spent, [*keys, "line_no"], "left").fillna(0, ["agents", "agent_ms"])
    return j.select(*keys, "line_no", "effort", "tool_count", "duration_ms", "agents", "agent_ms", F.greatest(F.lit(0), F.col("duration_ms") - F.col("agent_ms")).alias("model_ms"))


def subagents_in_turns(turns: DataFrame, subagents: DataFrame, start) -> DataFrame:
    """``turns`` (with ts and duration_ms) with the children (agent_id, first_ts, last_ts) of their session that ran inside: not before ``start``, and
    not beyond the turn's time and its duration."""
    keys = ["project_id", "session_id"]
    children = subagents.select(*keys, "agent_id", "first_ts", "last_ts")
    return contained(turns, children, keys, (start, F.unix_millis("ts") + F.col("duration_ms")), (F.unix_millis("first_ts"), F.unix_millis("last_ts")))


def percentile_bars(turns: DataFrame) -> DataFrame:
    one = R.latency_percentiles(turns).crossJoin(F.broadcast(R.post_vs_normal(turns)))
    bars = [("p50", "p50"), ("avg", "avg_ms"), ("p95", "p95"), ("post", "post_avg_ms"), ("p99", "p99")]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("bar"), F.col(c).cast("double").alias("value")) for n, c in bars])).alias("b")).select("b.*").filter("value > 0")


def model_share(models: DataFrame) -> DataFrame:
    m = R.model_usage(models)
    return m.select("family", "turns", r6(F.col("turns") / F.sum("turns").over(W.partitionBy(F.lit(1)))).alias("share"))


def model_champions(models: DataFrame, least_turns: int = 5) -> DataFrame:
    """The family with most turns and its share, and the cheapest per turn with enough turns."""
    e = R.model_efficiency(models)
    enough = F.when(F.col("turns") >= least_turns, F.struct("cost_per_turn", "family"))
    return e.agg(F.max_by("family", F.struct("turns", "family")).alias("dominant"), r6(F.max("turns") / F.sum("turns")).alias("dominant_share"), F.min(enough)["family"].alias("most_efficient"))


def overview_averages(s: DataFrame) -> DataFrame:
    t = R.totals(s)
    return t.select(r6(safe_div(F.col("cost"), F.col("sessions"))).alias("avg_cost"), r6(safe_div(F.col("tokens"), F.col("sessions"))).alias("avg_tokens"), F.floor(safe_div(F.col("messages"), F.col("sessions")) + 0.5).cast("long").alias("avg_messages"))


def today_stats(s: DataFrame, now: datetime) -> DataFrame:
    day = now.strftime("%Y-%m-%d")
    today = R.dated(s).filter(F.col("day") == day)
    return today.agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), r6(F.sum("cost")).alias("cost"), F.countDistinct("project_id").alias("projects"))


def weekly_usage(s: DataFrame, rows: int = 7) -> DataFrame:
    return R.daily_usage(s).orderBy(F.desc("day")).limit(rows).select("day", "cost", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


def day_delta(s: DataFrame) -> DataFrame:
    """Change of each day's cost against the previous day that has sessions; from zero it is 100 %."""
    d = R.daily_usage(s).select("day", "cost")  # a row per day
    p = F.lag("cost").over(W.orderBy("day"))
    return d.withColumn("p", p).filter("p IS NOT NULL").select("day", r6(F.when(F.col("p") > 0, (F.col("cost") - F.col("p")) / F.col("p") * 100).when(F.col("cost") > 0, 100.0).otherwise(0.0)).alias("delta_pct"))


def session_details(s: DataFrame, prices: DataFrame) -> DataFrame:
    rated = pricing.with_rates(s.withColumn("family", pricing.model_family(F.col("primary_model"))), prices)
    return rated.select("session_id", (F.unix_millis("last_ts") - F.unix_millis("first_ts")).alias("duration_ms"), "removed_tokens", r6(F.col("removed_tokens") / 1e6 * F.col("rate_input")).alias("cost_avoided"), r6(F.col("cost") - F.col("subagent_cost")).alias("own_cost"))


def tool_analytics(fold) -> DataFrame:
    """Calls by tool."""
    return fold.assistants.select(F.explode("tool_names").alias("tool")).groupBy("tool").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool")


def effort_of(df: DataFrame) -> DataFrame:
    return df.withColumn("effort", effort(F.col("output_tokens"), F.col("thinking_chars"), F.col("stop_reason")))
