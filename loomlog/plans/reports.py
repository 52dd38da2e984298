"""The report catalogue over folded sessions: usage, cache, latency, effort, parallel tools and health.

Every report takes frames (usually ``sessions`` or ``rolled_models``) and explicit parameters and returns a frame. Days are those of the
session's last timestamp, in the session time zone. Ties in ranked lists go to the smaller session id.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.scalars import EFFORTS, date_key, safe_div
from ..operators.fold import POOLS, Fold

r6 = lambda c: F.round(c, 6)
LEVELS = [f"effort_{x}" for x in EFFORTS]


def in_range(sessions: DataFrame, start: datetime | None = None, end: datetime | None = None, projects: list[str] | None = None) -> DataFrame:
    """Sessions whose last timestamp lies in the range, both ends included, of the listed projects (none listed: all)."""
    out = sessions.filter("last_ts IS NOT NULL")
    if start is not None:
        out = out.filter(F.col("last_ts") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("last_ts") <= F.lit(end))
    return out.filter(F.col("project_id").isin(projects)) if projects else out


def dated(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("day", date_key(F.col("last_ts")))


def totals(s: DataFrame) -> DataFrame:
    return s.agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum(F.col("cache_read") + F.col("cache_creation")).alias("cache_tokens"), r6(F.sum("cost")).alias("cost"))


def daily_usage(s: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_creation", "cache_5m", "cache_1h")]
    return dated(s).groupBy("day").agg(*sums, F.count("*").alias("sessions"), F.sum("message_count").alias("messages"), r6(F.sum("cost")).alias("cost")).orderBy("day")


def project_costs(s: DataFrame, names: DataFrame | None = None) -> DataFrame:
    out = s.groupBy("project_id").agg(r6(F.sum("cost")).alias("cost"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count("*").alias("sessions"), F.sum("message_count").alias("messages"))
    if names is None:
        return out.withColumn("project_name", F.col("project_id")).orderBy(F.desc("cost"), "project_id")
    named = out.join(names.select(F.col("id").alias("project_id"), F.col("name").alias("__name")), "project_id", "left")
    return named.withColumn("project_name", F.coalesce("__name", "project_id")).drop("__name").orderBy(F.desc("cost"), "project_id")


def model_usage(models: DataFrame) -> DataFrame:
    """By family; the unknown family is left out here, and only here."""
    return models.filter("family <> 'unknown'").groupBy("family").agg(F.sum("turn_count").alias("turns"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")).orderBy(F.desc("turns"), "family")


def cache_totals(s: DataFrame, prices: DataFrame, proxy: str = "sonnet-4-6") -> DataFrame:
    """Hit and reuse ratios, and savings at the proxy family's rates."""
    t = s.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "cache_read", "cache_creation", "cache_5m", "cache_1h")], F.coalesce(F.sum("cost"), F.lit(0.0)).alias("actual"))
    rate = prices.filter(F.col("family") == proxy).select((F.col("rate_input") - F.col("rate_read")).alias("saved_rate"))
    saved = F.col("cache_read") / 1e6 * F.col("saved_rate")
    hit, reuse = safe_div(F.col("cache_read"), F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation")), safe_div(F.col("cache_read"), F.col("cache_creation"))
    return t.crossJoin(F.broadcast(rate)).select(r6(hit).alias("hit_ratio"), r6(reuse).alias("reuse_ratio"), "cache_5m", "cache_1h", r6(saved).alias("savings"), r6(F.col("actual") + saved).alias("hypothetical_cost"), F.when(F.col("actual") + saved > 0, F.floor(saved / (F.col("actual") + saved) * 100 + 0.5)).otherwise(0).cast("long").alias("savings_pct"))


def daily_hit_ratio(s: DataFrame) -> DataFrame:
    d = dated(s).groupBy("day").agg(F.sum("cache_read").alias("r"), F.sum(F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation")).alias("d"))
    return d.filter("d > 0").select("day", r6(F.col("r") / F.col("d")).alias("hit_ratio")).orderBy("day")


def cache_busting_days(s: DataFrame, low: float = 0.1, high: float = 0.3) -> DataFrame:
    """Days below ``low`` right after a day (the previous one that has sessions) above ``high``. One row per day is windowed."""
    d = daily_hit_ratio(s).withColumn("previous_ratio", F.lag("hit_ratio").over(W.orderBy("day")))
    return d.filter((F.col("hit_ratio") < low) & (F.col("previous_ratio") > high)).orderBy("day")


def session_cache_efficiency(s: DataFrame, prices: DataFrame, top: int = 20) -> DataFrame:
    used = s.filter(F.col("cache_read") + F.col("cache_creation") > 0).withColumn("family", pricing.model_family(F.col("primary_model")))
    rated = pricing.with_rates(used, prices)
    hit = safe_div(F.col("cache_read"), F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation"))
    saved = F.col("cache_read") / 1e6 * (F.col("rate_input") - F.col("rate_read"))
    return rated.select("session_id", "project_id", "family", "cache_read", r6(hit).alias("hit_ratio"), r6(saved).alias("savings")).orderBy(F.desc("cache_read"), "session_id").limit(top)


def model_cache_savings(models: DataFrame, prices: DataFrame) -> DataFrame:
    sums = models.groupBy("family").agg(F.sum("cache_read").alias("cache_read"))
    rated = pricing.with_rates(sums, prices)
    rate = F.col("rate_input") - F.col("rate_read")
    return rated.select("family", "cache_read", r6(rate).alias("saved_rate"), r6(F.col("cache_read") / 1e6 * rate).alias("savings"))


def tier_cost(s: DataFrame, prices: DataFrame) -> DataFrame:
    rated = pricing.with_rates(s.withColumn("family", pricing.model_family(F.col("primary_model"))), prices)
    return rated.agg(r6(F.sum(F.col("cache_5m") / 1e6 * F.col("rate_5m"))).alias("cost_5m"), r6(F.sum(F.col("cache_1h") / 1e6 * F.col("rate_1h"))).alias("cost_1h"))


def compaction_summary(s: DataFrame, prices: DataFrame) -> DataFrame:
    rated = pricing.with_rates(s.withColumn("family", pricing.model_family(F.col("primary_model"))), prices)
    some = F.col("compactions") > 0
    avoided = F.sum(F.when(some, F.col("removed_tokens") / 1e6 * F.col("rate_input")).otherwise(0.0))
    return rated.agg(F.sum("compactions").alias("compactions"), F.sum(F.when(some, 1).otherwise(0)).alias("compacted_sessions"), F.sum("removed_tokens").alias("removed_tokens"), r6(safe_div(F.sum("removed_tokens"), F.sum(F.when(some, 1).otherwise(0)))).alias("avg_removed"), r6(avoided).alias("cost_avoided"))


def top_compaction_sessions(s: DataFrame, prices: DataFrame, top: int = 15) -> DataFrame:
    rated = pricing.with_rates(s.filter("compactions > 0").withColumn("family", pricing.model_family(F.col("primary_model"))), prices)
    peak = F.floor(F.col("removed_tokens") / F.col("compactions") + 0.5).cast("long")
    return rated.select("session_id", "compactions", "removed_tokens", peak.alias("peak_tokens"), r6(F.col("removed_tokens") / 1e6 * F.col("rate_input")).alias("cost_avoided")).orderBy(F.desc("removed_tokens"), "session_id").limit(top)


def model_efficiency(models: DataFrame) -> DataFrame:
    m = models.groupBy("family").agg(F.sum("turn_count").alias("turns"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))
    share = safe_div(F.col("cost"), F.sum("cost").over(W.partitionBy(F.lit(1)))) * 100  # a row per family
    return m.select("family", "turns", "output_tokens", r6("cost").alias("cost"), r6(safe_div(F.col("output_tokens"), F.col("turns"))).alias("output_per_turn"), r6(safe_div(F.col("cost"), F.col("turns"))).alias("cost_per_turn"), r6(share).alias("pct_of_cost")).orderBy(F.desc("cost"), "family")


def _model_days(models: DataFrame, s: DataFrame) -> DataFrame:
    return models.join(dated(s).select("project_id", "session_id", "day"), ["project_id", "session_id"])


def daily_model_cost(models: DataFrame, s: DataFrame) -> DataFrame:
    return _model_days(models, s).groupBy("day", "family").agg(r6(F.sum("cost")).alias("cost")).orderBy("day", "family")


def daily_model_pivot(models: DataFrame, s: DataFrame, families: tuple[str, ...] = (*pricing.FAMILIES, "unknown")) -> DataFrame:
    """A row per day, a zero-filled column per family; the families are known, so Spark needs no pass to find them."""
    p = _model_days(models, s).groupBy("day").pivot("family", list(families)).agg(r6(F.sum("cost"))).fillna(0.0)
    return p.select("day", *[F.col(f"`{f}`").alias(f.replace("-", "_")) for f in families]).orderBy("day")


def latency_percentiles(turns: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), width: int = 512) -> DataFrame:
    """Nearest-rank percentiles p<100 q> of durations, their number and average; no turns give zeros.

    Equal durations are counted first, in parallel. A histogram of ``width`` milliseconds, at most ten minutes long, tells the bucket that holds
    each rank, and only that bucket's durations are put in order: no task sees more than a histogram or a bucket.
    """
    counts = turns.filter("duration_ms IS NOT NULL").groupBy("duration_ms").agg(F.count("*").alias("n"))
    bucket = F.floor(F.col("duration_ms") / width)
    bars = counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"))
    upto = W.partitionBy(F.lit(1)).orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(F.lit(1))
    bars = bars.select("b", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(upto).alias("to"), F.sum("n").over(whole).alias("all"))
    ranks = F.array(*[F.struct(F.lit(q).alias("q"), F.greatest(F.ceil(F.lit(q) * F.col("all")), F.lit(1)).alias("rank")) for q in quantiles])
    chosen = bars.select("*", F.explode(ranks).alias("r")).filter("r.rank > before AND r.rank <= to").select("b", "r.q", (F.col("r.rank") - F.col("before")).alias("rank"))
    inside = counts.withColumn("b", bucket).join(F.broadcast(chosen), "b")  # a row for each quantile
    placed = inside.withColumn("to", F.sum("n").over(W.partitionBy("q").orderBy("duration_ms").rowsBetween(W.unboundedPreceding, 0))).filter("to >= rank")
    found = placed.groupBy().agg(*[F.coalesce(F.min(F.when(F.col("q") == q, F.col("duration_ms"))), F.lit(0)).cast("long").alias(f"p{round(q * 100)}") for q in quantiles])
    n, ms = F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.col("duration_ms") * F.col("n"))
    return found.crossJoin(F.broadcast(counts.agg(n.alias("turns"), r6(F.coalesce(ms / F.sum("n"), F.lit(0.0))).alias("avg_ms"))))  # a row each


def approx_latency_percentiles(turns: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Mergeable percentiles for very many turns (an extension)."""
    return turns.agg(F.percentile_approx("duration_ms", [0.5, 0.95, 0.99], accuracy).alias("p"))


def latency_histogram(turns: DataFrame) -> DataFrame:
    spark = turns.sparkSession
    names = spark.createDataFrame([(0, "<1s"), (1, "1-5s"), (2, "5-30s"), (3, ">30s")], "b int, bucket string")
    b = F.when(F.col("duration_ms") < 1000, 0).when(F.col("duration_ms") < 5000, 1).when(F.col("duration_ms") < 30_000, 2).otherwise(3)
    counts = turns.groupBy(b.alias("b")).agg(F.count("*").alias("n"))
    return names.join(counts, "b", "left").select("b", "bucket", F.coalesce("n", F.lit(0)).alias("turns")).orderBy("b")


def slowest_turns(turns: DataFrame, s: DataFrame, top: int = 20) -> DataFrame:
    """The limit comes first; only its rows meet their sessions."""
    slow = turns.orderBy(F.desc("duration_ms"), "session_id", "line_no").limit(top)
    return slow.join(s.select("project_id", "session_id", "primary_model", "title"), ["project_id", "session_id"]).select("session_id", "line_no", "turn_index", "duration_ms", F.coalesce("model", "primary_model").alias("model"), "title").orderBy(F.desc("duration_ms"), "session_id", "line_no")


def post_vs_normal(turns: DataFrame) -> DataFrame:
    avg = lambda c: F.coalesce(F.avg(F.when(c, F.col("duration_ms"))), F.lit(0.0))
    post, normal = avg(F.col("is_post_compaction")), avg(~F.col("is_post_compaction"))
    t = turns.agg(post.alias("post"), normal.alias("normal"))
    return t.select(r6("post").alias("post_avg_ms"), r6("normal").alias("normal_avg_ms"), r6(safe_div(F.col("post") - F.col("normal"), F.col("normal")) * 100).alias("impact_pct"))


def degrading_sessions(s: DataFrame) -> DataFrame:
    return s.filter((F.col("max_turn_ms") > 2 * F.col("median_turn_ms")) & (F.col("median_turn_ms") > 5000)).select("session_id", "median_turn_ms", "max_turn_ms")


def effort_distribution(s: DataFrame) -> DataFrame:
    return s.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in LEVELS])


def cost_by_effort(s: DataFrame) -> DataFrame:
    """The parent's cost split by its effort counts; four rows always."""
    own, n = F.col("cost") - F.col("subagent_cost"), sum((F.col(c) for c in LEVELS), F.lit(0))
    split = s.withColumn("own", own).withColumn("n", n).filter("n > 0 AND own > 0")
    each = split.select("own", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("turns")) for i, c in enumerate(LEVELS)])).alias("e"))
    sums = each.groupBy("e.i").agg(F.sum(F.col("own") * F.col("e.turns") / F.col("n")).alias("cost"), F.sum("e.turns").alias("turns"))
    names = s.sparkSession.createDataFrame(list(enumerate(EFFORTS)), "i int, effort string")
    return names.join(sums, "i", "left").select("effort", r6(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.coalesce("turns", F.lit(0)).alias("turns"), r6(F.coalesce(safe_div(F.col("cost"), F.col("turns")), F.lit(0.0))).alias("cost_per_turn"))


def effort_over_time(s: DataFrame) -> DataFrame:
    return dated(s).groupBy("day").agg(*[F.sum(c).alias(c) for c in LEVELS]).orderBy("day")


def parallel_tools(s: DataFrame) -> DataFrame:
    p = s.filter("parallel_groups > 0")
    return p.agg(F.coalesce(F.sum("parallel_groups"), F.lit(0)).alias("groups"), F.coalesce(F.max("max_degree"), F.lit(0)).alias("max_degree"), r6(F.coalesce(F.sum(F.col("parallel_groups") * F.col("max_degree")) / F.sum("parallel_groups"), F.lit(0.0))).alias("avg_degree"))


def parallel_degrees(s: DataFrame) -> DataFrame:
    return s.filter("parallel_groups > 0").groupBy("max_degree").agg(F.sum("parallel_groups").alias("groups")).orderBy("max_degree")


def flags(now: datetime) -> Column:
    """Health flags in their fixed order."""
    age = F.unix_millis(F.lit(now)) - F.unix_millis("last_ts")
    rules = {
        "SES001": F.col("cost") > 25,
        "SES002": F.col("compactions") >= 5,
        "SES003": F.col("input_tokens") + F.col("output_tokens") > 2_000_000,
        "SES004": (age > 14 * 86_400_000) & (F.col("message_count") >= 10),
        "SES005": F.col("has_error"),
        "SES006": F.col("has_idle_gap"),
    }
    return F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))


def flagged(s: DataFrame, now: datetime) -> DataFrame:
    f = s.withColumn("flags", flags(now))
    warning = F.arrays_overlap("flags", F.array(*[F.lit(f"SES00{i}") for i in (1, 2, 3, 5, 6)]))
    return f.withColumn("severity", F.when(F.size("flags") == 0, "clean").when(warning, "warning").otherwise("info"))


def session_flags(s: DataFrame, now: datetime) -> DataFrame:
    return flagged(s, now).select("session_id", F.array_join("flags", ",").alias("flags"), "severity")


def health_summary(s: DataFrame, now: datetime) -> DataFrame:
    """Sessions that are only of interest count as warnings; none is an error."""
    f = flagged(s, now)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return f.agg(count(F.col("severity") == "clean").alias("clean"), count(F.col("severity") != "clean").alias("warning"), F.lit(0).cast("long").alias("error"))


def unhealthy_sessions(s: DataFrame, now: datetime, top: int = 10) -> DataFrame:
    f = flagged(s, now).filter("severity <> 'clean'")
    return f.select("session_id", F.coalesce("slug", F.substring("session_id", 1, 8)).alias("title"), r6("cost").alias("cost"), F.array_join("flags", ",").alias("flags")).orderBy(F.desc("cost"), "session_id").limit(top)


def health_trend(s: DataFrame, now: datetime) -> DataFrame:
    f = dated(flagged(s, now))
    clean = F.col("severity") == "clean"
    return f.groupBy("day").agg(F.sum(F.when(clean, 1).otherwise(0)).alias("clean"), F.sum(F.when(clean, 0).otherwise(1)).alias("flagged")).orderBy("day")


def lint_summary(results: DataFrame) -> DataFrame:
    """Counts by severity and a score between 0 and 1."""
    n = lambda x: F.sum(F.when(F.col("severity") == x, 1).otherwise(0))
    t = results.agg(F.coalesce(n("error"), F.lit(0)).alias("errors"), F.coalesce(n("warning"), F.lit(0)).alias("warnings"), F.coalesce(n("info"), F.lit(0)).alias("infos"), F.count("*").alias("total"))
    return t.withColumn("score", r6(F.when(F.col("total") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (3 * F.col("errors") + F.col("warnings")) / (3 * F.col("total"))))))


def analytics(fold: Fold, prices: DataFrame, now: datetime, start: datetime | None = None, end: datetime | None = None, projects: list[str] | None = None) -> dict[str, DataFrame]:
    """All reports of one request over the same filtered sessions; persist ``fold.sessions`` to share their scan."""
    s = in_range(fold.sessions, start, end, projects)
    keys = s.select("project_id", "session_id")
    models, turns = (x.join(keys, ["project_id", "session_id"], "left_semi") for x in (fold.rolled_models, fold.turns))
    return {
        "totals": totals(s), "daily_usage": daily_usage(s), "project_costs": project_costs(s), "model_usage": model_usage(models), "cache_totals": cache_totals(s, prices), "daily_hit_ratio": daily_hit_ratio(s), "cache_busting_days": cache_busting_days(s),
        "session_cache_efficiency": session_cache_efficiency(s, prices), "model_cache_savings": model_cache_savings(models, prices), "tier_cost": tier_cost(s, prices), "compaction_summary": compaction_summary(s, prices),
        "top_compaction_sessions": top_compaction_sessions(s, prices), "model_efficiency": model_efficiency(models), "daily_model_cost": daily_model_cost(models, s), "latency_percentiles": latency_percentiles(turns), "latency_histogram": latency_histogram(turns),
        "slowest_turns": slowest_turns(turns, s), "post_vs_normal": post_vs_normal(turns), "degrading_sessions": degrading_sessions(s), "effort_distribution": effort_distribution(s), "cost_by_effort": cost_by_effort(s), "effort_over_time": effort_over_time(s),
        "parallel_tools": parallel_tools(s), "parallel_degrees": parallel_degrees(s), "health_summary": health_summary(s, now), "unhealthy_sessions": unhealthy_sessions(s, now), "health_trend": health_trend(s, now),
    }


