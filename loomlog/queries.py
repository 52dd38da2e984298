"""Queries over the driver's tables and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pricing
from .operators.fold import Fold
from .plans import derived as D
from .plans import reports as R
from .plans.stored import StoredFold, stored_fold
from .sources.adapter import event_records

NOW = datetime(2024, 1, 30, 12)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def fold_of(spark: SparkSession, sf_dir: str) -> StoredFold:
    """The fold of the events, whose sessions, models and turns are written once and read by all reports."""
    return stored_fold(spark, f"{sf_dir}/events.parquet", lambda: Fold(event_records(spark, sf_dir), pricing.price_table(spark)))


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE_SQL[name] = BASE + sql if sql.lstrip().startswith(("SELECT", ",")) else sql
        return build

    return keep


def _families() -> str:
    return "CASE " + " ".join(f"WHEN model LIKE '%{f}%' THEN '{f}'" for f in pricing.FAMILIES) + " ELSE 'unknown' END"


_PRICES = ", ".join(f"('{f}', {', '.join(f'{x}::DOUBLE' for x in r)})" for f, r in pricing.PRICES.items())
_EFFORT = "CASE WHEN thinking > 5000 OR out > 5000 OR coalesce(stop, '') = 'max_tokens' THEN 'ultrathink' WHEN thinking > 1000 OR out > 2000 THEN 'high' WHEN thinking > 0 OR out > 500 THEN 'medium' ELSE 'low' END"
_ERROR = "CASE WHEN text LIKE '%rate limit%' THEN 'rateLimit' WHEN text LIKE '%unauthorized%' THEN 'authFailure' WHEN text LIKE '%gateway%' THEN 'proxyError' WHEN stop = 'max_tokens' THEN 'maxTokensTruncation' END"
_COST = "(sum(inp) / 1e6 * any_value(p1) + sum(out) / 1e6 * any_value(p2) + sum(cr) / 1e6 * any_value(p3) + sum(c5) / 1e6 * any_value(p4) + sum(c1) / 1e6 * any_value(p5))"
_SUMS = "sum(inp)::BIGINT AS inp, sum(out)::BIGINT AS out, sum(cr)::BIGINT AS cr, sum(c5)::BIGINT AS c5, sum(c1)::BIGINT AS c1"

#: The adapter and the fold as CTEs: r (rows), a (assistant turns), turns, sm, bm (child models), subs, rm (rolled-up models), s (sessions).
BASE = f"""
WITH e AS (SELECT event_id AS i, ts, epoch_us(ts) // 1000 AS ms, user_id, event_type AS et, value, json_extract_string(props, '$.k')::BIGINT AS k, 'p' || (user_id % 4) AS pid FROM events),
price(family, p1, p2, p3, p4, p5) AS (VALUES {_PRICES}),
rec AS (SELECT pid, pid || '-' || strftime(ts, '%Y-%m-%d') AS sid, CASE WHEN i % 13 = 0 THEN 'a' || (i % 2) END AS agent, i, ts, ms, k,
    CASE WHEN et = 'view' THEN 'user' WHEN et = 'click' THEN 'carrier' WHEN et IN ('purchase', 'error') THEN 'assistant' WHEN et = 'signup' AND i % 7 = 0 THEN 'boundary' ELSE 'skip' END AS kind,
    CASE WHEN et IN ('purchase', 'error') THEN CASE i % 6 WHEN 0 THEN 'x-opus-4-6-20250313' WHEN 1 THEN 'x-sonnet-4-5' WHEN 2 THEN 'x-haiku-4-5' WHEN 3 THEN 'x-opus-4-1' WHEN 4 THEN 'x-mystery' END END AS model,
    CASE WHEN et = 'error' AND i % 4 = 3 THEN 'max_tokens' END AS stop,
    CASE WHEN et = 'error' THEN CASE i % 4 WHEN 0 THEN '429 rate limit' WHEN 1 THEN 'unauthorized' WHEN 2 THEN 'bad gateway' ELSE '' END ELSE '' END AS text,
    floor(value * 1000)::BIGINT AS inp, floor(value * 20)::BIGINT AS out, CASE WHEN i % 3 = 0 THEN k * 60000 ELSE 0 END AS cr, CASE WHEN i % 3 = 0 THEN k * 100 ELSE 0 END AS c5, CASE WHEN i % 3 = 0 THEN k * 50 ELSE 0 END AS c1,
    CASE WHEN i % 11 = 0 THEN floor(value * 20)::BIGINT ELSE 0 END AS thinking, CASE WHEN et IN ('purchase', 'error') THEN k % 4 ELSE 0 END AS tools,
    CASE WHEN et = 'signup' AND i % 7 = 0 THEN floor(value * 300)::BIGINT END AS pre,
    row_number() OVER (PARTITION BY pid, strftime(ts, '%Y-%m-%d'), CASE WHEN i % 13 = 0 THEN 'a' || (i % 2) END ORDER BY ts, i) AS line FROM e),
r0 AS (SELECT *, sum(CASE WHEN kind = 'boundary' THEN 1 ELSE 0 END) OVER w AS epoch, sum(CASE WHEN kind = 'user' THEN 1 ELSE 0 END) OVER w AS turn_index,
    lag(ms) OVER o AS prev_ms FROM rec WHERE agent IS NULL AND kind <> 'skip'
    WINDOW w AS (PARTITION BY pid, sid ORDER BY line ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY pid, sid ORDER BY line)),
anc AS (SELECT pid, sid, line, lag(ms) OVER (PARTITION BY pid, sid ORDER BY line) AS anchor FROM r0 WHERE kind IN ('user', 'carrier', 'assistant')),
r AS (SELECT r0.*, anchor, ms - anchor AS d, sum(CASE WHEN kind = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY r0.pid, r0.sid, epoch ORDER BY r0.line ROWS UNBOUNDED PRECEDING) AS since FROM r0 LEFT JOIN anc USING (pid, sid, line)),
a AS (SELECT *, {_EFFORT} AS effort, {_ERROR} AS err FROM r WHERE kind = 'assistant'),
turns AS (SELECT *, epoch > 0 AND since <= 2 AS post FROM r WHERE kind = 'assistant' AND d > 0 AND d <= 600000),
sm AS (SELECT pid, sid, model, any_value(family) AS family, min(line) AS first_line, {_SUMS}, count(*) AS n, {_COST} AS cost
    FROM (SELECT *, {_families()} AS family FROM r WHERE kind = 'assistant' AND model IS NOT NULL) JOIN price USING (family) GROUP BY pid, sid, model),
bm AS (SELECT pid, sid, agent, model, any_value(family) AS family, max(line) AS last_line, {_SUMS}, count(*) AS n, {_COST} AS cost
    FROM (SELECT *, {_families()} AS family FROM rec WHERE kind = 'assistant' AND agent IS NOT NULL) JOIN price USING (family) GROUP BY pid, sid, agent, model),
subs AS (SELECT b.*, coalesce(m.inp, 0) AS inp, coalesce(m.out, 0) AS out, coalesce(m.cost, 0) AS cost, m.primary_model FROM
    (SELECT pid, sid, agent, count(*) FILTER (kind IN ('user', 'assistant')) AS msgs, min(ms) AS first_ms, max(ms) AS last_ms FROM rec WHERE agent IS NOT NULL GROUP BY pid, sid, agent) b
    LEFT JOIN (SELECT pid, sid, agent, sum(inp)::BIGINT AS inp, sum(out)::BIGINT AS out, sum(cost) AS cost, (list(model ORDER BY n DESC, last_line) FILTER (model IS NOT NULL))[1] AS primary_model FROM bm GROUP BY pid, sid, agent) m USING (pid, sid, agent) WHERE msgs > 0),
sb AS (SELECT pid, sid, arg_min(ts, line) AS first_ts, arg_max(ts, line) AS last_ts, arg_min(ms, line) AS first_ms, arg_max(ms, line) AS last_ms, count(*) FILTER (kind IN ('user', 'assistant')) AS pmsgs, count(*) FILTER (kind = 'user') AS users,
    count(*) FILTER (kind = 'boundary') AS compactions, coalesce(sum(pre) FILTER (kind = 'boundary'), 0)::BIGINT AS removed, coalesce(bool_or(ms - prev_ms > 4500000), false) AS gap FROM r GROUP BY pid, sid),
sa AS (SELECT pid, sid, count(*) FILTER (effort = 'low') AS low, count(*) FILTER (effort = 'medium') AS medium, count(*) FILTER (effort = 'high') AS high, count(*) FILTER (effort = 'ultrathink') AS ultra,
    sum(tools)::BIGINT AS tool_calls, count(*) FILTER (tools > 1) AS pgroups, coalesce(max(tools) FILTER (tools > 1), 0) AS degree, bool_or(err IS NOT NULL) AS has_error FROM a GROUP BY pid, sid),
st AS (SELECT pid, sid, list_sort(list(d))[len(list(d)) // 2 + 1] AS median_ms, max(d) AS max_ms FROM turns GROUP BY pid, sid),
so AS (SELECT pid, sid, {_SUMS}, sum(cost) AS cost, (list(model ORDER BY n DESC, first_line))[1] AS primary_model FROM sm GROUP BY pid, sid),
sc AS (SELECT pid, sid, sum(inp)::BIGINT AS inp, sum(out)::BIGINT AS out, sum(cost) AS cost, sum(msgs)::BIGINT AS msgs, count(*) AS agents FROM subs GROUP BY pid, sid),
sw AS (SELECT pid, sid, sum(c5)::BIGINT AS c5, sum(c1)::BIGINT AS c1 FROM bm WHERE model IS NOT NULL GROUP BY pid, sid),
s AS (SELECT sb.*, coalesce(low, 0) AS low, coalesce(medium, 0) AS medium, coalesce(high, 0) AS high, coalesce(ultra, 0) AS ultra, coalesce(tool_calls, 0) AS tool_calls, coalesce(pgroups, 0) AS pgroups, coalesce(degree, 0) AS degree, coalesce(has_error, false) AS has_error,
    median_ms, max_ms, so.primary_model, coalesce(so.inp, 0) + coalesce(sc.inp, 0) AS inp, coalesce(so.out, 0) + coalesce(sc.out, 0) AS out, coalesce(so.cr, 0) AS cr, coalesce(so.c5, 0) + coalesce(sw.c5, 0) AS c5, coalesce(so.c1, 0) + coalesce(sw.c1, 0) AS c1,
    coalesce(so.cost, 0) + coalesce(sc.cost, 0) AS cost, coalesce(sc.cost, 0) AS sub_cost, pmsgs + coalesce(sc.msgs, 0) AS msgs, coalesce(sc.agents, 0) AS agents, strftime(last_ts, '%Y-%m-%d') AS day
    FROM sb LEFT JOIN sa USING (pid, sid) LEFT JOIN st USING (pid, sid) LEFT JOIN so USING (pid, sid) LEFT JOIN sc USING (pid, sid) LEFT JOIN sw USING (pid, sid)),
rm AS (SELECT pid, sid, model, any_value(family) AS family, sum(inp)::BIGINT AS inp, sum(out)::BIGINT AS out, sum(cr)::BIGINT AS cr, sum(c5)::BIGINT AS c5, sum(c1)::BIGINT AS c1, sum(cost) AS cost, sum(n)::BIGINT AS n FROM
    (SELECT pid, sid, model, family, inp, out, cr, c5, c1, cost, n FROM sm UNION ALL SELECT pid, sid, model, family, inp, out, cr, c5, c1, cost, n FROM bm WHERE model IS NOT NULL AND EXISTS (SELECT 1 FROM sb WHERE sb.pid = bm.pid AND sb.sid = bm.sid)) GROUP BY pid, sid, model),
sr AS (SELECT s.*, p1, p2, p3, p4, p5, family FROM (SELECT *, (SELECT any_value(f) FROM (SELECT {_families().replace("model", "primary_model")} AS f)) AS family FROM s) s JOIN price USING (family)),
fl AS (SELECT *, list_filter([CASE WHEN cost > 25 THEN 'SES001' END, CASE WHEN compactions >= 5 THEN 'SES002' END, CASE WHEN inp + out > 2000000 THEN 'SES003' END,
    CASE WHEN epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - last_ms > 14 * 86400000 AND msgs >= 10 THEN 'SES004' END, CASE WHEN has_error THEN 'SES005' END, CASE WHEN gap THEN 'SES006' END], lambda x: x IS NOT NULL) AS flags FROM s),
fs AS (SELECT *, CASE WHEN len(flags) = 0 THEN 'clean' WHEN len(list_filter(flags, lambda x: x <> 'SES004')) > 0 THEN 'warning' ELSE 'info' END AS severity FROM fl)
"""


def _s(report, *extra):
    """A report over all sessions."""
    return lambda spark, d: report(fold_of(spark, d).sessions, *[x(spark) if callable(x) else x for x in extra])


def _m(report, *extra):
    return lambda spark, d: report(fold_of(spark, d).rolled_models, *[x(spark) if callable(x) else x for x in extra])


def _t(report):
    return lambda spark, d: report(fold_of(spark, d).turns)


prices = pricing.price_table

# --- fold -------------------------------------------------------------------------------------------------------

query("w03_first_last_timestamp", "SELECT sid AS session_id, first_ts, last_ts FROM s")(lambda spark, d: fold_of(spark, d).sessions.select("session_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts")))
query("w04_idle_gap", "SELECT sid AS session_id, gap AS has_idle_gap FROM s")(lambda spark, d: fold_of(spark, d).sessions.select("session_id", "has_idle_gap"))
query("w05_max_idle_gap", "SELECT sid AS session_id, max(ms - prev_ms) AS gap_ms FROM r WHERE ms > prev_ms GROUP BY sid")(
    lambda spark, d: fold_of(spark, d).rows.filter("gap_ms > 0").groupBy("session_id").agg(F.max("gap_ms").alias("gap_ms"))
)
query("w06_compaction_epoch", "SELECT sid AS session_id, line AS line_no, epoch::BIGINT AS epoch, turn_index::BIGINT AS turn_index, since::BIGINT AS turns_since FROM r")(lambda spark, d: fold_of(spark, d).rows.select("session_id", "line_no", "epoch", "turn_index", "turns_since"))
query("w08_compactions", "SELECT sid AS session_id, epoch::BIGINT - 1 AS idx, pre AS pre_tokens, (turn_index - coalesce(lag(turn_index) OVER (PARTITION BY pid, sid ORDER BY line), 0))::BIGINT AS turns_since_last FROM r WHERE kind = 'boundary'")(
    lambda spark, d: fold_of(spark, d).compactions.select("session_id", "idx", "pre_tokens", "turns_since_last")
)
query("w09_turn_duration", "SELECT sid AS session_id, line AS line_no, turn_index::BIGINT AS turn_index, d AS duration_ms, post AS is_post_compaction FROM turns")(lambda spark, d: fold_of(spark, d).turns.select("session_id", "line_no", "turn_index", "duration_ms", "is_post_compaction"))
query("w11_parallel_groups", "SELECT sid AS session_id, line AS line_no, turn_index::BIGINT AS turn_index, tools AS tool_count FROM a WHERE tools > 1")(lambda spark, d: fold_of(spark, d).parallel_groups.select("session_id", "line_no", "turn_index", F.col("tool_count").cast("long").alias("tool_count")))
query("w13_session_effort", "SELECT sid AS session_id, low, medium, high, ultra AS ultrathink, CASE greatest(low, medium, high, ultra) WHEN low THEN 'low' WHEN medium THEN 'medium' WHEN high THEN 'high' ELSE 'ultrathink' END AS dominant FROM s")(
    lambda spark, d: fold_of(spark, d).sessions.select("session_id", *[F.col(f"effort_{x}").alias(x) for x in ("low", "medium", "high", "ultrathink")], F.col("dominant_effort").alias("dominant"))
)
query("w14_error_details", "SELECT sid AS session_id, line AS line_no, err AS classification, text AS message FROM a WHERE err IS NOT NULL")(lambda spark, d: fold_of(spark, d).errors.select("session_id", "line_no", "classification", "message"))
query("w15_median_turn", "SELECT sid AS session_id, median_ms AS median_turn_ms, max_ms AS max_turn_ms FROM s WHERE max_ms IS NOT NULL")(lambda spark, d: fold_of(spark, d).sessions.filter("max_turn_ms IS NOT NULL").select("session_id", "median_turn_ms", "max_turn_ms"))
query("w16_model_breakdown", "SELECT sid AS session_id, model, inp AS input_tokens, out AS output_tokens, cr AS cache_read, c5 AS cache_5m, c1 AS cache_1h, n AS turn_count, round(cost, 6) AS cost FROM sm")(
    lambda spark, d: fold_of(spark, d).session_models.select("session_id", "model", "input_tokens", "output_tokens", "cache_read", "cache_5m", "cache_1h", "turn_count", F.round("cost", 6).alias("cost"))
)
query("w17_primary_model", "SELECT sid AS session_id, primary_model FROM s")(lambda spark, d: fold_of(spark, d).sessions.select("session_id", "primary_model"))
query("w18_session_totals", "SELECT sid AS session_id, inp AS input_tokens, out AS output_tokens, cr AS cache_read, (c5 + c1)::BIGINT AS cache_creation, msgs AS message_count, pmsgs AS parent_messages, removed AS removed_tokens, tool_calls, agents AS n_subagents, round(cost, 6) AS cost FROM s")(
    lambda spark, d: fold_of(spark, d).sessions.select("session_id", "input_tokens", "output_tokens", "cache_read", "cache_creation", "message_count", "parent_messages", "removed_tokens", "tool_calls", "n_subagents", F.round("cost", 6).alias("cost"))
)
query("w21_subagents", "SELECT sid AS session_id, agent AS agent_id, msgs AS message_count, inp AS input_tokens, out AS output_tokens, round(cost, 6) AS cost, primary_model FROM subs")(
    lambda spark, d: fold_of(spark, d).subagents.select("session_id", "agent_id", "message_count", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"), "primary_model")
)
query("j04_subagent_rollup", "SELECT sid AS session_id, model, inp AS input_tokens, cr AS cache_read, n AS turn_count, round(cost, 6) AS cost FROM rm")(lambda spark, d: fold_of(spark, d).rolled_models.select("session_id", "model", "input_tokens", "cache_read", "turn_count", F.round("cost", 6).alias("cost")))

# --- reports ----------------------------------------------------------------------------------------------------

query("a01_totals", "SELECT count(*) AS sessions, sum(msgs)::BIGINT AS messages, sum(inp + out)::BIGINT AS tokens, sum(cr + c5 + c1)::BIGINT AS cache_tokens, round(sum(cost), 6) AS cost FROM s")(_s(R.totals))
query("a02_daily_usage", "SELECT day, sum(inp)::BIGINT AS input_tokens, sum(out)::BIGINT AS output_tokens, sum(cr)::BIGINT AS cache_read, sum(c5 + c1)::BIGINT AS cache_creation, sum(c5)::BIGINT AS cache_5m, sum(c1)::BIGINT AS cache_1h, count(*) AS sessions, sum(msgs)::BIGINT AS messages, round(sum(cost), 6) AS cost FROM s GROUP BY day")(_s(R.daily_usage))
query("a03_project_costs", "SELECT pid AS project_id, pid AS project_name, round(sum(cost), 6) AS cost, sum(inp + out)::BIGINT AS tokens, count(*) AS sessions, sum(msgs)::BIGINT AS messages FROM s GROUP BY pid")(_s(R.project_costs))
query("a04_model_usage", "SELECT family, sum(n)::BIGINT AS turns, sum(inp)::BIGINT AS input_tokens, sum(out)::BIGINT AS output_tokens FROM rm WHERE family <> 'unknown' GROUP BY family")(_m(R.model_usage))
query("a05_cache_totals", """SELECT round(coalesce(cr / nullif(inp + cr + w, 0), 0), 6) AS hit_ratio, round(coalesce(cr / nullif(w, 0), 0), 6) AS reuse_ratio, c5 AS cache_5m, c1 AS cache_1h, round(cr / 1e6 * 2.7, 6) AS savings, round(cost + cr / 1e6 * 2.7, 6) AS hypothetical_cost, floor(cr / 1e6 * 2.7 / (cost + cr / 1e6 * 2.7) * 100 + 0.5)::BIGINT AS savings_pct
    FROM (SELECT sum(inp)::DOUBLE AS inp, sum(cr)::DOUBLE AS cr, sum(c5 + c1)::DOUBLE AS w, sum(c5)::BIGINT AS c5, sum(c1)::BIGINT AS c1, sum(cost) AS cost FROM s)""")(_s(R.cache_totals, prices))
query("a07_daily_hit_ratio", "SELECT day, round(sum(cr)::DOUBLE / sum(inp + cr + c5 + c1)::DOUBLE, 6) AS hit_ratio FROM s GROUP BY day HAVING sum(inp + cr + c5 + c1) > 0")(_s(R.daily_hit_ratio))
query("a08_cache_busting_days", """SELECT * FROM (SELECT day, h AS hit_ratio, lag(h) OVER (ORDER BY day) AS previous_ratio FROM (SELECT day, round(sum(cr)::DOUBLE / sum(inp + cr + c5 + c1)::DOUBLE, 6) AS h FROM s GROUP BY day HAVING sum(inp + cr + c5 + c1) > 0)) WHERE hit_ratio < 0.86 AND previous_ratio > 0.86""")(
    _s(R.cache_busting_days, 0.86, 0.86)
)
query("a09_session_cache_efficiency", "SELECT sid AS session_id, pid AS project_id, family, cr AS cache_read, round(cr::DOUBLE / (inp + cr + c5 + c1), 6) AS hit_ratio, round(cr / 1e6 * (p1 - p3), 6) AS savings FROM sr WHERE cr + c5 + c1 > 0 ORDER BY cr DESC, sid LIMIT 20")(_s(R.session_cache_efficiency, prices))
query("a10_model_cache_savings", "SELECT family, sum(cr)::BIGINT AS cache_read, round(any_value(p1 - p3), 6) AS saved_rate, round(sum(cr)::DOUBLE / 1e6 * any_value(p1 - p3), 6) AS savings FROM rm JOIN price USING (family) GROUP BY family")(_m(R.model_cache_savings, prices))
query("a11_tier_cost", "SELECT round(sum(c5 / 1e6 * p4), 6) AS cost_5m, round(sum(c1 / 1e6 * p5), 6) AS cost_1h FROM sr")(_s(R.tier_cost, prices))
query("a12_compaction_summary", "SELECT sum(compactions)::BIGINT AS compactions, count(*) FILTER (compactions > 0) AS compacted_sessions, sum(removed)::BIGINT AS removed_tokens, round(coalesce(sum(removed)::DOUBLE / nullif(count(*) FILTER (compactions > 0), 0), 0), 6) AS avg_removed, round(sum(CASE WHEN compactions > 0 THEN removed / 1e6 * p1 ELSE 0 END), 6) AS cost_avoided FROM sr")(_s(R.compaction_summary, prices))
query("a13_top_compaction_sessions", "SELECT sid AS session_id, compactions, removed AS removed_tokens, floor(removed / compactions::DOUBLE + 0.5)::BIGINT AS peak_tokens, round(removed / 1e6 * p1, 6) AS cost_avoided FROM sr WHERE compactions > 0 ORDER BY removed DESC, sid LIMIT 15")(_s(R.top_compaction_sessions, prices))
query("a15_model_efficiency", "SELECT family, turns, output_tokens, round(cost, 6) AS cost, round(output_tokens / turns::DOUBLE, 6) AS output_per_turn, round(cost / turns, 6) AS cost_per_turn, round(cost / sum(cost) OVER () * 100, 6) AS pct_of_cost FROM (SELECT family, sum(n)::BIGINT AS turns, sum(out)::BIGINT AS output_tokens, sum(cost) AS cost FROM rm GROUP BY family)")(_m(R.model_efficiency))
query("a16_daily_model_cost", "SELECT day, family, round(sum(rm.cost), 6) AS cost FROM rm JOIN s USING (pid, sid) GROUP BY day, family")(lambda spark, d: R.daily_model_cost((f := fold_of(spark, d)).rolled_models, f.sessions))
query("a17_latency_percentiles", "SELECT coalesce(quantile_disc(d, 0.5), 0)::BIGINT AS p50, coalesce(quantile_disc(d, 0.95), 0)::BIGINT AS p95, coalesce(quantile_disc(d, 0.99), 0)::BIGINT AS p99, count(*) AS turns, round(coalesce(avg(d), 0), 6) AS avg_ms FROM turns")(_t(R.latency_percentiles))
query("a18_latency_histogram", "SELECT b, bucket, coalesce(n, 0) AS turns FROM (VALUES (0, '<1s'), (1, '1-5s'), (2, '5-30s'), (3, '>30s')) x(b, bucket) LEFT JOIN (SELECT CASE WHEN d < 1000 THEN 0 WHEN d < 5000 THEN 1 WHEN d < 30000 THEN 2 ELSE 3 END AS b, count(*) AS n FROM turns GROUP BY 1) USING (b)")(_t(R.latency_histogram))
query("a19_slowest_turns", "SELECT turns.sid AS session_id, line AS line_no, turn_index::BIGINT AS turn_index, d AS duration_ms, coalesce(model, primary_model) AS model, turns.sid AS title FROM turns JOIN s USING (pid, sid) ORDER BY d DESC, turns.sid, line LIMIT 20")(lambda spark, d: R.slowest_turns((f := fold_of(spark, d)).turns, f.sessions))
query("a20_post_vs_normal", "SELECT round(p, 6) AS post_avg_ms, round(n, 6) AS normal_avg_ms, round(CASE WHEN n > 0 THEN (p - n) / n ELSE 0 END * 100, 6) AS impact_pct FROM (SELECT coalesce(avg(d) FILTER (post), 0) AS p, coalesce(avg(d) FILTER (NOT post), 0) AS n FROM turns)")(_t(R.post_vs_normal))
query("a21_degrading_sessions", "SELECT sid AS session_id, median_ms AS median_turn_ms, max_ms AS max_turn_ms FROM s WHERE max_ms > 2 * median_ms AND median_ms > 5000")(_s(R.degrading_sessions))
query("a22_effort_distribution", "SELECT sum(low)::BIGINT AS effort_low, sum(medium)::BIGINT AS effort_medium, sum(high)::BIGINT AS effort_high, sum(ultra)::BIGINT AS effort_ultrathink FROM s")(_s(R.effort_distribution))
query("a23_cost_by_effort", """SELECT effort, round(coalesce(sum(own * t / n), 0), 6) AS cost, coalesce(sum(t), 0)::BIGINT AS turns, round(coalesce(sum(own * t / n) / nullif(sum(t), 0), 0), 6) AS cost_per_turn FROM
    (SELECT cost - sub_cost AS own, low + medium + high + ultra AS n, unnest(['low', 'medium', 'high', 'ultrathink']) AS effort, unnest([low, medium, high, ultra]) AS t FROM s) WHERE n > 0 AND own > 0 GROUP BY effort""")(_s(R.cost_by_effort))
query("a24_effort_over_time", "SELECT day, sum(low)::BIGINT AS effort_low, sum(medium)::BIGINT AS effort_medium, sum(high)::BIGINT AS effort_high, sum(ultra)::BIGINT AS effort_ultrathink FROM s GROUP BY day")(_s(R.effort_over_time))
query("a25_parallel_tools", "SELECT coalesce(sum(pgroups), 0)::BIGINT AS groups, coalesce(max(degree), 0) AS max_degree, round(coalesce(sum(pgroups * degree) / sum(pgroups), 0), 6)::DOUBLE AS avg_degree FROM s WHERE pgroups > 0")(lambda spark, d: R.parallel_tools(fold_of(spark, d).sessions).withColumn("max_degree", F.col("max_degree").cast("long")))
query("a25_parallel_degrees", "SELECT degree AS max_degree, sum(pgroups)::BIGINT AS groups FROM s WHERE pgroups > 0 GROUP BY degree")(lambda spark, d: R.parallel_degrees(fold_of(spark, d).sessions).withColumn("max_degree", F.col("max_degree").cast("long")))
query("a26_session_flags", "SELECT sid AS session_id, array_to_string(flags, ',') AS flags, severity FROM fs")(_s(R.session_flags, NOW))
query("a28_health_summary", "SELECT count(*) FILTER (severity = 'clean') AS clean, count(*) FILTER (severity <> 'clean') AS warning, 0::BIGINT AS error FROM fs")(_s(R.health_summary, NOW))
query("a28_unhealthy_sessions", "SELECT sid AS session_id, sid[1:8] AS title, round(cost, 6) AS cost, array_to_string(flags, ',') AS flags FROM fs WHERE severity <> 'clean' ORDER BY round(cost, 6) DESC, sid LIMIT 10")(_s(R.unhealthy_sessions, NOW))
query("a29_health_trend", "SELECT day, count(*) FILTER (severity = 'clean') AS clean, count(*) FILTER (severity <> 'clean') AS flagged FROM fs GROUP BY day")(_s(R.health_trend, NOW))
query("a32_today_stats", "SELECT count(*) AS sessions, sum(msgs)::BIGINT AS messages, sum(inp + out)::BIGINT AS tokens, round(sum(cost), 6) AS cost, count(DISTINCT pid) AS projects FROM s WHERE day = '2024-01-30'")(_s(D.today_stats, NOW))
query("a33_weekly_usage", "SELECT day, round(sum(cost), 6) AS cost, sum(inp + out)::BIGINT AS tokens FROM s GROUP BY day ORDER BY day DESC LIMIT 7")(_s(D.weekly_usage))
query("a34_day_delta", "SELECT day, round(CASE WHEN p > 0 THEN (c - p) / p * 100 WHEN c > 0 THEN 100 ELSE 0 END, 6)::DOUBLE AS delta_pct FROM (SELECT day, c, lag(c) OVER (ORDER BY day) AS p FROM (SELECT day, round(sum(cost), 6) AS c FROM s GROUP BY day)) WHERE p IS NOT NULL")(_s(D.day_delta))
query("a36_overview_averages", "SELECT round(sum(cost) / count(*), 6) AS avg_cost, round(sum(inp + out)::DOUBLE / count(*), 6) AS avg_tokens, floor(sum(msgs) / count(*) + 0.5)::BIGINT AS avg_messages FROM s")(
    lambda spark, d: R.totals(fold_of(spark, d).sessions).select(F.round(F.col("cost") / F.col("sessions"), 6).alias("avg_cost"), F.round(F.col("tokens") / F.col("sessions"), 6).alias("avg_tokens"), F.floor(F.col("messages") / F.col("sessions") + 0.5).alias("avg_messages"))
)
query("a37_model_champions", """SELECT (SELECT family FROM m ORDER BY turns DESC, family DESC LIMIT 1) AS dominant, (SELECT round(max(turns)::DOUBLE / sum(turns), 6) FROM m) AS dominant_share, (SELECT family FROM m WHERE turns >= 5 ORDER BY c, family LIMIT 1) AS most_efficient
    FROM (SELECT 1) """.replace("FROM m", "FROM (SELECT family, sum(n) AS turns, round(sum(cost) / sum(n), 6) AS c FROM rm GROUP BY family)"))(_m(D.model_champions))
query("a38_daily_model_pivot", "SELECT day, " + ", ".join(f"""round(coalesce(sum(rm.cost) FILTER (family = '{f}'), 0), 6) AS {f.replace("-", "_")}""" for f in (*pricing.FAMILIES, "unknown")) + " FROM rm JOIN s USING (pid, sid) GROUP BY day")(lambda spark, d: R.daily_model_pivot((f := fold_of(spark, d)).rolled_models, f.sessions))
query("a42_session_details", "SELECT sid AS session_id, last_ms - first_ms AS duration_ms, removed AS removed_tokens, round(removed / 1e6 * p1, 6) AS cost_avoided, round(cost - sub_cost, 6) AS own_cost FROM sr")(_s(D.session_details, prices))
query("a45_tool_analytics", "SELECT tool, count(*) AS calls FROM (SELECT 'tool' || unnest(range(1, tools + 1)) AS tool FROM a) GROUP BY tool")(lambda spark, d: D.tool_analytics(fold_of(spark, d)))

# --- derived ----------------------------------------------------------------------------------------------------

query("d01_insights", """, o AS (SELECT count(*)::DOUBLE AS n, coalesce(sum(inp + out), 0) AS tokens, coalesce(round(sum(cost), 6), 0) AS cost, floor(round(coalesce(sum(cr)::DOUBLE / nullif(sum(inp + cr + c5 + c1), 0), 0), 6) * 100 + 0.5) AS hit, coalesce(sum(compactions), 0)::DOUBLE AS comp, sum(ultra)::DOUBLE AS ultra, sum(low + medium + high + ultra)::DOUBLE AS levels FROM s),
    p AS (SELECT max(c) AS top FROM (SELECT round(sum(cost), 6) AS c FROM s GROUP BY pid)), m AS (SELECT max(round(c / t * 100, 6)) AS model FROM (SELECT sum(cost) AS c, sum(sum(cost)) OVER () AS t FROM rm GROUP BY family)),
    l AS (SELECT coalesce(quantile_disc(d, 0.95), 0)::DOUBLE AS p95, round(coalesce(avg(d) FILTER (post), 0), 6) AS pa, round(coalesce(avg(d) FILTER (NOT post), 0), 6) AS na FROM turns), z AS (SELECT round(sum(CASE WHEN compactions > 0 THEN removed / 1e6 * p1 ELSE 0 END), 6) AS saved FROM sr),
    x AS (SELECT *, floor(CASE WHEN cost > 0 THEN top / cost ELSE 0 END * 100 + 0.5) AS share, floor(CASE WHEN levels > 0 THEN ultra / levels ELSE 0 END * 100 + 0.5) AS up, CASE WHEN n > 0 THEN cost / n ELSE 0 END AS av, CASE WHEN n > 0 THEN comp / n ELSE 0 END AS per, CASE WHEN na > 0 THEN pa / na ELSE 0 END AS ratio FROM o, p, m, l, z)
    SELECT i.id, i.level, round(i.value, 6) AS value FROM (SELECT unnest([CASE WHEN hit >= 60 THEN {'id': 'cache-good', 'level': 'positive', 'value': hit::DOUBLE} END, CASE WHEN hit < 30 AND tokens > 0 THEN {'id': 'cache-low', 'level': 'warning', 'value': hit::DOUBLE} END,
        CASE WHEN share >= 60 THEN {'id': 'cost-concentration', 'level': 'warning', 'value': share::DOUBLE} END, CASE WHEN p95 > 30000 THEN {'id': 'latency-high', 'level': 'warning', 'value': p95} END, CASE WHEN up >= 25 THEN {'id': 'ultrathink-high', 'level': 'info', 'value': up::DOUBLE} END,
        CASE WHEN n = 0 THEN {'id': 'no-sessions', 'level': 'info', 'value': n} END, CASE WHEN av > 1 THEN {'id': 'high-session-cost', 'level': 'warning', 'value': av::DOUBLE} END, CASE WHEN model > 70 THEN {'id': 'model-dominance', 'level': 'info', 'value': model::DOUBLE} END,
        CASE WHEN per >= 1 THEN {'id': 'compaction-frequent', 'level': 'warning', 'value': per::DOUBLE} END, CASE WHEN per < 1 AND comp > 0 THEN {'id': 'compaction-present', 'level': 'info', 'value': comp} END, CASE WHEN pa > 0 AND na > 0 AND ratio >= 1.5 THEN {'id': 'compaction-latency-spike', 'level': 'warning', 'value': ratio::DOUBLE} END,
        CASE WHEN pa > 0 AND na > 0 AND ratio >= 1.2 AND ratio < 1.5 THEN {'id': 'compaction-latency-mild', 'level': 'info', 'value': ratio::DOUBLE} END, CASE WHEN saved > 0.5 THEN {'id': 'compaction-savings', 'level': 'positive', 'value': saved::DOUBLE} END]) AS i FROM x) WHERE i IS NOT NULL""")(lambda spark, d: D.insights((f := fold_of(spark, d)).sessions, f.rolled_models, f.turns, f.prices))
query("d02_what_if", """SELECT a.family AS source, b.family AS target, round(c, 6) AS cost, round(c * (b.p1 + b.p2) / (p.p1 + p.p2), 6) AS projected, round(c * (b.p1 + b.p2) / (p.p1 + p.p2) - c, 6) + 0 AS delta, round((c * (b.p1 + b.p2) / (p.p1 + p.p2) - c) / c * 100, 6) + 0 AS delta_pct
    FROM (SELECT family, round(sum(cost), 6) AS c FROM rm WHERE family <> 'unknown' GROUP BY family HAVING sum(cost) > 0) a JOIN price p ON a.family = p.family JOIN price b ON b.family <> a.family AND b.family <> 'unknown'""")(_m(D.what_if, prices))
query("d03_project_breakdown", "SELECT pid AS project_id, c AS cost, round(c / sum(c) OVER () * 100, 6) AS cost_share, round(t / sum(t) OVER () * 100, 6) AS token_share FROM (SELECT pid, round(sum(cost), 6) AS c, sum(inp + out)::DOUBLE AS t FROM s GROUP BY pid)")(_s(D.project_breakdown))
query("d04_timeline_blocks", """SELECT sid AS session_id, pid AS project_id, round(greatest(0, f), 6)::DOUBLE AS start_min, round(greatest(5, least(1440, l) - greatest(0, f)), 6)::DOUBLE AS minutes
    FROM (SELECT *, (first_ms - epoch_ms(TIMESTAMP '2024-01-15'))::DOUBLE / 60000 AS f, (last_ms - epoch_ms(TIMESTAMP '2024-01-15'))::DOUBLE / 60000 AS l FROM s) WHERE strftime(first_ts, '%Y-%m-%d') = '2024-01-15' OR strftime(last_ts, '%Y-%m-%d') = '2024-01-15'""")(_s(D.timeline_blocks, "2024-01-15"))
query("d05_timeline_days", "SELECT strftime(d, '%Y-%m-%d') AS day, strftime(d, '%Y-%m-%d') IN (SELECT day FROM s UNION SELECT strftime(first_ts, '%Y-%m-%d') FROM s) AS active FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d)")(_s(D.timeline_days, NOW))
query("d06_active_recent", "SELECT sid AS session_id, 'active' AS state FROM s WHERE epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - last_ms < 60000 UNION ALL SELECT * FROM (SELECT sid, 'recent' FROM s WHERE epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - last_ms >= 60000 ORDER BY last_ts DESC, sid LIMIT 3)")(_s(D.active_and_recent, NOW))
query("d07_turn_metrics", """SELECT pid AS project_id, sid AS session_id, line AS line_no, effort, tools AS tool_count, d AS duration_ms, count(x.agent) AS agents, coalesce(sum(last_ms - first_ms), 0)::BIGINT AS agent_ms, greatest(0, d - coalesce(sum(last_ms - first_ms), 0))::BIGINT AS model_ms
    FROM a LEFT JOIN (SELECT pid AS xp, sid AS xs, agent, first_ms, last_ms FROM subs) x ON xp = pid AND xs = sid AND first_ms >= anchor AND last_ms <= ms + d WHERE d > 0 AND d <= 600000 GROUP BY pid, sid, line, effort, tools, d""")(
    lambda spark, d: D.turn_metrics(fold_of(spark, d)).withColumn("tool_count", F.col("tool_count").cast("long"))
)
query("d08_percentile_bars", """SELECT * FROM (SELECT unnest(['p50', 'avg', 'p95', 'post', 'p99']) AS bar, unnest([quantile_disc(d, 0.5)::DOUBLE, round(avg(d), 6), quantile_disc(d, 0.95)::DOUBLE, round(coalesce(avg(d) FILTER (post), 0), 6), quantile_disc(d, 0.99)::DOUBLE]) AS value FROM turns) WHERE value > 0""")(_t(D.percentile_bars))
query("d10_model_share", "SELECT family, t AS turns, round(t / sum(t) OVER ()::DOUBLE, 6) AS share FROM (SELECT family, sum(n)::BIGINT AS t FROM rm WHERE family <> 'unknown' GROUP BY family)")(_m(D.model_share))
