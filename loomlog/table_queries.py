"""Queries of scalars, joins, filters, searches, set operations and rules over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import pricing
from .functions import scalars as P
from .operators import lint as L
from .operators import records as X
from .operators.intervals import contained
from .plans import derived as D
from .plans import reports as R
from .queries import NOW, fold_of, query
from .sources.adapter import event_records
from .sources.files import shared_root


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def conversations(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"), "role", "text")


# --- filters ----------------------------------------------------------------------------------------------------

query("f01_skip_record", "SELECT kind, count(*) AS n FROM rec WHERE kind <> 'skip' GROUP BY kind")(lambda s, d: event_records(s, d).filter("kind <> 'skip'").groupBy("kind").agg(F.count("*").alias("n")))


@query("f02_dedupe_uuid", "SELECT pid AS project_id, count(*) AS n FROM rec WHERE agent IS NULL AND kind <> 'skip' GROUP BY pid")
def f02(s, d):
    from .operators.fold import visible

    r = event_records(s, d).filter("agent_id IS NULL")
    twice = r.unionByName(r.filter(F.col("uuid").cast("long") % 17 == 0).withColumn("line_no", F.col("line_no") + 1_000_000))
    return visible(twice).groupBy("project_id").agg(F.count("*").alias("n"))


query("f05_date_range", "SELECT sid AS session_id FROM s WHERE last_ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20 23:59:59.999' AND pid IN ('p1', 'p2')")(
    lambda s, d: R.in_range(fold_of(s, d).sessions, F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-20 23:59:59.999").cast("timestamp"), ["p1", "p2"]).select("session_id")
)
query("f07_display_records", "WITH q AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant', 'system')) SELECT conv_id AS session_id, count(*) AS n FROM q GROUP BY conv_id")(
    lambda s, d: X.display(conversations(s, d).withColumn("kind", F.col("role"))).groupBy("session_id").agg(F.count("*").alias("n"))
)
query("f08_session_search", "WITH q AS (SELECT * FROM conversations) SELECT conv_id AS session_id, turn AS line_no FROM q WHERE lower(text) LIKE '%the%'")(lambda s, d: conversations(s, d).filter(X.contains(F.col("text"), "The")).select("session_id", "line_no"))
query("f12_message_rows", "SELECT sid AS session_id, line AS line_no FROM r WHERE kind IN ('user', 'assistant')")(lambda s, d: fold_of(s, d).rows.filter("kind IN ('user', 'assistant')").select("session_id", "line_no"))

# --- scalars ----------------------------------------------------------------------------------------------------

query("p01_classify_effort", "SELECT effort, count(*) AS n FROM a GROUP BY effort")(lambda s, d: fold_of(s, d).assistants.groupBy("effort").agg(F.count("*").alias("n")))
query("p02_classify_error", "SELECT err AS error, count(*) AS n FROM a GROUP BY err")(lambda s, d: fold_of(s, d).assistants.groupBy("error").agg(F.count("*").alias("n")))
query("p06_model_family", "SELECT model, any_value(family) AS family FROM rm GROUP BY model")(lambda s, d: fold_of(s, d).records.filter("model IS NOT NULL").select("model", pricing.model_family(F.col("model")).alias("family")).distinct())
query("p07_estimate_cost", "SELECT line AS line_no, sid AS session_id, round(inp / 1e6 * p1 + out / 1e6 * p2 + cr / 1e6 * p3 + c5 / 1e6 * p4 + c1 / 1e6 * p5, 6) AS cost FROM (SELECT a.*, CASE WHEN model LIKE '%opus-4-6%' THEN 'opus-4-6' WHEN model LIKE '%sonnet-4-5%' THEN 'sonnet-4-5' WHEN model LIKE '%haiku-4-5%' THEN 'haiku-4-5' WHEN model LIKE '%opus-4-1%' THEN 'opus-4-1' ELSE 'unknown' END AS family FROM a) JOIN price USING (family)")(
    lambda s, d: pricing.with_rates(fold_of(s, d).assistants.withColumn("family", pricing.model_family(F.col("model"))), pricing.price_table(s)).select("line_no", "session_id", F.round(pricing.cost(*map(F.col, ("input_tokens", "output_tokens", "cache_read", "cache_5m", "cache_1h"))), 6).alias("cost"))
)
query("p09_tool_names", """WITH q AS (SELECT DISTINCT p_brand, ['Read', 'Write', 'Edit', 'Bash', 'mcp__' || p_brand || '__x__run', p_brand][p_partkey % 6 + 1] AS name FROM part) SELECT DISTINCT name, CASE WHEN name = 'Read' THEN 'read' WHEN name = 'Write' THEN 'write' WHEN name = 'Edit' THEN 'edit' WHEN name = 'Bash' THEN 'exec' WHEN contains(name, '__') THEN 'mcp' ELSE 'other' END AS category,
    CASE WHEN contains(name, '__') THEN p_brand || '__x' END AS server, CASE WHEN contains(name, '__') THEN 'run' END AS method FROM q""")(
    lambda s, d: table(s, d, "part")
    .withColumn("name", F.get(F.array(F.lit("Read"), F.lit("Write"), F.lit("Edit"), F.lit("Bash"), F.concat(F.lit("mcp__"), "p_brand", F.lit("__x__run")), F.col("p_brand")), (F.col("p_partkey") % 6).cast("int")))
    .select("name", P.tool_category(F.col("name")).alias("category"), P.mcp_server(F.col("name")).alias("server"), P.mcp_method(F.col("name")).alias("method"))
    .distinct()
)
query("p12_project_names", r"""WITH q AS (SELECT DISTINCT p_brand AS b FROM part), i AS (SELECT '-home-me-' || b AS id, b FROM q UNION ALL SELECT '-C:-work-' || b, b FROM q UNION ALL SELECT b, b FROM q)
    SELECT id, CASE WHEN id LIKE '-C:-%' THEN 'C:\work\' || b WHEN id LIKE '-%' THEN '/home/me/' || b ELSE b END AS path, b AS name FROM i""")(
    lambda s, d: table(s, d, "part").select(F.explode(F.array(F.concat(F.lit("-home-me-"), "p_brand"), F.concat(F.lit("-C:-work-"), "p_brand"), F.col("p_brand"))).alias("id")).distinct().select("id", P.decode_project_id(F.col("id")).alias("path"), P.last_segment(P.decode_project_id(F.col("id"))).alias("name"))
)
query("p16_formats", """WITH q AS (SELECT o_orderkey, (o_orderkey * 7919) % 3000000 AS n FROM orders) SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6 + CASE WHEN n % 500000 = 250000 THEN 1e-9 ELSE 0 END) WHEN n >= 1000 THEN printf('%.1fK', n / 1e3 + CASE WHEN n % 500 = 250 THEN 1e-9 ELSE 0 END) ELSE n::VARCHAR END AS tokens FROM q""")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", P.format_tokens((F.col("o_orderkey") * 7919) % 3000000).alias("tokens"))
)
query("p19_csv_escape", """WITH q AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, turn, CASE WHEN contains(text, '"') OR contains(text, ',') OR contains(text, chr(10)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM q""")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", P.csv_escape(F.col("text")).alias("cell")))
query("p20_search_snippet", """WITH q AS (SELECT conv_id, turn, text, strpos(lower(text), 'and') AS p FROM conversations), b AS (SELECT *, greatest(p - 40, 1) AS f, least(p + 83, length(text) + 1) AS t FROM q WHERE p > 0)
    SELECT conv_id, turn, CASE WHEN f > 1 THEN '…' ELSE '' END || substring(text, f, t - f) || CASE WHEN t <= length(text) THEN '…' ELSE '' END AS snippet FROM b""")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", P.snippet(F.col("text"), "and").alias("snippet")).filter("snippet IS NOT NULL")
)
query("p21_entropy", """WITH q AS (SELECT DISTINCT p_name FROM part), c AS (SELECT p_name, unnest(string_split(p_name, '')) AS ch FROM q), n AS (SELECT p_name, ch, count(*) AS k FROM c GROUP BY ALL)
    SELECT p_name, round(-sum(k::DOUBLE / length(p_name) * log2(k::DOUBLE / length(p_name))), 6) + 0 AS entropy, count(*) AS unique_chars FROM n GROUP BY p_name""")(
    lambda s, d: table(s, d, "part").select("p_name").distinct().select("p_name", F.round(P.entropy(F.col("p_name")), 6).alias("entropy"), P.unique_chars(F.col("p_name")).cast("long").alias("unique_chars"))
)
query("p23_user_tags", r"""WITH q AS (SELECT conv_id, turn, '<system-reminder>' || role || '</system-reminder> ' || text AS t FROM conversations)
    SELECT conv_id, turn, 'System reminder' AS label, 'reminder' AS kind, regexp_extract(t, '<system-reminder>(.*?)</system-reminder>', 1) AS content FROM q""")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.explode(P.user_tags(F.concat(F.lit("<system-reminder>"), "role", F.lit("</system-reminder> "), "text"))).alias("t")).select("conv_id", "turn", "t.label", "t.kind", "t.content")
)
query("p26_token_estimate", "WITH q AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, turn, ceil(length(text) / 4)::BIGINT AS tokens FROM q")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", P.token_estimate(F.col("text")).alias("tokens")))
query("p30_labels", "SELECT sid AS session_id, line AS line_no, CASE WHEN d < 5000 THEN 'green' WHEN d < 60000 THEN 'yellow' ELSE 'red' END AS badge FROM turns")(lambda s, d: fold_of(s, d).turns.select("session_id", "line_no", P.latency_badge(F.col("duration_ms")).alias("badge")))

# --- joins ------------------------------------------------------------------------------------------------------

query("j01_session_project_name", "SELECT sid AS session_id, CASE pid WHEN 'p0' THEN 'alpha' WHEN 'p1' THEN 'beta' ELSE pid END AS project_name FROM s")(
    lambda s, d: fold_of(s, d).sessions.join(F.broadcast(s.createDataFrame([("p0", "alpha"), ("p1", "beta")], "project_id string, name string")), "project_id", "left").select("session_id", F.coalesce("name", "project_id").alias("project_name"))
)
query("j02_model_pricing", "SELECT model, any_value(p1) AS rate_input, any_value(p2) AS rate_output FROM rm JOIN price USING (family) GROUP BY model")(
    lambda s, d: pricing.with_rates(fold_of(s, d).rolled_models.select("model", "family").distinct(), pricing.price_table(s)).select("model", "rate_input", "rate_output")
)
query("j05_subagents_in_turn", "SELECT a.sid AS session_id, line AS line_no, x.agent AS agent_id FROM a JOIN subs x ON x.pid = a.pid AND x.sid = a.sid AND first_ms >= anchor AND last_ms <= ms + d WHERE d > 0 AND d <= 600000")(
    lambda s, d: (lambda f: D.subagents_in_turns(f.turns.select("project_id", "session_id", "line_no", "prev_ts", "ts", "duration_ms"), f.subagents, F.unix_millis("prev_ts")).select("session_id", "line_no", "agent_id"))(fold_of(s, d))
)
query("j05_order_intervals", """WITH o AS (SELECT o_custkey % 5 AS k, o_orderkey, epoch_ms(o_orderdate) AS a, epoch_ms(o_orderdate) + (o_orderkey % 30) * 86400000 AS z FROM orders), e AS (SELECT o_custkey % 5 AS k, o_orderkey AS inner_key, epoch_ms(o_orderdate) AS f, epoch_ms(o_orderdate) + (o_orderkey % 7) * 3600000 AS l FROM orders WHERE o_custkey % 11 = 0)
    SELECT o_orderkey, count(*) AS held, sum(inner_key)::BIGINT AS keys FROM o JOIN e USING (k) WHERE f >= a AND l <= z GROUP BY o_orderkey""")(
    lambda s, d: (lambda o: contained(o.select("k", "o_orderkey", "a"), o.filter("o_custkey % 11 = 0").select("k", F.col("o_orderkey").alias("inner_key"), F.col("a").alias("f")), ["k"], (F.col("a"), F.col("a") + F.col("o_orderkey") % 30 * 86_400_000), (F.col("f"), F.col("f") + F.col("inner_key") % 7 * 3_600_000)))(
        table(s, d, "orders").select(F.expr("o_custkey % 5").alias("k"), "o_custkey", "o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("a"))
    ).groupBy("o_orderkey").agg(F.count("*").alias("held"), F.sum("inner_key").alias("keys"))
)
query("j08_project_stats", "WITH o AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT c_custkey, round(coalesce(t, 0), 2) AS total FROM customer LEFT JOIN o ON c_custkey = o_custkey")(
    lambda s, d: table(s, d, "customer").join(table(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))
)
query("j11_allow_deny", """WITH al AS (SELECT DISTINCT replace(p_type, ' ', '/') AS a FROM part), de AS (SELECT 'STANDARD' AS d, 0 AS dp UNION ALL SELECT 'PROMO/', 0 UNION ALL SELECT 'ECO', 0 UNION ALL SELECT DISTINCT replace(p_type, ' ', '/') || '/x', 1 FROM part WHERE p_type NOT LIKE 'E%')
    SELECT a, arg_min(d, dp) AS d FROM al JOIN de ON starts_with(a || '/', CASE WHEN d LIKE '%/' THEN d ELSE d || '/' END) OR starts_with(d || '/', a || '/') GROUP BY a""")(
    lambda s, d: (lambda types: X.allow_deny_conflicts(
        types.distinct().withColumn("pos", F.lit(0)),
        s.createDataFrame([("STANDARD", 0), ("PROMO/", 0), ("ECO", 0)], "entry string, pos int").unionByName(types.filter("entry NOT LIKE 'E%'").select(F.concat("entry", F.lit("/x")).alias("entry")).distinct().withColumn("pos", F.lit(1))),
    ))(table(s, d, "part").select(F.replace(F.col("p_type"), F.lit(" "), F.lit("/")).alias("entry"))).select("a", "d")
)
query("j12_project_semi", "WITH k AS (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM k)")(lambda s, d: table(s, d, "customer").join(table(s, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select("c_custkey"))
query("j13_novel_findings", "WITH f AS (SELECT DISTINCT event_type AS check_id, user_id::VARCHAR AS masked FROM events), old AS (SELECT DISTINCT event_type || ':' || user_id AS fingerprint FROM events WHERE event_id % 3 = 0) SELECT check_id, masked FROM f WHERE check_id || ':' || masked NOT IN (SELECT fingerprint FROM old)")(
    lambda s, d: X.novel(table(s, d, "events").select(F.col("event_type").alias("check_id"), F.col("user_id").cast("string").alias("masked")).distinct(), table(s, d, "events").filter("event_id % 3 = 0").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("fingerprint")).distinct()).select("check_id", "masked")
)
query("j16_import_closure", """WITH RECURSIVE ed AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1), c AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT root, dst, depth + 1 FROM c JOIN ed ON src = node WHERE depth < 10) SELECT root, node, depth FROM c""")(
    lambda s, d: _closure(s, d)
)


def _closure(s, d):
    shared_root(s, "closure")  # names a checkpoint folder where a local session has none
    part = table(s, d, "part")
    return X.import_depths(part.filter("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst")), part.select(F.col("p_partkey").alias("node")))


# --- search, windows, sets --------------------------------------------------------------------------------------

query("a31_search", """WITH q AS (SELECT conv_id, turn, text, strpos(lower(text), 'tion') AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE lower(text) LIKE '%tion%'), b AS (SELECT *, greatest(p - 40, 1) AS f, least(p + 84, length(text) + 1) AS t FROM q)
    SELECT conv_id AS session_id, count(*) AS matches, string_agg(CASE WHEN n <= 3 THEN CASE WHEN f > 1 THEN '…' ELSE '' END || substring(text, f, t - f) || CASE WHEN t <= length(text) THEN '…' ELSE '' END END, '|' ORDER BY n) AS snippets FROM b GROUP BY conv_id""")(
    lambda s, d: X.search(conversations(s, d), "tion").withColumn("snippets", F.array_join("snippets", "|"))
)
query("o05_session_order", "SELECT sid AS session_id, row_number() OVER (ORDER BY round(cost, 6) DESC, sid) AS place FROM s ORDER BY place LIMIT 25")(
    lambda s, d: fold_of(s, d).sessions.select("session_id", F.round("cost", 6).alias("cost")).orderBy(F.desc("cost"), "session_id").limit(25).select("session_id", F.row_number().over(W.orderBy(F.desc("cost"), "session_id")).cast("long").alias("place"))
)
query("o07_top_k", "WITH q AS (SELECT * FROM orders) SELECT o_orderkey, o_totalprice FROM q ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(lambda s, d: table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10))
query("o09_distinct", "WITH q AS (SELECT * FROM events) SELECT DISTINCT event_type, strftime(ts, '%Y-%m-%d') AS day FROM q")(lambda s, d: table(s, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct())
query("o11_flatten", "SELECT sid AS session_id, line AS line_no, tool FROM (SELECT *, 'tool' || unnest(range(1, tools + 1)) AS tool FROM a)")(lambda s, d: fold_of(s, d).assistants.select("session_id", "line_no", F.explode("tool_names").alias("tool")))
query("o12_pagination", "WITH q AS (SELECT * FROM conversations) SELECT conv_id, turn FROM q ORDER BY conv_id, turn LIMIT 20 OFFSET 40")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn").orderBy("conv_id", "turn").offset(40).limit(20))

# --- rules ------------------------------------------------------------------------------------------------------


def bodies(s, d):
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))


query("l01_instruction_rules", r"""WITH q AS (SELECT doc_id::VARCHAR AS path, text AS t, len(string_split(text, chr(10))) AS n, ceil(length(text) / 4) AS k, len(regexp_extract_all(text, '\*\.\w+')) AS g FROM documents)
    SELECT path, 'CMD001' AS check_id, 'warning' AS severity FROM q WHERE n > 200 UNION ALL SELECT path, 'CMD002', 'info' FROM q WHERE n > 100 UNION ALL SELECT path, 'CMD003', 'warning' FROM q WHERE g >= 3
    UNION ALL SELECT path, 'XCT001', 'warning' FROM q WHERE k > 2500 UNION ALL SELECT path, 'XCT002', 'error' FROM q WHERE k > 5000""")(lambda s, d: L.instructions(bodies(s, d)).select("path", "check_id", "severity"))
query("l07_skill_rules", "WITH q AS (SELECT doc_id::VARCHAR AS path, len(string_split(text, chr(10))) AS n FROM documents) SELECT path, 'SKL002' AS check_id FROM q UNION ALL SELECT path, 'SKL003' FROM q UNION ALL SELECT path, 'SKL012' FROM q WHERE n > 500")(
    lambda s, d: L.skills(bodies(s, d)).select("path", "check_id")
)
query("l10_session_rules", """SELECT check_id, sid AS path, CASE WHEN check_id = 'SES005' AND fe IN ('rateLimit', 'authFailure', 'proxyError') THEN 'error' ELSE 'warning' END AS severity FROM (
    SELECT CASE WHEN cost > 25 THEN 'SES001' WHEN inp + out > 2000000 THEN 'SES003' WHEN compactions >= 5 THEN 'SES002' WHEN has_error THEN 'SES005' WHEN gap THEN 'SES006' END AS check_id, sid, fe
    FROM s LEFT JOIN (SELECT sid, arg_min(err, line) FILTER (err IS NOT NULL) AS fe FROM a GROUP BY sid) USING (sid)
    WHERE epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - last_ms <= 7 * 86400000) WHERE check_id IS NOT NULL ORDER BY sid LIMIT 10""")(lambda s, d: L.sessions(fold_of(s, d).sessions, NOW).select("check_id", "path", "severity"))
_LINES = "WITH q AS (SELECT doc_id::VARCHAR AS path, unnest(string_split(text, chr(10))) AS v, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)"


def text_lines(s, d):
    return bodies(s, d).select("path", F.posexplode(F.split("content", "\n")).alias("p", "value")).select("path", (F.col("p") + 1).cast("long").alias("line_no"), "value")


_HITS = _LINES + r""", h AS (SELECT path, line, 'SEC002' AS check_id FROM q WHERE regexp_matches(v, '\bA(?:KIA|SIA)[A-Z0-9]{16}\b')
    UNION ALL SELECT path, line, 'SEC004' FROM q WHERE regexp_matches(v, '(?i)\b(?:api[_-]?key|token|secret)["'']?\s*[:=]\s*["'']?[A-Za-z0-9+/_.-]{16,}')
    UNION ALL SELECT path, line, 'SEC005' FROM q WHERE regexp_matches(v, '(?i)\b(?:password|passwd|pwd)["'']?\s*[:=]\s*["'']?[^\s"'']{6,}'))"""
query("l11_secret_lines", _HITS + " SELECT path, line AS line_no, check_id FROM h")(lambda s, d: L.secret_lines(text_lines(s, d)).select("path", "line_no", "check_id"))
query("l11_secret_findings", _HITS + " SELECT check_id, 'error' AS severity, path, line::INTEGER AS line FROM h")(lambda s, d: L.secrets(text_lines(s, d), first=None, per_pattern=None, total=None).select("check_id", "severity", "path", "line"))
query("l11_first_findings", _HITS + """, n AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY path, line) AS n FROM h WHERE line <= 50) SELECT check_id, path, line::INTEGER AS line FROM n WHERE n <= 3 ORDER BY path, line, check_id LIMIT 20""")(lambda s, d: L.secrets(text_lines(s, d)).select("check_id", "path", "line"))
query("a30_lint_summary", """WITH q AS (SELECT len(string_split(text, chr(10))) AS n, ceil(length(text) / 4) AS k, len(regexp_extract_all(text, '\\*\\.\\w+')) AS g, len(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '```'))) AS fences FROM documents),
    t AS (SELECT count(*) FILTER (k > 5000) + count(*) FILTER (fences % 2 = 1) AS errors, count(*) FILTER (n > 200) + count(*) FILTER (k > 2500) + count(*) FILTER (g >= 3) AS warnings, count(*) FILTER (n > 100) AS infos FROM q)
    SELECT errors, warnings, infos, errors + warnings + infos AS total, round(CASE WHEN errors + warnings + infos = 0 THEN 1 ELSE greatest(0, 1 - (3 * errors + warnings)::DOUBLE / (3 * (errors + warnings + infos))) END, 6)::DOUBLE AS score FROM t""".replace("\\\\", "\\"))(
    lambda s, d: R.lint_summary(L.instructions(bodies(s, d)))
)
query("a44_lint_by_category", "WITH q AS (SELECT len(string_split(text, chr(10))) AS n, ceil(length(text) / 4) AS k FROM documents), t AS (SELECT 'CMD' AS category, count(*) FILTER (n > 200) + count(*) FILTER (n > 100) AS findings FROM q UNION ALL SELECT 'XCT', count(*) FILTER (k > 2500) + count(*) FILTER (k > 5000) FROM q) SELECT * FROM t WHERE findings > 0")(
    lambda s, d: L.by_category(L.filtered(L.instructions(bodies(s, d)), None, "").filter("check_id <> 'CMD003'"))
)
