"""Queries of session parts, shares, exports, catalogues and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import pricing
from .functions import scalars as P
from .operators import lint as L
from .operators import records as X
from .operators import transcript as T
from .plans import derived as D
from .plans import reports as R
from .queries import NOW, fold_of, query
from .sources import catalog as C
from .sources import incremental as I
from .sources.adapter import event_records
from .sources.files import shared_root
from .table_queries import bodies, table



def _sessions(*cols):
    """The sessions' columns ``cols``; a column that is computed comes as a function, since columns need a running session."""
    return lambda s, d: fold_of(s, d).sessions.select(*(c() if callable(c) else c for c in cols))


_prices = pricing.price_table

# --- fold -------------------------------------------------------------------------------------------------------

query("w01_titles", "SELECT sid AS session_id, sid AS title FROM s")(_sessions("session_id", "title"))
query("w02_project_path", "SELECT sid AS session_id, pid AS project_path FROM s")(_sessions("session_id", "project_path"))
query("w10_post_compaction", "SELECT sid AS session_id, count(*) FILTER (post) AS post, count(*) FILTER (NOT post) AS normal FROM turns GROUP BY sid")(
    lambda s, d: fold_of(s, d).turns.groupBy("session_id").agg(F.count_if("is_post_compaction").alias("post"), F.count_if(~F.col("is_post_compaction")).alias("normal"))
)
query("w12_tool_calls", "SELECT sid AS session_id, tool_calls::BIGINT AS tool_calls, false AS is_worktree FROM s")(_sessions("session_id", lambda: F.col("tool_calls").cast("long"), "is_worktree"))
query("w19_removed_tokens", "SELECT sid AS session_id, removed AS removed_tokens FROM s")(_sessions("session_id", "removed_tokens"))
query("w20_auto_tags", "SELECT sid AS session_id, CASE WHEN pgroups > 0 THEN 'parallel-threads' ELSE '' END AS tags FROM s")(_sessions("session_id", lambda: F.array_join("tags", ",").alias("tags")))


@query("w22_rollup_totals", """SELECT s.sid AS session_id, s.inp AS input_tokens, s.out AS output_tokens, s.cr AS cache_read, (s.c5 + s.c1)::BIGINT AS cache_creation, s.msgs::BIGINT AS message_count, coalesce(m.cr, 0)::BIGINT AS cache_read_with_children
    FROM s LEFT JOIN (SELECT pid, sid, sum(cr)::BIGINT AS cr FROM rm GROUP BY pid, sid) m USING (pid, sid)""")
def w22(s, d):
    """Session totals leave the children's cache reads out; the last column holds them."""
    f = fold_of(s, d)
    whole = f.rolled_models.groupBy("project_id", "session_id").agg(F.sum("cache_read").alias("w"))
    j = f.sessions.join(whole, ["project_id", "session_id"], "left")
    return j.select("session_id", "input_tokens", "output_tokens", "cache_read", "cache_creation", F.col("message_count").cast("long"), F.coalesce("w", F.lit(0)).cast("long").alias("cache_read_with_children"))


@query("w23_full_metadata", "SELECT sid AS session_id, count(*) FILTER (kind = 'user') AS user_messages, count(*) FILTER (kind = 'assistant') AS assistant_messages, coalesce(sum(inp) FILTER (kind = 'assistant'), 0)::BIGINT AS input_tokens, coalesce(array_to_string(list_sort(list(DISTINCT model) FILTER (kind = 'assistant' AND model IS NOT NULL)), ','), '') AS models FROM r GROUP BY sid")
def w23(s, d):
    r = event_records(s, d).withColumn("cache_creation_raw", F.col("cache_5m") + F.col("cache_1h")).withColumn("parent_uuid", F.lit(None).cast("string"))
    return T.full_metadata(r).select("session_id", "user_messages", "assistant_messages", "input_tokens", F.array_join("models", ",").alias("models"))


query("w25_record_usage", "SELECT sid AS session_id, line AS line_no, CASE WHEN inp + out > 0 THEN inp + out END AS tokens FROM a")(
    lambda s, d: fold_of(s, d).assistants.select("session_id", "line_no", F.when(F.col("input_tokens") + F.col("output_tokens") > 0, F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
)

# --- reports ----------------------------------------------------------------------------------------------------

query("a06_cache_savings", "SELECT round(sum(cr) / 1e6 * 2.7, 6) AS savings, round(sum(cost) + sum(cr) / 1e6 * 2.7, 6) AS hypothetical_cost FROM s")(lambda s, d: R.cache_totals(fold_of(s, d).sessions, _prices(s)).select("savings", "hypothetical_cost"))
query("a14_compaction_cost_avoided", "SELECT round(sum(CASE WHEN compactions > 0 THEN removed / 1e6 * p1 ELSE 0 END), 6) AS cost_avoided FROM sr")(lambda s, d: R.compaction_summary(fold_of(s, d).sessions, _prices(s)).select("cost_avoided"))
query("a27_session_severity", "SELECT severity, count(*) AS sessions FROM fs GROUP BY severity")(lambda s, d: R.flagged(fold_of(s, d).sessions, NOW).groupBy("severity").agg(F.count("*").alias("sessions")))
query("a35_project_share", "SELECT pid AS project_id, round(t / sum(t) OVER () * 100, 6) AS token_share FROM (SELECT pid, sum(inp + out)::DOUBLE AS t FROM s GROUP BY pid)")(lambda s, d: D.project_breakdown(fold_of(s, d).sessions).select("project_id", "token_share"))
query("a39_compaction_impact", "SELECT round(coalesce((p - n) / nullif(n, 0), 0) * 100, 6) AS impact_pct FROM (SELECT coalesce(avg(d) FILTER (post), 0) AS p, coalesce(avg(d) FILTER (NOT post), 0) AS n FROM turns)")(lambda s, d: R.post_vs_normal(fold_of(s, d).turns).select("impact_pct"))
query("a40_cache_savings_pct", "SELECT floor(v / (c + v) * 100 + 0.5)::BIGINT AS savings_pct FROM (SELECT sum(cr) / 1e6 * 2.7 AS v, sum(cost) AS c FROM s)")(lambda s, d: R.cache_totals(fold_of(s, d).sessions, _prices(s)).select(F.col("savings_pct").cast("long")))


def _heads(s, d):
    """Files with front matter, from ``part``."""
    content = F.concat(F.lit("---\nname: "), "p_name", F.lit('\ndescription: "'), "p_type", F.lit('"\n---\nBody '), "p_brand")
    return table(s, d, "part").select("p_partkey", F.concat(F.lit("skills/s"), F.col("p_partkey").cast("string"), F.lit("/SKILL.md")).alias("path"), content.alias("content"))


query("a43_skill_total", "WITH q AS (SELECT sum(length(p_type)) AS n FROM part) SELECT 'SKL_AGG' AS check_id, 'warning' AS severity FROM q WHERE n > 16000")(lambda s, d: L.skill_total(_heads(s, d)).select("check_id", "severity"))
query("d09_slowest_in_project", "SELECT sid AS session_id, line AS line_no, d AS duration_ms FROM turns WHERE pid = 'p1' ORDER BY d DESC, sid, line LIMIT 20")(
    lambda s, d: (lambda f: R.slowest_turns(f.turns.filter("project_id = 'p1'"), f.sessions))(fold_of(s, d)).select("session_id", "line_no", "duration_ms")
)

# --- filters and scalars ----------------------------------------------------------------------------------------

query("f06_projects", "SELECT sid AS session_id FROM s WHERE pid IN ('p2', 'p3')")(lambda s, d: R.in_range(fold_of(s, d).sessions, projects=["p2", "p3"]).select("session_id"))
query("f09_sidebar_search", "SELECT sid AS session_id FROM s WHERE pid = 'p2' OR contains(sid, 'p1-2024-01-0')")(
    lambda s, d: X.sidebar(fold_of(s, d).sessions, s.createDataFrame([("p0", "alpha"), ("p1", "beta"), ("p2", "Archive of P1-2024-01-0"), ("p3", "delta")], "id string, name string"), "p1-2024-01-0").select("session_id")
)
query("f10_catalog_search", "WITH q AS (SELECT * FROM part) SELECT p_partkey FROM q WHERE contains(lower(p_name), 'bl') OR contains(lower(p_type), 'steel')")(
    lambda s, d: table(s, d, "part").filter(X.contains(F.col("p_name"), "BL") | X.contains(F.col("p_type"), "Steel")).select("p_partkey")
)
query("f11_lint_filter", "WITH q AS (SELECT doc_id::VARCHAR AS path, ceil(length(text) / 4) AS k FROM documents) SELECT path, 'XCT002' AS check_id FROM q WHERE k > 5000")(lambda s, d: L.filtered(L.instructions(bodies(s, d)), "error", "XCT").select("path", "check_id"))
query("p08_active_pricing", "SELECT sid AS session_id, model, CASE family WHEN 'sonnet-4-5' THEN 9.0 ELSE p1 END::DOUBLE AS rate_input, p2 AS rate_output FROM sm JOIN price USING (family)")(
    lambda s, d: pricing.with_rates(fold_of(s, d).session_models, _prices(s, {"sonnet-4-5": {"rate_input": 9.0}})).select("session_id", "model", "rate_input", "rate_output")
)
query("p14_resolve_range", "SELECT sid AS session_id FROM s WHERE last_ts >= TIMESTAMP '2024-01-24' AND last_ts <= TIMESTAMP '2024-01-30 23:59:59.999'")(lambda s, d: R.in_range(fold_of(s, d).sessions, *P.resolve_range("7d", NOW)).select("session_id"))
query("p15_day_keys", "WITH q AS (SELECT min(ts::DATE) AS a, max(ts::DATE) AS b FROM events) SELECT strftime(t, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS t FROM q)")(
    lambda s, d: table(s, d, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).select(F.explode(P.day_keys(F.col("a"), F.col("b"))).alias("day"))
)
query("p17_frontmatter", "WITH q AS (SELECT * FROM part) SELECT p_partkey, p_name AS name, p_type AS description, 'Body ' || p_brand AS body FROM q")(
    lambda s, d: _heads(s, d).withColumn("f", P.frontmatter(F.col("content"))).select("p_partkey", F.try_element_at("f.meta", F.lit("name")).alias("name"), F.try_element_at("f.meta", F.lit("description")).alias("description"), "f.body")
)
query("p18_plan_title", "WITH q AS (SELECT * FROM part) SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Plan ' || p_partkey END AS title FROM q")(
    lambda s, d: table(s, d, "part").select("p_partkey", P.plan_title(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\n## "), "p_name", F.lit("\nmore"))).otherwise("more"), F.concat(F.lit("plan-"), F.col("p_partkey").cast("string"))).alias("title"))
)
query("p24_colour", """WITH q AS (SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ''), lambda x: ascii(x)::BIGINT), lambda h, x: (h * 31 + x + 2147483648 + 137438953472) % 4294967296 - 2147483648) AS h FROM part)
    SELECT p_partkey, (abs(h) % 8)::BIGINT AS colour FROM q""")(lambda s, d: table(s, d, "part").select("p_partkey", P.colour_index(F.col("p_name"), 8).cast("long").alias("colour")))
query("p25_relative_days", "SELECT sid AS session_id, CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 7 THEN n || 'd ago' ELSE day END AS label FROM (SELECT *, date_diff('day', last_ts::DATE, DATE '2024-01-30') AS n FROM s)")(
    _sessions("session_id", lambda: P.relative_days(F.col("last_ts"), F.lit("2024-01-30").cast("date")).alias("label"))
)
query("p27_balanced_glob", "WITH q AS (SELECT * FROM part) SELECT p_partkey, p_partkey % 6 IN (0, 5) AS valid FROM q")(
    lambda s, d: table(s, d, "part").select("p_partkey", P.balanced_glob(F.get(F.array(F.concat("p_brand", F.lit("/**/*.{ts,js}")), F.concat(F.lit("a["), "p_brand"), F.lit("  "), F.concat(F.lit("}"), "p_brand", F.lit("{")), F.concat(F.lit("["), "p_brand", F.lit("}")), F.concat(F.lit("{"), "p_brand", F.lit("[x]y}"))), (F.col("p_partkey") % 6).cast("int"))).alias("valid"))
)
query("p28_safe_div", "WITH q AS (SELECT c_nationkey, sum(c_acctbal) AS n, count(*) FILTER (c_acctbal > 9000) AS k FROM customer GROUP BY c_nationkey) SELECT c_nationkey, round(CASE WHEN k > 0 THEN n / k ELSE 0 END, 4) AS ratio FROM q")(
    lambda s, d: table(s, d, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("n"), F.count_if(F.col("c_acctbal") > 9000).alias("k")).select("c_nationkey", F.round(P.safe_div(F.col("n"), F.col("k")), 4).alias("ratio"))
)
query("p29_highlight", "WITH q AS (SELECT conv_id, turn, text, strpos(lower(text), 'the') AS p FROM conversations) SELECT conv_id, turn, substring(text, 1, p - 1) AS before, substring(text, p, 3) AS hit, substring(text, p + 3) AS after FROM q WHERE p > 0")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", P.highlight(F.col("text"), "The").alias("h")).filter("h IS NOT NULL").select("conv_id", "turn", "h.before", "h.hit", "h.after")
)
query("p31_health_label", "WITH q AS (SELECT c_custkey, floor(c_acctbal / 10000 * 100 + 0.5) AS p FROM customer) SELECT c_custkey, CASE WHEN p >= 80 THEN 'Excellent' WHEN p >= 50 THEN 'Good' WHEN p >= 25 THEN 'Fair' ELSE 'Poor' END AS label FROM q")(
    lambda s, d: table(s, d, "customer").select("c_custkey", P.health_label(F.col("c_acctbal") / 10000).alias("label"))
)
query("p32_model_label", "SELECT sid AS session_id, model, CASE WHEN family = 'unknown' THEN 'Claude' ELSE upper(family[1]) || split_part(family, '-', 1)[2:] || ' ' || replace(substring(family, strpos(family, '-') + 1), '-', '.') END AS label FROM sm")(
    lambda s, d: fold_of(s, d).session_models.select("session_id", "model", P.model_label(F.col("family")).alias("label"))
)

# --- joins ------------------------------------------------------------------------------------------------------


@query("j03_tool_results", "WITH q AS (SELECT l_orderkey, arg_max(l_returnflag, l_linenumber * 1000 + ascii(l_returnflag)) AS result FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS id, result FROM orders LEFT JOIN q ON l_orderkey = o_orderkey")
def j03(s, d):
    key = lambda c: (F.col(c) % 100).cast("string")
    calls = table(s, d, "orders").select(key("o_orderkey").alias("session_id"), F.lit(0).cast("long").alias("line_no"), F.lit(0).alias("pos"), F.lit("tool_use").alias("type"), F.col("o_orderkey").cast("string").alias("id"))
    results = table(s, d, "lineitem").select(key("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("long").alias("line_no"), F.ascii("l_returnflag").alias("pos"), F.lit("tool_result").alias("type"), F.col("l_orderkey").cast("string").alias("tool_use_id"), F.col("l_returnflag").alias("content"), F.lit(False).alias("is_error"))
    return X.with_results(calls.unionByName(results, allowMissingColumns=True)).filter("type = 'tool_use'").select(F.col("id").cast("long"), "result")


query("j06_turn_by_timestamp", "SELECT a.sid AS session_id, a.line AS line_no, t.line AS turn_line FROM a LEFT JOIN (SELECT pid, sid, ts, max(line) AS line FROM turns GROUP BY pid, sid, ts) t USING (pid, sid, ts)")(
    lambda s, d: (lambda f: X.turn_at(f.assistants.select("project_id", "session_id", "ts", "line_no"), f.turns))(fold_of(s, d)).select("session_id", "line_no", "turn_line")
)
query("j07_lint_meta", r"""WITH q AS (SELECT doc_id::VARCHAR AS path, ceil(length(text) / 4) AS k FROM documents), f AS (SELECT path, 'XCT001' AS check_id FROM q WHERE k > 2500 UNION ALL SELECT path, 'XCT002' FROM q WHERE k > 5000) SELECT path, check_id, 'XCT' AS category FROM f""")(
    lambda s, d: L.filtered(L.instructions(bodies(s, d)), None, "XCT").join(F.broadcast(L.metadata(s)), "check_id", "left").select("path", "check_id", "category")
)


@query("j10_session_tags", "SELECT sid AS session_id, CASE WHEN pid = 'p1' THEN CASE WHEN pgroups > 0 THEN 'parallel-threads,' ELSE '' END || 'starred' WHEN pgroups > 0 THEN 'parallel-threads' ELSE '' END AS tags FROM s")
def j10(s, d):
    x = fold_of(s, d).sessions
    stored = x.filter("project_id = 'p1'").select("session_id", F.concat("tags", F.array(F.lit("starred"))).alias("tags"))
    return X.with_tags(x, stored).select("session_id", F.array_join("tags", ",").alias("tags"))


def _files(s, d):
    """A listing: path, time and size of a file per order; an older one knows of no file of the last order status."""
    now = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit(NOW).alias("mtime"), F.col("o_custkey").cast("long").alias("size"), "o_orderstatus")
    then = now.withColumn("size", F.col("size") + F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).filter("o_orderstatus <> 'P'")
    return now.select("path", "mtime", "size"), then.select("path", "mtime", "size"), now.filter("o_orderstatus <> 'F'").select("path")


query("j14_changed_files", "WITH q AS (SELECT * FROM orders) SELECT o_orderkey::VARCHAR AS path FROM q WHERE o_orderstatus IN ('O', 'P')")(lambda s, d: (lambda f: I.changed(f[0], f[1]).select("path"))(_files(s, d)))
query("s10_prune_manifest", "WITH q AS (SELECT * FROM orders) SELECT o_orderkey::VARCHAR AS path FROM q WHERE o_orderstatus = 'O'")(lambda s, d: (lambda f: I.pruned(f[1], f[2]).select("path"))(_files(s, d)))
query("s12_upsert", "WITH q AS (SELECT * FROM orders) SELECT o_orderkey::VARCHAR AS path, o_custkey::BIGINT AS size FROM q")(lambda s, d: (lambda f: I.upsert(f[1], f[0], ["path"]).select("path", "size"))(_files(s, d)))
query("j15_plan_projects", "WITH q AS (SELECT DISTINCT p_type AS slug, 'p' || p_partkey % 4 AS project_id FROM part) SELECT slug, project_id FROM q WHERE contains(slug, 'STEEL')")(
    lambda s, d: C.plan_projects(
        table(s, d, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 4).cast("string")).alias("project_id"), F.concat(F.lit('{"slug": "'), "p_type", F.lit('"}')).alias("value")),
        table(s, d, "part").select(F.col("p_type").alias("slug")).distinct().filter("contains(slug, 'STEEL')"),
    )
)
query("j17_session_lookup", "SELECT sid AS session_id, msgs::BIGINT AS message_count FROM s WHERE sid = 'p1-2024-01-05'")(lambda s, d: fold_of(s, d).sessions.filter("session_id = 'p1-2024-01-05'").select("session_id", F.col("message_count").cast("long")))

# --- exports ----------------------------------------------------------------------------------------------------


def _transcripts(s, d):
    """The conversations as records with one text block a turn."""
    none = lambda kind="string": F.lit(None).cast(kind)
    block = F.struct(F.lit("text").alias("type"), F.lit(0).alias("pos"), F.col("text"), none().alias("thinking"), none().alias("name"), none().alias("input"), none().alias("id"), none().alias("tool_use_id"), none().alias("content"), none("boolean").alias("is_error"))
    return table(s, d, "conversations").select(
        F.lit("p").alias("project_id"), F.col("conv_id").cast("string").alias("session_id"), none().alias("agent_id"), none().alias("uuid"), F.col("turn").cast("long").alias("line_no"), F.col("role").alias("kind"), none().alias("ts_str"), none().alias("model"),
        F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens"), "text", F.array(block).alias("blocks"),
    )


query("k02_csv_rows", """WITH q AS (SELECT conv_id::VARCHAR AS session_id, turn::BIGINT AS line_no, role, coalesce(text, '') AS t FROM conversations WHERE role IN ('user', 'assistant'))
    SELECT session_id, line_no, ',' || role || ',text,' || CASE WHEN contains(t, '"') OR contains(t, ',') OR contains(t, chr(10)) THEN '"' || replace(t, '"', '""') || '"' ELSE t END || ',,0,0,' AS row FROM q""")(lambda s, d: T.csv_rows(_transcripts(s, d)).select("session_id", "line_no", "row"))
query("k03_markdown", """WITH q AS (SELECT conv_id::VARCHAR AS session_id, turn, text, CASE role WHEN 'user' THEN '## User' ELSE '## Assistant' END || chr(10) || chr(10) || text AS part FROM conversations WHERE role IN ('user', 'assistant'))
    SELECT session_id, '# Session ' || session_id || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY turn, text) || chr(10) AS document FROM q WHERE part IS NOT NULL GROUP BY session_id""")(lambda s, d: T.markdown(_transcripts(s, d)))

# --- orders, sets and rules -------------------------------------------------------------------------------------

query("o06_session_sort", "SELECT sid AS session_id, msgs::BIGINT AS message_count FROM s ORDER BY msgs DESC, sid")(lambda s, d: fold_of(s, d).sessions.select("session_id", F.col("message_count").cast("long")).orderBy(F.desc("message_count"), "session_id"))
query("o01_first_rows", "WITH q AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) SELECT conv_id, turn, text FROM q WHERE n <= 3")(
    lambda s, d: table(s, d, "conversations").withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text"))).filter("n <= 3").select("conv_id", "turn", "text")
)
query("o08_union", "SELECT sid AS session_id, 'session' AS part, cost_r AS cost FROM (SELECT sid, round(cost - sub_cost, 6) AS cost_r FROM s) UNION ALL SELECT sid, agent, round(cost, 6) FROM subs")(
    lambda s, d: (lambda f: f.sessions.select("session_id", F.lit("session").alias("part"), F.round(F.col("cost") - F.col("subagent_cost"), 6).alias("cost")).unionByName(f.subagents.select("session_id", F.col("agent_id").alias("part"), F.round("cost", 6).alias("cost"))))(fold_of(s, d))
)
query("o10_except", "WITH q AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) SELECT k FROM q")(lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k")).distinct().join(table(s, d, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti"))
query("l02_code_fences", r"""WITH q AS (SELECT doc_id::VARCHAR AS path, string_split(text, chr(10)) AS l FROM documents), f AS (SELECT path, list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '```')) AS fences FROM q)
    SELECT path, fences[len(fences)]::INTEGER AS line FROM f WHERE len(fences) % 2 = 1""")(lambda s, d: L.filtered(L.instructions(bodies(s, d)), None, "CMD006").select("path", "line"))


@query("l05_deep_imports", "WITH q AS (SELECT p_partkey AS k FROM part), z AS (SELECT max(k) AS m FROM q) SELECT 'd' || k % 7 || '/f' || k || '.md' AS path, 'CMD_IMPORT' AS check_id FROM q, z WHERE least(m + 1, (k // 10 + 1) * 10) - k > 5")
def l05(s, d):
    """Chains of up to ten files that import the next one by relative and absolute paths; a chain's last file, and a missing one, are steps."""
    shared_root(s, "closure")  # names a checkpoint folder where a local session has none
    k = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("d"), (n % 7).cast("string"), F.lit("/f"), n.cast("string"), F.lit(".md"))
    target = F.concat(F.when(k % 3 == 0, "  /root/").otherwise(" ../x/./../"), name(k + 1))
    content = F.concat(F.lit("text\n @import indented\n"), F.when(k % 10 < 9, F.concat(F.lit("@import"), target, F.lit(" \r\n@import ./"), F.regexp_extract(name(k), "[^/]*$", 0))).otherwise(F.concat(F.lit("@import gone.md"))))
    docs = table(s, d, "part").select(F.concat(F.lit("/root/"), name(k)).alias("path"), content.alias("content"))
    chains = X.import_chains(docs, docs).withColumn("root", F.substring("root", 7, 1 << 20))
    return L.deep_imports(chains).select("path", "check_id")
