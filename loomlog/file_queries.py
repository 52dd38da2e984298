"""Queries that write files and read them back: transcripts, exports, configuration, streams; with their SQL.

Transcripts are made of ``conversations``: project ``-home-me-proj<n>``, a session for each conversation, blank, broken and repeated lines,
tool calls with results in carrier lines, synthetic turns, child transcripts. :data:`LINES` is what SQL knows of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import pricing
from .functions import scalars as P
from .operators import lint as L
from .operators import records as X
from .operators import search as Q
from .operators import transcript as T
from .operators.fold import Fold, visible
from .queries import query
from .sources import catalog as C
from .sources import growing
from .sources import incremental as I
from .sources import transcripts as S
from .sources.files import kept, shared_root, write_lines
from .streaming import tail
from .streaming.live import keep_state, live_changes, secret_alerts
from .table_queries import table

LINES = """WITH q AS (SELECT conv_id AS c, turn AS t, role, coalesce(text, '') AS x, '-home-me-proj' || (conv_id % 4) AS pid, 'c' || conv_id AS sid, CASE WHEN turn = 0 THEN 1 ELSE turn + 4 END AS line,
    role = 'user' AND turn % 4 = 2 AND conv_id % 2 = 0 AS carrier, role = 'assistant' AND conv_id % 5 = 4 AS synthetic FROM conversations)
"""


def _json(c):
    """A column's value as JSON."""
    return F.substring(F.to_json(F.struct(c.alias("a"))), 6, 1 << 30).substr(F.lit(1), F.char_length(F.to_json(F.struct(c.alias("a")))) - 6)


def _rows(s, d, keep=None) -> DataFrame:
    """(path, line_no, value): the lines of all transcript files, or of the conversations that ``keep`` chooses."""
    q = table(s, d, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "role", F.coalesce("text", F.lit("")).alias("x"))
    q = q.filter(keep) if keep is not None else q
    text = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    n = lambda c: F.col(c).cast("string")
    call = text("u", n("c"), "-")
    chunk = lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))
    result = F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), text(call, (F.col("t") - 1).cast("string")).alias("tool_use_id"), F.array(chunk(text("out", n("t"))), chunk(F.substring("x", 1, 10))).alias("content"), (F.col("c") % 10 == 0).alias("is_error"))))
    tool = F.when(F.col("c") % 3 == 0, "Read").when(F.col("c") % 3 == 1, "Bash").otherwise("Edit")
    use = text('[{"type":"text","text":', _json(F.col("x")), '},{"type":"thinking","thinking":"hm"},{"type":"tool_use","id":"', call, n("t"), '","name":"', tool, '","input":{"file_path":"f', (F.col("c") % 7).cast("string"), '"}}]')
    carrier = (F.col("role") == "user") & (F.col("t") % 4 == 2) & (F.col("c") % 2 == 0)
    content = F.when(F.col("role") == "assistant", use).when(carrier, result).otherwise(_json(F.col("x")))
    model = F.when(F.col("role") == "assistant", F.when(F.col("c") % 5 == 4, "<synthetic>").otherwise("x-sonnet-4-5"))
    usage = F.when(F.col("role") == "assistant", text(',"model":"', model, '","usage":{"input_tokens":', F.char_length("x").cast("string"), ',"output_tokens":', n("t"), "}")).otherwise("")
    more = F.when(F.col("role") == "system", text(',"subtype":"compact_boundary","compactMetadata":{"preTokens":', (F.col("c") + 1000).cast("string"), "}")).when(F.col("role") == "user", text(',"cwd":"/home/me/proj', (F.col("c") % 4).cast("string"), '","slug":"plan-', (F.col("c") % 3).cast("string"), '"')).otherwise("")
    at = text("2024-01-", F.lpad((F.col("c") % 28 + 1).cast("string"), 2, "0"), "T00:", F.lpad(n("t"), 2, "0"), ":00.000Z")
    line = lambda prefix: text('{"type":"', F.col("role"), '","uuid":"', prefix, n("c"), "-", n("t"), '","timestamp":"', at, '"', more, ',"message":{"role":"', F.col("role"), '","content":', content, usage, "}}")
    folder = text("projects/-home-me-proj", (F.col("c") % 4).cast("string"), "/c", n("c"))
    first = F.filter(F.array(F.struct(F.lit(1).alias("o"), F.lit("").alias("v")), F.struct(F.lit(2).alias("o"), F.lit("{broken").alias("v")), F.struct(F.lit(3).alias("o"), line("r").alias("v"))), lambda _: F.col("t") == 0)
    own = q.select(text(folder, ".jsonl").alias("path"), "t", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("o"), line("r").alias("v"))), first)).alias("m")).select("path", (F.col("t") * 10 + F.col("m.o")).alias("line_no"), F.col("m.v").alias("value"))
    child = q.filter("c % 3 = 0 AND t <= 1").select(F.explode(F.array(text(folder, "/subagents/agent-k", n("c"), ".jsonl"), text(folder, "/subagents/agent-compact-", n("c"), ".jsonl"))).alias("path"), F.col("t").alias("line_no"), line("k").alias("value"))
    return own.unionByName(child)


def root_of(s, d) -> str:
    """The transcripts, written once for each query."""
    root = shared_root(s, "transcripts")
    write_lines(_rows(s, d), root)
    return root


def _records(s, d) -> DataFrame:
    return S.read_records(s, root_of(s, d))


def _own(s, d) -> DataFrame:
    """Records of sessions themselves, without the repeated first line."""
    return _records(s, d).filter("agent_id IS NULL AND line_no <> 4")


def _fold(s, d) -> Fold:
    return Fold(kept(_records(s, d), "records"), pricing.price_table(s))


# --- scan and discovery -----------------------------------------------------------------------------------------

query("s01_scan_jsonl", LINES + "SELECT sid AS session_id, '' AS agent_id, count(*) + 1 AS lines, max(line) AS last_line FROM q GROUP BY sid UNION ALL SELECT sid, 'k' || c, count(*), max(t) + 1 FROM q WHERE c % 3 = 0 AND t <= 1 GROUP BY sid, c")(
    lambda s, d: S.parse(S.scan_lines(s, root_of(s, d))).groupBy("session_id", F.coalesce("agent_id", F.lit("")).alias("agent_id")).agg(F.count("*").alias("lines"), F.max("line_no").alias("last_line"))
)
query("s02_project_dirs", LINES + "SELECT DISTINCT pid AS project_id FROM q")(lambda s, d: S.scan_lines(s, root_of(s, d)).select("project_id").distinct())
query("s03_session_files", LINES + "SELECT DISTINCT pid AS project_id, sid AS session_id FROM q")(lambda s, d: S.scan_lines(s, root_of(s, d)).filter("agent_id IS NULL").select("project_id", "session_id").distinct())
query("s04_subagent_files", LINES + "SELECT DISTINCT sid AS session_id, 'k' || c AS agent_id FROM q WHERE c % 3 = 0")(lambda s, d: S.scan_lines(s, root_of(s, d)).filter("agent_id IS NOT NULL").select("session_id", "agent_id").distinct())
query("s05_project_cwd", LINES + "SELECT DISTINCT pid AS project_id, '/home/me/proj' || c % 4 AS cwd FROM q WHERE role = 'user' AND t = 0")(lambda s, d: S.head_cwds(growing.heads(s, root_of(s, d))))
query("s06_scan_projects", LINES + "SELECT pid AS id, 'proj' || any_value(c % 4) AS name, '/home/me/proj' || any_value(c % 4) AS path, count(DISTINCT sid) AS session_count FROM q GROUP BY pid")(lambda s, d: S.projects(_fold(s, d).sessions).select("id", "name", "path", "session_count"))
query("s07_project_sessions", LINES + "SELECT sid AS session_id, '2024-01-' || lpad((c % 28 + 1)::VARCHAR, 2, '0') || ' 00:' || lpad(max(t)::VARCHAR, 2, '0') AS last_time FROM q WHERE pid = '-home-me-proj1' GROUP BY sid, c")(
    lambda s, d: _fold(s, d).sessions.filter("project_id = '-home-me-proj1' AND last_ts IS NOT NULL").orderBy(F.desc("last_ts"), "session_id").select("session_id", F.date_format("last_ts", "yyyy-MM-dd HH:mm").alias("last_time"))
)
query("s08_project_details", LINES + "SELECT DISTINCT pid AS id, '/home/me/proj' || c % 4 AS path, 'proj' || c % 4 AS name, true AS has_cwd FROM q")(lambda s, d: (lambda f: S.project_details(f.sessions, S.project_cwds(f.records)))(_fold(s, d)))


@query("s09_incremental_refresh", LINES + "SELECT sid AS session_id, count(*) FILTER (role IN ('user', 'assistant') AND NOT carrier AND NOT synthetic) + CASE WHEN c % 3 = 0 THEN count(*) FILTER (t <= 1 AND role IN ('user', 'assistant') AND NOT synthetic) ELSE 0 END AS messages FROM q GROUP BY sid, c")
def s09(s, d):
    """A store that first sees four fifths of the sessions, then all: the second refresh reads the new files only."""
    root, store = shared_root(s, "transcripts"), shared_root(s, "store")

    def build(path, keys):
        return visible(S.records(S.parse(S.scan_lines(s, path) if keys is None else growing.session_lines(keys, path)))).groupBy("project_id", "session_id").agg(F.count_if(F.col("kind").isin("user", "assistant")).alias("messages"))

    for part in ("c % 5 <> 0", "c % 5 = 0"):
        write_lines(_rows(s, d, part), root)
        sessions = I.refresh(s, root, store, build)
    return sessions.select("session_id", "messages")


# --- records ----------------------------------------------------------------------------------------------------

query("f03_is_carrier", LINES + "SELECT sid AS session_id, line AS line_no FROM q WHERE carrier")(lambda s, d: _own(s, d).filter("kind = 'carrier'").select("session_id", "line_no"))
query("f04_is_synthetic", LINES + "SELECT sid AS session_id, line AS line_no FROM q WHERE synthetic")(lambda s, d: _own(s, d).filter("kind = 'synthetic'").select("session_id", "line_no"))
query("p03_extract_text", LINES + "SELECT sid AS session_id, line AS line_no, CASE WHEN carrier THEN '' ELSE x END AS text FROM q WHERE role <> 'system'")(lambda s, d: _own(s, d).filter("type <> 'system'").select("session_id", "line_no", "text"))
query("p04_parse_usage", LINES + "SELECT sid AS session_id, line AS line_no, CASE WHEN role = 'assistant' THEN length(x) ELSE 0 END AS input_tokens, CASE WHEN role = 'assistant' THEN t ELSE 0 END AS output_tokens FROM q")(lambda s, d: _own(s, d).select("session_id", "line_no", "input_tokens", "output_tokens"))
query("p05_normalise_blocks", LINES + "SELECT sid AS session_id, line AS line_no, CASE WHEN role = 'assistant' THEN 'text,thinking,tool_use' WHEN carrier THEN 'tool_result' ELSE 'text' END AS types FROM q")(
    lambda s, d: _own(s, d).select("session_id", "line_no", F.array_join(F.transform("blocks", lambda b: b["type"]), ",").alias("types"))
)
query("w24_tool_result_text", LINES + "SELECT sid AS session_id, line AS line_no, 'out' || t || chr(10) || substring(x, 1, 10) AS content FROM q WHERE carrier")(lambda s, d: _own(s, d).filter("kind = 'carrier'").select("session_id", "line_no", F.col("blocks")[0]["content"].alias("content")))
_CALLS = LINES + ", k AS (SELECT CASE c % 3 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' ELSE 'Edit' END AS tool, 'f' || c % 7 AS file, c % 10 = 0 AND EXISTS (SELECT 1 FROM q r WHERE r.c = q.c AND r.t = q.t + 1 AND r.carrier) AS failed FROM q WHERE role = 'assistant' AND NOT synthetic)"
query("a45_tool_report", _CALLS + " SELECT tool, count(*) AS calls, count(*) FILTER (failed) AS errors, count(DISTINCT file) AS files, round(count(*) FILTER (failed) / count(*), 9) AS error_rate FROM k GROUP BY tool")(
    lambda s, d: X.tool_report(X.tool_calls(T.block_rows(_records(s, d))), "tool").withColumn("error_rate", F.round("error_rate", 9))
)
query("a45_top_files", _CALLS + " SELECT file, count(*) AS calls FROM k GROUP BY file")(lambda s, d: X.tool_calls(T.block_rows(_records(s, d))).groupBy("file").agg(F.count("*").alias("calls")))
query("k01_export_json", LINES + "SELECT sid AS id, pid AS project_id, count(*) FILTER (NOT carrier AND NOT synthetic) AS records FROM q GROUP BY sid, pid")(
    lambda s, d: (lambda f: T.json_documents(f.records, f.sessions))(_fold(s, d)).select(F.from_json("document", "id string, projectId string, records array<struct<line_no: long>>").alias("j")).select("j.id", F.col("j.projectId").alias("project_id"), F.size("j.records").cast("long").alias("records"))
)


@query("k04_write_export", LINES + "SELECT 'csv' AS form, 1 + sum(CASE WHEN role = 'assistant' AND NOT synthetic THEN 3 WHEN role = 'user' AND NOT carrier THEN 1 + len(x) - len(replace(x, chr(10), '')) ELSE 0 END) + sum(CASE WHEN role = 'assistant' AND NOT synthetic THEN len(x) - len(replace(x, chr(10), '')) ELSE 0 END) AS lines FROM q WHERE sid = 'c2'")
def k04(s, d):
    """One session's transcript as CSV, read back as lines."""
    f, path = _fold(s, d), shared_root(s, "export")
    T.write_export(f.records, f.sessions, "c2", "csv", path)
    return s.read.text(path).agg(F.count("*").alias("lines")).select(F.lit("csv").alias("form"), "lines")


# --- configuration ----------------------------------------------------------------------------------------------


def _settings(s, d) -> DataFrame:
    """(c_custkey, content, general, project): two settings files for each customer."""
    k = F.col("c_custkey")
    n = lambda x: x.cast("string")
    general = F.concat(F.lit('{"env":{"A":"'), n(k), F.lit('","B":"1"},"permissions":{"allow":["src/x'), n(k % 3), F.lit('"],"deny":["src"]},"hooks":{"Stop":[{"command":"done"}],"Start":[{"matcher":"m'), n(k % 5), F.lit('","hooks":[{"command":"a"},{"command":"b"}]}]},"disableSkillShellExecution":'), F.when(k % 3 == 0, "true").otherwise("false"), F.lit("}"))
    env = F.concat(F.lit('"env":{"B":"'), F.when(k % 2 == 0, "false").otherwise("true"), F.lit('"'), F.when(k % 6 == 0, f',"{L.SERVERS_ENABLED}":"false"').otherwise(""), F.when(k % 5 == 0, f',"{L.ENV_SCRUB}":"1"').otherwise(""), F.lit("}"))
    more = F.concat(F.when(k % 7 == 0, ',"sandbox":{"enableWeakerNestedSandbox":false},"plugins":[{"name":"p","version":"1"}],"allowedChannelPlugins":["c"]').otherwise(',"sandbox":{}'), F.when(k % 4 == 0, ',"skipDangerousModePermissionPrompt":true').otherwise(""), F.when(k % 8 == 0, ',"profile":{"name":"me"},"marketplaces":[{"name":"m","url":"u"}]').otherwise(""))
    project = F.concat(F.lit("{"), env, F.lit(',"permissions":{"allow":["srcfoo/'), n(k % 3), F.lit('"],"deny":["'), F.when(k % 2 == 0, "src/x1/").otherwise("lib"), F.lit('"]}'), more, F.lit("}"))
    parsed = lambda c: F.from_json(c, C.SETTINGS)
    return table(s, d, "customer").select(k, general.alias("content"), parsed(general).alias("general"), parsed(project).alias("project"))


def _merged(s, d) -> DataFrame:
    return _settings(s, d).select("c_custkey", F.col("c_custkey").cast("string").alias("path"), C.merged_settings(F.col("general"), F.col("project")).alias("s"))


query("s14_merged_settings", """WITH q AS (SELECT c_custkey AS k FROM customer) SELECT k AS c_custkey, k::VARCHAR AS a, CASE WHEN k % 2 = 0 THEN 'false' ELSE 'true' END AS b, 'src/x' || k % 3 || ',srcfoo/' || k % 3 AS allow, 'src,' || CASE WHEN k % 2 = 0 THEN 'src/x1/' ELSE 'lib' END AS deny,
    k % 3 = 0 AS no_shell, CASE WHEN k % 4 = 0 THEN true END AS bare, CASE WHEN k % 7 = 0 THEN false END AS weaker, CASE WHEN k % 8 = 0 THEN 'me' END AS profile FROM q""")(
    lambda s, d: _merged(s, d).select("c_custkey", F.col("s.env")["A"].alias("a"), F.col("s.env")["B"].alias("b"), F.array_join("s.permissions.allow", ",").alias("allow"), F.array_join("s.permissions.deny", ",").alias("deny"), F.col("s.disableSkillShellExecution").alias("no_shell"), F.col("s.skipDangerousModePermissionPrompt").alias("bare"), F.col("s.sandbox.enableWeakerNestedSandbox").alias("weaker"), F.col("s.profile.name").alias("profile"))
)
query("s15_hooks", "WITH q AS (SELECT c_custkey::VARCHAR AS path, c_custkey % 5 AS m FROM customer) SELECT path, 'Stop' AS event, '' AS matcher, 'done' AS command FROM q UNION ALL SELECT path, 'Start', 'm' || m, unnest(['a', 'b']) FROM q")(
    lambda s, d: C.hooks(C.settings(_settings(s, d).select(F.col("c_custkey").cast("string").alias("path"), "content"))).select("path", "event", "matcher", "command")
)
query("s16_extended_config", "WITH q AS (SELECT c_custkey AS k FROM customer) SELECT k::VARCHAR AS path, CASE WHEN k % 7 = 0 THEN 'p' ELSE '' END AS plugins, CASE WHEN k % 8 = 0 THEN 'm=u' ELSE '' END AS marketplaces, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS channels, k % 4 = 0 AS bare, k % 3 = 0 AS no_shell, 2 + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS env FROM q")(
    lambda s, d: C.extended_config(_merged(s, d)).select("path", F.array_join("plugins.name", ",").alias("plugins"), F.array_join(F.transform("marketplaces", lambda m: F.concat(m["name"], F.lit("="), m["url"])), ",").alias("marketplaces"), F.size("allowedChannelPlugins").alias("channels"), F.col("skipDangerousModePermissionPrompt").alias("bare"), F.col("disableSkillShellExecution").alias("no_shell"), F.size("env").alias("env"))
)


def _servers(s, d) -> tuple[DataFrame, DataFrame]:
    """Server entries, and a log of two lines a part: what became of its server, and for some the rest of an error or capabilities."""
    k = F.col("k")
    n = lambda c: c.cast("string")
    p = table(s, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("srv"), n(F.col("p_partkey") % 50)).alias("name"))
    command = F.concat(F.lit('{"mcpServers":{"'), "name", F.when(k % 2 == 0, F.concat(F.lit('":{"command":"run'), n(k), F.lit('","args":["-v","'), n(k), F.lit('"],"env":{"K":"'), n(k), F.lit('"}'))).otherwise(F.concat(F.lit('":{"url":"http://h'), n(k), F.lit('"'))), F.lit("}}}"))
    sources = C.settings(p.select("k", n(k).alias("path"), command.alias("content"))).withColumn("priority", F.col("path").cast("long")).withColumn("level", F.when(F.col("priority") % 3 == 0, "project").otherwise("global"))
    at = F.concat(F.lit("2024-01-01T00:"), F.lpad(n(F.floor(k / 60) % 60), 2, "0"), F.lit(":"), F.lpad(n(k % 60), 2, "0"), F.lit(".000Z "))
    of = F.concat(F.lit('MCP server "'), "name", F.lit('"'))
    says = F.when(k % 3 == 0, F.concat(at, F.lit("[DEBUG] "), of, F.lit(": Successfully connected (transport: stdio), no error"))).when(k % 3 == 1, F.concat(at, F.lit("[ERROR] "), of, F.lit(" Connection failed after 9ms: no "), n(k))).otherwise(F.concat(at, F.lit("[ERROR] "), of, F.lit(" Server stderr: bad "), n(k)))
    then = F.when(k % 3 == 2, F.when(k % 2 == 0, F.concat(F.lit("  at line "), n(k))).otherwise("")).when(k % 50 == 3, F.concat(at, F.lit("[DEBUG] "), of, F.lit(': Connection established with capabilities: {"tools":'), n(k), F.lit("}"))).otherwise(F.concat(at, F.lit("[DEBUG] failed: nothing")))
    log = p.filter("k % 50 <> 7").select(F.explode(F.array(F.struct((k * 2).alias("line_no"), says.alias("value")), F.struct((k * 2 + 1).alias("line_no"), then.alias("value")))).alias("l")).select("l.*")
    return sources, C.server_log(log)


_SERVERS = """WITH p AS (SELECT p_partkey AS k, 'srv' || p_partkey % 50 AS name, '2024-01-01T00:' || lpad(((p_partkey // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((p_partkey % 60)::VARCHAR, 2, '0') || '.000Z' AS tm FROM part), one AS (SELECT name, min(k) AS k FROM p GROUP BY name), l AS (SELECT * FROM p WHERE k % 50 <> 7),
    st AS (SELECT name, arg_max(CASE WHEN k % 3 = 0 THEN 'connected' ELSE 'failed' END, k) AS status, max(k) AS k, arg_max(tm, k) AS last_seen, coalesce(max(k) FILTER (k % 3 = 0), -1) AS c FROM l WHERE k % 3 < 2 GROUP BY name),
    er AS (SELECT name, arg_min('no ' || l.k, l.k) AS why FROM l JOIN st USING (name) WHERE l.k % 3 = 1 AND l.k > st.c GROUP BY name),
    sd AS (SELECT name, coalesce(arg_min('bad ' || k || chr(10) || '  at line ' || k, k) FILTER (k % 2 = 0), arg_max('bad ' || k, k)) AS err FROM l WHERE k % 3 = 2 GROUP BY name),
    ca AS (SELECT name, '{"tools":' || max(l.k) || '}' AS capabilities FROM l JOIN st USING (name) WHERE l.k % 50 = 3 AND l.k % 3 <> 2 AND l.k >= st.k GROUP BY name),
    x AS (SELECT name, status, last_seen, capabilities, CASE WHEN status = 'failed' THEN coalesce(err, why) END AS error FROM st LEFT JOIN er USING (name) LEFT JOIN sd USING (name) LEFT JOIN ca USING (name)),
    m AS (SELECT name, CASE WHEN k % 2 = 0 THEN 'stdio' ELSE 'sse' END AS kind, CASE WHEN k % 2 = 0 THEN 'run' || k END AS command, CASE WHEN k % 2 = 0 THEN '-v,' || k ELSE '' END AS args, CASE WHEN k % 2 = 1 THEN 'http://h' || k END AS url, CASE WHEN k % 2 = 0 THEN k::VARCHAR END AS env,
        CASE WHEN k % 3 = 0 THEN 'project' ELSE 'global' END AS level, coalesce(status, 'unknown') AS status, error, capabilities, last_seen FROM one LEFT JOIN x USING (name)) """
query("s17_servers", _SERVERS + "SELECT * FROM m")(lambda s, d: C.servers(*_servers(s, d)).withColumn("args", F.array_join("args", ",")).withColumn("env", F.try_element_at("env", F.lit("K"))))
query("j09_server_status", _SERVERS + "SELECT name, status FROM m")(lambda s, d: C.servers(*_servers(s, d)).select("name", "status"))
query("a41_server_counts", _SERVERS + "SELECT count(*) FILTER (status = 'connected') AS connected, count(*) FILTER (status = 'failed') AS failed FROM m")(lambda s, d: C.server_counts(C.servers(*_servers(s, d))))
query("s18_server_log", _SERVERS + "SELECT * FROM x")(lambda s, d: _servers(s, d)[1].drop("path"))


def _written(s, d) -> str:
    """A tree of command, skill, memory and plan files, one of each for every supplier."""
    k = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("Body "), k)
    head = F.concat(F.lit('---\nname: "n'), k, F.lit('"\ndescription: d'), k, F.lit("\nmore: m\n---\n"), body)
    files = F.array(
        F.struct(F.concat(F.lit("commands/do-"), k, F.lit(".md")).alias("path"), F.when(F.col("s_suppkey") % 2 == 0, head).otherwise(body).alias("value")),
        F.struct(F.concat(F.lit("skills/s"), k, F.lit("/SKILL.md")).alias("path"), head.alias("value")),
        F.struct(F.concat(F.lit("memory/"), k, F.lit(".md")).alias("path"), body.alias("value")),
        F.struct(F.concat(F.lit("plans/my-plan-"), k, F.lit(".md")).alias("path"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("\n# Plan "), k)).otherwise("text").alias("value")),
    )
    root = shared_root(s, "tree")
    write_lines(table(s, d, "supplier").select(F.explode(files).alias("f")).select("f.path", F.lit(0).alias("line_no"), "f.value"), root)
    return root


_SUPPLIERS = "WITH q AS (SELECT s_suppkey AS k FROM supplier) "
query("s19_commands", _SUPPLIERS + "SELECT CASE WHEN k % 2 = 0 THEN 'n' || k ELSE 'do-' || k END AS name, CASE WHEN k % 2 = 0 THEN 'd' || k END AS description, 'Body ' || k AS body FROM q")(
    lambda s, d: C.commands(C.documents(s, [f"{_written(s, d)}/commands/*.md"])).select("name", "description", F.trim(F.regexp_replace("body", "\n", "")).alias("body"))
)
query("s20_skills", _SUPPLIERS + "SELECT 's' || k AS dir, 'n' || k AS name, 'd' || k AS description, 'm' AS more FROM q")(lambda s, d: C.skills(C.documents(s, [f"{_written(s, d)}/skills/*/SKILL.md"])).select("dir", "name", "description", F.col("extra")["more"].alias("more")))
query("s21_memory", _SUPPLIERS + "SELECT 'project' AS scope, k::VARCHAR AS name, 6 + length(k::VARCHAR) AS size FROM q")(lambda s, d: C.memory(s, [], [f"{_written(s, d)}/memory/*.md"]).select("scope", C.stem().alias("name"), "size"))
query("s22_plans", _SUPPLIERS + "SELECT 'my-plan-' || k AS slug, CASE WHEN k % 2 = 0 THEN 'Plan ' || k ELSE 'My Plan ' || k END AS title FROM q")(lambda s, d: C.plans(C.documents(s, [f"{_written(s, d)}/plans/*.md"])).select("slug", "title"))


@query("s24_preferences", "WITH q AS (SELECT n_nationkey AS k FROM nation) SELECT 'key' || k AS key, CASE WHEN k % 2 = 0 THEN 'new' ELSE k::VARCHAR END AS value FROM q WHERE k % 2 = 0 OR k % 5 <> 3")
def s24(s, d):
    """Values that aren't numbers are put aside, then every second key is set anew."""
    n = table(s, d, "nation").select(F.concat(F.lit("key"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_nationkey").alias("k"))
    store = n.select("key", F.when(F.col("k") % 5 == 3, "bad!").otherwise(F.col("k").cast("string")).alias("value"))
    good, _ = C.valid_preferences(store, n.select("key", F.lit("^[0-9]+$").alias("pattern")))
    return C.put_preferences(good, n.filter("k % 2 = 0").select("key", F.lit("new").alias("value")))


query("s24_session_tags", "WITH q AS (SELECT n_nationkey AS k FROM nation) SELECT 's' || k AS session_id, CASE WHEN k % 3 = 0 THEN 'a,b' ELSE 'old' END AS tags FROM q WHERE k % 3 <> 1")(
    lambda s, d: (lambda n: C.put_tags(n.select("session_id", F.array(F.lit("old")).alias("tags")), n.filter("k % 3 < 2").select("session_id", F.when(F.col("k") % 3 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("tags"))))(
        table(s, d, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("session_id"), F.col("n_nationkey").alias("k"))
    ).select("session_id", F.array_join("tags", ",").alias("tags"))
)
query("p16_cost_and_time", "WITH q AS (SELECT o_orderkey, o_orderkey % 977 AS a, (o_orderkey * 7919) % 4000 + (o_orderkey % 3) * 60000 AS b FROM orders) SELECT o_orderkey, CASE WHEN a < 100 THEN '$' || printf('%.2f', a / 1.0) ELSE '$' || a END AS cost, CASE WHEN b < 1000 THEN b || 'ms' WHEN b < 60000 THEN printf('%.1fs', b / 1000 + CASE WHEN b % 500 = 250 THEN 1e-9 ELSE 0 END) ELSE (b // 60000) || 'm ' || floor(b % 60000 / 1000 + 0.5)::BIGINT || 's' END AS took FROM q")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", P.format_cost((F.col("o_orderkey") % 977).cast("double")).alias("cost"), P.format_ms((F.col("o_orderkey") * 7919) % 4000 + F.col("o_orderkey") % 3 * 60000).alias("took"))
)

# --- rules ------------------------------------------------------------------------------------------------------

query("l03_directories", "WITH q AS (SELECT p_partkey AS k FROM part) SELECT 'CMD_DEPRECATE' AS check_id, 'd' || k || '/old' AS path FROM q WHERE k % 10 = 0 UNION ALL SELECT 'XCT003', 'ignore.txt'")(
    lambda s, d: L.directories(table(s, d, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 10 == 0, "/old").otherwise("/new")).alias("path")), s, "/old", "ignore.txt").select("check_id", "path")
)


@query("l06_rule_files", """WITH q AS (SELECT p_partkey AS k FROM part) SELECT k::VARCHAR AS path, 'RUL001' AS check_id FROM q WHERE k % 3 = 0 UNION ALL SELECT k::VARCHAR, 'RUL002' FROM q WHERE k % 4 = 1
    UNION ALL SELECT k::VARCHAR, 'RUL003' FROM q WHERE k % 2 = 1 AND k % 4 <> 1 UNION ALL SELECT k::VARCHAR, 'RUL005' FROM q WHERE k % 5 = 0""")
def l06(s, d):
    k = F.col("p_partkey")
    glob = F.when(k % 4 == 1, "lib/ [*").when(k % 2 == 1, F.concat(F.lit("none/*.x"), k.cast("string"))).otherwise(F.concat(F.lit("**/d"), k.cast("string"), F.lit("/?.{ts,py}")))
    head = F.when(k % 3 == 0, "---\nopen ").otherwise("")
    docs = table(s, d, "part").select(k.cast("string").alias("path"), F.concat(head, F.lit("see `"), glob, F.lit("`"), F.when(k % 5 == 0, F.repeat(F.lit("\nx"), 100)).otherwise("")).alias("content"))
    files = table(s, d, "part").select(F.concat(F.lit("src/d"), k.cast("string"), F.lit("/m.py")).alias("path"))
    return L.rules(docs, files).select("path", "check_id")


query("l09_settings_rules", """WITH q AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS path FROM customer) SELECT path, 'CFG001' AS check_id, 'warning' AS severity FROM q WHERE k % 7 = 0 AND k % 9 > 0 UNION ALL SELECT path, 'CFG002', 'warning' FROM q UNION ALL SELECT path, 'CFG003', 'info' FROM q WHERE k % 6 = 0
    UNION ALL SELECT path, 'CFG004', 'info' FROM q WHERE k % 7 = 0 UNION ALL SELECT path, 'CFG005', 'warning' FROM q WHERE k % 4 = 0 UNION ALL SELECT path, 'CFG006', 'warning' FROM q WHERE k % 5 > 0 UNION ALL SELECT path, 'CFG007', 'info' FROM q WHERE k % 7 = 0 AND k % 3 > 0""")(
    lambda s, d: L.settings(_merged(s, d).withColumn("has_lock_files", F.col("c_custkey") % 9 == 0)).select("path", "check_id", "severity")
)
query("l12_unscrubbed", "WITH q AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0) SELECT o_custkey AS root, 'SEC008' AS check_id, 'warning' AS severity FROM q GROUP BY o_custkey")(
    lambda s, d: L.unscrubbed(L.secrets(table(s, d, "orders").select(F.col("o_custkey").alias("root"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(1).cast("long").alias("line_no"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("password = hunter"), F.col("o_orderkey").cast("string"))).otherwise("nothing").alias("value"))), False).select("root", "check_id", "severity")
)

# --- search -----------------------------------------------------------------------------------------------------


@query("a31_session_search", LINES + """, r AS (SELECT * FROM q WHERE NOT carrier UNION ALL SELECT * REPLACE (4 AS line) FROM q WHERE t = 0 AND NOT carrier), m AS (SELECT *, strpos(lower(x), 'tion') AS p, row_number() OVER (PARTITION BY sid ORDER BY line) AS n FROM r WHERE lower(x) LIKE '%tion%'),
    b AS (SELECT *, greatest(p - 40, 1) AS f, least(p + 84, length(x) + 1) AS z FROM m), g AS (SELECT sid, max(CASE WHEN role = 'user' THEN 'plan-' || c % 3 END) AS title FROM q GROUP BY sid)
    SELECT sid AS session_id, coalesce(any_value(title), sid) AS title, count(*) AS matches, string_agg(CASE WHEN n <= 3 THEN CASE WHEN f > 1 THEN '…' ELSE '' END || substring(x, f, z - f) || CASE WHEN z <= length(x) THEN '…' ELSE '' END END, '|' ORDER BY n) AS snippets FROM b JOIN g USING (sid) GROUP BY sid""")
def a31(s, d):
    """Candidates come from trigrams that the incremental store keeps; the second refresh takes up the sessions that were missing."""
    root, store = shared_root(s, "transcripts"), shared_root(s, "postings")

    def build(path, keys):
        lines = S.scan_lines(s, path) if keys is None else growing.session_lines(keys, path)
        return Q.postings(kept(Q.texts(S.records(S.parse(lines))), "texts"))  # ranges are found by a pass of its own

    for part in ("c % 5 <> 0", "c % 5 = 0"):
        write_lines(_rows(s, d, part), root)
        index = I.refresh(s, root, store, build)
    records = kept(S.read_records(s, root).select("project_id", "session_id", "agent_id", "line_no", "slug", "blocks"), "records")
    return Q.search_sessions(Q.texts(records), Q.titles(records), "tiON", index).select("session_id", "title", "matches", F.array_join("snippets", "|").alias("snippets"))


# --- streams ----------------------------------------------------------------------------------------------------


def _drained(s, stream: DataFrame, path: str | None = None) -> DataFrame:
    """All that is there now, through a streaming query and its checkpoint; with the same ``path``, the query goes on."""
    path = path or shared_root(s, "stream")
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{path}/out")


@query("r01_file_tail", LINES + "SELECT sid || '.jsonl' AS file, count(*) FILTER (t <= 2) + 3 AS first_lines, count(*) + 3 AS lines, count(*) + 3 AS starts FROM q GROUP BY sid")
def r01(s, d):
    """Files are read, grow in place, and are read on from the checkpoint: every line comes once."""
    root, path = shared_root(s, "transcripts"), shared_root(s, "stream")
    file = F.regexp_extract("path", "([^/]+)$", 1).alias("file")
    counts = []
    for keep in ("t <= 2", None):
        write_lines(_rows(s, d, keep), root)
        lines = _drained(s, growing.stream(s, root, f"{path}/log"), path)
        counts.append(lines.groupBy(file).agg(F.count("*").alias("lines"), F.countDistinct("start").alias("starts")))
        if len(counts) == 1:  # before the folder has more
            counts[0].write.parquet(f"{path}/first")
    first = s.read.parquet(f"{path}/first").select("file", F.col("lines").alias("first_lines"))
    return counts[1].join(first, "file").select("file", "first_lines", "lines", "starts")


query("r05_path_router", LINES + "SELECT DISTINCT pid AS project_id, sid AS session_id FROM q")(lambda s, d: I.touched_sessions(_drained(s, growing.stream(s, root_of(s, d), f"{shared_root(s, 'stream')}/log")).select("path")))


@query("r03_refold", LINES + "SELECT sid AS session_id, count(*) FILTER (role IN ('user', 'assistant') AND NOT carrier AND NOT synthetic) AS messages, 1 AS created, CASE WHEN c % 5 = 0 AND max(t) > 1 THEN 1 ELSE 0 END AS updated FROM q GROUP BY sid, c")
def r03(s, d):
    """A fifth of the sessions grows between two batches; touched sessions are folded again as a whole, upserted and pushed (K05)."""
    root, path = shared_root(s, "transcripts"), shared_root(s, "stream")

    def build(lines):
        own = visible(S.records(S.parse(lines)).filter("agent_id IS NULL"))
        return own.groupBy("project_id", "session_id").agg(F.count_if(F.col("kind").isin("user", "assistant")).alias("messages"))

    for keep in ("c % 5 <> 0 OR t <= 1", None):
        write_lines(_rows(s, d, keep), root)
        tail.push_sessions(growing.stream(s, root, f"{path}/log"), root, f"{path}/store", build, f"{path}/state", once=True).awaitTermination()
    events = s.read.parquet(f"{path}/store/events-*").groupBy("session_id").agg(F.count_if(F.col("event") == "created").alias("created"), F.count_if(F.col("event") == "updated").alias("updated"))
    return I.current(s, f"{path}/store").join(events, "session_id").select("session_id", "messages", "created", "updated")


@query("r04_secret_alerts", "WITH q AS (SELECT o_custkey % 20 AS k FROM orders) SELECT DISTINCT 'SEC005' AS check_id, 'pass…' || (17 + k) AS masked FROM q WHERE k % 7 <> 0")
def r04(s, d):
    """The same secrets in many files that grow twice. Some were alerted before; the second growth, and a query that starts anew, alert nothing."""
    root, path = shared_root(s, "transcripts"), shared_root(s, "stream")
    keep_state(s)
    orders = table(s, d, "orders").select("o_orderkey", F.col("o_custkey") % 20, F.concat(F.lit("projects/p/s"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".jsonl")).alias("path")).toDF("line_no", "k", "path")
    said = orders.withColumn("value", F.concat(F.lit("password = hunter"), F.repeat(F.lit("x"), F.col("k").cast("int"))))
    more = said.groupBy("path").agg(F.max("line_no").alias("line_no"), F.max_by("value", "line_no").alias("value")).withColumn("line_no", F.col("line_no") + 1)
    alerted = said.filter("k % 7 = 0").select(F.concat(F.lit("SEC005:pass…"), F.char_length("value").cast("string")).alias("fingerprint")).distinct()
    alerted.write.parquet(f"{path}/alerted")
    for rows in (said.filter("line_no % 3 = 0"), said, said.drop("k").unionByName(more)):
        write_lines(rows, root)
        got = _drained(s, secret_alerts(growing.stream(s, root, f"{path}/log", created="hold"), s.read.parquet(f"{path}/alerted")), f"{path}/one")
    known = alerted.unionByName(got.select("fingerprint"))
    again = _drained(s, secret_alerts(growing.stream(s, root, f"{path}/log-2"), known), f"{path}/two")
    return got.unionByName(again).select("check_id", "masked")


@query("r07_live_flag", """WITH e AS (SELECT user_id::VARCHAR AS session_id, epoch_ms(ts) AS ms FROM events), g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms) AS gap FROM e),
    r AS (SELECT session_id, ms, sum(CASE WHEN gap IS NULL OR gap >= 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT session_id, 'live' AS state, min(ms) AS at_ms FROM r GROUP BY session_id, n UNION ALL SELECT session_id, 'quiet', max(ms) + 60000 FROM r GROUP BY session_id, n""")
def r07(s, d):
    """Events as updates of a session for each user; the nations are the clock, long after the last update."""
    keep_state(s)
    stream = lambda name: s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")
    updates = stream("events").select(F.col("user_id").cast("string").alias("session_id"), "ts")
    ticks = stream("nation").select(F.make_timestamp(F.lit(2100), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("ts"))
    return _drained(s, live_changes(updates, ticks))


@query("r06_settings_stream", "WITH q AS (SELECT n_nationkey AS k FROM nation) SELECT 'settings' || k || '.json' AS file, k % 2 = 0 AS bare FROM q")
def r06(s, d):
    root, k = shared_root(s, "tree"), F.col("n_nationkey").cast("string")
    write_lines(table(s, d, "nation").select(F.concat(F.lit("p"), k, F.lit("/settings"), k, F.lit(".json")).alias("path"), F.lit(0).alias("line_no"), F.concat(F.lit('{"skipDangerousModePermissionPrompt":'), (F.col("n_nationkey") % 2 == 0).cast("string"), F.lit("}")).alias("value")), root)
    return _drained(s, tail.stream_settings(s, root).select("path", F.col("s.skipDangerousModePermissionPrompt").alias("bare"))).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "bare")
