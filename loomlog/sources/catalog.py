"""Readers of the configuration tree: settings, hooks, servers, commands, skills, memory, plans, preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import frontmatter, plan_title

# The keys of settings files.
SETTINGS = (
    "hooks map<string,array<variant>>, mcpServers map<string,variant>, permissions struct<allow:array<string>,deny:array<string>>, env map<string,string>, "
    "sandbox struct<unsandboxedCommands:array<string>,enableWeakerNestedSandbox:boolean>, skipDangerousModePermissionPrompt boolean, disableSkillShellExecution boolean, "
    "attribution struct<commitTemplate:string,prTemplate:string,hasDeprecatedCoAuthoredBy:boolean>, plugins array<struct<name:string,version:string,source:string>>, "
    "marketplaces array<struct<name:string,url:string>>, profile struct<name:string,email:string>, allowedChannelPlugins array<string>"
)
WHOLE = ("sandbox", "skipDangerousModePermissionPrompt", "disableSkillShellExecution", "attribution", "plugins", "marketplaces", "profile", "allowedChannelPlugins")

# What server log lines say.
LED = r"^\d{4}-\d{2}-\d{2}T"
CONNECTED = r'(\d{4}-\d{2}-\d{2}T[\d:.]+Z) \[DEBUG\] MCP server "([^"]+)": Successfully connected'
CAPABLE = r'MCP server "([^"]+)": Connection established with capabilities: (\{.+\})'
FAILED = r'(\d{4}-\d{2}-\d{2}T[\d:.]+Z) \[(?:DEBUG|ERROR)\] MCP server "([^"]+)"[: ]+Connection failed[^:]*: (.+)'
STDERR = r'(?s)\[ERROR\] MCP server "([^"]+)" Server stderr: (.+)'


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content, size, created) of whole text files; paths that match nothing are left out."""
    found = []
    for p in paths:
        try:
            found.append(spark.read.format("binaryFile").load(p).select("path", F.col("content").cast("string").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("created")))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    out = spark.createDataFrame([], "path string, content string, size long, created timestamp")
    for f in found:
        out = out.unionByName(f)
    return out


def stem(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def settings(docs: DataFrame) -> DataFrame:
    """Parsed settings; malformed files give a row of nulls."""
    return docs.select("path", F.from_json("content", SETTINGS, {"mode": "PERMISSIVE"}).alias("s"))


def merged_settings(general: Column, project: Column) -> Column:
    """The project's values win; hooks, servers and env merge by key; allow and deny lists are joined."""
    merge = lambda k: F.map_concat(F.map_filter(F.coalesce(general[k], F.map_filter(project[k], lambda a, b: F.lit(False))), lambda n, v: ~F.coalesce(F.map_contains_key(project[k], n), F.lit(False))), F.coalesce(project[k], F.map_filter(general[k], lambda a, b: F.lit(False))))
    none = F.array().cast("array<string>")
    lists = lambda k: F.concat(F.coalesce(general["permissions"][k], none), F.coalesce(project["permissions"][k], none))
    first = lambda k: F.coalesce(project[k], general[k]).alias(k)
    return F.struct(merge("hooks").alias("hooks"), merge("mcpServers").alias("mcpServers"), merge("env").alias("env"), F.struct(lists("allow").alias("allow"), lists("deny").alias("deny")).alias("permissions"), *map(first, WHOLE))


def hooks(s: DataFrame) -> DataFrame:
    """(path, event, pos, matcher, command): a bare command is a rule without matcher."""
    e = s.select("path", F.explode("s.hooks").alias("event", "rules")).select("path", "event", F.posexplode("rules").alias("pos", "rule"))
    g = lambda p: F.try_variant_get("rule", p, "string")
    nested = F.try_variant_get("rule", "$.hooks", "array<variant>")
    commands = F.when(g("$.command").isNotNull(), F.array(g("$.command"))).otherwise(F.transform(nested, lambda h: F.try_variant_get(h, "$.command", "string")))
    return e.select("path", "event", "pos", F.coalesce(g("$.matcher"), F.lit("")).alias("matcher"), F.explode_outer(commands).alias("command"))


def servers(sources: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(name, kind, command, args, url, env, level, status, error, capabilities, last_seen) from (priority, path, s[, level]): the first source with a
    name wins. ``log`` is a :func:`server_log`."""
    leveled = sources if "level" in sources.columns else sources.withColumn("level", F.lit("global"))
    e = leveled.select("priority", "level", F.explode("s.mcpServers").alias("name", "v"))
    g = lambda p, kind="string": F.try_variant_get("v", p, kind)
    kind = F.coalesce(g("$.type"), F.when(g("$.command").isNotNull(), "stdio").when(g("$.url").isNotNull(), "sse"))
    args, env = F.coalesce(g("$.args", "array<string>"), F.array().cast("array<string>")), F.coalesce(g("$.env", "map<string,string>"), F.create_map().cast("map<string,string>"))
    first = e.withColumn("n", F.row_number().over(W.partitionBy("name").orderBy("priority"))).filter("n = 1")
    one = first.select("name", kind.alias("kind"), g("$.command").alias("command"), args.alias("args"), g("$.url").alias("url"), env.alias("env"), "level")
    if log is None:
        return one.select("*", F.lit("unknown").alias("status"), *[F.lit(None).cast("string").alias(c) for c in ("error", "capabilities", "last_seen")])
    return one.join(log.select("name", "status", "error", "capabilities", "last_seen"), "name", "left").fillna({"status": "unknown"})


def log_blocks(log: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """``log`` (path, line_no, value) with block, the last line at or before each that begins with a time, or 0.

    A running maximum inside chunks of lines, and one over the chunks: no log is sorted as a whole.
    """
    led = F.when(F.col("value").rlike(LED), F.col("line_no"))
    lines = log.withColumn("__chunk", F.floor(F.col("line_no") / chunk)).withColumn("__led", led)
    before = W.partitionBy("path").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = lines.groupBy("path", "__chunk").agg(F.max("__led").alias("__last")).select("path", "__chunk", F.max("__last").over(before).alias("__before"))
    here = F.max("__led").over(W.partitionBy("path", "__chunk").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("__here", here).join(carried, ["path", "__chunk"]).withColumn("block", F.coalesce("__here", "__before", F.lit(0))).drop("__chunk", "__led", "__here", "__before")


def server_log(log: DataFrame) -> DataFrame:
    """(path, name, status, last_seen, capabilities, error) from log lines (line_no, value[, path]).

    The last connection or failure counts, and capabilities if they follow it. The error of a failed server is its first error output of
    several lines, else its last, else the first failure since it was connected. Error output goes on to the next line that begins with a time.
    Empty error output and capabilities that are no JSON are left out.
    """
    log = log if "path" in log.columns else log.withColumn("path", F.lit(""))
    part = lambda pattern, n: F.nullif(F.regexp_extract("value", pattern, n), F.lit(""))
    ok, bad, able = part(CONNECTED, 2), part(FAILED, 2), part(CAPABLE, 1)
    states = log.select("path", "line_no", F.coalesce(ok, able, bad).alias("name"), F.when(ok.isNotNull(), "connected").when(able.isNotNull(), "capable").otherwise("failed").alias("said"), F.coalesce(part(CONNECTED, 1), part(FAILED, 1)).alias("at"), F.trim(part(FAILED, 3)).alias("why"), F.when(F.try_parse_json(part(CAPABLE, 2)).isNotNull(), part(CAPABLE, 2)).alias("capabilities"))
    states = states.filter("name IS NOT NULL AND (said <> 'capable' OR capabilities IS NOT NULL)")
    is_state, line = F.col("said") != "capable", F.col("line_no")
    last = states.groupBy("path", "name").agg(
        F.max_by("said", F.when(is_state, line)).alias("status"),
        F.max_by("at", F.when(is_state, line)).alias("last_seen"),
        F.max(F.when(is_state, line)).alias("__state"),
        F.max(F.when(F.col("said") == "connected", line)).alias("__connected"),
        F.max(F.when(~is_state, line)).alias("__capable"),
        F.max_by("capabilities", F.when(~is_state, line)).alias("capabilities"),
    ).filter("__state IS NOT NULL")
    failures = states.filter("said = 'failed'").join(last.select("path", "name", "__connected"), ["path", "name"]).filter("__connected IS NULL OR line_no > __connected")
    why = failures.groupBy("path", "name").agg(F.min_by("why", "line_no").alias("why"))

    blocks = log_blocks(log)
    marked = blocks.filter(F.col("value").rlike(STDERR)).groupBy("path", "block").agg(F.min("line_no").alias("__from"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n")
    outputs = blocks.join(marked, ["path", "block"]).filter("line_no >= __from").groupBy("path", "block").agg(text.alias("value")).select("path", "block", part(STDERR, 1).alias("name"), F.trim(F.regexp_replace(part(STDERR, 2), r"^\s+|\s+$", "")).alias("text"))
    whole = F.col("text").contains("\n")
    stderr = outputs.filter("text <> ''").groupBy("path", "name").agg(F.coalesce(F.min_by("text", F.when(whole, F.col("block"))), F.max_by("text", "block")).alias("stderr"))

    out = last.join(why, ["path", "name"], "left").join(stderr, ["path", "name"], "left")
    error = F.when(F.col("status") == "failed", F.coalesce("stderr", "why"))
    return out.select("path", "name", "status", "last_seen", F.when(F.col("__capable") > F.col("__state"), F.col("capabilities")).alias("capabilities"), error.alias("error"))


def server_counts(s: DataFrame) -> DataFrame:
    return s.agg(F.count_if(F.col("status") == "connected").alias("connected"), F.count_if(F.col("status") == "failed").alias("failed"))


def commands(docs: DataFrame) -> DataFrame:
    m = docs.withColumn("f", frontmatter(F.col("content")))
    get = lambda k: F.try_element_at("f.meta", F.lit(k))
    return m.select("path", F.coalesce(get("name"), stem()).alias("name"), get("description").alias("description"), F.coalesce(F.nullif("f.body", F.lit("")), "content").alias("body"), "size")


def skills(docs: DataFrame) -> DataFrame:
    """``<dir>/SKILL.md`` files: name, display name, description, and what else the head holds."""
    m = docs.withColumn("f", frontmatter(F.col("content")))
    get = lambda k: F.try_element_at("f.meta", F.lit(k))
    known = ("name", "displayName", "description")
    return m.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir"), get("name").alias("name"), get("displayName").alias("display_name"), get("description").alias("description"), F.map_filter("f.meta", lambda k, v: ~k.isin(*known)).alias("extra"), F.col("f.body").alias("body"))


def memory(spark: SparkSession, general: list[str], project: list[str]) -> DataFrame:
    return documents(spark, general).withColumn("scope", F.lit("global")).unionByName(documents(spark, project).withColumn("scope", F.lit("project")))


def extended_config(settings: DataFrame) -> DataFrame:
    """A column for each key of :data:`WHOLE`, and env, with a value for flags, lists and env that the file leaves out; path first."""
    none = {"skipDangerousModePermissionPrompt": F.lit(False), "disableSkillShellExecution": F.lit(False)} | {k: F.array() for k in ("plugins", "marketplaces", "allowedChannelPlugins")}
    value = lambda k: F.coalesce(f"s.{k}", none[k]).alias(k) if k in none else F.col(f"s.{k}").alias(k)
    return settings.select("path", *map(value, WHOLE), F.coalesce("s.env", F.create_map().cast("map<string,string>")).alias("env"))


def plans(docs: DataFrame) -> DataFrame:
    """(path, slug, title, size) of plan files, the newest first where ``docs`` says when they were made (created)."""
    out = docs.select("path", stem().alias("slug"), plan_title(F.col("content"), stem()).alias("title"), "size", *[c for c in docs.columns if c == "created"])
    return out.orderBy(F.desc("created"), "path") if "created" in docs.columns else out


def plan_projects(lines: DataFrame, slugs: DataFrame) -> DataFrame:
    """(slug, project_id) of projects with a line that names the slug."""
    named = lines.select("project_id", F.regexp_extract("value", r'"slug":\s?"([^"]+)"', 1).alias("slug")).filter("slug <> ''").distinct()
    return slugs.select("slug").join(named, "slug").distinct().orderBy("slug", "project_id")


def valid_preferences(store: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries (key, value) of a store that ``allowed`` (key, pattern) accepts, and the others, to be put aside."""
    judged = store.join(F.broadcast(allowed), "key", "left").withColumn("__ok", F.coalesce(F.expr("value RLIKE pattern"), F.lit(False)))
    return judged.filter("__ok").select("key", "value"), judged.filter("NOT __ok").select("key", "value")


def put_preferences(store: DataFrame, patch: DataFrame) -> DataFrame:
    """A (key, value) table with the entries of ``patch`` replaced or added."""
    return store.join(patch.select("key"), "key", "left_anti").unionByName(patch.select("key", "value"))


def put_preference(store: DataFrame, key: str, value: str) -> DataFrame:
    return put_preferences(store, store.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def put_tags(stored: DataFrame, patch: DataFrame) -> DataFrame:
    """(session_id, tags) with the tags of ``patch``'s sessions replaced; sessions without a tag left go."""
    kept = stored.select("session_id", "tags").join(patch.select("session_id"), "session_id", "left_anti")
    return kept.unionByName(patch.select("session_id", F.array_sort(F.array_distinct("tags")).alias("tags"))).filter(F.size("tags") > 0)
