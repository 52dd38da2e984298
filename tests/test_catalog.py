"""Readers of the configuration tree and the rules over it."""

from __future__ import annotations

import json

import pytest
from loomlog.operators import lint as L
from loomlog.sources import catalog as C
from pyspark.sql import functions as F


@pytest.fixture()
def tree(tmp_path):
    general = {"hooks": {"Stop": [{"command": "x"}], "Start": [{"matcher": "m", "hooks": [{"command": "a"}, {"command": "b"}]}]}, "env": {"A": "1", "B": "1"}, "permissions": {"allow": ["src/a", "lib"], "deny": []}, "mcpServers": {"one": {"command": "c"}, "two": {"url": "http://x"}}}
    project = {"env": {"B": "false"}, "permissions": {"allow": [], "deny": ["srcfoo", "src/"]}, "mcpServers": {"one": {"command": "other", "args": ["-v"], "env": {"K": "1"}}}, "skipDangerousModePermissionPrompt": True, "sandbox": {"unsandboxedCommands": ["ls"]}, "plugins": [{"name": "p"}], "disableSkillShellExecution": False}
    (tmp_path / "general.json").write_text(json.dumps(general))
    (tmp_path / "project.json").write_text(json.dumps(project))
    (tmp_path / "broken.json").write_text("{")
    skill = tmp_path / "skills/my-skill"
    skill.mkdir(parents=True)
    (skill / "SKILL.md").write_text('---\nname: "other"\ndescription: d\nname: last\nmore: z\n---\nbody\n')
    (tmp_path / "plans").mkdir()
    (tmp_path / "plans/a-good-plan.md").write_text("\n\n# Heading\ntext")
    (tmp_path / "plans/no-title.md").write_text("text")
    return tmp_path


def both(spark, tree):
    g, p = (C.settings(C.documents(spark, [str(tree / f"{x}.json")])).select(F.col("s").alias(x)) for x in ("general", "project"))
    return g.crossJoin(p).select(F.lit("merged").alias("path"), C.merged_settings(F.col("general"), F.col("project")).alias("s"))  # one row each


def test_settings(spark, tree):
    s = both(spark, tree).first().s
    assert s.env == {"A": "1", "B": "false"} and s.permissions.allow == ["src/a", "lib"] and s.permissions.deny == ["srcfoo", "src/"] and s.skipDangerousModePermissionPrompt is True
    assert set(s.hooks) == {"Stop", "Start"} and set(s.mcpServers) == {"one", "two"}
    assert C.settings(C.documents(spark, [str(tree / "broken.json"), str(tree / "missing.json")])).count() == 1


def test_hooks_and_servers(spark, tree):
    docs = C.settings(C.documents(spark, [str(tree / "general.json")]))
    assert {(r.event, r.matcher, r.command) for r in C.hooks(docs).collect()} == {("Stop", "", "x"), ("Start", "m", "a"), ("Start", "m", "b")}
    other = C.settings(C.documents(spark, [str(tree / "project.json")])).withColumn("priority", F.lit(1))
    sources = docs.withColumn("priority", F.lit(2)).unionByName(other)
    log = C.server_log(log_of(spark, LOG))
    got = {r.name: (r.kind, r.command, r.args, r.env, r.level, r.status, r.last_seen) for r in C.servers(sources, log).collect()}
    assert got == {"one": ("stdio", "other", ["-v"], {"K": "1"}, "global", "failed", "2024-01-02T00:00:05.000Z"), "two": ("sse", None, [], {}, "global", "connected", "2024-01-02T00:00:01.000Z")}
    assert tuple(C.server_counts(C.servers(sources, log)).first()) == (1, 1)


LOG = """2024-01-02T00:00:00.000Z [DEBUG] MCP server "one": Successfully connected (transport: stdio) in 9ms
2024-01-02T00:00:01.000Z [DEBUG] MCP server "two": Successfully connected, no error
2024-01-02T00:00:01.500Z [DEBUG] MCP server "two": Connection established with capabilities: {"tools":true}
2024-01-02T00:00:01.700Z [DEBUG] MCP server "two": Connection established with capabilities: {broken}
2024-01-02T00:00:02.000Z [ERROR] MCP server "one" Server stderr: first
2024-01-02T00:00:03.000Z [ERROR] MCP server "one" Server stderr: Traceback
  line 1

  failed: nothing
2024-01-02T00:00:04.000Z [ERROR] MCP server "one" Server stderr: later
more
2024-01-02T00:00:05.000Z [DEBUG] MCP server "one" Connection failed after 3ms: refused
2024-01-02T00:00:05.500Z [ERROR] MCP server "two" Server stderr: an error that doesn't matter
2024-01-02T00:00:06.000Z [ERROR] MCP server "three": Connection failed: one
2024-01-02T00:00:07.000Z [ERROR] MCP server "three": Connection failed: two
2024-01-02T00:00:08.000Z [ERROR] MCP server "four" Server stderr: never connected nor failed"""


def log_of(spark, text: str):
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line_no long, value string")


@pytest.mark.parametrize("chunk", [2, 1 << 16])
def test_server_log(spark, chunk, monkeypatch):
    blocks = C.log_blocks
    monkeypatch.setattr(C, "log_blocks", lambda log: blocks(log, chunk))
    got = {r.name: (r.status, r.last_seen, r.capabilities, r.error) for r in C.server_log(log_of(spark, LOG)).collect()}
    assert got == {
        "one": ("failed", "2024-01-02T00:00:05.000Z", None, "Traceback\n  line 1\n\n  failed: nothing"),
        "two": ("connected", "2024-01-02T00:00:01.000Z", '{"tools":true}', None),
        "three": ("failed", "2024-01-02T00:00:07.000Z", None, "one"),
    }


def test_skills_and_plans(spark, tree):
    docs = C.documents(spark, [str(tree / "skills/*/SKILL.md")])
    s = C.skills(docs).first()
    assert (s.dir, s.name, s.description, s.extra, s.body) == ("my-skill", "last", "d", {"more": "z"}, "body")
    assert {r.check_id for r in L.skills(docs).collect()} == {"SKL004"}
    assert {r.title for r in C.plans(C.documents(spark, [str(tree / "plans/*.md")])).collect()} == {"Heading", "No Title"}


def test_settings_rules(spark, tree):
    merged = both(spark, tree)
    found = lambda locks: {(r.check_id, r.severity) for r in L.settings(merged.withColumn("has_lock_files", F.lit(locks))).collect()}
    assert found(True) == {("CFG002", "warning"), ("CFG005", "warning"), ("CFG006", "warning"), ("CFG007", "info")}
    assert found(False) == found(True) | {("CFG001", "warning")}
    text = '{"env": {"%s": "false", "%s": ""}, "allowedChannelPlugins": ["x"], "permissions": {"allow": ["src"], "deny": ["srcfoo"]}, "sandbox": {}, "hooks": {}, "skipDangerousModePermissionPrompt": true}' % (L.SERVERS_ENABLED, L.ENV_SCRUB)
    one = C.settings(spark.createDataFrame([("p", text)], "path string, content string")).withColumn("has_lock_files", F.lit(False))
    assert {(r.check_id, r.severity) for r in L.settings(one).collect()} == {("CFG003", "info"), ("CFG004", "info")}


def test_allow_deny(spark):
    from loomlog.operators.records import allow_deny_conflicts

    frame = lambda *xs: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "entry string, pos int")
    got = allow_deny_conflicts(frame("src", "a/b/", "a", "x"), frame("srcfoo", "a/b/c", "src/", "a", "src"))
    assert {(r.a, r.d) for r in got.collect()} == {("src", "src/"), ("a/b/", "a/b/c"), ("a", "a/b/c")}


def depth_first(files: dict[str, list[str]], root: str) -> int:
    met = set()

    def go(node: str, depth: int) -> int:
        if depth > 10 or node in met:
            return depth
        met.add(node)
        return max([depth, *(go(x, depth + 1) for x in files.get(node, []))])

    return go(root, 0)


def test_import_chains(spark, tmp_path):
    import random

    from loomlog.operators.records import import_chains, import_lines

    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    text = "@import ../b/./x.md\n @import no\n@import\t /abs/../y.md \r\nsay @import no\n@import z.md\n@import ../../../../up.md\n@imports no"
    docs = spark.createDataFrame([("/r/a/f.md", text), ("rel/f.md", "@import x.md"), ("null", None), ("/r/empty", "")], "path string, content string")
    got = [(r.src, r.dst) for r in import_lines(docs).orderBy("src", "pos").collect()]
    assert got == [("/r/a/f.md", x) for x in ("/r/b/x.md", "/abs/../y.md", "/r/a/z.md", "/up.md")] + [("rel/f.md", "rel/x.md")]

    r = random.Random(5)
    files = {f"/t/{i}": [f"/t/{r.randrange(44)}" for _ in range(r.choice([0, 1, 1, 1, 2, 3]))] for i in range(40)}
    files |= {f"/c/{i}": [f"/c/{i + 1}"] for i in range(14)}
    docs = spark.createDataFrame([(k, "\n".join(f"@import {x}" for x in v)) for k, v in files.items()], "path string, content string")
    roots = docs.select("path").unionByName(spark.createDataFrame([("/gone",)], "path string"))
    assert {x.root: x.depth for x in import_chains(docs, roots).collect()} == {k: depth_first(files, k) for k in [*files, "/gone"]}


def test_import_walk_is_streamed(spark, tmp_path):
    from loomlog.operators.records import import_chains

    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    files = {f"/t/{i}": [f"/t/{(i * 7 + k) % 30}" for k in range(i % 4)] for i in range(30)}
    docs = spark.createDataFrame([(k, "\n".join(f"@import {x}" for x in v)) for k, v in files.items()], "path string, content string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # roots go on over several batches
    try:
        found = import_chains(docs, docs)
        assert {x.root: x.depth for x in found.collect()} == {k: depth_first(files, k) for k in files}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()  # a call for each file


def test_rule_files(spark):
    docs = spark.createDataFrame([("r1", "---\nopen"), ("r2", "see `src/*.py` and `lib/[*` and `*.zig`")], "path string, content string")
    files = spark.createDataFrame([("src/a.py",)], "path string")
    assert sorted((r.check_id, r.path) for r in L.rules(docs, files).collect()) == [("RUL001", "r1"), ("RUL002", "r2"), ("RUL003", "r2")]


def test_secret_caps(spark):
    lines = spark.createDataFrame([("f", i, f"password = hunter{i:03d}") for i in range(10)], "path string, line_no long, value string")
    found = L.secrets(lines)
    assert found.count() == 3 and L.unscrubbed(found, False).count() == 1 and L.unscrubbed(found, True).count() == 0
