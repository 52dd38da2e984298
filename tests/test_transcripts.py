"""JSONL edge cases through the reader, the fold, the exports, the incremental store and the stream."""

from __future__ import annotations

import json

import pytest
from loomlog.functions import pricing
from loomlog.operators import records as X
from loomlog.operators import transcript as T
from loomlog.operators.fold import Fold
from loomlog.sources import incremental as I
from loomlog.sources import transcripts as S
from pyspark.sql import functions as F


def line(kind, at=None, content=None, **more):
    message = {k: more.pop(k) for k in ("model", "stop_reason", "usage") if k in more}
    out = {"type": kind, **more}
    if at is not None:
        out["timestamp"] = f"2024-01-01T00:{at // 60:02d}:{at % 60:02d}.000Z"
    if content is not None:
        message["content"] = content
    return json.dumps(out | ({"message": message} if message else {}), ensure_ascii=False)


USE = {"input_tokens": 100, "output_tokens": 50, "cache_read_input_tokens": 7, "cache_creation": {"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 2}}
TOOL = [{"type": "text", "text": "look, \"here\""}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"b": 1, "a": 2}}, {"type": "tool_use", "id": "t2", "name": "EnterWorktree", "input": {}}]
RESULT = [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "r1"}, {"type": "text", "text": "r2"}]}]
LINES = [
    line("user", 0, "hello 😀", uuid="u1", cwd="/home/me/proj", slug="a-title"),
    "",
    "{broken",
    '{"type": "user"',
    line("progress", 1, "x", uuid="a1"),
    line("assistant", 10, TOOL, uuid="a1", model="x-sonnet-4-5", usage=USE) + "\r",
    line("assistant", 11, TOOL, uuid="a1", model="x-sonnet-4-5", usage=USE),
    line("user", 20, RESULT, uuid="c1"),
    line("assistant", 30, [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "done"}], model="x-opus-4-1", usage=USE),
    line("assistant", 31, "synthetic", model="<synthetic>", usage=USE),
    line("system", 40, subtype="compact_boundary", compactMetadata={"preTokens": 1000}),
    line("user", 41, "summary", isCompactSummary=True),
    line("user", None, "no time"),
    line("assistant", 60, "cleared anchor", model="x-opus-4-1", usage=USE),
    line("user", 70, []),
    line("assistant", 90, "429 rate limit", usage=USE),
]


@pytest.fixture()
def root(tmp_path):
    p = tmp_path / "root/projects/-home-me-proj"
    (p / "s1/subagents").mkdir(parents=True)
    (p / "s1.jsonl").write_text("\n".join(LINES) + "\n")
    child = [line("user", 5, "go"), line("assistant", 6, "ok", model="x-haiku-4-5", usage=USE), line("assistant", 7, "ok", usage=USE)]
    (p / "s1/subagents/agent-x.jsonl").write_text("\n".join(child))
    (p / "s1/subagents/agent-compact-y.jsonl").write_text("\n".join(child))
    (p / "s1/subagents/agent-empty.jsonl").write_text("")
    return str(tmp_path / "root")


def fold(spark, root):
    return Fold(S.read_records(spark, root).persist(), pricing.price_table(spark))


def test_reader(spark, root):
    r = {x.line_no: x for x in S.read_records(spark, root).filter("agent_id IS NULL").collect()}
    assert set(r) == set(range(1, 17)) - {2, 3, 4}
    assert [r[n].kind for n in (1, 5, 6, 8, 10, 11, 12, 15)] == ["user", "skip", "assistant", "carrier", "synthetic", "boundary", "skip", "user"]
    assert r[1].blocks[0].text == "hello 😀" and r[15].blocks == []
    assert r[8].blocks[0].content == "r1\nr2" and r[6].tool_names == ["Read", "EnterWorktree"] and r[11].pre_tokens == 1000
    assert {x.agent_id for x in S.read_records(spark, root).filter("agent_id IS NOT NULL").collect()} == {"x"}


def test_fold(spark, root):
    f = fold(spark, root)
    # The repeated uuid goes; a progress row with that uuid doesn't count; a user without a time clears the anchor.
    assert sorted((t.line_no, t.duration_ms) for t in f.turns.collect()) == [(6, 10_000), (9, 10_000), (16, 20_000)]
    s = f.sessions.first()
    assert (s.title, s.project_path, s.compactions, s.removed_tokens, s.primary_model) == ("a-title", "/home/me/proj", 1, 1000, "x-opus-4-1")
    assert (s.n_subagents, s.parallel_groups, s.max_degree, s.has_error, s.is_worktree, s.tool_calls) == (1, 1, 2, True, True, 2)
    # Three parent turns have a model and count; both child turns count, but not their cache reads.
    assert (s.input_tokens, s.cache_read, s.message_count) == (3 * 100 + 2 * 100, 3 * 7, s.parent_messages + 3)
    assert s.median_turn_ms == 10_000 and s.max_turn_ms == 20_000
    assert {(m.model, m.turn_count) for m in f.rolled_models.collect()} == {("x-sonnet-4-5", 1), ("x-opus-4-1", 2), ("x-haiku-4-5", 1)}


def test_reports_of_no_sessions(spark, root):
    from datetime import datetime

    from loomlog.plans.reports import analytics

    f = fold(spark, root)
    for name, df in analytics(f, f.prices, datetime(2024, 1, 2), datetime(2030, 1, 1), datetime(2030, 1, 2)).items():
        assert df.columns, name
        df.collect()


def test_exports(spark, root, tmp_path):
    f = fold(spark, root)
    rows = [r.row for r in T.csv_rows(f.records).orderBy("line_no", "pos").collect()]
    assert rows[1] == '2024-01-01T00:00:10.000Z,assistant,text,"look, ""here""",x-sonnet-4-5,100,50,'
    md = T.markdown(f.records).first().document
    assert "--- compacted ---" in md and "r1\nr2" in md and md.index("hello") < md.index("done")
    doc = json.loads(T.json_documents(f.records, f.sessions).first().document)
    assert doc["id"] == "s1" and doc["records"][0]["line_no"] == 1
    for form in ("csv", "json", "md"):
        T.write_export(f.records, f.sessions, "s1", form, str(tmp_path / form))
        assert spark.read.text(str(tmp_path / form)).count() > 0
    with pytest.raises(ValueError):
        T.write_export(f.records, f.sessions, "s1", "pdf", str(tmp_path / "pdf"))


def test_incremental(spark, root, tmp_path):
    built = []

    def build(path, keys):
        own = S.read_records(spark, path)
        if keys is not None:
            own = own.join(keys, ["project_id", "session_id"], "left_semi")
            built.append(keys.count())
        return Fold(own, pricing.price_table(spark)).sessions

    store = str(tmp_path / "store")
    assert I.refresh(spark, root, store, build).count() == 1
    new = tmp_path / "root/projects/-home-me-proj/s2.jsonl"
    new.write_text(line("user", 0, "hi") + "\n")
    assert I.refresh(spark, root, store, build).count() == 2 and built == [1]
    new.unlink()
    assert [r.session_id for r in I.refresh(spark, root, store, build).collect()] == ["s1"]


def test_stream(spark, root, tmp_path):
    from loomlog.streaming.tail import refold, stream_lines

    got = []
    q = refold(stream_lines(spark, root), lambda keys: keys, lambda df: got.extend(r.session_id for r in df.collect()), str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert got == ["s1"]


def test_tags_novelty_and_results(spark):
    s = spark.createDataFrame([("a", ["x"]), ("b", ["x"])], "session_id string, tags array<string>")
    stored = spark.createDataFrame([("a", ["x", "y"])], "session_id string, tags array<string>")
    assert {r.session_id: r.tags for r in X.with_tags(s, stored).collect()} == {"a": ["x", "y"], "b": ["x"]}
    b = spark.createDataFrame([("s", 1, 0, "tool_use", "t", None, None, None), ("s", 2, 0, "tool_result", None, "t", "old", False), ("s", 3, 0, "tool_result", None, "t", "new", True)], "session_id string, line_no long, pos int, type string, id string, tool_use_id string, content string, is_error boolean")
    assert [(r.result, r.result_error) for r in X.with_results(b).filter(F.col("type") == "tool_use").collect()] == [("new", True)]


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    from loomlog.sources import growing
    from loomlog.sources.incremental import listing
    from loomlog.sources.transcripts import scan_lines

    wrote = {"p/a.jsonl": "\ufeffone\r\n\ntwo\rthree", "p/a/subagents/agent-x.jsonl": "child\n", "p/a/subagents/agent-compact-1.jsonl": "no\n", "p/a/other/b.jsonl": "no\n", "p/_b.jsonl": "no\n", ".q/c.jsonl": "no\n", "-q r/d.jsonl": "", "-q r/e.jsonl": "é\n" * 3, "-q r/f.txt": "no\n"}
    for name, text in wrote.items():
        path = tmp_path / "projects" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    root = f"file://{tmp_path}"
    lines, files = scan_lines(spark, root), listing(spark, root)
    want = [("-q r", "e", "", n, "é") for n in (1, 2, 3)] + [("p", "a", "", n, v) for n, v in enumerate(["one", "", "two", "three"], 1)] + [("p", "a", "x", 1, "child")]
    assert sorted((r.project_id, r.session_id, r.agent_id or "", r.line_no, r.value) for r in lines.collect()) == want
    seen = {n: len(t.encode()) for n, t in wrote.items() if n not in ("p/_b.jsonl", ".q/c.jsonl", "-q r/f.txt")}
    assert {r.path.partition("/projects/")[2]: r.size for r in files.collect()} == seen
    assert all(abs(r.mtime.timestamp() - (tmp_path / "projects" / r.path.partition("/projects/")[2]).stat().st_mtime) < 1e-3 for r in files.collect())
    plans = [x._jdf.queryExecution().toString() for x in (lines, files)]
    assert not any("FileScan" in p or "Window" in p for p in plans)  # nothing of a file comes to the driver, no line is sorted
    keys = spark.createDataFrame([("p", "a"), ("-q r", "e"), ("p", "gone")], "project_id string, session_id string").coalesce(1)
    own = growing.session_lines(keys, root)
    assert sorted((r.project_id, r.session_id, r.agent_id or "", r.line_no, r.value) for r in own.collect()) == want
    assert own.rdd.getNumPartitions() > 1  # keys of one small file, read by several tasks
    assert scan_lines(spark, f"{root}/none").count() == 0
