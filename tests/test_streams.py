"""Streams over files that grow: every line once, sessions upserted, secrets alerted once, sessions that turn quiet by the clock."""

from __future__ import annotations

import io
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomlog.sources import growing
from loomlog.sources.incremental import current, finished
from loomlog.streaming import live, tail


class Folder:
    def __init__(self, path):
        self.path = path
        (path / "projects/p").mkdir(parents=True)
        self.uri = f"file://{path}"

    def write(self, name: str, data: bytes, mode: str = "ab") -> None:
        with open(self.path / f"projects/p/{name}.jsonl", mode) as f:
            f.write(data)

    def drain(self, df, name: str) -> list[tuple]:
        out, state = str(self.path / f"{name}-out"), str(self.path / f"{name}-state")
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in df.sparkSession.read.schema(df.schema).parquet(out).collect())


@pytest.fixture
def folder(tmp_path):
    return Folder(tmp_path)


@pytest.mark.parametrize("data", [b"", b"\n", b"a", b"a\n", b"one\ntwo\r\n\nlong line here\nhalf", b"\n\n\nx\n"])
def test_ranges_give_each_line_once(data):
    f = pa.PythonFile(io.BytesIO(data), "r")
    whole = [x.removesuffix(b"\r").decode() for x in data.split(b"\n")[:-1]]
    for step in (1, 2, 3, 7, 100):
        got = [x for at in range(0, len(data), step) for part in growing.lines_of(f, at, min(at + step, len(data))) for x in part]
        assert [v for _, v in got] == whole
        assert all(data[s:].startswith(v.encode()) for s, v in got)
    last = [v for part in growing.lines_of(f, 0, len(data), last=True) for _, v in part]
    assert last == whole + ([data.rpartition(b"\n")[2].decode()] if not data.endswith(b"\n") and data else [])


def test_lines_come_once_and_whole(spark, folder):
    def lines():
        rows = folder.drain(growing.stream(spark, folder.uri, f"{folder.uri}/log", split_bytes="3"), "lines")
        return [(p.rpartition("/")[2], *rest) for p, *rest in rows]

    folder.write("a", b"one\ntwo\nhal")
    folder.write("b", "é\r\n".encode())
    first = [("a.jsonl", 0, "one", True), ("a.jsonl", 4, "two", True), ("b.jsonl", 0, "é", True)]
    assert lines() == first
    assert lines() == first  # nothing new
    folder.write("a", b"f\nthree\n")
    (folder.path / "projects/p/b.jsonl").unlink()
    folder.write("c", b"new\n")
    second = sorted([*first, ("a.jsonl", 8, "half", False), ("a.jsonl", 13, "three", False), ("c.jsonl", 0, "new", True)])
    assert lines() == second
    folder.write("a", b"again\n", "wb")  # replaced by a shorter one
    folder.write("b", b"back\n")
    assert lines() == sorted([*second, ("a.jsonl", 0, "again", False), ("b.jsonl", 0, "back", True)])


def test_existing_and_created(spark, folder):
    folder.write("a", b"one\n")
    run = lambda name, **options: [(p.rpartition("/")[2], v) for p, _, v, _ in folder.drain(growing.stream(spark, folder.uri, f"{folder.uri}/log-{name}", **options), name)]
    assert run("skip", existing="skip") == [] and run("hold", created="hold") == []
    folder.write("a", b"two\n")
    folder.write("b", b"three\n")
    assert run("skip", existing="skip") == [("a.jsonl", "two"), ("b.jsonl", "three")]
    assert run("hold", created="hold") == [("a.jsonl", "one"), ("a.jsonl", "two")]


def test_log_is_compacted(spark, tmp_path):
    log = growing.Log(f"file://{tmp_path}/log")
    before = {}
    for v in range(1, 40):
        now = {f"f{i}": growing.Known(v, v, 0) for i in range(v % 5, 6)}
        log.add(v, before, now)
        before = now
        assert log.state(v) == now
    log.forget(39)
    assert log.versions()[0] == 33 and log.state(39) == before


def test_session_lines_read_only_the_keys(spark, folder):
    folder.write("s1", b"a\n\nb")
    folder.write("s2", b"c\n")
    (folder.path / "projects/p/s1/subagents").mkdir(parents=True)
    (folder.path / "projects/p/s1/subagents/agent-k.jsonl").write_bytes(b"d\n")
    (folder.path / "projects/p/s1/subagents/agent-compact-k.jsonl").write_bytes(b"e\n")
    keys = spark.createDataFrame([("p", "s1"), ("p", "gone")], "project_id string, session_id string")
    got = sorted((r.session_id, r.agent_id or "", r.line_no, r.value) for r in growing.session_lines(keys, folder.uri).collect())
    assert got == [("s1", "", 1, "a"), ("s1", "", 2, ""), ("s1", "", 3, "b"), ("s1", "k", 1, "d")]


def test_pushed_sessions(spark, folder):
    store, pushed = f"{folder.uri}/store", []
    build = lambda lines: lines.groupBy("project_id", "session_id").agg(F.count("*").alias("n"))
    push = lambda df: pushed.extend((r.session_id, r.event) for r in df.collect())
    run = lambda: tail.push_sessions(growing.stream(spark, folder.uri, f"{folder.uri}/log"), folder.uri, store, build, f"{folder.uri}/state", push, once=True).awaitTermination()
    rows = lambda: sorted((r.session_id, r.n) for r in current(spark, store).collect())
    folder.write("s1", b"a\n")
    folder.write("s2", b"a\n")
    run()
    assert rows() == [("s1", 1), ("s2", 1)] and sorted(pushed) == [("s1", "created"), ("s2", "created")]
    pushed.clear()
    folder.write("s1", b"b\n")
    folder.write("s3", b"a\n")
    run()
    assert rows() == [("s1", 2), ("s2", 1), ("s3", 1)] and sorted(pushed) == [("s1", "updated"), ("s3", "created")]
    batch = spark.createDataFrame([(f"{folder.uri}/projects/p/s1.jsonl", False)], "path string, is_new boolean")
    pushed.clear()
    folder.write("s1", b"c\n")
    tail.push_batch(batch, 1, folder.uri, store, build, push)  # the second batch again
    assert rows() == [("s1", 2), ("s2", 1), ("s3", 1)] and not pushed
    for n in range(2, 18):  # over a merge
        tail.push_batch(batch, n, folder.uri, store, build)
        assert finished(spark, store, n + 1)
    assert rows() == [("s1", 3), ("s2", 1), ("s3", 1)]


def test_secrets_are_alerted_once(spark, folder):
    live.keep_state(spark)
    alerts = lambda name, store: [(f, p.rpartition("/")[2]) for f, _, _, p, _ in folder.drain(live.secret_alerts(growing.stream(spark, folder.uri, f"{folder.uri}/log-{name}", created="hold"), store), name)]
    store = spark.createDataFrame([("SEC005:pass…25",)], "fingerprint string")
    folder.write("a", b"password = hunter22\n" * 5 + b"password = hunter2222222x\n")
    assert alerts("one", store) == []  # creation alerts nothing
    folder.write("a", b"more\n")
    one = [("SEC005:pass…19", "a.jsonl")]
    assert alerts("one", store) == one
    folder.write("a", b"password = hunter22\n")
    assert alerts("one", store) == one  # the same checkpoint
    folder.write("b", b"password = hunter22\npassword = hunter333333\n")
    folder.write("c", b"x\n")
    known = store.unionByName(spark.createDataFrame([(one[0][0],)], "fingerprint string"))
    assert alerts("two", known) == []
    for name in "abc":
        folder.write(name, b"y\n")
    assert alerts("two", known) == [("SEC005:pass…23", "b.jsonl")]  # a fresh checkpoint with the store


def test_sessions_turn_live_and_quiet(spark, tmp_path):
    live.keep_state(spark)
    start = datetime(2024, 1, 1)

    def folder_of(name: str, schema: str):
        path = tmp_path / name
        path.mkdir()
        return spark.readStream.schema(schema).json(str(path)), lambda n, *rows: (path / f"{n}.json").write_text("".join(f"{r}\n" for r in rows))

    ts = lambda s: (start + timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")
    updates, update = folder_of("updates", "session_id string, ts timestamp")
    ticks, tick = folder_of("ticks", "ts timestamp")
    row = lambda session, s: f'{{"session_id": "{session}", "ts": "{ts(s)}"}}'
    out = live.live_changes(updates, ticks)
    q = out.writeStream.format("memory").queryName("live_changes").option("checkpointLocation", str(tmp_path / "state")).start()
    zero = int((start - datetime(1970, 1, 1)).total_seconds() * 1000)
    got = lambda: sorted(((r.at_ms - zero) // 1000, r.session_id, r.state) for r in spark.table("live_changes").collect())
    try:
        update(1, row("a", 0), row("b", 5))
        q.processAllAvailable()
        assert got() == [(0, "a", "live"), (5, "b", "live")]
        update(2, row("a", 40))
        tick(1, f'{{"ts": "{ts(59)}"}}')
        q.processAllAvailable()
        assert len(got()) == 2  # within a minute of the last update
        tick(2, f'{{"ts": "{ts(80)}"}}')
        q.processAllAvailable()
        assert got()[2:] == [(65, "b", "quiet")]
        tick(3, f'{{"ts": "{ts(101)}"}}')
        q.processAllAvailable()
        assert got()[2:] == [(65, "b", "quiet"), (100, "a", "quiet")]
        update(3, row("a", 200), row("a", 300))
        tick(4, f'{{"ts": "{ts(400)}"}}')
        q.processAllAvailable()
        assert got()[4:] == [(200, "a", "live"), (260, "a", "quiet"), (300, "a", "live"), (360, "a", "quiet")]
    finally:
        q.stop()


def test_live_times_are_rounded_to_milliseconds(spark, tmp_path):
    live.keep_state(spark)
    (tmp_path / "updates").mkdir()
    (tmp_path / "ticks").mkdir()
    at = ["2024-01-01T00:00:00.001499Z", "2024-01-01T00:01:00.001500Z"]
    (tmp_path / "updates/1.json").write_text("".join(f'{{"session_id": "a", "ts": "{t}"}}\n' for t in at))
    (tmp_path / "ticks/1.json").write_text('{"ts": "2100-01-01T00:00:00Z"}')
    read = lambda name, schema: spark.readStream.schema(schema).json(str(tmp_path / name))
    out = live.live_changes(read("updates", "session_id string, ts timestamp"), read("ticks", "ts timestamp"))
    path, zero = str(tmp_path / "out"), 1_704_067_200_000
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(path).collect())
    assert got == [("a", "live", zero + 1), ("a", "live", zero + 60_002), ("a", "quiet", zero + 60_001), ("a", "quiet", zero + 120_002)]
