"""Interval containment, trigram search, bounded head reads and rank selection, each against brute force."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlog.operators import search as Q
from loomlog.operators.intervals import contained
from loomlog.plans.reports import latency_percentiles
from loomlog.sources import growing
from loomlog.sources import transcripts as S


@pytest.mark.parametrize("seed", range(2))
def test_contained(spark, seed):
    r = random.Random(seed)
    times = lambda n, most: [(r.choice("xyz") if r.random() < 0.95 else None, i, (a := r.choice([0, -50, 1_700_000_000_000]) + r.randrange(300)), a + r.choice([0, 1, r.randrange(most), -1])) for i in range(n)]
    outer, inner = times(120, 400) + [("x", 900, None, 5), ("x", 901, 5, None)], times(120, 60) + [("x", 902, None, None)]
    o, i = spark.createDataFrame(outer + outer[:3], "k string, o int, a long, z long"), spark.createDataFrame(inner, "k string, i int, f long, l long")
    got = Counter((x.o, x.i) for x in contained(o, i, ["k"], (F.col("a"), F.col("z")), (F.col("f"), F.col("l"))).collect())
    want = Counter((x[1], y[1]) for x in outer + outer[:3] for y in inner if x[0] and x[0] == y[0] and None not in (*x, *y) and y[2] <= y[3] and x[2] <= y[2] and y[3] <= x[3])
    assert got == want and want


def test_contained_meets_few_pairs(spark):
    """One session of 100,000 turns of a second, children of half a second in every tenth."""
    turns = spark.range(100_000).select(F.lit("s").alias("k"), F.col("id").alias("o"), (F.col("id") * 1000).alias("a"))
    children = turns.filter("o % 10 = 0").select("k", F.col("o").alias("i"), F.col("a").alias("f"))
    pairs = contained(turns, children, ["k"], (F.col("a"), F.col("a") + 999), (F.col("f") + 100, F.col("f") + 600))
    assert pairs.filter("o = i").count() == pairs.count() == 10_000


def transcript(folder, texts) -> None:
    folder.mkdir(parents=True)
    for n, lines in enumerate(texts):
        rows = [{"type": "user", "slug": "named" if n == 1 else None, "message": {"content": x}} for x in lines]
        (folder / f"s{n}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")


def test_search_equals_scan(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abAB é") for _ in range(r.randrange(1, 9)))
    block = lambda: r.choice([{"type": "text", "text": word()}, {"type": "thinking", "thinking": word()}, {"type": "text", "text": ""}, {"type": "tool_use", "name": "aba"}])
    texts = [[word() if r.random() < 0.5 else [block() for _ in range(3)] for _ in range(30)] for _ in range(6)]
    transcript(tmp_path / "projects/p", texts)
    records = S.read_records(spark, f"file://{tmp_path}")
    held, titles = Q.texts(records), Q.titles(records)
    index = Q.postings(held).persist()

    def brute(query: str) -> dict:
        out = {}
        for n, lines in enumerate(texts):
            every = [t for x in lines for t in ([x] if isinstance(x, str) else [b.get("text") or b.get("thinking") or "" for b in x])]
            if k := sum(query.lower() in t.lower() for t in every if t):
                out[f"s{n}"] = ("named" if n == 1 else f"s{n}", k)
        return out

    for query in ("aba", "ABAB", "b é", "a", "bb", "zzz", "aéb"):
        got = Q.search_sessions(held, titles, query, index).collect()
        assert {x.session_id: (x.title, x.matches) for x in got} == brute(query), query
        assert all(len(x.snippets) == min(3, x.matches) for x in got)
    assert Q.search_sessions(held, titles, "  ", index).count() == 0
    index.unpersist()


def test_candidates_are_narrow(spark):
    texts = spark.createDataFrame([("p", "s", i, 0, f"filler {i} " + ("needle" if i == 7 else "needless" if i == 9 else "need")) for i in range(50)], "project_id string, session_id string, line_no long, pos int, text string")
    assert {x.line_no for x in Q.candidates(Q.postings(texts), "NEEDLE").collect()} == {7, 9}


def test_heads_read_their_bytes_only(spark, tmp_path):
    folder = tmp_path / "projects/p"
    folder.mkdir(parents=True)
    line = lambda cwd, n=0: json.dumps({"pad": "x" * n, "cwd": cwd}) + "\n"
    (folder / "a.jsonl").write_text(line("", 10) + line(7) + line("/late", 5000))  # cut off inside the line
    (folder / "b.jsonl").write_text("{broken\n" + line("/first") + line("/second"))
    (folder / "c.jsonl").write_text(line("/third") * 1000)
    (folder / "d.jsonl").write_text("")
    (tmp_path / "projects/q").mkdir()
    (tmp_path / "projects/q/a.jsonl").write_text("x" * 4096 + "\n" + line("/beyond"))
    heads = growing.heads(spark, f"file://{tmp_path}")
    sizes = {(r.project_id, r.session_id): r.n for r in heads.groupBy("project_id", "session_id").agg((F.sum(F.length("value") + 1) - 1).alias("n")).collect()}
    assert max(sizes.values()) == 4096 and len(sizes) == 4  # an empty file has no line
    assert [tuple(r) for r in S.head_cwds(heads).collect()] == [("p", "/first")]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 19, 20, 21, 100, 1001])
def test_nearest_rank(spark, n):
    r = random.Random(n)
    values = sorted(r.choice([1, 511, 512, 513, r.randrange(1, 600_000)]) for _ in range(n))
    got = latency_percentiles(spark.createDataFrame([(v,) for v in values], "duration_ms long")).first()
    assert (got.p50, got.p95, got.p99, got.turns) == (*[values[max(0, math.ceil(q * n / 100) - 1)] if n else 0 for q in (50, 95, 99)], n)
    assert abs(got.avg_ms - (sum(values) / n if n else 0)) < 1e-5
