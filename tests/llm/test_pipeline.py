"""The corpus pipeline, stage by stage, against brute force on the stage's own input."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import compare
import corpus_pipeline
import numpy as np
import pytest
from loomlog.llm import simhash
from loomlog.llm.common import documents, materialise
from loomlog.llm.decontaminate import words_of
from loomlog.llm.mixing import OP5_SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def kept(spark, corpus):
    """Rows after each stage but the last, by the stage's name; and the mixture."""
    docs, out = documents(spark, corpus), {}
    out["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, corpus), name)
        assert docs.columns == documents(spark, corpus).columns
        out[name] = docs.collect()
    out["mixture"] = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    return out


def test_language_keeps_what_has_one(kept):
    gone = {r.doc_id for r in kept["input"]} - {r.doc_id for r in kept["language"]}
    known = [r for r in kept["input"] if r.lang and r.doc_id < 10_000 and len(WORD.findall(r.text or "")) >= 20]
    assert sum(r.doc_id in gone for r in known) <= 0.02 * len(known)
    assert all(any(c.isalpha() for c in r.text or "") for r in kept["language"])


def test_exact_copies(kept):
    groups = defaultdict(list)
    for r in kept["language"]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    want = Counter(min((-len(r.text), r.doc_id) for r in g)[1] for g in groups.values())
    assert Counter(r.doc_id for r in kept["exact_copies"]) == want


def test_near_duplicates(kept):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in kept["exact_copies"]}
    left = {r.doc_id for r in kept["near_duplicates"]}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    ids = sorted(sets)
    holders = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            holders[s].add(i)
    near = lambda i: {j for s in sets[i] for j in holders[s]} - {i}
    for i in left:
        assert not [j for j in near(i) & left if alike(i, j) >= 0.85]
    for i in set(ids) - left:
        assert [j for j in near(i) if alike(i, j) >= 0.7]


def test_min_hashes_are_independent():
    r = np.random.default_rng(1)
    sets = r.integers(0, 2**64, (400, 100), np.uint64)
    alone = [np.stack([simhash.min_hashes(s[i : i + 1], 5) for i in range(100)]) for s in sets]
    assert np.mean([len(set(one.argmin(axis=0).tolist())) == 5 for one in alone]) > 0.85  # 0.90 if independent
    missed = 0
    for s in r.integers(0, 2**64, (3000, 100), np.uint64):  # alike by 0.8
        a, b = simhash.band_keys(simhash.min_hashes(s[:90], 52)), simhash.band_keys(simhash.min_hashes(s[10:], 52))
        missed += not (a == b).any()
    assert missed == 0


def near_pairs(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {tuple(r) for r in simhash.near_copies(docs).collect()}


def test_repeated_lines_are_near_copies(spark):
    r = np.random.default_rng(2)
    texts, want = [], set()
    for k in range(60):  # one shingle set twice; the second text repeats a tenth of it 20 times
        words = [f"w{x}" for x in r.integers(0, 10**6, 100)]
        part = words[:14] * 20
        texts += [" ".join(words[:14] * 2 + words), " ".join(part + words)]
        want |= {(2 * k, 2 * k), (2 * k + 1, 2 * k)}
    assert near_pairs(spark, texts) == want


def test_near_copies_at_the_threshold(spark):
    def pair(k, shared, more):  # sets of shared + more shingles, of which all / shared are common
        words = [f"w{k}x{i}" for i in range(shared + more + 4)]
        return [" ".join(words), " ".join(words[: shared + 4])]

    texts, want = [], set()
    for k in range(100):
        shared, more = (400, 100) if k % 2 else (79 * 5, 21 * 5)  # 0.80 and 0.79
        texts += pair(k, shared, more)
        want |= {(2 * k, 2 * k), (2 * k + 1, 2 * k)} if k % 2 else set()
    assert near_pairs(spark, texts) == want


def test_close_fingerprints_are_linked_by_pivot_tables(spark, monkeypatch):
    r = np.random.default_rng(4)
    texts = []
    for _ in range(50):  # a text and two copies: one with another word at its end, one with two equal lines more
        words = [f"w{x}" for x in r.integers(0, 10**6, 3000)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words + words[-5:] * 2)]
    want = near_pairs(spark, texts)
    assert want == {(i, i - i % 3) for i in range(150)}
    monkeypatch.setattr(simhash, "_wide_links", lambda dealt, similarity, small: spark.createDataFrame([], "a long, b long"))
    assert near_pairs(spark, texts) == want  # without any min-hash bucket
    fp = {t: simhash._majority(simhash._ones(h), len(h)) for t in texts for h in [simhash.shingle_set(t, 5)]}
    assert max((fp[texts[3 * k]] ^ fp[texts[3 * k + j]]).bit_count() for k in range(50) for j in (1, 2)) <= 4


def test_benchmark_leaks(spark, kept, corpus):
    items = [" " + " ".join(words_of(r.text)) + " " for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    left = {r.doc_id for r in kept["benchmark_leaks"]}
    for r in kept["near_duplicates"]:
        text = " " + " ".join(words_of(r.text)) + " "
        if any(x in text for x in items):
            assert r.doc_id not in left
    assert len(left) >= 0.9 * len(kept["near_duplicates"])


def test_mixture(spark, kept, tmp_path):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(r.doc_id, r.text, r.source) for r in kept["benchmark_leaks"]]
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    pq.write_table(pa.Table.from_pandas(frame, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())]), preserve_index=False), tmp_path / "documents.parquet")
    con = compare.views(str(tmp_path))
    want = {i: n for i, n in con.execute(f"SELECT doc_id, taken FROM ({OP5_SQL})").fetchall() if n}
    got = Counter()
    for r in kept["mixture"]:
        assert len(WORD.findall(r.text)) == r.mix_words
        got[r.doc_id] += r.mix_words
    assert dict(got) == want


def test_same_when_run_again(spark, corpus, kept):
    again = corpus_pipeline.run(spark, corpus).collect()
    key = lambda r: (r.doc_id, r.mix_epoch, r.mix_words)
    assert sorted(map(key, again)) == sorted(map(key, kept["mixture"]))


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
