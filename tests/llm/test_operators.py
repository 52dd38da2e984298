"""The ten operators against brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from loomlog.llm import registry
from loomlog.llm.decontaminate import build, wand, words_of
from loomlog.llm.pii import sanitise, sanitised_text
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def roots(n: int, links) -> list[int]:
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables_give_empty_tables(spark, empty, name):
    df = registry.QUERIES[name](spark, empty)
    assert df.columns and df.count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql_with_edge_rows(spark, corpus, name):
    assert compare.differences(spark, compare.views(corpus), registry.QUERIES[name], registry.ORACLE_SQL[name], corpus) == ""


def test_op1(spark, corpus, texts):
    def fingerprint(t):
        w = WORD.findall(lower(t or ""))
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    rows = [(r["doc_id"], fingerprint(r["text"])) for r in texts]
    fp = np.array([f for _, f in rows], np.uint64)
    links = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4) if j > i]
    root = roots(len(rows), links)
    least = defaultdict(lambda: 1 << 60)
    for (i, _), g in zip(rows, root, strict=True):
        least[g] = min(least[g], i)
    want = sorted((i, f"{f:016x}", least[g]) for (i, f), g in zip(rows, root, strict=True))
    assert sorted(tuple(r) for r in registry.QUERIES["op1_simhash_near_dedup"](spark, corpus).select("doc_id", "fingerprint", "component_id").collect()) == want


def base_pii(t: str):
    def luhn(d):
        return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m[0])]


def show(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_op2(spark, corpus, texts):
    got = registry.QUERIES["op2_pii_sanitisation"](spark, corpus).collect()
    want = Counter()
    for r in texts:
        base = base_pii(r["text"] or "")
        n = Counter(k for k, _, _ in base)
        want[(r["doc_id"], n["email"], n["ip"], n["card"], n["phone"], sha(show(base)))] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    by_id = {r["doc_id"]: show(base_pii(r["text"] or "")) for r in texts}
    assert all((r.spans or "").startswith(by_id[r.doc_id]) for r in got)


def test_op2_terms_that_disclose_go(spark):
    rows = [(i, f"Please write to Quillfeather {i} at q@example.org soon, item {i}.") for i in range(4)] + [(100 + i, f"Please write to someone soon, item {i}.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sanitise(docs).join(docs, "doc_id").select("doc_id", sanitised_text(F.col("text"), F.col("found"), F.col("terms")).alias("clean")).collect()
    assert all("Quillfeather" not in r.clean and "q@example.org" not in r.clean for r in out)
    assert all("write" in r.clean for r in out)


def test_op2_terms_far_from_the_entity_go(spark):
    far = "and so on with the same old words as ever " * 4
    rows = [(i, f"Mail {i} to q@example.org now. {far} Quillfeather said so, {far} and quillfeather again.") for i in range(4)] + [(100 + i, f"Mail {i} to someone now. {far} He said so again.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sanitise(docs).join(docs, "doc_id").select("doc_id", sanitised_text(F.col("text"), F.col("found"), F.col("terms")).alias("clean")).collect()
    assert len(out) == 64 and all("quillfeather" not in r.clean.lower() and "q@example.org" not in r.clean for r in out)
    assert all("same old words" in r.clean and "said so" in r.clean for r in out)


def test_op3(spark, corpus, texts):
    items = {r["item_id"]: words_of(r["text"]) for r in pq.read_table(f"{corpus}/benchmark.parquet").to_pylist()}
    got = {(r.doc_id, r.item_id) for r in registry.QUERIES["op3_benchmark_decontamination"](spark, corpus).collect()}
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    for r in texts:
        w = words_of(r["text"] or "")
        joined, have = " " + " ".join(w) + " ", grams(w) if w else set()
        for k, x in items.items():
            if " " + " ".join(x) + " " in joined:
                assert (r["doc_id"], k) in got
            elif (r["doc_id"], k) in got:
                assert len(grams(x) & have) / len(grams(x)) > 0.5


def test_op3_wand_finds_what_scoring_all_finds():
    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()]
    for threshold in (0.1, 0.3, 0.5):
        ix = build(items, threshold, block=4)
        for _, text in items[:20]:
            terms = sorted({ix.terms[w] for w in words_of(text)[3:] if w in ix.terms})
            score = Counter()
            for t in terms:
                for s, x in zip(*ix.postings[t], strict=True):
                    score[s] += x
            want = {s: x for s, x in score.items() if x >= threshold - 1e-9}
            found = dict(wand(ix, terms))
            assert found.keys() == want.keys()
            assert all(abs(found[s] - want[s]) < 1e-9 for s in want)


def base_secrets(t: str):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_op4(spark, corpus, texts):
    got = registry.QUERIES["op4_secret_scan"](spark, corpus).collect()
    want = Counter()
    for r in texts:
        base = base_secrets(r["text"] or "")
        n = Counter(k for k, _, _ in base)
        want[(r["doc_id"], n["assign"], n["access"], n["hex"], sha(show(base)))] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    by_id = {r["doc_id"]: base_secrets(r["text"] or "") for r in texts}
    assert all({f"{k}:{s}:{e}" for k, s, e in by_id[r.doc_id]} <= set(r.spans.split(",")) | {""} for r in got)


def test_op6(spark, corpus):
    pages = pq.read_table(f"{corpus}/pages.parquet").to_pylist()
    first: dict[bytes, int] = {}
    for r in sorted(pages, key=lambda r: r["page_id"]):
        first.setdefault((r["html"] or "").encode(), r["page_id"])
    want = set()
    for r in pages:
        p = (r["html"] or "").encode()
        own = first[p] == r["page_id"]
        want.add((r["page_id"], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if own else "revisit", None if own else first[p]))
    got = registry.QUERIES["op6_warc_round_trip"](spark, corpus).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(pages)


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = registry.QUERIES["op7_language_id"](spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    judged = [r.lang_pred == truth[r.doc_id]["lang"] for r in got if r.held_out and truth[r.doc_id]["lang"] and len((truth[r.doc_id]["text"] or "").split()) >= 5]
    assert np.mean(judged) > 0.95


def test_op7_edges(spark, corpus, texts):
    got = {r.doc_id: r for r in registry.QUERIES["op7_language_id"](spark, corpus).collect()}
    known = {r["lang"] for r in texts if r["lang"]}
    for r in texts:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]].lang_pred == "und" and got[r["doc_id"]].score == 0
        assert got[r["doc_id"]].lang_pred in known | {"und"}


def test_op8(spark, corpus, texts):
    words = [WORD.findall(r["text"] or "") for r in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(texts, words, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = True
        want[(r["doc_id"], len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))] += 1
    got = registry.QUERIES["op8_substring_dedup"](spark, corpus).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want


def test_op9(spark, corpus, texts):
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [(*WORD.findall(lower(r["text"] or "")), None) for r in texts]
    counts = Counter(t for r, ts in zip(texts, tokens, strict=True) if not out(r["doc_id"]) for t in ts)
    total, floor = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = defaultdict(list)
    for r, ts in zip(texts, tokens, strict=True):
        want[r["doc_id"]].append((len(ts), sum(counts[t] > 0 for t in ts), math.fsum(math.log10((counts[t] + 0.5) / floor) for t in ts)))
    got = registry.QUERIES["op9_brown_lm"](spark, corpus).collect()
    assert len(got) == len(texts)
    for r in got:
        n, known, base = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), n, known, total)
        assert abs(r.base_score - base) <= 1e-6 * max(1, abs(base))
        assert math.isfinite(r.score) and r.score < 0


def test_op9_classes_beat_words_alone(spark):
    got = [r for r in registry.QUERIES["op9_brown_lm"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
