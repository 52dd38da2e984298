"""The named methods themselves, against brute force or enumeration, and rows that are hard to tell apart."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from loomlog.llm import brown_lm, decontaminate, langid, mixing, pii, secrets_crf, simhash, warc
from loomlog.llm.common import shared_path
from pyspark.sql import functions as F

from test_operators import base_pii

SMALL = "/root/testdata/sf0.01"


# --- op2 --------------------------------------------------------------------------------------------------------


def test_op2_terms_of_the_real_table(spark):
    """Every added span follows from PMI over information content, counted here in plain Python."""
    docs = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    term = re.compile(r"(?<![^\W\d_'-])(?<!['-])[^\W\d_](?:[^\W\d_]|['-]){2,}")
    digits = lambda v: re.sub("[^0-9]", "", v)
    group = {"email": lambda v: v.rpartition("@")[2], "ip": lambda v: ".".join(v.split(".")[:2]), "card": lambda v: digits(v)[:6], "phone": lambda v: digits(v)[:4]}
    words, held, found = {}, {}, {}
    for r in docs:
        t = r["text"] or ""
        found[r["doc_id"]] = base = base_pii(t)
        spans, clean, at = sorted((s, e) for _, s, e in base), "", 0
        for s, e in spans:
            if s >= at:
                clean, at = clean + t[at:s] + "[]", e
        clean += t[at:]
        words[r["doc_id"]] = set(term.findall(clean.lower()))
        own = {}
        for kind in pii.KINDS:
            found_at: dict[str, tuple[int, str]] = {}
            matches = [(s, e) for k, s, e in base if k == kind]
            for s, e in matches:
                v = t[s:e].lower()
                for name in (f"value:{kind}:{v}", f"group:{kind}:{group[kind](v)}", f"kind:{kind}"):
                    found_at.setdefault(name, (s, (t[max(0, s - 60) : s][-60:], t[e : e + 60])))
            own |= found_at
        held[r["doc_id"]] = {name: context for name, (_, context) in own.items()}
    n, c_t, c_e = len(docs), Counter(), Counter()
    met, contexts = Counter(), defaultdict(set)
    for i, own in held.items():
        c_t.update(words[i])
        c_e.update(own.keys())
        for e, context in own.items():
            for w in words[i]:
                met[e, w] += 1
                contexts[e, w].add(context)
    ratio = {(e, w): math.log2(m * n / (c_t[w] * c_e[e])) / math.log2(n / c_e[e]) for (e, w), m in met.items() if c_e[e] < n and len(contexts[e, w]) >= 2}
    want = {(i, w) for i, own in held.items() for w in words[i] if any(ratio.get((e, w), 0) >= 0.8 for e in own)}
    texts = {r["doc_id"]: r["text"] or "" for r in docs}
    out = pii.sanitise(spark.read.parquet(f"{SMALL}/documents.parquet")).select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.*").collect()
    got = {(r.doc_id, texts[r.doc_id][r.s : r.e].lower()) for r in out}
    assert len(want) > 50 and len(got & want) >= 0.97 * max(len(got), len(want))  # contexts here ignore pieces of neighbouring findings


# --- op3 --------------------------------------------------------------------------------------------------------


def test_op3_first_pass_drops_nothing_that_scores():
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()][:60]
    r = random.Random(1)
    vocabulary = [w for _, t in items for w in decontaminate.words_of(t)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(150)) for _ in range(5)] + [" ".join(r.choice(vocabulary) for _ in range(40)) + " " + " ".join(w for w in decontaminate.words_of(t) if r.random() < 0.8) for _, t in items[:30]]
    for threshold in (0.3, 0.5):
        ix = decontaminate.build(items, threshold)
        for text in texts:
            words = decontaminate.words_of(text)
            ids = np.array([ix.terms.get(w, -1) for w in words], np.int64)
            known = np.flatnonzero(ids >= 0)
            rows = known[decontaminate.candidates(ix, np.zeros(len(known), np.int64), known, ids[known], 64)]
            starts = {s for p in rows.tolist() for s in range(max(0, -(-(p - 63) // 24)) * 24, p + 1, 24)}
            for s in range(0, len(words), 24):
                terms = np.unique(ids[s : s + 64])
                score = Counter()
                for t in terms[terms >= 0].tolist():
                    for seg, x in zip(*ix.postings[t], strict=True):
                        score[seg] += x
                assert s in starts or max(score.values(), default=0) < threshold


def test_op3_ids_of_any_kind(spark):
    item = " ".join(f"word{i}" for i in range(50)) + "? answer one two."
    items = spark.createDataFrame([(1, item), (2, None), (None, item), (3, ""), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([("a", item), ("a", "clean text"), (None, f"so {item} it goes"), (None, "clean"), ("b", None), ("9007199254740993", item)], "doc_id string, text string")
    hits = decontaminate.contamination(docs, items).collect()
    assert Counter((r.doc_id, r.item_id) for r in hits) == Counter({(d, i): n for d in ("a", None, "9007199254740993") for i, n in ((1, 2), (None, 1))})
    assert Counter((r.doc_id, r.text) for r in decontaminate.decontaminate(docs, items).collect()) == Counter([("a", "clean text"), (None, "clean"), ("b", None)])
    big = docs.select(F.lit(9007199254740993).alias("doc_id"), "text").limit(1).union(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    assert {r.doc_id for r in decontaminate.contamination(big, items).collect()} == {9007199254740993}


# --- op4 --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def crf(spark):
    return secrets_crf.train(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_op4_viterbi_is_the_best_of_all_labellings(crf):
    line = "my token was Zx81kQ99aLm2 = ok"
    tokens = secrets_crf.TOKEN.findall(line)
    e = crf.w[secrets_crf.features(np.array([secrets_crf.shape(x) for x in tokens]), 2, tokens)].sum(axis=1)
    t = crf.t + crf.banned

    def value(labels):
        return sum(t[a, b] + e[k, b] for k, (a, b) in enumerate(zip((0, *labels), labels, strict=False)))

    best = max(itertools.product(range(3), repeat=len(tokens)), key=value)
    assert tuple(crf.decode(tokens, 2).tolist()) == best


def test_op4_plain_lines_decode_to_nothing(crf):
    r = random.Random(2)
    for _ in range(300):
        tokens = [r.choice(["word", "Other", ",", ".", '"', "(", "naïve", "don't"[:3], "é"]) for _ in range(r.randrange(1, 30))]
        assert not secrets_crf.TELLING.search(" ".join(tokens)) and not crf.decode(tokens, r.randrange(4)).any()


def planted(count: int = 400) -> list[tuple[str, tuple[int, int] | None]]:
    """Lines with a secret that no base pattern finds, and as many with ids, numbers, versions and addresses."""
    r = random.Random(9)
    filler = lambda: " ".join(r.choice(["then", "we", "went", "home", "and", "saw", "it"]) for _ in range(r.randrange(1, 6)))
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    out = []
    for _ in range(count):
        value = "".join(r.choice(letters) for _ in range(r.randrange(12, 30)))
        head = f"{filler()} {r.choice(['password', 'token', 'secret', 'api_key'])} {r.choice(['is', 'was', ''])} ".replace("  ", " ")
        if re.search("[0-9].*[A-Za-z].*[0-9]", value):
            out.append((head + value + " " + filler(), (len(head), len(head) + len(value))))
        out.append((f"{filler()} {r.choice([f'item{r.randrange(999)}', f'v{r.randrange(9)}.{r.randrange(20)}.1', str(r.randrange(10**9)), f'host{r.randrange(9)}.example.com', '2024-01-05'])} {filler()} the token ring", None))
    return out


def test_op4_finds_what_the_patterns_miss(crf):
    hit = wrong = total = 0
    for line, span in planted():
        assert not secrets_crf.base_spans(line)
        got = crf.spans(line)
        total += span is not None
        hit += span in got
        wrong += sum(x != span for x in got)
    assert hit / total > 0.9 and wrong / max(1, hit + wrong) < 0.05


# --- op5 --------------------------------------------------------------------------------------------------------


def test_op5_mix_is_one_order_cut_at_the_budget(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    queue = mixing.fair_queue(docs)
    budget = sum(math.floor(r.target + 0.5) for r in queue.select("source", "target").distinct().collect())
    taken = mixing.mix(docs).select(F.spark_partition_id().alias("p"), "doc_id", "mix_epoch", "mix_words", "mix_finish", "text").collect()
    assert sum(r.mix_words for r in taken) == budget
    assert all(len(r.text.split()) == r.mix_words for r in taken)
    by_part = defaultdict(list)
    for r in taken:
        by_part[r.p].append(r.mix_finish)
    order = [x for p in sorted(by_part) for x in by_part[p]]
    assert order == sorted(order) and max(order) <= 1
    assert {r.doc_id: r.taken for r in queue.collect() if r.taken} == dict(sum((Counter({r.doc_id: r.mix_words}) for r in taken), Counter()))


def test_op5_reruns_and_twins(spark):
    rows = [(1, "a b c", "x")] * 3 + [(1, "d e f", "x"), (2, None, "x"), (3, "g", None), (4, "h i", ""), (None, "j k", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(tuple, mixing.mix(docs.repartition(n)).collect()), key=repr) for n in (1, 3)]
    assert runs[0] == runs[1]
    assert {r.source for r in mixing.fair_queue(docs).collect()} == {"x", None, ""}


# --- op6 --------------------------------------------------------------------------------------------------------


@pytest.fixture()
def archive(spark):
    warc.register(spark)
    rows = [(1, "http://a/é?q=%41 b", "x" * 100), (2, "http://a/2", None), (3, None, ""), (None, " tab\there ", "x" * 100), (4, "http://a/4", "y" * 3_000_000), (4, "http://a/4", "😀퟿"), (5, "line\nend", "x" * 100)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, record_type int, payload int")
    path = shared_path(spark, "test")
    warc.records(pages).repartition(2).write.format("warc").option("split_bytes", "1").mode("append").save(path)
    return path, rows


def test_op6_edges(spark, archive):
    path, rows = archive
    back = spark.read.format("warc").option("verify", "true").load(path).collect()
    assert len(back) == len(rows)
    assert Counter(r.record_type for r in back) == {"response": 4, "revisit": 3}
    assert {bytes(r.payload) for r in back if r.record_type == "response"} == {x.encode() for x in ("x" * 100, "", "y" * 3_000_000, "😀퟿")}
    assert {r.target_uri for r in back} == {"http://a/é?q=%41 b", "http://a/2", None, "%20tab%09here%20", "http://a/4", "line%0Aend"}
    assert sorted(r.payload_bytes for r in back) == sorted(len((x or "").encode()) for _, _, x in rows)


def test_op6_predicates_skip_payloads(spark, archive, monkeypatch):
    path, _ = archive
    reader = warc.WarcReader({"path": path}, spark.read.format("warc").load(path).schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 5)]))
    assert [type(x) for x in left] == [GreaterThan]
    parts = reader.partitions()
    assert len(parts) == 7  # a split at every record
    decoded = []
    monkeypatch.setattr(warc.Record, "payload", lambda self, row: decoded.append(row["record_id"]) or b"")
    kinds = [k for p in parts for b in reader.read(p) for k in b.column("record_type").to_pylist()]
    assert kinds == ["revisit"] * 3 and decoded == []
    assert spark.read.format("warc").load(path).filter("target_uri = 'http://a/4'").count() == 2


def test_op6_verify_fails_on_a_changed_payload(spark, tmp_path):
    warc.register(spark)
    good = warc.encode_record("response", "urn:page:1", None, "1970-01-01T00:00:00Z", None, warc.base32_sha1(b"abc"), 3, b"abc")
    (tmp_path / "bad.warc").write_bytes(good.replace(b"\r\n\r\nabc\r\n", b"\r\n\r\nabd\r\n"))
    assert spark.read.format("warc").load(str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="does not match"):
        spark.read.format("warc").option("verify", "true").load(str(tmp_path)).collect()


# --- op7 --------------------------------------------------------------------------------------------------------


def test_op7_letters_always_have_a_language(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(20)] + [(100 + i, "le chat et le chien à a", "fr") for i in range(30)], "doc_id long, text string, lang string")
    filters = langid.learn(docs)
    for text in ("a", "I", "x 5 b", "日"):
        assert filters.decide(text)[0] in ("en", "fr")
    assert filters.decide("à")[0] == "fr" and filters.decide("qqq") == ("fr", 0.0)  # a tie goes to the language with most documents
    assert filters.decide("5 .") == filters.decide(None) == ("und", 0.0)
    assert set(langid.learn(docs, max_langs=1).langs) == {"fr"}


def test_op7_blocks_change_nothing(monkeypatch):
    text = "Ein längeres Wort und noch EINES, 12 a b"
    whole = np.concatenate(list(langid.ngram_keys(text, 3)))
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert np.concatenate(list(langid.ngram_keys(text, 3))).tolist() == whole.tolist()


# --- op9 --------------------------------------------------------------------------------------------------------


def test_op9_contexts_and_moves(spark):
    docs = spark.createDataFrame([("the cat sat on the mat",), ("The dog sat",), (None,), ("",)], "text string")
    contexts = brown_lm.Contexts(2, {b"the": 0, b"sat": 1})
    got = {(r.h, r.k): r.n for r in brown_lm.left_contexts(docs, "text", contexts, flush=3).collect()}
    want = Counter()
    for t in ("the cat sat on the mat", "the dog sat", "", ""):
        before = contexts.end
        for w in [*t.encode().split(), b""]:
            want[brown_lm.word_hash(w), before] += 1
            before = contexts.number(w)
    assert got == want

    r = np.random.default_rng(4)
    table = r.integers(0, 50, (5, 3)).astype(float)
    at, k = np.array([0, 0, 1, 2, 2]), np.array([0, 3, 1, 2, 4])
    n, now = np.array([4.0, 2.0, 1.0, 3.0, 3.0]), np.array([-1, 2, 0])
    for w, c in ((1, 2), (2, 0)):  # words that have a class are counted in it
        for i in np.flatnonzero(at == w):
            table[k[i], c] += n[i]

    def likelihood(x):
        h = lambda y: float((y[y > 0] * np.log(y[y > 0])).sum())
        return h(x) - h(x.sum(axis=0))

    best = brown_lm.best_classes(table, table.sum(axis=0), at, k, n, now)
    for w in range(3):
        x = table.copy()
        for i in np.flatnonzero(at == w):
            if now[w] >= 0:
                x[k[i], now[w]] -= n[i]
        value = []
        for c in range(3):
            y = x.copy()
            for i in np.flatnonzero(at == w):
                y[k[i], c] += n[i]
            value.append(likelihood(y))
        assert value[best[w]] >= max(value) - 1e-6


def test_op9_score_is_that_of_the_model(spark):
    """With a table of 50 words, most words are joined in Spark: their scores are those of the model's tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model, words = brown_lm.train(docs.filter("doc_id % 2 = 0"), table_words=50)
    known = {bytes(r.w): (r.n, r.cls) for r in words.collect()}
    classes = model.contexts.classes
    assert {c for _, c in known.values()} >= {classes + s for s in range(3)} and model.contexts.of.keys() <= set(model.vocab.words)
    for row in np.power(10.0, model.step):
        assert abs(row.sum() - 1) < 0.02  # each context's classes share its probability
    got = {r.doc_id: r for r in brown_lm.score(docs, model, words).collect()}
    for r in docs.limit(40).collect():
        before, total = model.end, 0.0
        for w in [*brown_lm.tokens(r.text), b""]:
            n, c = known.get(w, (0, model.end if not w else classes + brown_lm.shape_class(w)))
            total += model.step[before, c] + math.log10((n + 0.5) / model.mass[c])
            before = model.contexts.number(w)
        assert abs(got[r.doc_id].score - total) < 1e-6 * max(1, abs(total))


# --- op1 and the near-duplicate stage ---------------------------------------------------------------------------


def test_near_copies_with_ids_of_any_kind(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(None, base, 1), (None, base + " end", 2), ("b", base, 3), ("b", "quite another text of seven words", 4), ("a", base + " tail", 5), ("c", None, 6), ("c", "", 7)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, rid int")
    assert sorted(r.rid for r in simhash.drop_near_copies(docs).collect()) == [4, 5, 6, 7]
    got = simhash.near_duplicates(docs.filter("text = '' OR text IS NULL OR doc_id IS NULL"))
    assert {(r.doc_id, r.component_id) for r in got.filter("fp = 0").collect()} == {("c", "c")}
