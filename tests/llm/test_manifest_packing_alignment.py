"""Merkle manifest, packing and token alignment against plain versions of their own, on the smallest tables and rows made to be awkward."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_plain import aligned_plainly

from loomlog.llm import packing
from loomlog.llm.alignment import Links, align, looked_up, op13_token_alignment, write_shards
from loomlog.llm.common import documents
from loomlog.llm.merkle import leaf_hash, manifest, op11_merkle_manifest
from loomlog.llm.packing import END, WINDOW, Levels, WordEncoder, op12_packing, pack, vocabulary

NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def rows_of(spark, folder, *names):
    return [tuple(r) for r in documents(spark, folder).select(*names).collect()]


# --- Merkle manifest --------------------------------------------------------------------------------------------


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def steps(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for nodes in tree[:-1]:
        first = at // 8 * 8
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        at //= 8
    return out


def manifest_plainly(rows: list[tuple]) -> Counter:
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    for k in langs:
        langs[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: levels([leaf(r) for r in langs[k]]) for k in order}
    top = levels([trees[k][-1][0] for k in order]) if order else [[""]]
    out = Counter()
    for n, k in enumerate(order):
        for i, r in enumerate(langs[k]):
            path = steps(trees[k], i) + steps(top, n)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            low = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            node = leaf((*r[:4], low)) if hit else leaf(r)
            for left, right in path:
                node = H(left, node, right)
            out[r[0], leaf(r), trees[k][-1][0], top[-1][0], H(*[left + right for left, right in path]), node, node == top[-1][0]] += 1
    return out


def test_manifest(spark, corpus, bare):
    for folder in (corpus, bare):
        got = Counter(tuple(r) for r in op11_merkle_manifest(spark, folder).collect())
        assert got == manifest_plainly(rows_of(spark, folder, *NAMES))


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [1, 1], [64, 65, 1], [1] * 9])
def test_manifest_shapes(spark, sizes):
    rows = [(i * 100 + j, "s", None if i == 0 else f"l{i}", j, "Text") for i, n in enumerate(sizes) for j in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = {r.doc_id: (r.leaf, r.subroot, r.root) for r in manifest(docs).collect()}
    want = {k[0]: k[1:4] for k in manifest_plainly(rows)}
    assert got == want


def test_manifest_of_nothing(spark, empty):
    assert op11_merkle_manifest(spark, empty).count() == 0


def test_leaf_fields_cannot_shift(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc"), ("-", "abc")], "x string, y string")
    assert df.select(leaf_hash([F.col("x"), F.col("y")]).alias("h")).distinct().count() == 5


# --- packing ----------------------------------------------------------------------------------------------------


def ids_plainly(texts: list[str | None]) -> list[list[int]]:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [[*e.ids, END] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_are_encoded_as_in_whole_texts():
    r = random.Random(1)
    bits = ["a", "B", "s", "'", "'s", "1", "_", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", " ", "é", "é", "̸", "Σ", "ß", "İ", "<|endoftext|>", "<|", "|>", "½", "²", "日本", "😀", "=", "!", "-", "​", "﻿", "\x00", "ﬁ", "क्षि"]
    bits += [chr(c) for c in range(0x80, 0x250)]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(4000)] + ["", "x" * 5000, " ".join(map(str, range(3000)))]
    encode = WordEncoder(vocabulary("word_bpe_49k.json"))
    got = [ids.tolist() + [END] for i in range(0, len(texts), 500) for ids in encode(pa.array(texts[i : i + 500]))]
    assert got == ids_plainly(texts)
    assert [x.tolist() for x in encode(pa.array(["a b", "", "c"])[1:])] == [[], encode(pa.array(["c"]))[0].tolist()]  # a slice


def test_words_forgotten_are_encoded_anew(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 10)
    encode, texts = WordEncoder(vocabulary("word_bpe_49k.json")), [f"word{i} naïve café{i}" for i in range(50)]
    got = [encode(pa.array([t]))[0].tolist() + [END] for t in texts]
    assert got == ids_plainly(texts) and len(encode.known) < 40


@pytest.mark.parametrize("seed", range(3))
def test_levels_choose_the_smallest_sum_of_squares(seed):
    r, window = random.Random(seed), 20
    chosen, counts = Levels(window), [0] * (window + 1)
    for _ in range(300):
        size = r.randrange(1, window)

        def after(level: int, size: int = size) -> int:
            c = list(counts)
            c[level] -= level > 0
            c[level + size] += 1
            return sum(x * x for x in c[1:window])

        options = [h for h in range(window - size + 1) if h == 0 or counts[h]]
        best = min(map(after, options))
        level = chosen.choose(size)
        assert level == max(h for h in options if after(h) == best)
        chosen.move(level, level + size)
        counts[level] -= level > 0
        counts[level + size] += 1
        assert chosen.counts[1:window].tolist() == counts[1:window]


def checked_pieces(pieces: list[tuple], documents: list[tuple], window: int) -> tuple[int, int]:
    """Padding, and the number of documents under a window that are cut."""
    by_id, sequences = defaultdict(list), defaultdict(list)
    for row_id, start, length, crc, tokens, sequence, offset in pieces:
        by_id[row_id].append((start, length, crc, tokens))
        sequences[sequence].append((offset, length))
    want = defaultdict(list)
    for row_id, ids in documents:
        want[row_id].append(ids)
    assert by_id.keys() == want.keys()
    cut = 0
    for row_id, texts in want.items():
        if len(texts) > 1:  # rows of one id: together they have the pieces of all
            assert sum(p[1] for p in by_id[row_id]) == sum(map(len, texts))
            continue
        at, ids = 0, texts[0]
        for start, length, crc, tokens in sorted(by_id[row_id]):
            assert start == at and length > 0 and tokens == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            at += length
        assert at == len(ids)
        cut += len(by_id[row_id]) > 1 and len(ids) < window
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, cut


def test_packing(spark, corpus, bare):
    for folder in (corpus, bare):
        texts = rows_of(spark, folder, "doc_id", "text")
        docs = [(i, ids) for (i, _), ids in zip(texts, ids_plainly([t for _, t in texts]), strict=True)]
        got = [tuple(r) for r in op12_packing(spark, folder).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
        padding, cut = checked_pieces(got, docs, WINDOW)
        assert padding == 0 and cut <= len(docs) // 5


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_packer_bounds_open_windows(limit):
    r, window = random.Random(limit), 64
    packer, docs, out, most = packing.Packer(window, limit), [], [], 0
    for i in range(400):
        ids = np.array([r.randrange(1000) for _ in range(r.choice([1, 33, 33, 33, 40, 64, 130, r.randrange(1, 64)]))], dtype="<u4")
        docs.append((i, ids.tolist()))
        out.extend(packer.put(i, ids))
        most = max(most, packer.n_open)
    out.extend(packer.finish())
    pieces = [(p[0], p[1], len(p[2]), zlib.crc32(p[2].tobytes()), p[3], n, sum(len(q[2]) for q in w[:k])) for n, w in enumerate(out) for k, p in enumerate(w)]
    assert checked_pieces(pieces, docs, window)[0] == 0 and most <= limit


def test_packed_ids(spark, empty):
    docs = spark.createDataFrame([("a", "one two three " * 3000, 1), ("b", None, 2), (None, "x", 3)], "id string, body string, start int")
    rows = pack(docs, vocabulary("word_bpe_49k.json"), "id", "body").orderBy("id", "start").collect()
    whole = [i for r in rows if r.id == "a" for i in r.ids]
    assert whole == ids_plainly(["one two three " * 3000])[0] and [r.ids for r in rows if r.id == "b"] == [[END]]
    assert op12_packing(spark, empty).count() == 0


# --- alignment --------------------------------------------------------------------------------------------------


def test_alignment(spark, corpus, bare):
    for folder in (corpus, bare):
        got = Counter(tuple(r) for r in op13_token_alignment(spark, folder).collect())
        assert got == Counter(aligned_plainly(rows_of(spark, folder, "doc_id", "text")))


def test_alignment_of_odd_texts(spark, empty):
    r = random.Random(2)
    bits = ["a", "the ", "  ", "\n", "\t", "é", "é", "▁", "日本", "😀", "<|endoftext|>", "<s>", "<0x41>", "ﬁ", " ", "\x00", "12", "'s", "½", "​"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(9))) for _ in range(300)] + [None, "", " ", "▁", "x" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = Counter(tuple(x) for x in align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), batch_bytes=200, held_keys=50).collect())
    want = Counter(aligned_plainly(list(enumerate(texts))))
    assert got == want and any(k[1] == 0 for k in want) and any(k[1] for k in want)
    assert op13_token_alignment(spark, empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_links(seed):
    r = random.Random(seed)
    cuts = lambda n: np.diff([0, *sorted(r.sample(range(1, n), r.randrange(n - 1))), n])
    sizes = [r.randrange(2, 12) for _ in range(20)]
    a, b = [cuts(n) for n in sizes], [cuts(n) for n in sizes]
    first = np.concatenate([[0], np.cumsum([len(x) for x in a])])
    links = Links.of(np.concatenate(a), np.concatenate(b), first)
    spans = lambda lengths: list(zip(np.cumsum(lengths) - lengths, np.cumsum(lengths), strict=True))
    sa, sb = spans(np.concatenate(a)), spans(np.concatenate(b))
    assert list(zip(links.a, links.b, strict=True)) == [(i, j) for i, (p, q) in enumerate(sa) for j, (s, e) in enumerate(sb) if p < e and s < q]
    assert [i for i, c in zip(links.a, links.closes, strict=True) if c] == [i for i, (_, q) in enumerate(sa) if q in {e for _, e in sb}]


def test_shards(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(60) << 32 | r.randrange(9), r.randrange(1, 5)) for _ in range(3000)]
    want = Counter()
    for k, n in rows:
        want[k] += n
    ordered = spark.createDataFrame(rows, "key long, n long").repartitionByRange(6, "key").sortWithinPartitions("key")
    said = write_shards(ordered, f"file://{tmp_path}/shards").collect()
    shards = sorted([(x.path, x.first, x.last, x.n) for x in said if x.path], key=lambda s: s[1])
    assert len(shards) > 3 and sum(s[3] for s in shards) == len(want)
    keys = np.array(sorted(want), dtype=np.int64)
    assert looked_up(keys, shards).tolist() == [want[k] for k in keys.tolist()]
    assert looked_up(keys[5:7], shards).tolist() == [want[k] for k in keys[5:7].tolist()]
    best = {}
    for k, n in want.items():
        best[k >> 32] = max(best.get(k >> 32, 0), n)
    found: dict[int, int] = {}
    for x in said:  # a b may have keys in two shards
        if x.b is not None:
            found[x.b] = max(found.get(x.b, 0), x.best)
    assert found == best
