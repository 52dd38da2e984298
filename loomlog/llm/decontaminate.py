"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap checks.

Index. Each test item is cut into segments of at most ``segment`` words, the postings of the inverted
index. A posting's impact is its BM25 contribution divided by the segment's score against itself, so that one
threshold fits all segments. Postings are ordered by segment; every ``block`` consecutive segments have their maximum stored
per term (block-max).

Search. Every passage (``passage`` words, starting every ``stride`` words) of every document is a query. A
vectorised first pass bounds, for all passages of a batch, the score any segment can reach and drops
the passages in which none can reach the threshold; the remaining ones run block-max WAND and return every
segment at or above the threshold (no top-k). Hits are verified against the document's words: the shares of the
item's question and of its answer, as word 3-grams, found around the hit.

The test set is dealt into index shards of at most ``shard_bytes`` of text, built one after the other and broadcast; the documents are
scanned once, a column of hits for each shard. What is broadcast has the size of the test set, a given table of
evaluation items, never that of the corpus.

Defined cases: null or empty texts match nothing; an item without words matches nothing; items
that repeat a text or an id are all reported, null item ids too; an item without a sentence end has no answer, its
whole text is the question; a passage is cut from whole texts of any length; each row is reported by its own text, so that null and
repeated ids change nothing; columns of any name pass through; empty tables give an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, text_batches

WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is what follows the last question mark, or else the last sentence."""
    head, mark, tail = text.rpartition("?")
    if not mark:
        parts = SENTENCE.split(text.strip())
        head, tail = (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")
    return words_of(head), words_of(tail)


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


@dataclass
class Index:
    """One shard: ``postings[t]`` lists (segment, impact) of term t in order of segment."""

    threshold: float
    block: int
    items: list[tuple[object, int, set, set]]  #: id, words, 3-grams of the question and of the answer
    owner: list[int] = field(default_factory=list)  #: segment -> number of its item
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[tuple[list[int], list[float]]] = field(default_factory=list)
    maxima: list[dict[int, float]] = field(default_factory=list)  #: term -> block -> greatest impact
    top: list[float] = field(default_factory=list)  #: term -> greatest impact
    # The first pass bounds each segment (blocks of one): term -> its segments, as offsets into ids and impacts.
    offsets: np.ndarray = None
    segs: np.ndarray = None
    bounds: np.ndarray = None
    slack: float = 0.0  #: what terms left out of the first pass can add to any segment's bound


def build(items: list[tuple[object, str]], threshold: float, segment: int = 40, block: int = 8, left_out: float = 0.4, k1: float = 1.2, b: float = 0.75) -> Index:
    ix = Index(threshold, block, [])
    segments: list[list[str]] = []
    for item_id, text in items:
        words = words_of(text or "")
        if not words:
            continue
        question, answer = question_and_answer(text)
        # The answer's 3-grams begin in the question, so that an answer of a word or two has some.
        ix.items.append((item_id, len(words), trigrams(question), trigrams(question[-2:] + answer) if answer else set()))
        n = -(-len(words) // segment)
        for k in range(n):
            segments.append(words[k * len(words) // n : (k + 1) * len(words) // n])
            ix.owner.append(len(ix.items) - 1)
    found: dict[str, list[tuple[int, int]]] = {}
    for s, words in enumerate(segments):
        for w in set(words):
            found.setdefault(w, []).append((s, words.count(w)))
    mean, total = np.mean([len(s) for s in segments] or [1]), len(segments)
    raw = {w: [(s, np.log(1 + (total - len(at) + 0.5) / (len(at) + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(segments[s]) / mean))) for s, f in at] for w, at in found.items()}
    own = np.zeros(total)
    for at in raw.values():
        for s, x in at:
            own[s] += x
    weak = np.zeros(total)  # per segment, the share of its score that the first pass leaves out
    sparse: list[list[tuple[int, float]]] = []
    for w in sorted(raw, key=lambda w: -len(raw[w])):
        ix.terms[w] = len(ix.terms)
        seg, impact = np.array([s for s, _ in raw[w]]), np.array([x / own[s] for s, x in raw[w]])
        ix.postings.append((seg.tolist(), impact.tolist()))
        best: dict[int, float] = {}
        for s, x in zip((seg // block).tolist(), impact.tolist(), strict=True):
            best[s] = max(best.get(s, 0.0), x)
        ix.maxima.append(best)
        # Frequent terms go first: a term is left out while no segment loses over ``left_out`` of the threshold.
        if (weak[seg] + impact).max() < threshold * left_out:
            weak[seg] += impact
            sparse.append([])
        else:
            sparse.append(list(zip(*ix.postings[-1], strict=True)))
    ix.slack = float(weak.max(initial=0))
    ix.top = [max(x.values()) for x in ix.maxima]
    ix.offsets = np.concatenate(([0], np.cumsum([len(x) for x in sparse]))).astype(np.int64)
    flat = [y for x in sparse for y in x]
    ix.segs, ix.bounds = np.array([y for y, _ in flat], np.int64), np.array([y for _, y in flat], float)
    return ix


def candidates(ix: Index, docs: np.ndarray, at: np.ndarray, terms: np.ndarray, passage: int) -> np.ndarray:
    """Word occurrences (rows of the three arrays) from which some segment can reach the threshold within ``passage`` words."""
    count = ix.offsets[terms + 1] - ix.offsets[terms]
    row = np.repeat(np.arange(len(terms)), count)
    if not len(row):
        return row
    entry = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ix.offsets[terms], count)
    order = np.lexsort((at[row], docs[row], ix.segs[entry]))
    row, entry = row[order], entry[order]
    # Places on one line: stretches of (segment, document) lie too far apart to meet in one passage.
    new = np.r_[True, (np.diff(ix.segs[entry]) != 0) | (np.diff(docs[row]) != 0)]
    place = at[row] + (np.cumsum(new) - 1) * (int(at.max()) + passage + 1)
    total = np.concatenate(([0.0], np.cumsum(ix.bounds[entry])))
    reach = total[np.searchsorted(place, place + passage)] - total[:-1]
    return np.unique(row[reach + ix.slack >= ix.threshold - 1e-9])


def wand(ix: Index, terms: list[int]) -> list[tuple[int, float]]:
    """All segments that score the threshold or more for a query of distinct terms (document at a time, block-max WAND)."""
    cursor = [[0, ix.postings[t][0][0], t] for t in terms]
    out, end = [], 1 << 60
    limit = ix.threshold - 1e-9

    def advance(c: list[int], to: int) -> None:
        seg = ix.postings[c[2]][0]
        c[0] = bisect_left(seg, to, c[0])
        c[1] = seg[c[0]] if c[0] < len(seg) else end

    while True:
        cursor.sort(key=itemgetter(1))
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursor):
            if c[1] == end:
                break
            bound += ix.top[c[2]]
            if bound >= limit:
                pivot = c[1]
                break
        if pivot < 0:
            return out
        upto = [c for c in cursor if c[1] <= pivot]
        block = pivot // ix.block
        if sum(ix.maxima[c[2]].get(block, 0.0) for c in upto) < limit:
            # No segment of this block qualifies with these terms: move to its end, or to the next term's place.
            following = min((c[1] for c in cursor if c[1] > pivot), default=end)
            to = max(pivot + 1, min((block + 1) * ix.block, following))
            for c in upto:
                advance(c, to)
        elif cursor[0][1] == pivot:
            score = sum(ix.postings[c[2]][1][c[0]] for c in upto)
            if score >= limit:
                out.append((pivot, score))
            for c in upto:
                advance(c, pivot + 1)
        else:
            for c in upto:
                advance(c, pivot)


def search(ix: Index, texts: list[str], passage: int, stride: int, piece: int = 1 << 18) -> Iterator[tuple[int, int, float, float, float]]:
    """(text number, item id, best score, question overlap, answer overlap) of every item found in a text.

    Texts are taken together until they hold ``piece`` words.
    """
    held: list[tuple[int, list[str]]] = []
    size = 0
    for number, text in enumerate(texts):
        if text:
            held.append((number, words_of(text)))
            size += len(held[-1][1])
        if held and (size >= piece or number == len(texts) - 1):
            yield from _search(ix, held, passage, stride)
            held, size = [], 0


def _search(ix: Index, held: list[tuple[int, list[str]]], passage: int, stride: int) -> Iterator[tuple[int, int, float, float, float]]:
    get = ix.terms.get
    ids = [np.array([get(w, -1) for w in words], np.int64) for _, words in held]
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    at = np.concatenate([np.arange(len(x)) for x in ids])
    term = np.concatenate(ids)
    known = np.flatnonzero(term >= 0)
    rows = known[candidates(ix, doc[known], at[known], term[known], passage)]
    starts: dict[int, set[int]] = {}
    for d, p in zip(doc[rows].tolist(), at[rows].tolist(), strict=True):
        first = max(0, -(-(p - passage + 1) // stride))
        starts.setdefault(d, set()).update(range(first * stride, p + 1, stride))
    for d, begin in starts.items():
        number, words = held[d]
        best: dict[int, tuple[float, int, int]] = {}
        for s in begin:
            terms = np.unique(ids[d][s : s + passage])
            for seg, score in wand(ix, terms[terms >= 0].tolist()):
                x, lo, hi = best.get(item := ix.owner[seg], (0.0, s, s))
                best[item] = (max(x, score), min(lo, s), max(hi, s))
        for item, (score, lo, hi) in best.items():
            item_id, around, *parts = ix.items[item]
            have = trigrams(words[max(0, lo - around) : hi + passage + around])
            share = [len(g & have) / len(g) if g else -1.0 for g in parts]
            yield number, item_id, score, *share


def _scan(shared: Broadcast, overlap: float, passage: int, stride: int) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """A function from batches of texts to their verified items in one broadcast index."""

    def verified(question: float, answer: float) -> bool:
        enough = lambda x: x < 0 or x >= overlap  # noqa: E731  (negative: the item has no such part)
        return enough(question) and enough(answer) or min(question, answer) >= 0 and (question + answer) / 2 >= overlap

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            for number, item, score, question, answer in search(shared.value, batch.tolist(), passage, stride):
                if verified(question, answer):
                    found[number].append({"item": item, "score": score, "question": None if question < 0 else question, "answer": None if answer < 0 else answer})
            yield pd.Series(found)

    return scan


def _hits(docs: DataFrame, items: DataFrame, text: str, item_col: str, item_text: str, threshold: float, overlap: float, passage: int, stride: int, segment: int, shard_bytes: int) -> list[Column]:
    """For each index shard a column of ``docs``: its verified items, array<struct<item, score, question, answer>>."""
    if segment > passage - stride:
        raise ValueError("a segment must fit into some passage whole: segment <= passage - stride")
    spark = docs.sparkSession
    text_batches(spark)
    chosen = items.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    shards = max(1, -(-(chosen.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // shard_bytes))
    kind = f"array<struct<item: {dict(items.dtypes)[item_col]}, score: double, question: double, answer: double>>"

    out = []
    for k in range(shards):
        own = chosen.filter(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k) if shards > 1 else chosen
        shared = spark.sparkContext.broadcast(build([(r["i"], r["t"]) for r in own.orderBy("i", "t").collect()], threshold, segment))
        out.append(F.pandas_udf(_scan(shared, overlap, passage, stride), kind)(F.col(text)))
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = 0.5, overlap: float = 0.6, passage: int = 64, stride: int = 24, segment: int = 40, shard_bytes: int = 8 << 20) -> DataFrame:
    """Verified pairs: id, item_id, score, question_overlap, answer_overlap (null if the item has no such part).

    A pair is verified when the question's overlap is at least ``overlap`` and so is the answer's, or when both
    together are: an answer too short to be evidence then counts by its share. Ids stay in Spark, of any type, null or repeated.
    """
    hits = _hits(docs, items, text, item_col, item_text, threshold, overlap, passage, stride, segment, shard_bytes)
    found = docs.select(F.col(id_col).alias(id_col), F.explode(F.concat(*hits)).alias("h"))
    return found.select(id_col, F.col("h.item").alias("item_id"), "h.score", F.col("h.question").alias("question_overlap"), F.col("h.answer").alias("answer_overlap"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = 0.5, overlap: float = 0.6, passage: int = 64, stride: int = 24, segment: int = 40, shard_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` without a verified test item. Each row is judged by its own text, whatever its id; nothing is shuffled."""
    for hit in _hits(docs, items, text, item_col, item_text, threshold, overlap, passage, stride, segment, shard_bytes):
        docs = docs.filter(F.size(hit) == 0)
    return docs


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
