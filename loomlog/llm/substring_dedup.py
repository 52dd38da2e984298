"""Removal of repeated word windows with suffix automata over reference shards.

A window is ``length`` consecutive words; a window repeats if the same words start anywhere else. Every word that
a repeated window covers goes.

Automata of all documents can't be broadcast, and streaming every document past every shard grows with the square of the
corpus. So reference shards hold only what can match, and each shard meets only the passages that can match it:

1. Anchors. The smallest hash among a window's ``gram``-word grams is its anchor. Equal windows have equal anchors, and the
   windows of one anchor are consecutive, so they make up a region of fewer than two windows' length. Regions are counted by (anchor,
   content hash), with map-side combine: equal regions repeat all their windows.
2. A second scan hands on the regions whose anchor occurs in more than one place (a Bloom filter of fixed greatest size
   tells; a false hit costs a row), with their words if the anchor's regions differ.
3. Different regions of one anchor are a reference shard: a suffix automaton of them, with occurrence counts, takes each region as a
   stream, and the match that ends at each word, cut to ``length``, says whether the window there occurs again. Anchors with more
   than ``shard`` different regions are not gathered: their windows are dealt out one by one and counted.
4. Spans meet their documents once; kept words are joined.

Defined cases: a null text has no words; texts shorter than a window lose nothing; rows that repeat an id and a text repeat each
other's windows; ids may be null or repeat with other texts; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, split_join, text_batches

P = 0x9E3779B97F4A7C15
PI = pow(P, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of a number modulo 2 ** 64, grown as needed."""

    def __init__(self, of: int):
        self.of, self.table = of, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            self.table = np.concatenate((self.table, self.table * np.uint64(pow(self.of, len(self.table), 1 << 64))))
        return self.table[:n]


UP, DOWN = Powers(P), Powers(PI)


def regions(words: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per region of a text: anchor hash, content hash, first window, number of windows."""
    n = len(words)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, n)
    g = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        g = g * np.uint64(P) + h[k : k + len(g)]
    g = mixed(g)
    span = length - gram + 1
    at = np.concatenate([np.lib.stride_tricks.sliding_window_view(g[k : k + 65536 + span - 1], span).argmin(axis=1) + k for k in range(0, n - length + 1, 65536)]) + np.concatenate([np.arange(min(65536, n - length + 1 - k)) for k in range(0, n - length + 1, 65536)])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(at)])
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * UP.upto(n), dtype=np.uint64)))
    content = (total[first + count + length - 1] - total[first]) * DOWN.upto(n)[first]
    content = mixed(content + ((at[first] - first) * 131 + count).astype(np.uint64) * np.uint64(P))
    return g[at[first]], content, first, count


class Bits:
    """A Bloom filter with one hash: the anchors' low bits."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        p = h & self.mask
        return (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1


def filter_of(anchors: DataFrame, most_bits: int = 1 << 28) -> Bits:
    """Of (anchor); 16 bits each up to ``most_bits`` in all, which bounds what is collected and broadcast.

    Tasks make the bitmaps, of 4 KB each, and the driver lays their bytes one behind the other: it never holds a row for each word or anchor.
    """
    size = 1 << 15
    n = anchors.count()
    while size < min(most_bits, 16 * n):
        size *= 2
    place = F.col("anchor").bitwiseAND(F.lit(size - 1)) + 1  # Spark's bitmaps count places and blocks from 1
    bits = anchors.select(F.bitmap_bucket_number(place).alias("block"), F.bitmap_bit_position(place).alias("at"))
    words = np.zeros(size // 64, np.uint64)
    # Dealt by block first: partial bitmaps of each task would be many times the anchors.
    for r in bits.repartition("block").groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).collect():  # 8192 at most
        words[(r["block"] - 1) * 512 : r["block"] * 512] = np.frombuffer(r["bits"], "<u8")
    return Bits(words)


class Automaton:
    """Suffix automaton of word sequences; after :meth:`close`, ``seen`` counts the places where each state's sequences end."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.seen = [-1], [0], [0]

    def add(self, words: list[bytes], weight: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w, weight)

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.seen.append(0)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: bytes, weight: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # the sequence so far is known from an earlier region
            if self.size[q] != self.size[last] + 1:
                q = self._split(last, w, q)
            self.seen[q] += weight
            return q
        new = len(self.next)
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        self.seen.append(weight)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return new

    def close(self) -> Automaton:
        for s in sorted(range(1, len(self.next)), key=self.size.__getitem__, reverse=True):
            self.seen[self.link[s]] += self.seen[s]
        return self

    def repeated(self, words: list[bytes], length: int) -> list[bool]:
        """For each window of a region that was added: whether it occurs more than once."""
        state, out, size, link, seen, step = 0, [], self.size, self.link, self.seen, self.next
        for k, w in enumerate(words):
            state = step[state][w]
            while size[link[state]] >= length:
                state = link[state]
            if k >= length - 1:
                out.append(seen[state] > 1)
        return out


def _scan(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("key"), F.col(text).alias("text"))


def _split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 35, gram: int = 5, shard: int = 2000) -> DataFrame:
    """(id, key, first, n): n windows from word ``first`` on repeat, in the rows with this id and key (hash of id and text)."""

    text_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                found = [regions(_split_words(t), length, gram)[:2] for t in batch["text"].iloc[at : at + 256]]
                yield pd.DataFrame({"anchor": np.concatenate([a for a, _ in found]).view(np.int64), "region": np.concatenate([r for _, r in found]).view(np.int64)})

    scan, kind = _scan(docs, id_col, text), dict(docs.dtypes)[id_col]
    counts = scan.select("text").mapInPandas(count, "anchor long, region long").groupBy("anchor", "region").agg(F.count("*").alias("n"))
    # Both counts by anchor sit on the exchange by anchor; only what occurs again is kept.
    per = counts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("places"), F.max(F.when(F.col("n") == 1, 1).otherwise(0)).alias("any_lone"))
    shared = materialise(per.filter("places > 1").select("anchor", "kinds", "any_lone"), "anchors")
    again = filter_of(shared.select("anchor"))
    differ = filter_of(shared.filter("kinds > 1 AND any_lone = 1").select("anchor"))
    context = docs.sparkSession.sparkContext
    filters = context.broadcast((again, differ))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again, differ = filters.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                out = []
                for r in batch.iloc[at : at + 256].itertuples(index=False):
                    words = _split_words(r.text)
                    anchor, region, first, n = regions(words, length, gram)
                    keep = np.flatnonzero(again.has(anchor))
                    if not len(keep):
                        continue
                    texts = [b" ".join(words[first[k] : first[k] + n[k] + length - 1]) if d else None for k, d in zip(keep.tolist(), differ.has(anchor[keep]).tolist(), strict=True)]
                    out.append(pd.DataFrame({"id": pd.Series([r.id] * len(keep), dtype=object), "key": r.key, "anchor": anchor[keep].view(np.int64), "region": region[keep].view(np.int64), "first": first[keep], "n": n[keep], "words": texts}))
                if out:
                    yield pd.concat(out)

    places = scan.mapInPandas(pick, f"id {kind}, key long, anchor long, region long, first int, n int, words binary")
    places = materialise(places, "places")
    # Regions that occur again; a false hit of the filter is its anchor's only region and occurs once. One region may hold a large part of all places.
    times = materialise(places.groupBy("anchor", "region").agg(F.count("*").alias("times")).filter("times > 1"), "times")
    pure = split_join(places.drop("words"), times, ["anchor", "region"], "times", places.count()).select("id", "key", "first", "n")
    mixed_anchors = shared.filter("kinds > 1 AND any_lone = 1").select("anchor", "kinds")
    members = places.filter("words IS NOT NULL").groupBy("anchor", "region").agg(F.count("*").alias("times"), F.min(F.struct(F.col("id"), F.col("key"), F.col("first"), F.col("n"), F.col("words"))).alias("m"))
    members = members.select("anchor", "times", "m.*").join(mixed_anchors, "anchor")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
                cut = int(np.searchsorted(batch["anchor"].to_numpy(), batch["anchor"].iloc[-1]))
                batch, rest = batch.iloc[:cut], batch.iloc[cut:]
            else:
                batch = rest
            if batch is None or not len(batch):
                continue
            out = []
            anchors = batch["anchor"].to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]), len(batch)]
            ids, keys, firsts, times, texts = (batch[c].tolist() for c in ("id", "key", "first", "times", "words"))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                words = [bytes(t).split() for t in texts[a:b]]
                automaton = Automaton()
                for w, t in zip(words, times[a:b], strict=True):
                    automaton.add(w, min(t, 2))
                automaton.close()
                for k in range(a, b):
                    if times[k] == 1:
                        hit = np.flatnonzero(automaton.repeated(words[k - a], length))
                        for s in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else ():
                            out.append((ids[k], keys[k], firsts[k] + int(s[0]), len(s)))
            if out:
                made = pd.DataFrame(out, columns=["id", "key", "first", "n"])
                yield made.astype({"id": object})

    some = members.filter(F.col("kinds") <= shard).select("anchor", "id", "key", "first", "times", "words")
    lone = some.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(match, f"id {kind}, key long, first int, n int")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                words = bytes(r.words).split()
                out += [(r.id, r.key, r.first + k, r.times, hashlib.blake2b(b" ".join(words[k : k + length]), digest_size=16).digest()) for k in range(len(words) - length + 1)]
            yield pd.DataFrame(out, columns=["id", "key", "first", "times", "w"]).astype({"id": object})

    single = members.filter(F.col("kinds") > shard).select("id", "key", "first", "times", "words").mapInPandas(windows, f"id {kind}, key long, first int, times long, w binary")
    often = single.groupBy("w").agg(F.sum("times").alias("all")).filter(F.col("all") > 1).withColumnRenamed("w", "o")
    crowd = single.filter("times = 1").join(often, F.col("w") == F.col("o")).select("id", "key", "first", F.lit(1).alias("n"))
    return pure.unionByName(lone).unionByName(crowd)


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    for batch in batches:
        if len(batch):
            yield batch
    yield None


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 35, **options) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the words kept, joined by a space), removed (maximal spans [first, end) of words)."""
    spans = repeated_spans(docs, id_col, text, length, **options).distinct().groupBy("id", "key").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    spans = spans.select(F.col("id").alias("sid"), F.col("key").alias("skey"), F.col("spans.first").alias("firsts"), F.col("spans.n").alias("ns"))
    joined = _scan(docs, id_col, text).join(spans, F.col("key").eqNullSafe(F.col("skey")) & F.col("id").eqNullSafe(F.col("sid")), "left").select("id", "text", "firsts", "ns")
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                words, removed = _split_words(r.text), []
                n = len(words)
                if r.firsts is not None:
                    edge = np.zeros(n + 1, np.int64)
                    first = np.asarray(r.firsts, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + np.asarray(r.ns, np.int64) + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                    removed = turn.reshape(-1, 2).tolist()
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                out.append((r.id, n, n - len(words), b" ".join(words), removed))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept", "removed"]).astype({"id": object})

    return joined.mapInPandas(cut, f"id {kind}, n_words long, n_removed long, kept binary, removed array<array<long>>").select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), "removed")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 34, 0) + 1)) AS p FROM d),
h AS (SELECT s.doc_id, p, sha256(array_to_string(w[p:p + 34], ' ')) AS h FROM s JOIN d USING (doc_id)),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS k FROM r),
x AS (SELECT doc_id, list(k) AS ks FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ks IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce((SELECT string_agg(word, ' ' ORDER BY k) FROM (SELECT unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k) WHERE NOT list_contains(ks, k)), '') END) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
