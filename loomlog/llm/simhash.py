"""SimHash near-duplicate detection with pivot distance tables.

A fingerprint's pivot table holds its Hamming distances to many reference fingerprints. Two
fingerprints within d bits differ by at most d in every coordinate, so pairs with a larger maximum
coordinate difference are discarded and only survivors are compared bit by bit.

Equal fingerprints are collapsed first. Within a bucket (:func:`bucket_keys`) rows are sorted by the first pivot
distance, so that a fingerprint meets only those within d in that coordinate. Buckets are what keeps this from being a
cross join: of ``blocks`` pieces of a fingerprint, d differing bits leave ``blocks - d`` or more equal, and each choice of
that many pieces is a bucket key, so no link is lost. Buckets with over ``chunk`` fingerprints are
dealt as pairs of chunks, each compared in a task of its own; none is capped. Links leave
a bucket as trees (enough for components), never as all pairs of a group; components are
found over links in Spark (:mod:`.components`).

Defined cases: null and empty texts have fingerprint zero and are linked like any other; rows that repeat a
fingerprint are one node; ids may be null, repeat or be of any type that sorts; whole texts of any length are read; only the named
columns are looked at; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, text_batches, with_row_keys
from .components import components

SEED = 42
BLOCK = 1 << 16  #: shingles hashed at once, so that a very long text needs bounded memory


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the text's word shingles, repeats included, block by block; nothing for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last, digest = ends[width - 1 :] if len(words) >= width else ends[-1:], xxhash.xxh64_intdigest
    for at in range(0, len(last), BLOCK):
        pairs = zip(starts[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist(), strict=False)
        yield np.array([digest(flat[a:b], SEED) for a, b in pairs], dtype=np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the text's word shingles: a bit is set if it is in over half of the hashes."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, width):
        n, ones = n + len(h), ones + _ones(h)
    return _majority(ones, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long) of every row."""

    text_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, width) for t in batch], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), simhash(F.col(text)).alias("fp"))


def pivots(count: int) -> np.ndarray:
    """Reference fingerprints: rows of the 64 x 64 Walsh matrix, which lie 32 bits from each other."""
    i, j = np.arange(1, count + 1, dtype=np.uint64)[:, None], np.arange(64, dtype=np.uint64)[None, :]
    odd = np.bitwise_count(i & j) & 1
    return np.bitwise_or.reduce(odd.astype(np.uint64) << j, axis=1)


def bucket_keys(fp: Column, bits: int, blocks: int) -> Column:
    """One key for each choice of ``blocks - bits`` of the fingerprint's ``blocks`` pieces."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - bits)):
        mask = sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("band"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("key")))
    return F.explode(F.array(*keys))


def forest(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect rows 0 to ``count`` where ``near`` (a row, the rows left) finds them, as a forest."""
    left = np.arange(count)
    a, b = [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            found = near(x, left)
            if len(found):
                a += [x] * len(found)
                b += found.tolist()
                todo += found.tolist()
                left = np.setdiff1d(left, found, assume_unique=True)
    return np.array(a, np.int64), np.array(b, np.int64)


def tree_links(fp: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``bits``, as a forest; rows are sorted by table[:, 0]."""

    def near(x: int, left: np.ndarray) -> np.ndarray:
        found = left[np.searchsorted(table[left, 0], max(0, int(table[x, 0]) - bits)) : np.searchsorted(table[left, 0], int(table[x, 0]) + bits, "right")]
        found = found[(np.abs(table[found].astype(np.int16) - table[x].astype(np.int16)).max(axis=1, initial=0) <= bits)]
        return found[np.bitwise_count(fp[found] ^ fp[x]) <= bits]

    return forest(len(fp), near)


def _small(fp: np.ndarray, table: np.ndarray, group: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small groups at once: neighbours at lag 1, 2, ... of rows sorted by group, then table[:, 0]."""
    a, b, at = [], [], np.arange(len(fp))
    for lag in range(1, most):
        at = at[at + lag < len(fp)]
        at = at[(group[at] == group[at + lag]) & (table[at + lag, 0].astype(np.int16) - table[at, 0] <= bits)]
        if not len(at):
            break
        near = at[np.abs(table[at].astype(np.int16) - table[at + lag].astype(np.int16)).max(axis=1) <= bits]
        near = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= bits]
        a.append(near)
        b.append(near + lag)
    return np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])


def links(nodes: DataFrame, bits: int = 4, blocks: int = 6, n_pivots: int = 16, chunk: int = 4096, small: int = 32) -> DataFrame:
    """Links (a, b) between rows of ``nodes`` (id, fp; fp distinct) within ``bits``: a forest for each task."""
    refs = pivots(n_pivots)
    rows = nodes.select("id", "fp", bucket_keys(F.col("fp"), bits, blocks).alias("k")).select("id", "fp", "k.*")
    return _compared(_dealt(rows, chunk), refs, bits, small)


def _dealt(rows: DataFrame, chunk: int, carry: str = "fp") -> DataFrame:
    """(id, ``carry``, g): tasks g of the buckets (band, key) that have several rows; large ones are dealt as pairs of chunks."""
    size = rows.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    dealt = rows.join(size, ["band", "key"]).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64(carry, "id"), F.col("parts")).cast("int"))
    dealt = dealt.select("id", carry, "band", "key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return dealt.select("id", carry, F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g"))


def _compared(dealt: DataFrame, refs: np.ndarray, bits: int, small: int) -> DataFrame:
    """Links (a, b) inside each task g."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _whole_tasks(batches):
            ids, group, fp = batch["id"].to_numpy(), batch["g"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ refs[None, :])
            _, first, count = np.unique(group, return_index=True, return_counts=True)
            few = np.repeat(count <= small, count)
            at = np.flatnonzero(few)
            a, b = _small(fp[at], table[at], group[at], bits, small)
            found = [(at[a], at[b])]
            for f, n in zip(first[count > small], count[count > small], strict=True):
                a, b = tree_links(fp[f : f + n], table[f : f + n], bits)
                found.append((a + f, b + f))
            a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            if len(a):
                yield pd.DataFrame({"a": ids[a], "b": ids[b]})

    d0 = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(refs[0].view(np.int64)))))
    return dealt.withColumn("d0", d0).repartition("g").sortWithinPartitions("g", "d0", "fp").mapInPandas(compare, "a long, b long").distinct()


def _whole_tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows, sorted by g, in batches that end where a task g ends."""
    rest = None
    for batch in _with_end(batches):
        if batch is not None:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            cut = int(np.searchsorted(batch["g"].to_numpy(), batch["g"].iloc[-1]))
            batch, rest = batch.iloc[:cut], batch.iloc[cut:]
        else:
            batch = rest
        if batch is not None and len(batch):
            yield batch


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    for batch in batches:
        if len(batch):
            yield batch
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, bits: int = 4, **options) -> DataFrame:
    """id, fp (signed long) and component_id, the smallest id reachable over links, of every row.

    Fingerprints are the nodes, so ids may be of any type, null or repeated; component_id is null only if all reachable ids are.
    """
    own = materialise(fingerprints(docs, id_col, text, width), "simhash")
    nodes = materialise(own.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    found = components(links(nodes.select(F.col("fp").alias("id"), "fp"), bits, **options))
    placed = nodes.join(found, F.col("fp") == F.col("id"), "left").select(F.col("fp").alias("nfp"), F.coalesce("component", "fp").alias("component"), "least")
    best = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("nfp", "component_id")
    return own.join(best, own.fp == best.nfp, "left").select(F.col("id").alias(id_col), "fp", "component_id")


BINS = 512
WIDE = 0.65  #: what sketches of a pair alike by 0.8 reach: over eight standard errors lower


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    blocks = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def min_hashes(h: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima of ``h``, each under a hash of its own: xor with a seed, then a mixer that is not linear, so that no order follows from another."""
    z = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    low = np.full(count, np.uint64(2**64 - 1))
    for at in range(0, len(h), 4096):
        x = (h[None, at : at + 4096] ^ z[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(29)
        low = np.minimum(low, x.min(axis=1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One value for each two of the minima."""
    a, b = low[::2], low[1::2]
    return (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b


def sketched(docs: DataFrame, id_col: str, text: str, width: int, bands: int) -> DataFrame:
    """id, shingles (how many distinct), fp (SimHash of the distinct shingles, a signed long), mins (``bands`` values of two minima each) and sketch (one byte for each of 512 bins) of every row that has words."""

    text_batches(docs.sparkSession)

    @F.pandas_udf("shingles long, fp long, mins array<long>, sketch binary")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        top = np.uint64(2**64 - 1)
        for batch in texts:
            out = []
            for text in batch:
                low, bins = np.full(2 * bands, top), np.full(BINS, top)
                distinct, ones = shingle_set(text, width), np.zeros(64, np.int64)
                for at in range(0, len(distinct), BLOCK):
                    h = distinct[at : at + BLOCK]
                    ones += _ones(h)
                    low = np.minimum(low, min_hashes(h, 2 * bands))
                    np.minimum.at(bins, (h >> np.uint64(55)).astype(np.int64), h & np.uint64(2**55 - 1))
                if len(distinct):
                    out.append((len(distinct), int(np.uint64(_majority(ones, len(distinct))).view(np.int64)), band_keys(low).view(np.int64), np.where(bins == top, 0, 1 + (bins >> np.uint64(20)) % np.uint64(255)).astype(np.uint8).tobytes()))
                else:
                    out.append((None, None, None, None))
            yield pd.DataFrame(out, columns=["shingles", "fp", "mins", "sketch"]).astype({"shingles": "Int64", "fp": "Int64"})

    return docs.select(F.col(id_col).alias("id"), sketch(F.col(text)).alias("s")).select("id", "s.*").filter("shingles IS NOT NULL AND id IS NOT NULL")


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of shingle sets from their sketches (standard error below 0.02 for long texts; 0 marks an empty bin)."""
    used = np.count_nonzero(a | b, axis=-1)
    same = np.count_nonzero((a == b) & (a > 0), axis=-1)
    return (same / np.maximum(used, 1) - 1 / 255) / (1 - 1 / 255)


def _wide_links(dealt: DataFrame, similarity: float, small: int) -> DataFrame:
    """Links (a, b) inside each task g between rows whose sketches are alike by WIDE and whose sizes allow ``similarity``."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _whole_tasks(batches):
            ids, group, size = batch["id"].to_numpy(), batch["g"].to_numpy(), batch["shingles"].to_numpy()
            sketch = np.frombuffer(b"".join(batch["sketch"]), np.uint8).reshape(len(batch), -1)
            _, first, count = np.unique(group, return_index=True, return_counts=True)
            found, few = [], np.flatnonzero(np.repeat(count <= small, count))
            # Neighbours at lag 1, 2, ...; sizes rise inside a task, so none is near behind the first that is too large.
            at = np.arange(len(few))
            for lag in range(1, small):
                at = at[at + lag < len(few)]
                at = at[(group[few[at]] == group[few[at + lag]]) & (size[few[at]] / size[few[at + lag]] >= similarity)]
                if not len(at):
                    break
                near = at[similar(sketch[few[at]], sketch[few[at + lag]]) >= WIDE]
                found.append((few[near], few[near + lag]))
            for f, c in zip(first[count > small], count[count > small], strict=True):
                s, n = sketch[f : f + c], size[f : f + c]

                def near(x: int, left: np.ndarray, s: np.ndarray = s, n: np.ndarray = n) -> np.ndarray:
                    left = left[np.minimum(n[left], n[x]) / np.maximum(n[left], n[x]) >= similarity]
                    return left[similar(s[left], s[x]) >= WIDE]

                a, b = forest(c, near)
                found.append((a + f, b + f))
            if found:
                a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
                yield pd.DataFrame({"a": ids[a], "b": ids[b]})

    return dealt.repartition("g").sortWithinPartitions("g", "shingles").mapInPandas(compare, "a long, b long").distinct()


def alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the sets alike by ``similarity`` or more, as a forest; shared hashes are counted."""
    n = np.array([len(s) for s in sets])
    ends = np.cumsum(n)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sets, seen = np.split(codes, ends[:-1]), np.zeros(len(codes), bool)

    def near(x: int, left: np.ndarray) -> np.ndarray:
        left = left[np.minimum(n[left], n[x]) / np.maximum(np.maximum(n[left], n[x]), 1) >= similarity]
        seen[sets[x]] = True
        common = np.array([np.count_nonzero(seen[sets[i]]) for i in left], np.int64)
        seen[sets[x]] = False
        return left[common / (n[left] + n[x] - common) >= similarity]

    return forest(len(sets), near)


def _exact_links(dealt: DataFrame, similarity: float, width: int) -> DataFrame:
    """Links (a, b) inside each task g between texts whose shingle sets are alike by ``similarity`` or more."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _whole_tasks(batches):
            ids = batch["id"].to_numpy()
            _, first, count = np.unique(batch["g"].to_numpy(), return_index=True, return_counts=True)
            for f, c in zip(first, count, strict=True):
                a, b = alike([shingle_set(t, width) for t in batch["text"].iloc[f : f + c]], similarity)
                if len(a):
                    yield pd.DataFrame({"a": ids[a + f], "b": ids[b + f]})

    return dealt.repartition("g").sortWithinPartitions("g").mapInPandas(verify, "a long, b long").distinct()


def close_links(own: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that connect the rows of ``own`` (id, fp; ids distinct) whose fingerprints are within ``bits``: :func:`links` over the smallest id of each fingerprint, and that id with the others."""
    nodes = materialise(own.groupBy("fp").agg(F.min("id").alias("least")), "near-nodes")
    same = own.select("id", "fp").join(nodes, "fp").filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    return links(nodes.select(F.col("least").alias("id"), "fp"), bits).unionByName(same)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5, bits: int = 4, bands: int = 26, chunk: int = 2048, chunk_shingles: int = 1 << 20, small: int = 32) -> DataFrame:
    """(id, component_id) of the rows that have a near copy: shingle sets alike by ``similarity`` or more. Ids are distinct longs.

    Fingerprints of the shingle sets within ``bits`` are linked by pivot distance tables, as in :func:`near_duplicates`. At a similarity of 0.8
    they lie about 10 of 64 bits apart, up to 18 and farther, where pieces of a fingerprint no longer make buckets. So for the rest there
    are further buckets, pairs of independent min-hash values of the shingles: two sets that are alike by 0.8 share none of 26 pairs with
    probability (1 - 0.64) ** 26 = 3e-12. Within such a bucket a pair is skipped if the sizes of its sets exclude it or a 512-bin sketch
    says less than 0.65. What all these links connect is a group; each text of a group is read once more, and links that count are
    those whose sets, counted out, are alike by ``similarity``. Groups with over ``chunk`` texts or
    ``chunk_shingles`` shingles are dealt as pairs of chunks.
    """
    own = materialise(sketched(docs, id_col, text, width, bands), "sketches")
    rows = own.select("id", "shingles", F.posexplode("mins").alias("band", "key"))
    dealt = _dealt(rows, chunk, "shingles").join(own.select(F.col("id").alias("sid"), F.col("shingles").alias("sn"), "sketch"), (F.col("id") == F.col("sid")) & (F.col("shingles") == F.col("sn"))).drop("sid", "sn")
    groups = materialise(components(close_links(own, bits).unionByName(_wide_links(dealt, similarity, small))).join(own.groupBy("id").agg(F.sum("shingles").alias("shingles")), "id"), "near-groups")
    size = groups.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("shingles") / chunk_shingles)).cast("int").alias("parts"))
    split = groups.join(size, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    split = split.select("id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    split = split.select("id", F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("g"))
    texts = docs.select(F.col(id_col).alias("tid"), F.col(text).alias("text")).join(split, F.col("tid") == F.col("id")).select("id", "g", "text")
    return components(_exact_links(texts, similarity, width)).withColumnRenamed("component", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each group of near copies.

    Rows are told apart by a number of their own, so ids may be null (they come last), repeat or be of any type that sorts. Rows
    without words have no near copy and stay; rows that repeat a text of words are near copies of each other.
    """
    keyed = with_row_keys(docs, "near-rows")
    groups = materialise(near_copies(keyed.select("rid", F.col(f"row.`{text}`").alias("text")), "rid", "text", **options), "near-members")
    named = keyed.select("rid", F.col(f"row.`{id_col}`").alias("own")).join(groups, F.col("rid") == F.col("id"))
    order = F.struct(F.col("own").isNull().alias("last"), "own", "rid")
    stays = named.groupBy("component_id").agg(F.min(order).alias("b")).select(F.col("b.rid").alias("stays"))
    gone = groups.select("id").join(stays, F.col("id") == F.col("stays"), "left_anti")
    return keyed.join(gone, F.col("rid") == F.col("id"), "left_anti").select("row.*")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
