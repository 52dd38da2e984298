"""Alignment of two tokenizers over a corpus: which tokens of one meet which of the other, and how often corpus-wide.

Both token sequences of a text cover the same bytes. Their ends, merged, cut the bytes into elementary ranges; each lies in exactly one
token of either side, and two tokens overlap in exactly one such range. So the ranges are the links, and ranges where both sides end close a group.

1. Every task encodes its texts, stores the ids as 16-bit numbers and, in rows of their own, what its links' pair keys (b << 32 | a, int64) sum
   up to by ``np.unique``: at most ``held_keys`` at a time.
2. The partial counts are range-partitioned and sorted by key. A task's stretch is summed by run lengths and written to the shared folder as
   a shard: its sorted keys, then their counts. A key never straddles shards, since equal keys share a range. No pair is hot: it has a row per task at most.
3. Every task reads its texts' ids again, looks their different keys up in the shards by ``searchsorted``, and sums counts per text. Shards are
   memory-mapped where the shared folder is a file system, so that workers of a machine share pages; from other stores one shard at a time is read.

The highest count of each b is a maximum over shards; its table is bounded by b's vocabulary.

Defined cases: a text that is null, empty, or that one side does not give back byte for byte (a normaliser changed it, or it holds the mark that
stands for a blank) has no tokens: zeros and an empty groups_sha256. Special tokens' strings are ordinary text. Ids are carried as they are, may be null or
repeat; repeated rows count each; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, partitions, shared_path, text_batches
from .packing import by_bytes, vocabulary

BLANK_MARK = "▁"
#: The pattern that splits text before the merges of byte-level vocabularies; fixed by the vocabulary.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """The vocabulary of a ``tokenizers`` byte-level BPE file; ids are merge ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        special = {t["content"] for t in said["added_tokens"] if t["special"]}
        of = byte_alphabet()
        ranks = {bytes(of[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.model = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(f" {t}") for t in texts]


class Pieces:
    """The vocabulary of a ``sentencepiece`` model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", x) else x.replace(BLANK_MARK, " ").encode() for x in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_LOADED: dict[tuple[type, str], ByteLevel | Pieces] = {}


def loaded(kind: type, path: str) -> ByteLevel | Pieces:
    """One for each worker process."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


@dataclass
class Links:
    """Of texts laid end to end: for every link its token on either side, and whether the link closes a group; and each text's first link."""

    a: np.ndarray  # token's place
    b: np.ndarray
    closes: np.ndarray
    first: np.ndarray  # a link's place for each text, and the number of links

    @staticmethod
    def of(a_lengths: np.ndarray, b_lengths: np.ndarray, a_first: np.ndarray) -> Links:
        """Lengths are tokens' bytes; both sides of each text have the same bytes; ``a_first`` has the first token of each text and their number."""
        ea, eb = np.cumsum(a_lengths), np.cumsum(b_lengths)
        size = int(ea[-1]) + 1 if len(ea) else 0
        na, nb = np.bincount(ea, minlength=size), np.bincount(eb, minlength=size)  # tokens that end at each byte
        ends = np.flatnonzero(na + nb)
        before = lambda n: (np.cumsum(n) - n)[ends]  # noqa: E731  (tokens that end earlier: the place of the one that is on)
        text_ends = np.concatenate([[0], ea])[a_first]
        return Links(before(na), before(nb), (na[ends] > 0) & (nb[ends] > 0), np.searchsorted(ends, text_ends, side="right"))


def groups_text(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, links: Links, words: tuple[np.ndarray, ...]) -> list[str]:
    """For each text ``a1,a2|b1;a3|b2``: the tokens in order, ``|`` between a group's sides, ``;`` between groups."""
    a_last, b_last = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    a_last[links.a[links.closes]], b_last[links.b[links.closes]] = True, True
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    # Side a of a group comes before its side b: each token's place is its own place plus the other side's tokens before it.
    out = np.empty(len(a) + len(b), dtype=object)
    out[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = np.where(a_last, words[1][a], words[0][a])
    out[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = np.where(b_last, words[2][b], words[0][b])
    at = a_first + b_first
    return ["".join(out[i:j].tolist())[:-1] for i, j in zip(at[:-1], at[1:], strict=True)]


def firsts(lengths: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def keys_of(a: np.ndarray, b: np.ndarray, links: Links) -> np.ndarray:
    return (b[links.b].astype(np.int64) << 32) | a[links.a]


ROWS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a_ids binary, b_ids binary, keys binary, counts binary"


def encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str, text: str, batch_bytes: int, held_keys: int) -> DataFrame:
    """A row per document with its tokens and groups, and rows with partial counts of pair keys, in which ``keys`` is not null."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    names = ["id", *[x.split()[0] for x in ROWS.split(", ")]]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = loaded(ByteLevel, a_path), loaded(Pieces, b_path)
        sizes = [np.array([len(t) for t in s.bytes], dtype=np.int64) for s in sides]
        top = max(len(s.bytes) for s in sides)
        words = tuple(np.array([f"{i}{end}" for i in range(top)], dtype=object) for end in ",|;")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kind = pa.int64()

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.zeros(len(keys), dtype=np.int64)
            np.add.at(counts, at, np.concatenate([c for _, c in held]))
            return keys, counts

        def counted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            blank = [pa.nulls(1, t) for t in (kind, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*blank, pa.array([keys.astype("<i8").tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=names)

        for batch in batches:
            kind = batch.column("id").type
            for part in by_bytes(batch, batch_bytes):
                texts = part.column("text").to_pylist()
                coded = [s.encode(texts) for s in sides]
                for i, t in enumerate(texts):
                    whole = b" " + t.encode()
                    if not t or any(b"".join(map(s.bytes.__getitem__, ids[i])) != whole for s, ids in zip(sides, coded, strict=True)):
                        coded[0][i] = coded[1][i] = []
                first = [firsts([len(x) for x in ids]) for ids in coded]
                a, b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=f[-1]) for ids, f in zip(coded, first, strict=True))
                links = Links.of(sizes[0][a], sizes[1][b], first[0])
                said = groups_text(a, b, *first, links, words)
                closed = np.concatenate([[0], np.cumsum(links.closes)])
                keys, counts = np.unique(keys_of(a, b, links), return_counts=True)
                held.append((keys, counts))
                short = [[x[i:j].tobytes() for i, j in zip(f[:-1], f[1:], strict=True)] for x, f in zip((a.astype("<u2"), b.astype("<u2")), first, strict=True)]
                numbers = [np.diff(first[0]), np.diff(first[1]), np.diff(closed[links.first]), np.diff(links.first)]
                shas = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(x, pa.int64()) for x in numbers], pa.array(shas), *[pa.array(x, pa.binary()) for x in short], *[pa.nulls(len(texts), pa.binary())] * 2], names=names)
                if sum(len(k) for k, _ in held) > held_keys:
                    held[:] = [summed()]
                    if len(held[0][0]) > held_keys // 2:
                        yield counted(*held.pop())
        if held:
            yield counted(*summed())

    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, {ROWS}")


def exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) rows of partial counts, a slice at a time."""
    for batch in batches:
        for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
            k, c = (np.frombuffer(x.as_buffer(), dtype="<i8") for x in (keys, counts))
            for i in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)]), pa.array(c[i : i + (1 << 16)])], names=["key", "n"])


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def write_shards(sorted_counts: DataFrame, folder: str) -> DataFrame:
    """Sums runs of equal keys of each sorted partition and writes them as a shard. Rows: (path, first, last, n) of every shard, and (b, best)."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, dtype="<i8")], [np.zeros(0, dtype="<i8")]
        for batch in batches:
            k, c = (batch.column(x).to_numpy().astype("<i8") for x in ("key", "n"))
            if not len(k):
                continue
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            k, c = k[starts], np.add.reduceat(c, starts)
            if len(keys[-1]) and keys[-1][-1] == k[0]:  # the run goes on from the batch before
                counts[-1][-1] += c[0]
                k, c = k[1:], c[1:]
            if len(k):
                keys.append(k)
                counts.append(c)
        k, c = np.concatenate(keys), np.concatenate(counts)
        if not len(k):
            return
        fs, at = open_store(f"{folder}/{uuid.uuid4().hex}")  # another attempt writes another file; only what the rows name is read
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(at, compression=None) as out:
            out.write(k.tobytes())
            out.write(c.tobytes())
        b = k >> 32
        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        best = np.maximum.reduceat(c, starts)
        name = f"{folder}/{at.rpartition('/')[2]}"
        n = len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([name] + [None] * n, pa.string()), *[pa.array([x] + [None] * n, pa.int64()) for x in (int(k[0]), int(k[-1]), len(k))], pa.array([None, *b[starts].tolist()], pa.int64()), pa.array([None, *best.tolist()], pa.int64())], names=["path", "first", "last", "n", "b", "best"])

    return sorted_counts.mapInArrow(task, "path string, first long, last long, n long, b long, best long")


def shard(path: str, n: int) -> np.ndarray:
    """Keys and counts, as two rows; mapped if the file is on a file system, else read."""
    fs, at = open_store(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(at, dtype="<i8", mode="r", shape=(2, n))
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype="<i8").reshape(2, n)


def looked_up(keys: np.ndarray, shards: list[tuple[str, int, int, int]]) -> np.ndarray:
    """The counts of ``keys``, sorted and each in one of ``shards`` (path, first, last, n), which are sorted by first."""
    out = np.zeros(len(keys), dtype=np.int64)
    begins, ends = np.searchsorted(keys, [s[1] for s in shards]), np.searchsorted(keys, [s[2] for s in shards], side="right")
    for (path, _, _, n), i, j in zip(shards, begins, ends, strict=True):
        if i < j:
            held = shard(path, n)
            out[i:j] = held[1][np.searchsorted(held[0], keys[i:j])]
    return out


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text", batch_bytes: int = 1 << 21, held_keys: int = 1 << 21) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    text_batches(spark)
    path, folder = shared_path(spark, "token-pairs"), shared_path(spark, "pair-shards")
    coded = encoded(docs, a_path, b_path, id_col, text, batch_bytes, held_keys)
    coded.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(coded.schema).parquet(path)

    partial = stored.filter("keys IS NOT NULL").select("keys", "counts").mapInArrow(exploded, "key long, n long")
    ordered = partial.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    said = shared_path(spark, "pair-manifest")
    write_shards(ordered, folder).write.parquet(said)
    manifest = spark.read.schema("path string, first long, last long, n long, b long, best long").parquet(said)
    shards = sorted([tuple(r) for r in manifest.filter("path IS NOT NULL").select("path", "first", "last", "n").collect()], key=lambda s: s[1])  # one for each partition at most
    best = {r["b"]: r["best"] for r in manifest.filter("b IS NOT NULL").groupBy("b").agg(F.max("best").alias("best")).collect()}  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast((shards, best))

    rows = stored.filter("keys IS NULL").select("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a_ids", "b_ids")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = loaded(ByteLevel, a_path), loaded(Pieces, b_path)
        sizes = [np.array([len(t) for t in s.bytes], dtype=np.int64) for s in sides]
        places, most = shared.value
        top = np.zeros(len(sizes[1]), dtype=np.int64)
        top[list(most)] = list(most.values())
        for whole in batches:
            step = max(1, whole.num_rows * batch_bytes // max(1, whole.nbytes))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").astype(np.int64) for c in ("a_ids", "b_ids"))
                links = Links.of(sizes[0][a], sizes[1][b], firsts(batch.column("n_a").to_pylist()))
                keys, at = np.unique(keys_of(a, b, links), return_inverse=True)
                counts = looked_up(keys, places)[at]
                sums = [np.concatenate([[0], np.cumsum(x)])[links.first] for x in (counts == top[b[links.b]], counts)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")], *[pa.array(np.diff(x), pa.int64()) for x in sums], batch.column("groups_sha256")], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(task, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").withColumnRenamed("id", id_col)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
