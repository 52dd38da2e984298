"""Packing of documents into training windows by the sum-of-squares rule.

Every task packs the rows of its own partition as they come, so nothing is shuffled and no state is shared. A level array counts the open
windows of each fill. A document goes to the fill level for which the sum of the squared counts is smallest afterwards (a new window is level 0);
of equal levels the fullest is taken, and of the windows of a level the latest. A document of a window or more fills windows of its own first, and
only what is left over is placed.

Windows still open at the end are filled up with pieces cut from the emptiest of them, so that one at most stays partly filled; that one is
cut into sequences whose lengths are powers of two, which need no padding. The same filling up happens when over ``open_windows`` windows are
open: it bounds a task's memory by the tokens of so many windows, for any lengths.

Tokens are those of a vocabulary file. Texts are cut at blanks and line ends, which no token spans, and each different piece of a word is encoded
once by a worker; the pieces it remembers are bounded by ``KEPT_WORDS``.

Defined cases: a null text is the empty text, whose only token is the end token; ids are carried as they are, may be null or repeat (each
row's pieces start at 0); a very long text is cut into windows; an empty table gives no piece; other columns are left out. Sequence ids are the
partition's number times 2^40 plus a number from 0: they depend on how the table is split, and agree between runs over the same splits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_batches

WINDOW, END = 4096, 2
KEPT_WORDS = 400_000

#: How the vocabulary splits normalised text; fixed by the vocabulary file. Written for words of :data:`PLAIN`.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\t\n\x0b\x0c\r ]|_)+")
#: Characters that the vocabulary's normaliser lower-cases one by one and leaves as they are otherwise: ASCII and Latin letters but one.
PLAIN = r"^[\x00-\x7f\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]*$"
WORD_END = "</w>"
BLANKS = "\t\n\x0b\x0c\r"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(codes: np.ndarray, firsts: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[firsts[c] : firsts[c + 1]]`` of all codes c, one after another, and where each begins."""
    sizes = np.diff(firsts)[codes]
    at = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(firsts[codes] - at[:-1], sizes) + np.arange(at[-1])], at


class WordEncoder:
    """Token ids of texts; equal to encoding whole texts with the vocabulary of ``path``.

    A batch's different words are cut into pieces, and its different pieces looked up, by Arrow; only pieces that the worker hasn't met are encoded.
    Words of other scripts, and those that may hold a special token, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        names = self.model.get_vocab()
        self.ending = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ending[[i for w, i in names.items() if w.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _pieces(self, pieces: list[str], most: int = 512) -> list[bytes]:
        """Pieces are encoded ``most`` to a text; the last token of a piece is one that ends a word."""
        parts = [" ".join(pieces[i : i + most]) for i in range(0, len(pieces), most)]
        ids = np.array([i for e in self.model.encode_batch_fast(parts, add_special_tokens=False) for i in e.ids], dtype="<u4")
        ends = ((np.flatnonzero(self.ending[ids]) + 1) * 4).tolist()
        data = ids.tobytes()
        return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _ids(self, texts: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin, and the ids."""
        if len(self.known) > KEPT_WORDS:
            self.known = {"": b""}
        names = texts.to_pylist()
        new = [w for w in names if w not in self.known]
        self.known.update(zip(new, encode(new), strict=True))
        found = list(map(self.known.__getitem__, names))
        return np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))]) // 4, np.frombuffer(b"".join(found), dtype="<u4")

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
        low = pc.utf8_lower(words.filter(plain))
        mixed = pc.invert(pc.utf8_is_alpha(low))
        low = pc.replace_with_mask(low, mixed, pa.array([" ".join(PIECES.findall(w)) for w in low.filter(mixed).to_pylist()], pa.string()))
        cut = pc.split_pattern(low, " ")
        pieces = pc.dictionary_encode(cut.flatten())
        ids, at = gathered(pieces.indices.to_numpy(), *self._ids(pieces.dictionary, self._pieces))
        firsts, (more, rest) = at[cut.offsets.to_numpy()], self._ids(words.filter(pc.invert(plain)), self._whole)
        is_plain = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(words), dtype=np.int64)
        place[is_plain], place[~is_plain] = np.arange(len(cut)), np.arange(len(cut), len(words))
        flat, at = gathered(place, np.concatenate([firsts, more[1:] + firsts[-1]]), np.concatenate([ids, rest]))
        return at, flat

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        for c in BLANKS:
            texts = pc.replace_substring(texts, c, " ")
        split = pc.split_pattern(texts, " ")
        words = pc.dictionary_encode(split.flatten())
        ids, at = gathered(words.indices.to_numpy(), *self._words(words.dictionary))
        ends = at[split.offsets.to_numpy()]
        return [ids[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process, so that its words last from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Levels:
    """Which fill level a piece goes to: ``counts[f]`` open windows are filled to f, 0 < f < window."""

    def __init__(self, window: int):
        self.window, self.counts = window, np.zeros(window + 1, dtype=np.int64)

    def choose(self, size: int) -> int:
        c = self.counts
        out = np.where(c > 0, 1 - 2 * c, np.iinfo(np.int64).max // 2)  # one window fewer at the level
        out[0] = 0
        into = 1 + 2 * c  # one more at the level it reaches
        into[self.window] = 0  # full windows are not counted
        cost = (out[: self.window - size + 1] + into[size:])[::-1]
        return self.window - size - int(cost.argmin())

    def move(self, level: int, to: int) -> None:
        if level:
            self.counts[level] -= 1
        if to < self.window:
            self.counts[to] += 1


Piece = tuple[object, int, np.ndarray, int]  # id, start, token ids, the document's tokens


class Packer:
    def __init__(self, window: int, open_windows: int):
        self.window, self.limit, self.levels = window, open_windows, Levels(window)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def put(self, row_id: object, ids: np.ndarray) -> Iterator[list[Piece]]:
        """The windows that the document fills."""
        start = 0
        while len(ids) - start >= self.window:
            yield [(row_id, start, ids[start : start + self.window], len(ids))]
            start += self.window
        if start < len(ids):
            yield from self._place([(row_id, start, ids[start:], len(ids))], len(ids) - start)
            if self.n_open > self.limit:
                yield from self.fill_up()

    def _place(self, pieces: list[Piece], size: int) -> Iterator[list[Piece]]:
        level = self.levels.choose(size)
        self.levels.move(level, level + size)
        held = self.open[level].pop() if level else []
        self.n_open -= bool(level)
        held.extend(pieces)
        if level + size == self.window:
            yield held
        else:
            self.open.setdefault(level + size, []).append(held)
            self.n_open += 1

    def fill_up(self) -> Iterator[list[Piece]]:
        """Open windows, the fullest first, are filled with pieces cut from the emptiest; one at most stays open."""
        rest = [w for level in sorted(self.open) for w in self.open[level]]  # the emptiest first
        self.open, self.n_open, self.levels = {}, 0, Levels(self.window)
        first, last = 0, len(rest) - 1
        while first < last:
            to, room = rest[last], self.window - sum(len(p[2]) for p in rest[last])
            while room and first < last:
                row_id, start, ids, tokens = rest[first].pop()
                if len(ids) > room:
                    rest[first].append((row_id, start, ids[:-room], tokens))
                    start, ids = start + len(ids) - room, ids[-room:]
                to.append((row_id, start, ids, tokens))
                room -= len(ids)
                first += not rest[first]
            if not room:
                yield to
                last -= 1
        if first == last:
            size = sum(len(p[2]) for p in rest[first])
            yield from self._place(rest[first], size)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self.fill_up()
        for windows in self.open.values():
            for pieces in windows:
                yield from powers(pieces)
        self.open, self.n_open, self.levels = {}, 0, Levels(self.window)


def powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """``pieces`` cut into sequences whose lengths are different powers of two, the longest first."""
    left = sum(len(p[2]) for p in pieces)
    pieces = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out = []
        while size:
            row_id, start, ids, tokens = pieces.pop()
            if len(ids) > size:
                pieces.append((row_id, start + size, ids[size:], tokens))
                ids = ids[:size]
            out.append((row_id, start, ids, tokens))
            size -= len(ids)
        yield out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, open_windows: int = 1024, batch_bytes: int = 1 << 22, with_ids: bool = True) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``, ids, the piece's token ids."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{', ids array<int>' if with_ids else ''}"

    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, tail = encoder(path), Packer(window, open_windows), np.array([end], dtype="<u4")
        sequence, kind = TaskContext.get().partitionId() << 40, None

        def batch_of(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            out, pieces_ids = [], []
            for pieces in windows:
                offset = 0
                for row_id, start, ids, tokens in pieces:
                    out.append((row_id, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, offset))
                    pieces_ids.append(ids)
                    offset += len(ids)
                sequence += 1
            cols = list(zip(*out, strict=True))
            arrays = [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]]
            if with_ids:
                firsts = np.concatenate([[0], np.cumsum(cols[2])]).astype("<i4")
                arrays.append(pa.ListArray.from_arrays(pa.array(firsts), pa.array(np.concatenate(pieces_ids).astype("<i4"))))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            kind = batch.column("id").type
            for part in by_bytes(batch, batch_bytes):
                full = [w for row_id, ids in zip(part.column("id").to_pylist(), encode(part.column("text")), strict=True) for w in packer.put(row_id, np.append(ids, tail))]
                if full:
                    yield batch_of(full)
        full = list(packer.finish())
        if full:
            yield batch_of(full)

    return rows.mapInArrow(task, schema).withColumnRenamed("id", id_col)


def by_bytes(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with ``most`` bytes of text, or a single longer one."""
    column = batch.column("text")
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def op12_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), with_ids=False)
