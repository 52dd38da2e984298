"""Brown class-based n-gram language model.

P(w | previous) = P(class(w) | context class(previous)) * P(w | class(w)), smoothed; a text's score is the sum
of log10 over its words and one end token.

Training counts cover every training text, and every word with at least ``min_count`` training occurrences takes part in the exchange,
however many there are. The exchange is the distributed one for predictive class bigrams (Uszkoreit and Brants, 2008):

1. A scan counts, for each word, the context classes of the words before it: L(w, k). At first the ``classes`` most frequent words are context
   classes of their own and all other words have the class of their shape (:func:`shape_class`).
2. Rounds over L alone: each word goes to the class c that raises the sum of N(k, c) log N(k, c) - N(c) log N(c) most, all words in
   parallel against the class table N of the round before, half of them in each round, so that two words don't swap for ever.
3. The words of the table (below) take their classes as context classes, and 1 and 2 are repeated.

L has a row for each word and context class that meet; nothing of it but the table N, of fixed size, is collected. Words below ``min_count``
and unknown words have the class of their shape, so that their class needs no table.

Both scans and scoring broadcast at most ``table_words`` frequent words with counts and classes; what all other words need is joined in
Spark, so the vocabulary may grow with the corpus. A word outside the table has, as the word before another, the class of its shape.

Defined cases: a null text is empty and scores its end token; ids may be null or repeat, other columns are left out; rows that repeat
a text have equal scores; without training texts all words are unknown; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, materialise, text_batches
from .substring_dedup import Bits, filter_of

END = b""  #: the end token; no word is empty
SHAPES = 16
PIECE = 1 << 18  #: words of one text that are turned into numbers at once


def tokens(text: str | None) -> list[bytes]:
    """The words of the text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


DIGIT = re.compile(rb"[0-9]").search


def shape_class(word: bytes) -> int:
    """Length (4 steps) by kind: with a digit, with a final mark, of letters, other."""
    last = word[-1]
    if DIGIT(word):
        kind = 0
    elif 97 <= last < 123 or last >= 128:
        kind = 2
    else:
        kind = 1 if len(word) > 1 and (97 <= word[-2] < 123 or word[-2] >= 128) else 3
    return 4 * kind + min(3, len(word) // 4)


def word_hash(word: bytes) -> int:
    """The word's number where its classes are learned, as a signed long."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def count_words(docs: DataFrame, text: str, flush: int = 300_000) -> DataFrame:
    """(w, h, shape, n) over all rows; tasks hand on partial counts when they hold ``flush`` words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"w": list(held), "n": list(held.values())})

        for batch in batches:
            for t in batch[text]:
                held.update(tokens(t))
                held[END] += 1
                if len(held) > flush:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [bytes(w) for w in batch["w"]]
            yield pd.DataFrame({"w": words, "h": [word_hash(w) for w in words], "shape": [shape_class(w) if w else SHAPES for w in words], "n": batch["n"]})

    counts = docs.select(text).mapInPandas(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return counts.mapInPandas(describe, "w binary, h long, shape int, n long")


@dataclass
class Vocabulary:
    """Frequent words: their place in ``words`` is their number."""

    words: list[bytes]
    counts: np.ndarray
    total: int  #: training tokens
    distinct: int
    least: int  #: all words with this count or more are in ``words``
    ends: int  #: end tokens


def vocabulary(counts: DataFrame, table_words: int) -> Vocabulary:
    step = F.floor(F.ln("n") / np.log(1.05)).cast("int")
    levels = counts.groupBy(step.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()  # counts grow by 5 % a level: few rows
    least, have = 1 << 62, 0
    for r in levels:
        have += r["words"]
        if have > table_words:
            break
        least = r["least"]
    top = counts.filter((F.col("n") >= least) & (F.octet_length("w") > 0)).select("w", "n").toPandas()  # table_words rows at most
    top["w"] = [bytes(w) for w in top["w"]]
    top = top.sort_values(["n", "w"], ascending=[False, True])
    ends = counts.filter(F.octet_length("w") == 0).select("n").first()
    return Vocabulary(top["w"].tolist(), top["n"].to_numpy(np.int64), sum(r["n"] for r in levels), sum(r["words"] for r in levels), least, 0 if ends is None else ends["n"])


@dataclass
class Contexts:
    """Context classes: 0 to ``classes`` for words of the table, then one a shape, then that of the end token."""

    classes: int
    of: dict[bytes, int]  #: words that have another context class than that of their shape
    end: int = field(init=False)

    def __post_init__(self):
        self.end = self.classes + SHAPES

    def number(self, word: bytes) -> int:
        if not word:
            return self.end
        return k if (k := self.of.get(word)) is not None else self.classes + shape_class(word)


class Numbers(dict):
    """Word -> place in ``made``, which holds ``make(word)``; made once for each word."""

    def __init__(self, make):
        super().__init__()
        self.make, self.made = make, []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.made)
        self.made.append(self.make(word))
        return n


def left_contexts(docs: DataFrame, text: str, contexts: Contexts, taking_part: Bits | None = None, flush: int = 6 << 20) -> DataFrame:
    """L: (h, k, n) of each word and the context classes before it; a text begins after an end token.

    Words that surely don't take part in the exchange, by the filter ``taking_part``, and the end token are counted together by shape: h is
    their number, 0 to SHAPES. A word that the filter lets through by mistake is counted as itself, and told apart when joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast((contexts, taking_part))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (contexts, taking_part), digest = shared.value, xxhash.xxh64_intdigest
        number = Numbers(contexts.number)  # words of the texts that are held
        held: list[np.ndarray] = []
        size, width = 0, contexts.end + 1

        def out() -> pd.DataFrame:
            """Texts stand behind each other, each ended by an end token, so that every word's neighbour is the one before it."""
            ids = np.concatenate(held)
            classes = np.array(number.made, np.int64)
            hashes = np.fromiter(map(digest, number), np.uint64, len(number))
            own = np.arange(len(number))
            if taking_part is not None:
                words, out = list(number), np.flatnonzero(~taking_part.has(hashes))
                shapes = np.array([SHAPES if not words[i] else shape_class(words[i]) for i in out.tolist()], np.int64)
                # Words of a shape go under the first of them.
                hashes[out] = shapes.astype(np.uint64)
                first = np.zeros(SHAPES + 1, np.int64)
                first[shapes[::-1]] = out[::-1]
                own[out] = first[shapes]
            pair, n = np.unique(own[ids] * width + np.concatenate(([contexts.end], classes[ids[:-1]])), return_counts=True)
            hashes = hashes.view(np.int64)
            return pd.DataFrame({"h": hashes[pair // width], "k": (pair % width).astype(np.int32), "n": n})

        for batch in batches:
            for t in batch[text]:
                words = tokens(t)
                words.append(END)
                held.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if size > flush:
                    yield out()
                    number, held, size = Numbers(contexts.number), [], 0
        if held:
            yield out()

    return docs.select(text).mapInPandas(count, "h long, k int, n long").groupBy("h", "k").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(table: np.ndarray, size: np.ndarray, at: np.ndarray, k: np.ndarray, n: np.ndarray, now: np.ndarray) -> np.ndarray:
    """The class that each word adds most likelihood to.

    ``table`` is N(k, c) and ``size`` N(c) over the exchange classes; rows (``at``, ``k``, ``n``) are the words' contexts, ``at`` in
    rising order; ``now`` is each word's present class, -1 for none, which the word is taken out of first.
    """
    words = len(now)
    count = np.bincount(at, n, words)
    own = np.zeros((words, len(size)))
    own[np.flatnonzero(now >= 0), now[now >= 0]] = 1
    own_n = own[at] * n[:, None]
    base = np.maximum(table[k] - own_n, 0)
    gain = _xlogx(base + n[:, None]) - _xlogx(base)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    total = np.zeros((words, len(size)))
    if len(at):
        total[at[first]] = np.add.reduceat(gain, first, axis=0)
    rest = np.maximum(size[None, :] - own * count[:, None], 0)
    total -= _xlogx(rest + count[:, None]) - _xlogx(rest)
    best = total.argmax(axis=1)
    # A tie with the present class stays.
    stay = (now >= 0) & (total[np.arange(words), np.maximum(now, 0)] >= total[np.arange(words), best] - 1e-9)
    return np.where(stay, now, best)


def _by_word(left: DataFrame, words: DataFrame) -> DataFrame:
    """(h, cls, k, n): a word's contexts as two lists; at most as many as there are context classes."""
    lists = left.groupBy("h").agg(F.collect_list("k").alias("k"), F.collect_list("n").alias("n"))
    return lists.join(words, "h")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (cls, k, n): the word's place, context class and count of each entry of the lists, and the words' classes."""
    k, n = batch.column("k"), batch.column("n")
    at = np.repeat(np.arange(batch.num_rows), k.value_lengths().to_numpy(zero_copy_only=False))
    return at, k.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy().astype(float), batch.column("cls").to_numpy().astype(np.int64)


def exchange(left: DataFrame, words: DataFrame, classes: int, context_classes: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Words (h, cls) after ``rounds`` of the exchange, from ``words`` (h, cls; -1: none yet), and the table N(k, c) of those that have a class."""
    spark = left.sparkSession
    state = materialise(_by_word(left, words), "exchange")

    def table_of(state: DataFrame) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = np.zeros(context_classes * classes)
            for b in batches:
                at, k, n, cls = _flat(b)
                cells += np.bincount(k * classes + cls[at], n, len(cells))
            found = np.flatnonzero(cells)
            yield pa.RecordBatch.from_pydict({"cell": found, "n": cells[found].astype(np.int64)})

        got = state.filter("cls >= 0").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros(context_classes * classes)
        table[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(float)
        return table.reshape(context_classes, classes)

    table = table_of(state)
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(table)

        def move(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            table = shared.value
            size = table.sum(axis=0)
            for whole in batches:
                for a in range(0, whole.num_rows, 1000):
                    b = whole.slice(a, 1000)
                    at, k, n, now = _flat(b)
                    best = best_classes(table, size, at, k, n, now)
                    turn = (b.column("h").to_numpy() >> 7) % 2 == number % 2
                    cls = np.where(turn | (now < 0), best, now).astype(np.int32)
                    yield b.set_column(b.schema.get_field_index("cls"), "cls", pa.array(cls))

        state = materialise(state.mapInArrow(move, state.schema), "exchange")
        table = table_of(state)
    return state.select("h", "cls"), table


@dataclass
class Model:
    vocab: Vocabulary
    contexts: Contexts
    cls: np.ndarray  #: class of each word of the table
    step: np.ndarray  #: log10 P(class | context class before)
    mass: np.ndarray  #: class -> tokens + 0.5 (words + 1), what emission counts are divided by
    min_count: int

    @property
    def end(self) -> int:
        return self.contexts.end


def smoothed(pair: np.ndarray, prior: float = 10.0) -> np.ndarray:
    """log10 P(class | context class): counts with ``prior`` tokens of the classes' own shares."""
    size = pair.sum(axis=0)
    back = (size + 0.5) / (size.sum() + 0.5 * len(size))
    return np.log10((pair + prior * back) / (pair.sum(axis=1, keepdims=True) + prior))


def train(docs: DataFrame, text: str = "text", table_words: int = 300_000, classes: int = 48, rounds: tuple[int, int] = (3, 2), min_count: int = 5) -> tuple[Model, DataFrame]:
    """The model and (w, n, cls) of all training words; the classes of words are followed by one a shape and that of the end token."""
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    counts = materialise(count_words(docs, text), "word-counts")
    vocab = vocabulary(counts, table_words)
    n_contexts = classes + SHAPES + 1
    # The most frequent words begin as classes of their own.
    seeds = spark.createDataFrame([(word_hash(w), k) for k, w in enumerate(vocab.words[:classes])], "h long, seed int")
    taking_part = counts.filter((F.col("n") >= min_count) & (F.octet_length("w") > 0)).select("h")
    words = taking_part.join(F.broadcast(seeds), "h", "left").select("h", F.coalesce("seed", F.lit(-1)).alias("cls"))
    contexts = Contexts(classes, {w: k for k, w in enumerate(vocab.words[:classes])})
    taking_filter = filter_of(taking_part.select(F.col("h").alias("anchor")))
    for last, times in enumerate(rounds):
        left = materialise(left_contexts(docs, text, contexts, taking_filter), "left-contexts")
        words, pair = exchange(left, words, classes, n_contexts, times)
        if not last:
            contexts = Contexts(classes, _table_classes(vocab, words))
    # Classes of words, of shapes and of the end token; a word's own row tells its class.
    placed = materialise(counts.join(words, "h", "left").select("w", "h", "n", F.coalesce("cls", F.col("shape") + classes).alias("cls")), "word-classes")
    kinds = np.zeros(n_contexts)
    for r in placed.groupBy("cls").agg(F.count("*").alias("words")).collect():  # a row for each class
        kinds[r["cls"]] = r["words"]
    mistaken = left.filter(~F.col("h").between(0, SHAPES)).join(placed.filter(F.col("cls") >= classes).select("h", "cls"), "h").select("k", "cls", "n")
    by_shape = left.filter(F.col("h").between(0, SHAPES)).select("k", (F.col("h") + classes).cast("int").alias("cls"), "n")
    rest = by_shape.unionByName(mistaken).groupBy("k", "cls").agg(F.sum("n").alias("n")).collect()  # context classes by shapes
    whole = np.zeros((n_contexts, n_contexts))
    whole[:, :classes] = pair
    for r in rest:
        whole[r["k"], r["cls"]] = r["n"]
    own = _table_classes(vocab, placed)
    cls = np.array([own[w] for w in vocab.words] or [0], np.int64)
    return Model(vocab, contexts, cls, smoothed(whole), whole.sum(axis=0) + 0.5 * (kinds + 1), min_count), placed.select("w", "n", "cls")


def _table_classes(vocab: Vocabulary, words: DataFrame) -> dict[bytes, int]:
    """Classes of the words of the table, as far as they have one."""
    by_hash = {word_hash(w): w for w in vocab.words}
    table = words.sparkSession.createDataFrame(pd.DataFrame({"th": np.array(list(by_hash), np.int64)}), "th long")
    got = words.join(F.broadcast(table), F.col("h") == F.col("th")).select("h", "cls").toPandas()  # table_words rows at most
    return {by_hash[h]: c for h, c in zip(got["h"].tolist(), got["cls"].tolist(), strict=True)}


def score(docs: DataFrame, model: Model, words: DataFrame, id_col: str = "doc_id", text: str = "text", flag: Column | None = None) -> DataFrame:
    """Per row: id, flag, n_tokens, n_known, train_tokens, base_score (unigram), score and perplexity (class model)."""
    vocab = model.vocab
    floor = vocab.total + 0.5 * (vocab.distinct + 1)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, {w: i for i, w in enumerate(vocab.words)}))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        vocab, get, end = model.vocab, table.get, model.end
        counts = vocab.counts if len(vocab.counts) else np.zeros(1, np.int64)
        base = np.log10((counts + 0.5) / floor)
        emit = np.log10((counts + 0.5) / model.mass[model.cls])
        before_of = np.array([model.contexts.number(w) for w in vocab.words] or [0], np.int64)
        end_base, end_emit = np.log10((vocab.ends + 0.5) / floor), np.log10((vocab.ends + 0.5) / model.mass[end])
        shapes = Numbers(lambda w: model.contexts.classes + shape_class(w))
        for batch in batches:
            n_tokens, n_known, bases, scores, ends = [], [], [], [], [0]
            tail: list[tuple[bytes, int]] = []
            times: list[int] = []
            for t in batch.column("text").to_pylist():
                words = tokens(t)
                before, known, b, s = end, int(vocab.ends > 0), end_base, end_emit
                own: Counter[tuple[bytes, int]] = Counter()
                for at in range(0, len(words), PIECE):
                    part = words[at : at + PIECE]
                    ids = np.fromiter([get(w, -1) for w in part], np.int64, len(part))
                    k = before_of[ids]
                    rare = np.flatnonzero(ids < 0)
                    unknown = [part[i] for i in rare.tolist()]
                    if unknown:
                        place = np.fromiter(map(shapes.__getitem__, unknown), np.int64, len(unknown))
                        k[rare] = np.array(shapes.made, np.int64)[place] if len(place) > 4096 else [shapes.made[i] for i in place.tolist()]
                    ahead = np.concatenate(([before], k[:-1]))
                    before = k[-1]
                    if unknown:
                        own.update(zip(unknown, ahead[rare].tolist(), strict=True))
                    at_table = ids >= 0
                    hit = ids[at_table]
                    known += len(hit)
                    b += base[hit].sum()
                    s += emit[hit].sum() + model.step[ahead[at_table], model.cls[hit]].sum()
                n_tokens.append(len(words) + 1)
                n_known.append(known)
                bases.append(float(b))
                scores.append(float(s + model.step[before, end]))
                tail += own
                times += own.values()
                ends.append(len(tail))
            w = [x for x, _ in tail]
            of_shape = np.array(shapes.made or [0], np.int32)[np.fromiter(map(shapes.__getitem__, w), np.int64, len(w))]
            fields = {"w": pa.array(w, pa.binary()), "k": pa.array([k for _, k in tail], pa.int32()), "m": pa.array(times, pa.int64()), "shape": pa.array(of_shape)}
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
            kept = {c: batch.column(c) for c in ("rid", "id", "flag")}
            if len(shapes) > 500_000:
                shapes = Numbers(shapes.make)
            yield pa.RecordBatch.from_pydict(kept | {"n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base": pa.array(bases, pa.float64()), "model": pa.array(scores, pa.float64()), "tail": lists})

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), (F.lit(False) if flag is None else flag).alias("flag"), F.col(text).alias("text"))
    parts = materialise(rows.mapInArrow(measure, f"rid long, id {kind}, flag boolean, n_tokens long, n_known long, base double, model double, tail array<struct<w: binary, k: int, m: long, shape: int>>"), "lm-parts")
    tail = parts.select("rid", F.explode("tail").alias("t")).select("rid", "t.*")
    rare = words.filter((F.col("n") < vocab.least) & (F.octet_length("w") > 0)).select(F.col("w").alias("cw"), "n", "cls")
    # The class tables, one row for each pair of classes.
    steps = spark.createDataFrame(pd.DataFrame([(k, c, float(x), float(model.mass[c])) for k, row in enumerate(model.step) for c, x in enumerate(row)], columns=["sk", "sc", "step", "mass"]))
    seen = F.coalesce("n", F.lit(0)) + 0.5
    joined = tail.join(rare, F.col("w") == F.col("cw"), "left").withColumn("c", F.coalesce("cls", "shape"))
    joined = joined.join(F.broadcast(steps), (F.col("k") == F.col("sk")) & (F.col("c") == F.col("sc")))
    sums = joined.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("t_known"), F.sum(F.col("m") * F.log10(seen / floor)).alias("t_base"), F.sum(F.col("m") * (F.log10(seen / F.col("mass")) + F.col("step"))).alias("t_model")
    )
    whole = parts.drop("tail").join(sums.withColumnRenamed("rid", "srid"), F.col("rid") == F.col("srid"), "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select(
        F.col("id").alias(id_col), "flag", "n_tokens", plus("n_known", "t_known").cast("long").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        plus("base", "t_base").alias("base_score"), plus("model", "t_model").alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op9_brown_lm(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 5, 1)
    model, words = train(docs.filter(~out))
    return score(docs, model, words, flag=out).withColumnRenamed("flag", "held_out")
