"""Language identification with bit-sliced n-gram Bloom filters.

Each language has a Bloom filter of the character n-grams that are typical of it. The filters are
stored bit-sliced: one machine word per filter position holds that position's bit for 64 languages, so
that the AND of ``hashes`` words answers, for one n-gram and all languages at once, which languages contain it.
A text's n-grams are looked up this way, counted per language, corrected for the filter's false positives
(known from its fill), and the language with the largest corrected share wins.

Learning uses a bounded sample: about ``train_docs`` labelled documents of each language, and one at least, chosen by a
hash of text and id (rows equal in both are chosen together). Filters have a fixed size (``slots`` words per 64 languages), which bounds what is
collected and broadcast. Prediction reads whole texts and nothing but the text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing was learned; any other
text gets a learned language; ties, no known n-gram among them, go to the language with most labelled documents, then to the first
in code point order; null labels are not learned, ids may be null or repeat; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, text_batches

UND = "und"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
BLOCK = 1 << 20  #: code points handled at once, so that a very long text needs bounded memory


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def ngram_keys(text: str, n: int) -> Iterator[np.ndarray]:
    """Keys of the lower-cased text's n-grams, block by block; each is an exact packing for n <= 3.

    Everything that is not a letter becomes one space, n-grams lie within a word and its two borders; a word of one letter
    has those of its borders. Blocks overlap by n - 1, so that none adds or loses an n-gram.
    """
    text = f" {text.lower()} "
    for at in range(0, max(1, len(text) - n + 1), BLOCK):
        part = text[at : at + BLOCK + n - 1]
        if not part.isalpha():
            part = "".join([c if c.isalpha() else " " for c in part])
        part = _codes(part)
        if len(part) < n:
            continue
        keys, blanks = np.zeros(len(part) - n + 1, np.uint64), np.zeros(len(part) - n + 1, np.int8)
        for k in range(n):
            c = part[k : k + len(keys)]
            keys = (keys << np.uint64(21)) | c
            blanks += c == 32
        inner = np.zeros(len(keys), bool)
        for k in range(1, n - 1):
            inner |= part[k : k + len(keys)] == 32
        yield keys[(blanks < n) & ~inner]


def positions(keys: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    """The filter positions of each key, one array per hash function."""
    shift, out = np.uint64(64 - slots.bit_length() + 1), []
    for k in range(hashes):
        h = keys * MIX[k]
        h ^= h >> np.uint64(29)
        out.append(((h * MIX[(k + 1) % 3]) >> shift).astype(np.int64))
    return out


class Filters:
    """The learned filters: ``words[b, p]`` holds the bits of languages 64 b .. 64 b + 63 at position p."""

    def __init__(self, langs: list[str], words: np.ndarray, n: int, hashes: int, docs: list[int] | None = None):
        self.langs, self.words, self.n, self.hashes = langs, words, n, hashes
        self.docs = np.array(docs or [0] * len(langs))  #: labelled documents of each language, for ties
        fill = [np.mean((words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(langs))]
        self.false = np.minimum(np.array(fill, float) ** hashes, 0.999)

    def shares(self, text: str) -> np.ndarray | None:
        """Per language, the share of the text's n-grams that it contains, corrected for false positives."""
        hits, total = np.zeros(len(self.langs)), 0
        for keys in ngram_keys(text, self.n):
            total += len(keys)
            where = positions(keys, self.words.shape[1], self.hashes)
            for b, row in enumerate(self.words):
                mask = row[where[0]]
                for p in where[1:]:
                    mask &= row[p]
                for i in range(64 * b, min(64 * b + 64, len(self.langs))):
                    hits[i] += np.count_nonzero(mask & np.uint64(1 << (i % 64)))
        if not len(self.langs):
            return None
        if not total:
            return np.zeros(len(self.langs))
        return np.clip((hits / total - self.false) / (1 - self.false), 0, 1)

    def decide(self, text: str | None) -> tuple[str, float]:
        shares = self.shares(text) if text else None
        if shares is None or not any(c.isalpha() for c in text):
            return UND, 0.0
        best = int(np.lexsort((np.arange(len(shares)), -self.docs, -shares))[0])
        return self.langs[best], float(shares[best])


def learn(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", n: int = 3, train_docs: int = 1000, slots: int = 1 << 18, hashes: int = 3, min_count: int = 3, ratio: float = 0.25, max_langs: int = 1024) -> Filters:
    """Filters from about ``train_docs`` documents of each of the ``max_langs`` languages with most labelled documents (the sample's bounds).

    An n-gram is typical of a language when it occurs ``min_count`` times in its sample and at least ``ratio``
    times as often, per n-gram, as in the language that uses it most.
    """
    text_batches(labelled.sparkSession)
    if slots & (slots - 1):
        raise ValueError("slots must be a power of two")
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # Drawn by text and id: ids may be null or repeat. The smallest draw of a language is always in.
    draw = F.pmod(F.xxhash64(F.col(text), F.col(id_col), F.lit(11)), F.lit(1 << 20)) / (1 << 20)
    told = known.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n"), F.min(draw).alias("least")).orderBy(F.desc("n"), "l").limit(max_langs).collect()
    counts, least = {r["l"]: r["n"] for r in told}, {r["l"]: r["least"] for r in told}
    langs = sorted(counts)
    if not langs:
        return Filters([], np.zeros((1, slots), np.uint64), n, hashes)
    spark, index = labelled.sparkSession, {x: i for i, x in enumerate(langs)}
    share = spark.createDataFrame([(x, index[x], min(1.0, train_docs / counts[x]), least[x]) for x in langs], "__lang string, __li int, __share double, __least double")
    sample = known.join(F.broadcast(share), F.col(lang) == F.col("__lang")).filter((draw < F.col("__share")) | (draw == F.col("__least"))).select("__li", F.col(text).alias("__text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for li, texts in batch.groupby("__li")["__text"]:
                keys = [k for t in texts for k in ngram_keys(t, n)]
                if keys:
                    key, times = np.unique(np.concatenate(keys), return_counts=True)
                    yield pd.DataFrame({"li": np.full(len(key), li, np.int32), "key": key.view(np.int64), "n": times})

    grams = sample.mapInPandas(count, "li int, key long, n long").groupBy("li", "key").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("li").agg(F.sum("n").alias("total"))
    rated = grams.join(F.broadcast(totals), "li").withColumn("rate", F.col("n") / F.col("total"))
    peak = rated.groupBy("key").agg(F.max("rate").alias("peak"), F.collect_list(F.struct("li", "n", "rate")).alias("uses"))  # a key has at most max_langs uses
    typical = peak.select("key", F.explode("uses").alias("u"), "peak").filter((F.col("u.n") >= min_count) & (F.col("u.rate") >= F.col("peak") * ratio)).select("key", F.col("u.li").alias("li"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            li = batch["li"].to_numpy()
            for p in positions(batch["key"].to_numpy().view(np.uint64), slots, hashes):
                yield pd.DataFrame({"b": li // 64, "p": p, "bit": np.left_shift(np.uint64(1), (li % 64).astype(np.uint64)).view(np.int64)})

    # At most ``slots`` rows for each 64 languages reach the driver.
    words = np.zeros((-(-len(langs) // 64), slots), np.uint64)
    for r in typical.mapInPandas(place, "b int, p long, bit long").groupBy("b", "p").agg(F.bit_or("bit").alias("w")).toPandas().itertuples():
        words[r.b, r.p] = np.int64(r.w).view(np.uint64)
    return Filters(langs, words, n, hashes, [counts[x] for x in langs])


def predict(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added."""
    shared, taken = docs.sparkSession.sparkContext.broadcast(filters), {c.lower() for c in docs.columns}
    if clash := taken & {"lang_pred", "score"}:
        raise ValueError(f"rename these columns first: {sorted(clash)}")

    @F.pandas_udf("lang_pred string, score double")
    def decide(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in texts:
            yield pd.DataFrame([own.decide(t) for t in batch], columns=["lang_pred", "score"])

    got = docs.withColumn("__lang", decide(F.col(text)))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__lang.lang_pred").alias("lang_pred"), F.col("__lang.score").alias("score"))


def is_held_out(id_col: str = "doc_id") -> Column:
    return held_out(F.col(id_col), 4, 2)


def keep_languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = 0.15, **options) -> DataFrame:
    """The documents with a learned language: those without letters, or like none of them, go."""
    filters = learn(docs.filter(~is_held_out(id_col)), id_col, text, lang, **options)
    out = predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("__text")), filters, "__text")
    return out.filter((F.col("lang_pred") != UND) & (F.col("score") >= min_score)).select("__row.*")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    filters = learn(docs.filter(~is_held_out()))
    return predict(docs.select("doc_id", is_held_out().alias("held_out"), "text"), filters).drop("text")
