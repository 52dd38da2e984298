"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort puts equal texts
side by side, and a window compares each full text with its neighbour's.

Spark's range exchange gathers a sample of its keys on the driver, so the keys are bounded: a text's
first ``head`` characters and, for texts that begin alike, its hash. Equal texts agree in both and meet;
the sort behind the exchange and the window go by the whole text.

Texts that hold many rows would land in one partition, so their rows get a salt as a second sort
key (:func:`heavy_texts` counts hashes with map-side combine). The salt only spreads work: the
first row of each salted run is compared again, full text against full text, and a wrong guess
about heaviness costs time, never correctness.

Defined cases: a null text equals the empty text; texts that are equal after deleting
``[\\x20\\x09-\\x0D]`` form one group; the row with most code points in the original text stays, then the
smallest id (a null id comes last); of rows that tie in everything exactly one stays; an empty
table gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, documents, materialise, partitions


def normalise(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def heavy_texts(docs: DataFrame, text: str, limit: int) -> DataFrame:
    """Hash and row count of the texts with over ``limit`` rows: at most rows / limit of them."""
    return docs.groupBy(F.xxhash64(normalise(F.col(text))).alias("__h")).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit)


def content_sort(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: list[str] | None = None, min_run: int = 200, head: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 and the ``carry`` columns.

    A text counts as heavy when it has more rows than ``min_run`` and than a quarter of an even
    partition; so heavy texts number at most four per partition, which bounds what is broadcast.
    """
    carry = list(carry or [])
    n_parts = partitions(docs.sparkSession)
    limit = max(min_run, docs.count() // (4 * n_parts))
    heavy = [(r["__h"], r["__n"]) for r in heavy_texts(docs, text, limit).collect()]
    norm = normalise(F.col("__row.__text")) if carry else F.col("__norm")
    size = F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("__len")
    if carry:  # rows travel whole; their normalised texts are made again behind the exchange
        rows = docs.select(F.col(id_col).alias("__id"), size, F.struct(F.col(text).alias("__text"), *[F.col(f"`{c}`") for c in carry if c != text]).alias("__row"))
    else:
        rows = docs.select(F.col(id_col).alias("__id"), size, normalise(F.col(text)).alias("__norm"))
    rows = rows.withColumn("__begin", F.substring(norm, 1, head)).withColumn("__h", F.xxhash64(norm))
    if heavy:
        table = docs.sparkSession.createDataFrame([(h, -(-n // limit)) for h, n in heavy], "__heavy long, __salts long")
        spread = F.pmod(F.xxhash64("__id", "__len"), F.col("__salts"))
        rows = rows.join(F.broadcast(table), F.col("__h") == F.col("__heavy"), "left").withColumn("__salt", F.coalesce(spread, F.lit(-1).cast("long"))).drop("__heavy", "__salts")
    bounded = ["__begin", "__h", "__salt"] if heavy else ["__begin", "__h"]
    ranged = rows.repartitionByRange(n_parts, *bounded)
    ranged = ranged.withColumn("__norm", norm) if carry else ranged
    run = W.partitionBy(*bounded, "__norm")
    best = run.orderBy(F.desc("__len"), F.asc_nulls_last("__id"))
    local = (
        ranged.withColumn("__keep", F.first("__id").over(best))
        .withColumn("__rank", F.row_number().over(best))
        .withColumn("__size", F.count(F.lit(1)).over(run))
        .withColumn("__sha", F.sha2("__norm", 256))
    )
    row = [F.col("__row")] if carry else []
    if heavy:
        local = materialise(local.select("__id", "__len", "__keep", "__rank", "__size", "__sha", "__salt", F.when((F.col("__rank") == 1) & (F.col("__salt") >= 0), F.col("__norm")).alias("__head"), *row), "content-sort")
        # At most one head per salt of a heavy text; equal heads meet by their full text.
        merged = (
            local.filter(F.col("__head").isNotNull())
            .groupBy("__head")
            .agg(F.min(F.struct(-F.col("__len"), F.col("__id").isNull(), F.col("__id"), F.col("__salt"))).alias("b"), F.sum("__size").alias("__all"), F.first("__sha").alias("__sha"))
            .select("__sha", F.col("b.__id").alias("__best"), F.col("b.__salt").alias("__best_salt"), "__all")
        )
        local = local.join(F.broadcast(merged), "__sha", "left")
        salted = F.col("__salt") >= 0
        keep, size = F.when(salted, F.col("__best")).otherwise(F.col("__keep")), F.when(salted, F.col("__all")).otherwise(F.col("__size"))
        kept = (F.col("__rank") == 1) & (~salted | (F.col("__salt") == F.col("__best_salt")))
    else:
        keep, size, kept = F.col("__keep"), F.col("__size"), F.col("__rank") == 1
    return local.select(F.col("__id").alias(id_col), keep.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.col("__sha").alias("text_sha256"), *row)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return content_sort(docs, id_col, text, carry=docs.columns).filter("kept").select(*[F.col("__row.__text" if c == text else f"__row.`{c}`").alias(c) for c in docs.columns])


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return content_sort(documents(spark, sf_dir))


OP10_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS rn,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
