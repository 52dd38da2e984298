"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in its source's shuffled queue; queues repeat (``max_epochs`` times), because a source may have to give
more words than it has. A document's virtual finish time is its source's cumulative words divided by the source's target; the
document in service when the target is used up is split there, so that its first part finishes at virtual time 1. All queues
are then sorted by finish time, words are summed along that order and the order is truncated at the total budget.

The global sort: ranges are stretches of virtual time of equal width. A source's words are even over virtual time, so the ranges hold
equal numbers of words at every size, without sampling; ranges are summed first, those behind the budget are dropped whole, and running
sums are taken inside a range from the range's offset. Likewise no source is gathered in one task: its queue is cut by the leading
digits of the shuffle key into stretches that hold about a quarter of an even partition's rows.

Per source there is one row, and two windows over these rows alone run in one task.

Defined cases: a null text has size 0; a null source is a source of its own, last in order and apart from ''; ids may be null or
repeat: rows are queued one by one, those that share id, size and text are alike; a document of size 0, or of a source without words,
takes no words and has no finish time if its source's target is under half a word; other columns pass through, and those named like the three
that :func:`mix` adds are refused; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, materialise, partitions, with_row_keys

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Per source: source_size, documents and target, water-filled: no target above ``max_epochs`` times the size.

    Sources are aggregated first; the two windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    fill, everything = W.orderBy("ratio", F.asc_nulls_last("source")), W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", level).withColumn("open", F.when(F.col("ratio") > F.col("level"), F.col("level")))
    # Sources fill up in order of ratio; the first that doesn't sets the level of all that don't.
    water = F.first("open", ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(water.isNull() | (F.col("ratio") <= water), F.col("cap").cast("double")).otherwise(water * F.col("weight"))
    return per.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def sizes(docs: DataFrame, id_col: str, text: str, source: str, seed: int, *keep: str) -> DataFrame:
    """id, source, size, the shuffle key and what orders rows of one key, per row."""
    shuffle = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return docs.select(*keep, F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), shuffle.alias("key"), F.xxhash64(text).alias("twin"))


def queued(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """``sized`` with source_size, target, budget (the target in whole words) and queue_before (words ahead in its queue)."""
    per = materialise(targets(sized, weights, share, max_epochs).withColumn("budget", F.floor(F.col("target") + 0.5).cast("long")), "mix-targets")
    total = per.agg(F.sum("n_docs")).first()[0] or 0
    stretch = max(1, total // (4 * partitions(sized.sparkSession)))
    digits = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = sized.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("piece", F.shiftright(digits * F.ceil(F.col("n_docs") / stretch), 32))
    sums = rows.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("source").alias("s"), F.col("piece").alias("p"), ahead.alias("offset"))
    within = W.partitionBy("source", "piece").orderBy("key", "id", "size", "twin").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")))
    return rows.withColumn("queue_before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("s", "p", "piece", "offset", "twin", "key", "n_docs")


def served(queue: DataFrame, max_epochs: int, *keep: str) -> DataFrame:
    """What the global queue serves: ``keep`` columns, epoch, words, finish and range of every document part within the total budget."""
    budget = queue.groupBy("source").agg(F.max("budget").alias("b")).agg(F.sum("b")).first()[0] or 0
    ranges = 4 * partitions(queue.sparkSession)

    def parts(epoch: int) -> Column:
        """A document's parts in one pass of its queue: up to its source's target, and behind it."""
        start = F.col("queue_before") + F.col("source_size") * epoch
        first = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("budget") - start))
        part = lambda words, end: F.struct(F.lit(epoch + 1).alias("epoch"), words.alias("words"), (end / F.col("budget")).alias("finish"))
        return F.array(part(first, start + first), part(F.col("size") - first, start + F.col("size")))

    each = F.filter(F.concat(*map(parts, range(max_epochs))), lambda m: m["words"] > 0)
    units = queue.filter("budget > 0").select(*keep, F.explode(each).alias("m")).select(*keep, "m.*")
    # Behind virtual time 1 lies one range more.
    units = units.withColumn("range", F.least(F.ceil(F.col("finish") * ranges), F.lit(ranges + 1)).cast("int"))
    sums = units.groupBy("range").agg(F.sum("words").alias("w"))  # one row for each range
    ahead = F.coalesce(F.sum("w").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("range").alias("r"), ahead.alias("offset")).filter(F.col("offset") < budget)
    order = W.partitionBy("range").orderBy("finish", *keep, "epoch").rowsBetween(W.unboundedPreceding, -1)
    running = units.join(F.broadcast(offsets), F.col("range") == F.col("r")).withColumn("before", F.col("offset") + F.coalesce(F.sum("words").over(order), F.lit(0)))
    return running.filter(F.col("before") < budget).select(*keep, "epoch", F.least("words", F.lit(budget) - F.col("before")).alias("words"), "finish", "range")


def fair_queue(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """One row per document: id, source, size, source_size, target, queue_before, finish (of its first pass), taken."""
    sized = materialise(sizes(docs, id_col, text, source, seed, F.monotonically_increasing_id().alias("rid")), "mix-sizes")
    queue = materialise(queued(sized, weights, share, max_epochs), "mix-queue")
    taken = served(queue, max_epochs, "rid").groupBy("rid").agg(F.sum("words").alias("taken")).withColumnRenamed("rid", "trid")
    finish = F.when(F.col("budget") > 0, (F.col("queue_before") + F.col("size")) / F.col("budget"))
    return queue.join(taken, F.col("rid") == F.col("trid"), "left").select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "queue_before", finish.alias("finish"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """The mixed corpus: a row for each time a document is taken, range-partitioned and sorted by virtual finish time over all sources.

    Columns of ``docs`` (the text cut where the budget ends inside it), then mix_epoch, mix_words and mix_finish.
    """
    keyed = with_row_keys(docs, "mix-rows")
    column = lambda c: F.col(f"row.`{c}`").alias(c)
    sized = materialise(sizes(keyed.select("rid", column(id_col), column(text), column(source)), id_col, text, source, seed, "rid"), "mix-sizes")
    parts = served(materialise(queued(sized, weights, share, max_epochs), "mix-queue"), max_epochs, "rid")
    # Both parts of a document join in one pass; one row per document meets its text.
    parts = parts.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("finish", "range", "epoch", "words"))).alias("parts")).withColumnRenamed("rid", "prid")
    taken = keyed.join(parts, F.col("rid") == F.col("prid")).select("row", F.explode("parts").alias("m"))
    whole = F.col(f"row.`{text}`")
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    cut = F.when(F.col("m.words") < F.size(words), F.array_join(F.slice(words, F.lit(1), F.col("m.words").cast("int")), " ")).otherwise(whole)
    own = {c.lower() for c in docs.columns}
    if clash := own & {"mix_epoch", "mix_words", "mix_finish"}:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    out = taken.select(*[(cut.alias(c) if c == text else column(c)) for c in docs.columns], F.col("m.epoch").alias("mix_epoch"), F.col("m.words").alias("mix_words"), F.col("m.finish").alias("mix_finish"), F.col("m.range").alias("__range"))
    n = partitions(docs.sparkSession)
    # Four ranges of virtual time go to each partition, in their order: a global sort without a sampling run.
    out = out.repartitionById(n, F.least(F.shiftright(F.col("__range") - 1, 2), F.lit(n - 1)))
    return out.sortWithinPartitions("mix_finish", id_col, "mix_epoch").drop("__range")


def op5_fair_queue_mix(spark, sf_dir: str) -> DataFrame:
    return fair_queue(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "finish", "taken")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':7') AS key FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS ratio FROM p),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level FROM r
      WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w AS (SELECT min_by(level, ratio) AS water FROM l WHERE ratio > level),
t AS (SELECT source, source_size, CASE WHEN water IS NULL OR ratio <= water THEN cap::DOUBLE ELSE water * weight END AS target FROM l, w),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN floor(target + 0.5) > 0 THEN (ahead + size)::DOUBLE / floor(target + 0.5) END AS finish,
       (greatest(0, least(size, floor(target + 0.5)::BIGINT - ahead)) + greatest(0, least(size, floor(target + 0.5)::BIGINT - source_size - ahead)))::BIGINT AS taken FROM q
"""
