"""Containment of intervals by an index of time buckets, as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contained(outer: DataFrame, inner: DataFrame, keys: list[str], span: tuple[Column, Column], within: tuple[Column, Column]) -> DataFrame:
    """All columns of ``outer`` and ``inner`` for the pairs of equal ``keys`` in which the inner interval ``within`` lies in the outer one, ``span``.

    Bounds are whole milliseconds, ends included. An outer interval of length n goes to the one or two buckets of 2^k > n milliseconds that it
    touches; an inner one looks, for each k that occurs (64 at most), into the bucket that it begins in. So a pair meets once, and what meets lies within
    a few lengths of the outer interval: pairs of a group with very many intervals are not compared.

    Defined cases: a null bound, or an end before its beginning, contains nothing and lies in nothing; null keys meet nothing; equal rows count each.
    Other columns of ``inner`` must not be called as those of ``outer``.
    """
    size = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    bucket = lambda at, k: F.floor(at / size(k)).cast("long")
    lengthy = outer.withColumn("__s", span[0]).withColumn("__e", span[1]).filter("__s <= __e").withColumn("__k", F.length(F.bin(F.col("__e") - F.col("__s"))))
    placed = lengthy.withColumn("__b", F.explode(F.sequence(bucket(F.col("__s"), F.col("__k")), bucket(F.col("__e"), F.col("__k")))))
    levels = F.broadcast(lengthy.select("__k").distinct())  # 64 rows at most
    looking = inner.withColumn("__f", within[0]).withColumn("__l", within[1]).filter("__f <= __l").crossJoin(levels).withColumn("__b", bucket(F.col("__f"), F.col("__k")))
    met = placed.join(looking, [*keys, "__k", "__b"]).filter("__f >= __s AND __l <= __e")
    return met.drop("__s", "__e", "__k", "__b", "__f", "__l")
