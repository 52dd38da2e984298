"""Joins that split frequent values off, against Spark's own join."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlog.llm.common import split_join


@pytest.mark.parametrize("rows", [0, 1, 50, 20_000])
def test_split_join(spark, rows):
    left = spark.range(rows).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 211).alias("k"))
    table = left.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    got = split_join(left, table, ["k"], "n", rows, most=16)
    assert Counter(map(tuple, got.select("id", "k", "n").collect())) == Counter(map(tuple, left.join(table, "k").select("id", "k", "n").collect()))


def test_split_join_broadcasts_few_values(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 211).alias("k"))
    table = left.groupBy("k").agg(F.count("*").alias("n"))
    assert [r.k for r in table.filter(F.col("n") > 20_000 // 16).collect()] == [7]
    assert table.filter(F.col("n") > 20_000 // 300).count() < 300
