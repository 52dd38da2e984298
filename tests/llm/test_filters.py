"""The filter that is broadcast: its bits against plain Python, and what of it comes to the driver."""

from __future__ import annotations

import numpy as np
import pytest
from loomlog.llm.substring_dedup import filter_of
from pyspark.sql.classic.dataframe import DataFrame


@pytest.mark.parametrize(("n", "most_bits"), [(0, 1 << 28), (1, 1 << 28), (200_000, 1 << 28), (200_000, 1 << 17)])
def test_filter_comes_to_the_driver_as_bytes(spark, monkeypatch, n, most_bits):
    """Its rows are bitmaps of 4 KB; a row for each word of 64 bits took 585 MB of the driver's Python for 2 GB of text."""
    held = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, n)
    held[:4] = [0, -1, (1 << 63) - 1, -(1 << 63)][:n]
    rows, collect = [], DataFrame.collect

    def counted(self):
        out = collect(self)
        rows.append(len(out))
        return out

    anchors = spark.createDataFrame([(int(h),) for h in held], "anchor long")
    monkeypatch.setattr(DataFrame, "collect", counted)
    got = filter_of(anchors, most_bits)
    monkeypatch.undo()
    size = 64 * len(got.words)
    assert size <= most_bits and size >= min(most_bits, 16 * n)
    assert sum(rows) <= size >> 15
    want = np.zeros(size, bool)
    want[held.view(np.uint64) & np.uint64(size - 1)] = True
    assert (np.unpackbits(got.words.view(np.uint8), bitorder="little").astype(bool) == want).all()
    assert got.has(held.view(np.uint64)).all()
