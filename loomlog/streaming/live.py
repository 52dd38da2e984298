"""Stateful streams: which sessions are live, and secrets that have not been alerted before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lint import secret_lines

LIVE_MS = 60_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """The session's state store becomes the one that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Liveness(StatefulProcessor):
    """A session turns live with an update and quiet when none follows for ``LIVE_MS``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Updates of a batch count in the order of their times, so that batches of any size give the same changes."""
        (session,) = key
        if session is None:  # ticks: they only move the watermark
            return
        before = until = self.until.get()[0] if self.until.exists() else None
        for at in sorted(r.at_ms for r in rows):
            if until is not None and at >= until:
                yield Row(session_id=session, state="quiet", at_ms=until)
                until = None
            if until is None:
                yield Row(session_id=session, state="live", at_ms=at)
            until = max(until or 0, at + LIVE_MS)
        if before is not None and before != until:
            self.handle.deleteTimer(before)
        if before != until:
            self.until.update((until,))
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (session,) = key
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.until.exists() and self.until.get()[0] <= at:
            self.until.clear()
            yield Row(session_id=session, state="quiet", at_ms=at)


def live_changes(updates: DataFrame, ticks: DataFrame) -> DataFrame:
    """(session_id, state ``live`` or ``quiet``, at_ms) as sessions turn.

    ``updates`` has session_id and ts, ``ticks`` has ts: the clock. The watermark follows both, so a session turns quiet when the clock has
    passed its last update by a minute, without further input of its own. Updates older than the clock come too late and count for nothing.
    Times count to the nearest millisecond, halves away from 1970.
    """
    both = updates.select("session_id", "ts").unionByName(ticks.select(F.lit(None).cast("string").alias("session_id"), "ts"))
    rows = both.withWatermark("ts", "0 seconds").select("session_id", "ts", F.expr("(unix_micros(ts) + CASE WHEN unix_micros(ts) < 0 THEN -500 ELSE 500 END) div 1000").alias("at_ms"))
    return rows.groupBy("session_id").transformWithState(Liveness(), "session_id string, state string, at_ms long", "Append", "EventTime")


class Novelty(StatefulProcessor):
    """The first row of each key, for good; keys of the initial state have had theirs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        first = min(rows, key=lambda r: (r.path, r.start, r.check_id))
        self.seen.update((True,))
        yield Row(fingerprint=key[0], check_id=first.check_id, masked=first.masked, path=first.path, start=first.start)


def secret_alerts(lines: DataFrame, alerted: DataFrame) -> DataFrame:
    """(fingerprint, check_id, masked, path, start): findings whose fingerprint, check id and masked value, has never been alerted.

    ``lines`` has path, start and value and should come from a source that holds new files' content back until they grow
    (``created=hold``), as creation alerts nothing. ``alerted`` (fingerprint) is the store of earlier alerts: a query without a checkpoint
    starts from it. State is kept for each fingerprint and never expires. Of the rows of a fingerprint in an Arrow batch, a task passes
    the first on, so a secret that fills a log makes no hot key.
    """
    hits = secret_lines(lines, None, order="start").select(F.concat_ws(":", "check_id", "masked").alias("fingerprint"), "check_id", "masked", "path", F.col("line_no").alias("start"))
    known = alerted.select("fingerprint").distinct().groupBy("fingerprint")
    return hits.mapInPandas(first_of_each, hits.schema).groupBy("fingerprint").transformWithState(Novelty(), hits.schema, "Append", "None", known)


def first_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.sort_values(["fingerprint", "path", "start"]).drop_duplicates("fingerprint")
