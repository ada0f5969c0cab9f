"""Refreshes of views that signals make stale: one at once, then at most one a window.

The first signal of a view refreshes it. Those that arrive within the window after a refresh share one
refresh at the window's end; a signal after that refreshes at once again. So the refresh that follows
one at r is at max(r + window, the first signal after r), and covers every signal up to then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.signals import matters
from ..plans.query import AnalyticsQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REFRESH = "view string, refresh_ms bigint, n_signals bigint, waited boolean"


class Refreshes(StatefulProcessor):
    """State of a view: when it was last refreshed, and the times of signals that no refresh covers yet. A
    timer stands at the next refresh that is due."""

    def __init__(self, window_ms: int, live: bool):
        self.window_ms, self.live = window_ms, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "refresh_ms bigint")
        self.waiting = handle.getListState("waiting", "at_ms bigint, n bigint")

    def _now(self, timers) -> int:
        return timers.getCurrentProcessingTimeInMs() if self.live else timers.getCurrentWatermarkInMs()

    def _refreshes(self, view: str, waiting: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        """Refreshes that are due; what still waits stays in the state, with a timer."""
        last = self.last.get()[0] if self.last.exists() else None
        waiting, k, out = sorted(waiting), 0, []
        while k < len(waiting):
            due = waiting[k][0] if last is None else max(waiting[k][0], last + self.window_ms)
            if due > now:
                break
            first, n = waiting[k][0], 0
            while k < len(waiting) and waiting[k][0] <= due:
                n += waiting[k][1]
                k += 1
            out.append((view, due, n, first < due))
            last = due
        if out:
            self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if k < len(waiting):
            self.waiting.put(waiting[k:])
            self.handle.registerTimer(due)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["view", "refresh_ms", "n_signals", "waited"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, came = self._now(timerValues), {}
        for part in rows:
            counts = {now: len(part)} if self.live else part["at_ms"].value_counts().to_dict()
            for at, n in counts.items():
                came[int(at)] = came.get(int(at), 0) + int(n)
        yield from self._refreshes(key[0], [*((r[0], r[1]) for r in self.waiting.get()), *came.items()], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._refreshes(key[0], [(r[0], r[1]) for r in self.waiting.get()], self._now(timerValues))

    def close(self) -> None:
        pass


def refreshes(signals: DataFrame, window: str = "1 second", lateness: str | None = None) -> DataFrame:
    """When views (view, at) are refreshed: view, refreshed_at, n_signals covered, waited.

    A signal counts when it is seen, with timers on the clock of the cluster. With a lateness, a signal
    counts at its own time at, in milliseconds, once nothing older can arrive, so that a replay gives the same
    refreshes; one that is later than that is dropped by the watermark. Rows without a view or time are no
    signals; repeated ones count each; a view that gets very many signals keeps a number for each millisecond
    that has one, and only until they are covered.
    """
    live = lateness is None
    window_ms = signals.sparkSession.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {window}"))).alias("ms")).first()["ms"]
    rows = signals.where("view is not null and at is not null").select("view", "at", F.unix_millis("at").alias("at_ms"))
    rows = rows if live else rows.withWatermark("at", lateness)
    told = rows.groupBy("view").transformWithStateInPandas(Refreshes(window_ms, live), REFRESH, "Append", "ProcessingTime" if live else "EventTime")
    return told.select("view", F.timestamp_millis("refresh_ms").alias("refreshed_at"), "n_signals", "waited")


def stale_views(signals: DataFrame, views: dict[str, AnalyticsQuery]) -> DataFrame:
    """Each view that a signal (raw_report_id, run_ts, incidents) matters to: view, at."""
    stale = F.array(*(F.when(matters(F.struct("raw_report_id", "incidents"), query), view) for view, query in views.items()))
    return signals.select(F.explode(F.array_compact(stale)).alias("view"), F.col("run_ts").alias("at"))


def start(told: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs refreshes(...) and calls show with those of each batch. Timers need the state in RocksDB; the
    session's own setting stands again once the query has begun."""
    spark = told.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return told.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "200 milliseconds"})).start()
    finally:
        spark.conf.set(PROVIDER, before)
