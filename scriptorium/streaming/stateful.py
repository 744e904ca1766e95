"""Streams with state of their own: drift of values against a reference, by event-time timers; and rates over a limit.

Rows are counted before they are shuffled: each task of a micro-batch sends one row for each key, window and bin. A key's state is
a map from (window, bin) to a count, so it is as large as the windows that are open; a timer at the end of each window (after
the watermark passed it) gives the window's row and frees its counts. A row counts if its window is still open, which is until an event
comes whose window ends more than the delay and one width later. State and offsets lie in the checkpoint, so a stream that is
started again goes on where it stopped, and gives no row twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The least share of a bin.
FLOOR = 1e-6
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> list[int]:
    """Counts of equal-width bins; values beyond the ends fall into the first and last one, nulls into none."""
    at = _bin(value, low, high, bins)
    found = {r["bin"]: r["count"] for r in rows.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).count().collect()}  # bins rows at most
    return [found.get(k, 0) for k in range(bins)]


def index(reference: list[int], now: list[int], floor: float = FLOOR) -> float:
    """Population stability index of two histograms."""
    p, q = (np.maximum(np.array(x, float) / max(sum(x), 1), floor) for x in (reference, now))
    return float(((q - p) * np.log(q / p)).sum())


def counted(events: DataFrame, key: str, value: str, low: float, high: float, bins: int, width_ms: int) -> DataFrame:
    """(key, ts, start, bin, n): events counted within each task, by window and bin; ts is the last millisecond of the window."""

    def run(batches):
        for b in batches:
            b = b[b["value"].notna() & b["ts"].notna()]
            if len(b):
                ms = b["ts"].astype("datetime64[us]").astype("int64") // 1000
                at = np.clip(np.floor((b["value"] - low) / (high - low) * bins), 0, bins - 1).astype(int)
                rows = pd.DataFrame({"key": b["key"], "start": ms - ms % width_ms, "bin": at}).groupby(["key", "start", "bin"], as_index=False, dropna=False).size()
                rows["ts"] = pd.to_datetime(rows["start"] + width_ms - 1, unit="ms")
                yield rows.rename(columns={"size": "n"})[["key", "ts", "start", "bin", "n"]]

    rows = events.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    return rows.mapInPandas(run, "key string, ts timestamp, start long, bin int, n long")


class Drift(StatefulProcessor):
    """Counts of the open windows of one key; a row for each window that closes."""

    def __init__(self, reference: list[int], width_ms: int):
        self.reference, self.width = reference, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "start long, bin int", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        got = pd.concat(list(rows)).groupby(["start", "bin"])["n"].sum()
        for (start, at), n in got.items():
            if start + self.width > closed:
                place = (int(start), int(at))
                before = self.counts.getValue(place)[0] if self.counts.containsKey(place) else 0
                self.counts.updateValue(place, (before + int(n),))
        for start in sorted({s for s, _ in got.index}):
            if start + self.width > closed:
                self.handle.registerTimer(int(start + self.width))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.width
        now = [0] * len(self.reference)
        for at in range(len(now)):
            if self.counts.containsKey((start, at)):
                now[at] = int(self.counts.getValue((start, at))[0])
                self.counts.removeKey((start, at))
        yield pd.DataFrame({"key": [key[0]], "start": [pd.Timestamp(start, unit="ms")], "n": [sum(now)], "psi": [index(self.reference, now)]})

    def close(self) -> None:
        pass


def with_state(spark: SparkSession) -> None:
    """State of one's own needs the RocksDB store; streams that are started from now on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _bin(value: str, low: float, high: float, bins: int) -> Column:
    return F.greatest(F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def table_drift(events: DataFrame, reference: list[int], key: str, value: str, low: float, high: float, width_ms: int) -> DataFrame:
    """The rows of drift() for a table, where all windows are closed: one aggregation."""
    start = F.timestamp_millis(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (1000 * width_ms)).cast("long") * width_ms)
    at = _bin(value, low, high, len(reference))
    held = events.filter(F.col(value).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).cast("string").alias(key), start.alias("start"), at.alias("bin"))
    counts = held.groupBy(key, "start").agg(F.count("*").alias("n"), *(F.count_if(F.col("bin") == k).alias(f"c{k}") for k in range(len(reference))))
    part = lambda k: (F.greatest(F.col(f"c{k}") / F.col("n"), F.lit(FLOOR)), F.lit(max(reference[k] / max(sum(reference), 1), FLOOR)))
    total = sum(((q - p) * F.log(q / p) for q, p in map(part, range(len(reference)))), F.lit(0.0))
    return counts.select(key, "start", "n", F.round(total, 9).alias("psi"))


def drift(events: DataFrame, reference: list[int], key: str = "event_type", value: str = "value", low: float = 0.0, high: float = 100.0, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(key, start, n, psi): how far each window of each key is from the reference histogram. events: key, ts, value; a stream or a table.

    Rows without ts or value count nowhere, those without key are a key of their own. A stream gives a window's row once it is closed, a
    table gives all.
    """
    width_ms = int(pd.Timedelta(width).total_seconds() * 1000)
    if not events.isStreaming:
        return table_drift(events, reference, key, value, low, high, width_ms)
    late = f"{width_ms + int(pd.Timedelta(delay).total_seconds() * 1000)} milliseconds"
    with_state(events.sparkSession)
    rows = counted(events, key, value, low, high, len(reference), width_ms).withWatermark("ts", late)
    out = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Drift(reference, width_ms), outputStructType="key string, start timestamp, n long, psi double", outputMode="Append", timeMode="EventTime")
    return out.select(F.col("key").alias(key), "start", "n", F.round("psi", 9).alias("psi"))


def rates(requests: DataFrame, most: int, client: str = "user_id", per: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(client, start, n): windows in which a client asked more than most times, once they are closed. requests: client, ts."""
    n = requests.withWatermark("ts", delay).groupBy(F.window("ts", per).alias("w"), client).agg(F.count("*").alias("n"))
    return n.filter(F.col("n") > most).select(client, F.col("w.start").alias("start"), "n")
