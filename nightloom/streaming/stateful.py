"""A detector on a stream whose samples come late and out of order.

Samples wait in a buffer, keyed by their number, until the watermark has passed them; then a
state machine takes them in order, as the batch detector does. A timer wakes a recording that
gets no more samples, and one that has been silent for long gives up its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOUND = "rec long, start long, end long, nadir double, ended timestamp"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunDetector(StatefulProcessor):
    """Runs of flagged samples among valid ones, with the least value; those still open at the end are not told.

    A sample whose number is not above the last one judged came too late and is passed over.
    """

    def __init__(self, least: int, idle_ms: int):
        self.least, self.idle_ms = least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "i long", "ms long, valid boolean, flag boolean, value double")
        # The last number judged, the open run's start and least value, and the latest event time seen.
        self.machine = handle.getValueState("machine", "last long, start long, nadir double, seen long")

    def _judge(self, key: tuple, upto: int) -> Iterator[pd.DataFrame]:
        last, start, nadir, seen = self.machine.get() if self.machine.exists() else (-1, None, None, 0)
        ready = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator() if v[0] <= upto)
        found = []
        for i, (ms, valid, flag, value) in ready:
            self.waiting.removeKey((i,))
            last = max(last, i)
            if not valid:
                continue
            if flag:
                start, nadir = (i, value) if start is None else (start, min(nadir, value))
            elif start is not None:
                if i - start >= self.least:
                    found.append((key[0], start, i, nadir, pd.Timestamp(ms, unit="ms")))
                start, nadir = None, None
        self.machine.update((last, start, nadir, seen))
        yield pd.DataFrame(found, columns=["rec", "start", "end", "nadir", "ended"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        last, start, nadir, seen = self.machine.get() if self.machine.exists() else (-1, None, None, 0)
        for frame in rows:
            ms = frame["ts"].astype("datetime64[ms]").astype("int64")
            for i, at, valid, flag, value in zip(frame["i"], ms, frame["valid"], frame["flag"], frame["value"]):
                if i > last:
                    self.waiting.updateValue((int(i),), (int(at), bool(valid), bool(flag), float(value)))
                    seen = max(seen, int(at))
        self.machine.update((last, start, nadir, seen))
        yield from self._judge(key, watermark)
        self._wake_at(seen + 1 if self.waiting.exists() else seen + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._judge(key, timerValues.getCurrentWatermarkInMs())
        seen = self.machine.get()[3]
        if self.waiting.exists():
            self._wake_at(seen + 1)
        elif timerValues.getCurrentWatermarkInMs() >= seen + self.idle_ms:  # nothing will come that counts
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.waiting.clear()
            self.machine.clear()
        else:
            self._wake_at(seen + self.idle_ms)

    def _wake_at(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def detected_runs(samples: DataFrame, least: int, late: str = "30 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """(rec, start, end, nadir, ended) of a stream (rec, ts, i, valid, flag, value), as runs end.

    Whatever the order of samples up to ``late`` apart, the runs are those of ``bridged_runs``.
    """
    spark = samples.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != _ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    own = samples.select("rec", "ts", "i", "valid", "flag", F.col("value").cast("double").alias("value")).withWatermark("ts", late)
    return own.groupBy("rec").transformWithStateInPandas(statefulProcessor=RunDetector(least, idle_ms), outputStructType=FOUND, outputMode="append", timeMode="eventTime")


def tumbling(samples: DataFrame, size: str = "1 second", late: str = "30 seconds") -> DataFrame:
    """(rec, window_start, n, greatest, mean) of windows that follow each other; later samples are dropped."""
    own = samples.withWatermark("ts", late) if samples.isStreaming else samples
    own = own.groupBy("rec", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("greatest"), F.avg("value").alias("mean"))
    return own.select("rec", F.unix_seconds("w.start").alias("window_start"), "n", "greatest", "mean")
