"""Windows, sessions and an online run detector over streams of (rec, ts, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding(samples: DataFrame, size: str = "60 seconds", every: str = "30 seconds", late: str = "30 seconds") -> DataFrame:
    """Counts and totals of windows; samples later than ``late`` are dropped."""
    own = samples.withWatermark("ts", late) if samples.isStreaming else samples
    own = own.groupBy("rec", F.window("ts", size, every).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.select("rec", F.unix_seconds("w.start").alias("window_start"), "n", "total")


def sessions(flags: DataFrame, gap: str = "5 seconds", late: str = "30 seconds") -> DataFrame:
    """Runs of flagged samples, merged over gaps of up to ``gap``."""
    own = flags.withWatermark("ts", late) if flags.isStreaming else flags
    own = own.where("flag").groupBy("rec", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return own.select("rec", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def online_runs(flags: DataFrame, least: int) -> DataFrame:
    """Runs of (rec, i, flag) as they end; an open run is kept as state, in order of arrival."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (start,) = state.get if state.exists else (None,)
        found = []
        for frame in frames:
            for i, flag in frame.sort_values("i")[["i", "flag"]].itertuples(index=False):
                if flag and start is None:
                    start = int(i)
                elif not flag and start is not None:
                    if i - start >= least:
                        found.append((key[0], start, int(i)))
                    start = None
        state.update((start,))
        yield pd.DataFrame(found, columns=["rec", "start", "end"])

    return flags.groupBy("rec").applyInPandasWithState(step, "rec long, start long, end long", "start long", "append", GroupStateTimeout.NoTimeout)
