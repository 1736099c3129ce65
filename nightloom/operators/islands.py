"""Runs of rows, and intervals (``start``, ``end``, end exclusive)."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.operators.frames import CHUNK, chunked
from nightloom.shipping import ship_library


def stitched(fragments: DataFrame, firsts: DataFrame | None, keys: list[str], least: Sequence[str] = (), first: Sequence[str] = (), total: Sequence[str] = ()) -> DataFrame:
    """Runs from the fragments that chunks have of them.

    ``fragments`` has keys, chunk, start, end (the next valid sample, null if the chunk does not
    know it), stop (after the last one), edge (whether it may go on beyond the chunk) and values;
    ``firsts`` (keys or the first of them, chunk, next) the first valid sample of each chunk.
    Only fragments at edges meet per recording, at most two of a chunk. ``least`` values of a
    run are the least of its fragments', ``first`` ones the first fragment's, ``total`` ones the sum.
    """
    values = [*least, *first, *total]
    if firsts is not None:
        own = [k for k in keys if k in firsts.columns]
        order = Window.partitionBy(*own).orderBy("chunk")
        after = firsts.withColumn("_after", F.lead("next").over(order)).select(*own, "chunk", "_after")
        fragments = fragments.join(after, [*own, "chunk"], "left").withColumn("end", F.coalesce("end", "_after")).drop("_after")
    fragments = fragments.select(*keys, "start", "end", "stop", "edge", *values)
    order = Window.partitionBy(*keys).orderBy("start")
    edges = fragments.where("edge")
    reach = F.max(F.coalesce("end", "start")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    edges = edges.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edges = edges.groupBy(*keys, "_run").agg(
        F.min("start").alias("start"), F.max_by("end", "start").alias("end"), F.max("stop").alias("stop"),
        *[F.min(v).alias(v) for v in least], *[F.min_by(v, "start").alias(v) for v in first], *[F.sum(v).alias(v) for v in total],
    )
    columns = [*keys, "start", "end", "stop", *values]
    return fragments.where("not edge").select(columns).unionByName(edges.select(columns))


def _in_chunks(df: DataFrame, valid: Column | None, flag: Column, least: Sequence[str], first: Sequence[str], by: str, at: str, size: int) -> DataFrame:
    """Runs among the valid rows; without ``valid``, of a signal without gaps, whose next row is at most one beyond the chunk."""
    own = df if valid is None else df.where(valid)
    own = own.select(by, F.col(at).alias("_at"), F.coalesce(flag, F.lit(False)).alias("_flag"), *least, *first)
    own = chunked(own, 0, 1 if valid is None else 0, by, "_at", size)
    order = Window.partitionBy(by, "_chunk").orderBy("_at")
    own = own.withColumns({"_o": F.row_number().over(order), "_next": F.lead("_at").over(order)})
    own = own.withColumn("_group", F.col("_o") - F.row_number().over(Window.partitionBy(by, "_chunk", "_flag").orderBy("_at")))
    found = own.where("_flag and _mine").groupBy(by, F.col("_chunk").alias("chunk"), "_group").agg(
        F.min("_at").alias("start"), F.max_by("_next", "_at").alias("end"), (F.max("_at") + 1).alias("stop"), (F.min("_o") == 1).alias("_opens"),
        *[F.min(v).alias(v) for v in least], *[F.min_by(v, "_at").alias(v) for v in first],
    )
    found = found.withColumn("edge", F.col("_opens") | F.col("end").isNull() | (F.col("end") >= (F.col("chunk") + 1) * size))
    firsts = None if valid is None else df.where(valid).groupBy(by, F.expr(f"{at} div {size}").alias("chunk")).agg(F.min(at).alias("next"))
    return stitched(found, firsts, [by], least, first)


def runs(df: DataFrame, flag: Column, by: str = "rec", at: str = "i", least: int = 1, open_at_end: bool = False, size: int = CHUNK) -> DataFrame:
    """(by, start, end) of maximal runs of true rows of a signal without gaps.

    A run that reaches the last row ends after it if ``open_at_end``, else it is dropped.
    """
    found = _in_chunks(df, None, flag, (), (), by, at, size)
    if open_at_end:
        found = found.withColumn("end", F.coalesce("end", "stop"))
    return found.where(F.col("end").isNotNull() & (F.col("end") - F.col("start") >= least)).select(by, "start", "end")


def bridged_runs(
    df: DataFrame, valid: Column, flag: Column, lowest: Sequence[str] = (), first: Sequence[str] = (), by: str = "rec", at: str = "i", least: int = 1, size: int = CHUNK
) -> DataFrame:
    """Runs over the valid rows alone: invalid ones neither end a run nor count as its end.

    The end is the next valid row that is false; a run without one is dropped. Lengths are
    measured on the original places. Columns of ``lowest`` have a run's least value, those
    of ``first`` the one at its start.
    """
    found = _in_chunks(df, valid, flag, lowest, first, by, at, size)
    return found.where(F.col("end").isNotNull() & (F.col("end") - F.col("start") >= least)).drop("stop")


def merge(intervals: DataFrame, by: str = "rec") -> DataFrame:
    """Overlapping and touching intervals made one."""
    order = Window.partitionBy(by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = intervals.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    own = own.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return own.groupBy(by, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def overlapping(a: DataFrame, b: DataFrame, on: Column, by: str = "rec", bucket: float = 60.0) -> DataFrame:
    """Pairs of intervals (by, s1, e1) and (by, s2, e2) that share a stretch of ``bucket`` seconds and meet ``on``.

    A pair is looked for in the stretches of both and found once, in the first that they share.
    """
    cut = lambda df, s, e: df.withColumn("_low", F.floor(F.col(s) / bucket)).withColumn("_bucket", F.explode(F.sequence("_low", F.greatest(F.floor(F.col(e) / bucket), "_low"))))
    left, right = cut(a, "s1", "e1"), cut(b, "s2", "e2").withColumnRenamed("_low", "_low2")
    return left.join(right, [by, "_bucket"]).where((F.col("_bucket") == F.greatest("_low", "_low2")) & on).drop("_bucket", "_low", "_low2")


def thinned(points: DataFrame, distance: int, by: str = "rec", at: str = "j") -> DataFrame:
    """Points from left to right, each at least ``distance`` after the last one kept.

    A point that is so far after the one before it is kept whatever was before, so points are
    judged apart between such gaps.
    """
    order = Window.partitionBy(by).orderBy(at)
    own = points.select(by, at).withColumn("_new", F.when(F.col(at) - F.lag(at).over(order) < distance, 0).otherwise(1))
    own = own.withColumn("_chain", F.sum("_new").over(order))
    kept = F.aggregate(
        F.array_sort(F.collect_list(at)),
        F.array().cast("array<bigint>"),
        lambda have, x: F.when((F.size(have) == 0) | (x - F.element_at(have, -1) >= distance), F.concat(have, F.array(x))).otherwise(have),
    )
    return own.groupBy(by, "_chain").agg(kept.alias("_kept")).select(by, F.explode("_kept").alias(at))


def class_runs(windows: DataFrame, confidence: float, length: float, by: str = "rec", size: int = CHUNK) -> DataFrame:
    """Runs of equal classes over ordered windows (by, start, label, conf): (by, type, start, end, avg_conf, n).

    Class 0 and low confidence break a run; a run at the end is kept; an end is the last
    window's start plus ``length``. Windows are in order within chunks of ``size`` seconds.
    """
    own = windows.withColumn("chunk", F.floor(F.col("start") / size))
    firsts = own.groupBy(by, "chunk").agg(F.min("start").alias("next"))
    order = Window.partitionBy(by, "chunk").orderBy("start")
    ok = (F.col("label") != 0) & (F.col("conf") >= confidence)
    own = own.withColumns({"_ok": ok, "_o": F.row_number().over(order), "_next": F.lead("start").over(order)}).where("_ok")
    own = own.withColumn("_group", F.col("_o") - F.row_number().over(Window.partitionBy(by, "chunk", "label").orderBy("start")))
    own = own.groupBy(by, F.col("label").alias("type"), "chunk", "_group").agg(
        F.min("start").alias("start"), F.max_by("_next", "start").alias("end"), F.max("start").alias("stop"), (F.min("_o") == 1).alias("_opens"),
        F.sum("conf").alias("_conf"), F.count("*").alias("n"),
    )
    found = stitched(own.withColumn("edge", F.col("_opens") | F.col("end").isNull()), firsts, [by, "type"], total=["_conf", "n"])
    return found.select(by, "type", "start", (F.col("stop") + length).alias("end"), (F.col("_conf") / F.col("n")).alias("avg_conf"), "n")


def split_long(events: DataFrame, above: float, part: float) -> DataFrame:
    """Events longer than ``above`` as trunc(length / part) equal ones, with ``part`` numbers; others as they are."""
    length = F.col("end") - F.col("start")
    n = F.when(length > above, F.floor(length / part)).otherwise(1).cast("int")
    own = events.withColumns({"_n": n, "_length": length}).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = F.col("_length") / F.col("_n")
    return own.withColumns({"start": F.col("start") + F.col("part") * step, "end": F.col("start") + (F.col("part") + 1) * step, "was_split": F.col("_n") > 1}).drop("_n", "_length")


#: Rows of whole chains that are judged together; a longer chain is a group of its own.
TOGETHER = 10_000


def in_groups(rows: DataFrame, start: str, end: str, ties: Sequence[str], by: str = "rec") -> DataFrame:
    """Rows with ``_chain`` and ``_group``: no chain of overlaps connects rows of two chains, a group has the chains that begin in ``TOGETHER`` rows."""
    order = Window.partitionBy(by).orderBy(start, *ties)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = rows.withColumns({"_new": F.when(F.col(start) < reach, 0).otherwise(1), "_o": F.row_number().over(order)})
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("_chain", F.max(F.when(F.col("_new") == 1, F.col("_o"))).over(so_far).cast("long"))
    return own.withColumn("_group", F.expr(f"_chain div {TOGETHER}")).drop("_new", "_o")


def _greedy(overlap: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values(["avg_conf", "ord"], ascending=[False, True])
        longest = float((own["end"] - own["start"]).max())
        starts, ends, keep = [], [], np.zeros(len(own), np.bool_)
        for at, (s, e) in enumerate(zip(own["start"].to_list(), own["end"].to_list())):
            # Kept ones that can meet this one begin less than the longest length before it.
            low, high = bisect.bisect_left(starts, s - longest), bisect.bisect_left(starts, e)
            meets = False
            for s2, e2 in zip(starts[low:high], ends[low:high]):
                both = max(min(e, e2) - max(s, s2), 0.0)
                whole = (e - s) + (e2 - s2)
                meets |= whole > 0 and whole - both > 0 and both / (whole - both) > overlap
            if not meets:
                keep[at] = True
                if s != s:
                    continue  # without a start it meets none
                place = bisect.bisect_left(starts, s)
                starts.insert(place, s)
                ends.insert(place, e)
        return own[keep]

    return run


def suppressed(events: DataFrame, overlap: float, by: str = "rec") -> DataFrame:
    """Greedy suppression: by confidence, keep an event that overlaps no kept one by more than ``overlap``.

    ``events`` has by, ord (input order), start, end, avg_conf; equal confidences keep the
    input order. Events that no chain of overlaps connects do not meet, so a task holds some
    such chains at a time, not a recording.
    """
    ship_library(events.sparkSession)
    own = events.select(by, F.col("ord").cast("long").alias("ord"), *[F.col(x).cast("double").alias(x) for x in ("start", "end", "avg_conf")])
    own = in_groups(own, "start", "end", ["ord"], by).drop("_chain")
    schema = f"{own.schema[by].name} {own.schema[by].dataType.simpleString()}, ord long, start double, end double, avg_conf double, _group long"
    return own.groupBy(by, "_group").applyInPandas(_greedy(overlap), schema).drop("_group")
