"""Events found against events labelled: one to one, where they overlap enough."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.functions.scalar import temporal_iou
from nightloom.operators.islands import in_groups, overlapping
from nightloom.shipping import ship_library


def _taken(frame: pd.DataFrame) -> pd.DataFrame:
    """The pairs of some chains from the likest on, each event of a chain once."""
    left, right, keep = set(), set(), []
    for at, chain, t, p in frame.sort_values(["iou", "truth", "found"], ascending=[False, True, True])[["_chain", "truth", "found"]].itertuples():
        if (chain, t) not in left and (chain, p) not in right:
            left.add((chain, t))
            right.add((chain, p))
            keep.append(at)
    return frame.loc[keep]


def matched(truth: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """(rec, truth, found, iou): pairs of events whose overlap over union is at least ``least``, from the likest on, each event in one.

    Both have rec, id, start and end. Pairs are looked for by the minute. Events that no chain of
    pairs connects in time are judged apart, and a task holds some such chains, not a recording.
    """
    ship_library(truth.sparkSession)
    a = truth.select("rec", F.col("id").cast("long").alias("truth"), F.col("start").cast("double").alias("s1"), F.col("end").cast("double").alias("e1"))
    b = found.select("rec", F.col("id").cast("long").alias("found"), F.col("start").cast("double").alias("s2"), F.col("end").cast("double").alias("e2"))
    iou = temporal_iou(*[F.col(x) for x in ("s1", "e1", "s2", "e2")])
    pairs = overlapping(a, b, F.expr("s1 < e2 and s2 < e1")).withColumn("iou", iou).where(F.col("iou") >= least)
    pairs = pairs.withColumns({"low": F.least("s1", "s2"), "high": F.greatest("e1", "e2")})
    pairs = in_groups(pairs, "low", "high", ["truth", "found"]).select("rec", "_group", "_chain", "truth", "found", "iou")
    schema = f"rec {pairs.schema['rec'].dataType.simpleString()}, _group long, _chain long, truth long, found long, iou double"
    return pairs.groupBy("rec", "_group").applyInPandas(_taken, schema).drop("_group", "_chain")


def match_report(truth: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(type, labelled, found, hits, hits_of_type, precision, recall, f1) per type of event.

    ``truth`` and ``found`` have rec, id and type. A hit is a matched event, one of its type if
    both have it; precision, recall and f1 count hits of the type. Without a denominator they are 0.
    """
    t = truth.select("rec", F.col("id").alias("truth"), F.col("type").alias("type"))
    p = found.select("rec", F.col("id").alias("found"), F.col("type").alias("own"))
    both = pairs.join(t, ["rec", "truth"]).join(p, ["rec", "found"])
    hits = both.groupBy("type").agg(F.count("*").alias("hits"), F.count_if(F.col("type") == F.col("own")).alias("hits_of_type"))
    out = t.groupBy("type").agg(F.count("*").alias("labelled")).join(p.groupBy(F.col("own").alias("type")).agg(F.count("*").alias("found")), "type", "full_outer")
    out = out.join(hits, "type", "left").na.fill(0)
    ratio = lambda n, d: F.coalesce(F.try_divide(n.cast("double"), d), F.lit(0.0))
    h = F.col("hits_of_type")
    return out.withColumns({"precision": ratio(h, F.col("found")), "recall": ratio(h, F.col("labelled")), "f1": ratio(2 * h, F.col("found") + F.col("labelled"))})
