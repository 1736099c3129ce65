"""Distributed union-find: the connected components of a graph too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship


#: Edges in a part. Rounds over few edges take few tasks, each of which would leave files of its own.
PART_EDGES = 200_000
#: Edges (16 bytes each) that one task ties by itself, at every size of the input; more take rounds.
TASK_EDGES = 500_000


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mark")).first()
    return row["n"], row["mark"]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: each node tied to the least one that these edges connect it with."""
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    nodes, where = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v = where[: len(u)], where[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[u], root[v])
        before = root.copy()
        for x in (u, v):
            np.minimum.at(root, before[x], least)
            np.minimum.at(root, x, least)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), both long; root is the component's least node.

    Each task first turns its edges into stars, so a hub has one edge per task and star at
    most. Then large-star and small-star steps alternate: each node's larger neighbours,
    then its smaller ones, are tied to the least node next to it. Every step is a grouping
    with a partial minimum and a join, and every round is stored, so no neighbourhood is
    gathered in one place. Rounds grow with the logarithm of the longest chain. Edges that
    are ``TASK_EDGES`` at most, at first or after some rounds, are stars after one pass of
    one task. Nulls and loops are dropped; no edges give no rows.
    """
    ship(edges.sparkSession)
    edges = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    edges = settle(edges.mapInArrow(_forest, "u long, v long").distinct())
    mark = _mark(edges)
    while mark[0]:
        if mark[0] <= TASK_EDGES:
            edges = settle(edges.coalesce(1).mapInArrow(_forest, "u long, v long"))
            break
        parts = -(-mark[0] // PART_EDGES)
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        joined = large.join(least, F.col("u") == F.col("c"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        edges = settle(small.where("u <> v").distinct().coalesce(parts))
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("u")).distinct().withColumn("v", F.col("u"))
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
