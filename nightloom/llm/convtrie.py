"""The prefix trie of conversations, from partial tries that are merged by key.

A node is named by a 128-bit hash of its sequence of turns: the exclusive or of a hash of
each turn and its place, so that a prefix's name follows from running hashes. Every task
combines its own rows to a table of nodes; these tables are merged by name in rounds, first
within groups of tasks, then all, which sums members and joins end lists. End lists are kept
in blocks of neighbouring ids, so a node where very many conversations end or pass is many
small rows until the end. The rollup from the leaves doubles its reach each round: a node
adds what its descendants at distances below 2**k know of those below them, and a round for
each bit of the greatest depth is enough, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship

GROUP = 20
HEADS = 4
#: Turns of a conversation are numbered and hashed in stretches of 2**12.
STRETCH_BITS = 12
#: End lists are in blocks of ids that agree but for these low bits.
BLOCK_BITS = 12
#: Rows that a task combines at once.
LOCAL_ROWS = 250_000
#: The groups of partial tables in each round of merges.
MERGES = (64, 1)

_PART = "k1 long, k2 long, p1 long, p2 long, depth long, words long, block long, members long, least long, ends array<long>, slot int"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, stretch, number, h1, h2, words): turns in order, null first, numbered from 0; ties by role and text.

    A long conversation is numbered by stretches of its turn numbers, whose sizes are added up.
    """
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("role", "text")],
    )
    none = -(1 << 62)  # before every stretch
    own = own.withColumn("stretch", F.coalesce(F.shiftright("turn", STRETCH_BITS), F.lit(none)))
    in_order = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("conv_id", "stretch").agg(F.count("*").alias("n")).select("conv_id", "stretch", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    own = own.select(
        "conv_id", "stretch", (F.row_number().over(within) - 1).alias("number"),
        F.xxhash64("role", "text", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2"), words.alias("words"),
    )
    return own.join(sizes, ["conv_id", "stretch"]).withColumn("number", F.col("number") + F.col("before")).drop("before")


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first one of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, g1, g2, words, last): a row of depth 0 for each conversation and one for each turn of it.

    ``g1`` and ``g2`` hash a turn and its place; the row of depth 0 has zeros.
    """
    fields = ["h1", "h2", "words"]
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = turns.where((F.col("conv_id") == first) & (F.col("number") < HEADS - 1))
    heads = heads.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("number", *fields))).alias("head")).withColumnRenamed("conv_id", "first")
    # A row per stretch, so that a long conversation's turns are joined in parts.
    stretches = turns.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    own = stretches.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns({"first": first, "h": borrowed(F.col("conv_id"))})
    own = own.join(heads, "first", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<number:long,h1:long,h2:long,words:long>>")))
    own = own.select("conv_id", "h", "head", F.size("head").cast("long").alias("taken"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    own = settle(own)
    root = F.array(F.struct(*[F.lit(0).cast("long").alias(x) for x in ("depth", "h1", "h2", "words")]))
    head = F.transform("head", lambda x, i: F.struct((i + 1).cast("long").alias("depth"), *[x[f].alias(f) for f in fields]))
    of_head = own.select("conv_id", "length", F.explode(F.concat(root, head)).alias("x")).select("conv_id", "length", "x.*")
    parts = stretches.select("conv_id", "stretch").join(own.select("conv_id", "h", "taken", "length"), "conv_id")
    of_own = turns.join(parts, ["conv_id", "stretch"]).where(F.col("number") >= F.col("h"))
    of_own = of_own.select("conv_id", "length", (F.col("number") - F.col("h") + F.col("taken") + 1).alias("depth"), *fields)
    g = lambda h: F.when(F.col("depth") > 0, F.xxhash64(h, "depth")).otherwise(0)
    both = of_head.unionByName(of_own)
    return both.select("conv_id", "depth", g("h1").alias("g1"), g("h2").alias("g2"), "words", (F.col("depth") == F.col("length")).alias("last"))


def named_prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, last): the name of each prefix and of the one that is a turn shorter."""
    own = rows.withColumn("stretch", F.shiftright("depth", STRETCH_BITS))
    in_order = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of more than a stretch have rows here.
    before = own.where(F.col("stretch") >= 0).groupBy("conv_id", "stretch").agg(F.bit_xor("g1").alias("b1"), F.bit_xor("g2").alias("b2"))
    before = before.select("conv_id", "stretch", *[F.bit_xor(x).over(in_order).alias(x) for x in ("b1", "b2")]).where("stretch > 0")
    running = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumns({"k1": F.bit_xor("g1").over(running), "k2": F.bit_xor("g2").over(running)}).join(before, ["conv_id", "stretch"], "left")
    own = own.withColumns({k: F.col(k).bitwiseXOR(F.coalesce(b, F.lit(0))) for k, b in (("k1", "b1"), ("k2", "b2"))})
    parent = lambda k, g: F.when(F.col("depth") > 0, F.col(k).bitwiseXOR(F.col(g)))
    return own.select("conv_id", "depth", "k1", "k2", parent("k1", "g1").alias("p1"), parent("k2", "g2").alias("p2"), "words", "last")


def _table(batch: pa.Table, slot: int) -> pa.RecordBatch:
    conv, k1, k2 = (batch[x].to_numpy() for x in ("conv_id", "k1", "k2"))
    block = conv >> BLOCK_BITS
    order = np.lexsort((conv, block, k2, k1))
    batch, conv, k1, k2, block = batch.take(pa.array(order)), conv[order], k1[order], k2[order], block[order]
    new = np.ones(len(conv), np.bool_)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    last = batch["last"].to_numpy()
    bounds = np.append(np.concatenate(([0], np.cumsum(last)))[at], last.sum()).astype(np.int32)
    kept = batch.take(pa.array(at)).combine_chunks()
    columns = [kept[x].combine_chunks() for x in ("k1", "k2", "p1", "p2", "depth", "words")]
    columns += [pa.array(block[at]), pa.array(np.diff(at, append=len(conv))), pa.array(conv[at]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(conv[last]))]
    columns.append(pa.array(np.full(len(at), slot, np.int32)))
    return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "p1", "p2", "depth", "words", "block", "members", "least", "ends", "slot"])


def _partial_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slot, held, n = TaskContext.get().partitionId(), [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LOCAL_ROWS:
            yield _table(pa.Table.from_batches(held), slot)
            held, n = [], 0
    if n:
        yield _table(pa.Table.from_batches(held), slot)


def merged_tries(prefixes: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2, depth, words, block, members, least, ends): one row per node and block of ids."""
    ship(prefixes.sparkSession)
    table = prefixes.mapInArrow(_partial_tries, _PART)
    same = [F.min(x).alias(x) for x in ("p1", "p2", "depth", "words")]
    for groups in MERGES:
        table = table.withColumn("slot", F.col("slot") % groups).groupBy("k1", "k2", "block", "slot").agg(
            *same, F.sum("members").alias("members"), F.min("least").alias("least"), F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends")
        )
    return table.drop("slot")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for k1, k2, ends in zip(*(batch[x].to_pylist() for x in ("k1", "k2", "ends"))):
            text = ",".join(map(str, ends)).encode()
            if (k1, k2) == key:
                state.update(b"," + text)
            else:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["k1", "k2", "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["k1", "k2", "ends_sha256"])


def end_digests(table: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which a conversation ends: a node's blocks go through its hash in order, one at a time."""
    own = table.where(F.size("ends") > 0).select("k1", "k2", "block", "ends").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block")
    return own.mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: list[str], depth: int) -> DataFrame:
    """(k1, k2, values): each value summed over the node's subtree, by ancestors at distance 1, 2, 4 and so on.

    Sums go up by a grouping with partial sums; the next ancestor is found by a join on this
    one's name, whose hot names adaptive execution splits. Every round is stored.
    """
    state = nodes.select("k1", "k2", F.col("p1").alias("a1"), F.col("p2").alias("a2"), *values)
    for _ in range(depth.bit_length()):
        above = state.where("a1 is not null")
        sums = above.groupBy("a1", "a2").agg(*[F.sum(v).alias(f"+{v}") for v in values]).withColumnsRenamed({"a1": "k1", "a2": "k2"})
        further = above.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        state = state.join(sums, ["k1", "k2"], "left").join(further, ["a1", "a2"], "left")
        state = settle(state.select("k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), *[(F.col(v) + F.coalesce(f"+{v}", F.lit(0))).alias(v) for v in values]))
    return state.select("k1", "k2", *values)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text, a row per turn. Null roles and texts are
    empty, null turns come first, equal turns go by role and text, repeated rows are turns of
    their own; rows without a conv_id belong to no conversation and are left out. A very long
    text is hashed whole, and a very long conversation worked on in stretches. An empty table
    gives no node, not even the root; other columns, whatever their names, are not looked at.
    """
    turns = settle(numbered_turns(conversations))
    table = settle(merged_tries(named_prefixes(rebuilt_turns(turns))))
    nodes = table.groupBy("k1", "k2").agg(*[F.min(x).alias(x) for x in ("p1", "p2", "depth", "words", "least")], F.sum("members").alias("members"))
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["k1", "k2"], "left").join(end_digests(table), ["k1", "k2"], "left").na.fill(0, ["n_children"])
    nothing = hashlib.sha256(b"").hexdigest()
    nodes = nodes.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("members") - 1) * F.col("words"), "ends_sha256": F.coalesce("ends_sha256", F.lit(nothing))})
    nodes = settle(nodes)
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    sums = rolled_up(nodes, ["n_leaves", "saved_tokens"], depth)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent_conv_id"))
    found = nodes.drop("n_leaves", "saved_tokens").join(sums, ["k1", "k2"]).join(parents, ["p1", "p2"], "left")
    return found.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")
