"""From band keys to verified links and classes, for any kind of signature.

Items are texts, named by a 64-bit hash (``node``), so exact copies are one item. Each has
a sketch, one bit of each of 64 samples. Items that share a band key are a bucket. Pairs of
a bucket whose sketches agree in too few bits are no links: a link of exactly 0.8 agrees in
57.6 bits on average and in fewer than ``AGREE`` once in about 20,000. Among the first 24
items of a bucket, in an order of its own, all other pairs are candidates; every further
item is compared with these 24 and is a candidate with the three it is most alike. That
joins most of a large class by linear work. What it leaves apart in a larger bucket is
compared with a representative: the item most like the majority of the bucket, such as the
original of many edited copies. So far all work is linear in the items. In buckets that are
still in several classes, every item outside the largest class is then compared with all
items of other classes by the texts, in blocks (``links_between``), so no link is lost; this
step is quadratic where a large bucket is of many classes. Entries of buckets are dealt by
the first bits of their keys, those of a part and a batch as one row, so that few rows are
shuffled and sorted; a task takes its parts one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .components import components
from .textkernels import among, mix

#: Bits of 64 that the sketches of a link have in common at least.
AGREE = 48
#: The first items of a bucket, of which all pairs are candidates.
ALL_PAIRS = 24
#: Of these, how many a later item of the bucket is a candidate with.
BEST = 3
#: Nodes that tasks get as one sorted array to pick their texts by (8 bytes each); more are joined.
BROADCAST_NODES = 1_000_000
#: Bytes of text in a block of a bucket; a task holds two blocks at a time.
BLOCK_BYTES = 1 << 19

#: Bits of a key that name its part: 4,096 parts, each of which a task sorts in memory.
PART_BITS = 12
#: Entries that a task sorts at a time, in whole parts.
PART_ENTRIES = 1 << 18
#: Entries after which a signer gives its buckets on.
SIGNED_ENTRIES = 1 << 19

BANDS_SCHEMA = "part int, key binary, node binary, sketch binary, other binary, bucket binary"
_NAMES = ["key", "node", "sketch", "other", "bucket"]
_PAIR_NAMES = ["u", "v", "bucket", "sketch"]


def sketch_of(values: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 rows, per column, as a long."""
    out = np.zeros(values.shape[1], np.uint64)
    for i, row in enumerate(values[:64]):
        out |= (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)) << np.uint64(i)
    return out.view(np.int64)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 64 - np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


def _likest(first: np.ndarray, late: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (late item, one of the bucket's first) of the BEST that are alike enough; ``first`` is where a late item's bucket begins."""
    bits = np.stack([_agree(sketches[first + i], sketches[late]) for i in range(ALL_PAIRS)])
    out = [], []
    for _ in range(BEST):
        best = bits.argmax(axis=0)
        at = np.arange(len(late))
        good = bits[best, at] >= AGREE
        out[0].append(late[good])
        out[1].append((first + best)[good])
        bits[best, at] = 0
    return np.concatenate(out[0]), np.concatenate(out[1])


def _by_bucket(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """An order by key; in buckets of more than ALL_PAIRS, by the bucket's own order of nodes."""
    order = np.argsort(keys)
    begin = np.flatnonzero(np.concatenate(([True], keys[order[1:]] != keys[order[:-1]])))
    sizes = np.diff(np.append(begin, len(keys)))
    large = np.flatnonzero(np.repeat(sizes > ALL_PAIRS, sizes))
    own = order[large]
    order[large] = own[np.lexsort((mix(keys[own].view(np.uint64) ^ nodes[own].view(np.uint64)), keys[own]))]
    return order


def _packed(part: np.ndarray, bounds: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row per part with its values in each column, eight bytes each; columns that are not given are null."""
    at = pa.py_buffer((bounds * 8).astype(np.int32))
    values = [pa.Array.from_buffers(pa.binary(), len(part), [None, at, pa.py_buffer(np.ascontiguousarray(columns[x]))]) if x in columns else pa.nulls(len(part), pa.binary()) for x in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *values], ["part", *_NAMES])


def local_bands(keys: np.ndarray, nodes: np.ndarray, sketches: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The buckets of a part of the data, packed: entries have key, node and sketch and are dealt by their keys' first bits.

    Of a bucket that has many items here the first 24 are entries. Each further one only
    names its candidates among these, as rows of node and other, so a hot bucket does not
    meet in one task. All items of such a bucket are also named as its members, by
    ``bucket``, its key, and themselves as ``other``.
    """
    order = _by_bucket(keys, nodes)
    keys, nodes, sketches = keys[order], nodes[order], sketches[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(begin, len(keys)))
    place = np.arange(len(keys)) - np.repeat(begin, sizes)
    early = place < ALL_PAIRS
    late = np.flatnonzero(~early)
    part = keys[early] >> (64 - PART_BITS)
    bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    yield _packed(part[bounds], np.append(bounds, len(part)), key=keys[early], node=nodes[early], sketch=sketches[early])
    if len(late):
        u, v = _likest(np.repeat(begin, sizes)[late], late, sketches)
        large = np.flatnonzero(np.repeat(sizes, sizes) > ALL_PAIRS)
        yield _packed(keys[late[:1]] >> (64 - PART_BITS), np.array([0, len(u)]), node=nodes[u], other=nodes[v])
        yield _packed(keys[late[:1]] >> (64 - PART_BITS), np.array([0, len(large)]), node=nodes[large], sketch=sketches[large], other=nodes[large], bucket=keys[large])


def _sorted_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of whole parts by key, without buckets of one item, and other rows as they are, of packed rows sorted by part."""

    def values(rows: list, name: str) -> np.ndarray:
        return np.frombuffer(b"".join(row[name] for row in rows), np.int64)

    def entries(rows: list) -> Iterator[pa.RecordBatch]:
        keys, nodes, sketches = (values(rows, x) for x in _NAMES[:3])
        order = _by_bucket(keys, nodes)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        keys, order = keys[shared], order[shared]
        if len(keys):
            # Equal items of a bucket are to be next to each other.
            again = np.lexsort((mix(keys.view(np.uint64) ^ nodes[order].view(np.uint64)), keys))
            keys, order = keys[again], order[again]
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes[order]), pa.array(sketches[order]), none, none], _NAMES)

    gathered, size, last = [], 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] is None:
                node, other = values([row], "node"), values([row], "other")
                rest = [pa.nulls(len(node), pa.int64()) if row[x] is None else pa.array(values([row], x)) for x in ("sketch", "bucket")]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node), rest[0], pa.array(other), rest[1]], _NAMES)
                continue
            if size >= PART_ENTRIES and row["part"] != last:
                yield from entries(gathered)
                gathered, size = [], 0
            gathered.append(row)
            size += len(row["key"]) // 8
            last = row["part"]
    if gathered:
        yield from entries(gathered)


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of packed rows sorted by part.

    A row with a ``bucket`` is no pair: it names a member of a bucket of more than ALL_PAIRS.
    """
    for batch in _sorted_parts(batches):
        if batch.column(3).null_count == 0:
            u, v = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), batch.column(4), batch.column(2)], _PAIR_NAMES)
            continue
        keys, nodes, sketches = (batch.column(i).to_numpy() for i in range(3))
        same = np.concatenate(([False], (keys[1:] == keys[:-1]) & (nodes[1:] == nodes[:-1])))
        keys, nodes, sketches = keys[~same], nodes[~same], sketches[~same]
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(begin, len(keys)))
        place = np.arange(len(keys)) - np.repeat(begin, sizes)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, min(int(sizes.max()), ALL_PAIRS)):
            later = np.flatnonzero((keys[lag:] == keys[:-lag]) & (place[lag:] < ALL_PAIRS)) + lag
            later = later[_agree(sketches[later - lag], sketches[later]) >= AGREE]
            u.append(nodes[later - lag])
            v.append(nodes[later])
        late = np.flatnonzero(place >= ALL_PAIRS)
        if len(late):
            a, b = _likest(np.repeat(begin, sizes)[late], late, sketches)
            u.append(nodes[b])
            v.append(nodes[a])
            large = np.repeat(sizes > ALL_PAIRS, sizes)
            member = pa.array(nodes[large])
            yield pa.RecordBatch.from_arrays([member, member, pa.array(keys[large]), pa.array(sketches[large])], _PAIR_NAMES)
        u, v = np.concatenate(u), np.concatenate(v)
        none = pa.nulls(len(u), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), none, none], _PAIR_NAMES)


def candidates(bands: DataFrame) -> DataFrame:
    """Distinct (u, v, bucket, sketch) from what ``local_bands`` gives: pairs, u < v, without a bucket, and members u of large ones."""
    entries = bands.repartition("part").sortWithinPartitions("part")
    return entries.mapInArrow(_bucket_pairs, "u long, v long, bucket long, sketch long").where("u <> v or bucket is not null").distinct()


def representatives(members: DataFrame) -> DataFrame:
    """(key, p, p_root, p_sketch): of each bucket the item that is most like its majority; members have key, node, sketch and root."""
    bit = lambda i: F.shiftright("sketch", i).bitwiseAND(1)
    sums = members.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(bit(i)).alias(f"b{i}") for i in range(64)])
    majority = sum((F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(-(1 << 63) if i == 63 else 1 << i)).otherwise(F.lit(0)) for i in range(64)), F.lit(0))
    sums = settle(sums.select("key", majority.cast("long").alias("majority")))
    alike = F.lit(64) - F.bit_count(F.col("sketch").bitwiseXOR(F.col("majority")))
    best = members.join(sums, "key").groupBy("key").agg(F.max(F.struct(alike.alias("alike"), "node", "root", "sketch")).alias("best"))
    return best.select("key", F.col("best.node").alias("p"), F.col("best.root").alias("p_root"), F.col("best.sketch").alias("p_sketch"))


def block_links(table: pa.Table, profile: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: float) -> pa.Table:
    """Links (u, v) between the rows of a block that ask and all rows that do not, one per asking row and other class."""
    table = table.combine_chunks()
    asking, others = table.filter(table["asks"]), table.filter(pc.invert(table["asks"]))
    terms, weights, sizes = profile(asking["text"].combine_chunks())
    begin = np.append(0, np.cumsum(sizes))
    known, other_weights, other_sizes = profile(others["text"].combine_chunks())
    vocabulary, at = np.unique(known, return_inverse=True)
    first = np.cumsum(other_sizes) - other_sizes
    totals = np.add.reduceat(other_weights, first)
    own_roots, roots = asking["root"].to_numpy(), others["root"].to_numpy()
    shared, u, v = np.zeros(len(vocabulary)), [], []
    for i, root in enumerate(own_roots):
        own, weight = terms[begin[i] : begin[i + 1]], weights[begin[i] : begin[i + 1]]
        here = among(vocabulary, own)
        place = np.searchsorted(vocabulary, own[here])
        shared[place] = weight[here]
        both = np.add.reduceat(np.minimum(shared[at], other_weights), first)
        shared[place] = 0
        hits = np.flatnonzero((both >= threshold * (totals + weight.sum() - both)) & (roots != root))
        hits = hits[np.unique(roots[hits], return_index=True)[1]]
        u.append(np.full(len(hits), i))
        v.append(hits)
    u, v = asking["node"].to_numpy()[np.concatenate(u)], others["node"].to_numpy()[np.concatenate(v)]
    return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def links_between(members: DataFrame, own: DataFrame, profile: Callable, threshold: float) -> DataFrame:
    """Links (u, v) that tie the classes of each bucket: of all linked pairs of two classes, at least one per item outside the largest and class.

    members has key, node and root, own the texts by node. Blocks are dealt by (bucket, block, block).
    """
    sized = settle(members.join(own.select("node", F.octet_length("text").cast("long").alias("bytes")), "node"))
    shares = sized.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda x: F.floor(x / BLOCK_BYTES).cast("int") + 1
    largest = F.max(F.struct("n", "root", "bytes")).alias("largest")
    plan = settle(shares.groupBy("key").agg(largest, F.sum("bytes").alias("bytes"), F.count("*").alias("roots")).where("roots > 1"))
    plan = plan.select("key", F.col("largest.root").alias("most"), blocks(F.col("bytes") - F.col("largest.bytes")).alias("asking"), blocks(F.col("bytes")).alias("all"))
    placed = sized.join(plan, "key").withColumns({"a": F.pmod(F.xxhash64("node", F.lit(1)), "asking").cast("int"), "b": F.pmod(F.xxhash64("node", F.lit(2)), "all").cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = placed.where("root <> most").select("key", "a", every("all").alias("b"), F.lit(True).alias("asks"), "node", "root")
    rows = rows.unionByName(placed.select("key", every("asking").alias("a"), "b", F.lit(False).alias("asks"), "node", "root"))
    none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})

    def find(table: pa.Table) -> pa.Table:
        asks = pc.sum(table["asks"]).as_py()
        return block_links(table, profile, threshold) if 0 < asks < len(table) else none

    return rows.join(own, "node").groupBy("key", "a", "b").applyInArrow(find, "u long, v long")


def link_classes(bands: DataFrame, fetch: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame, DataFrame], DataFrame], profile: Callable, threshold: float) -> DataFrame:
    """(node, root) of all items that have a verified link.

    ``fetch`` gives the texts of the items of pairs (u, v); ``judge`` keeps the pairs that are a link by these texts.
    ``profile`` gives the terms of some texts, each text's sorted, their weights, and how many terms each text has.
    """
    found = settle(candidates(bands))
    # A member row (u, u) asks for its text as well.
    own = fetch(found.select("u", "v"))
    links = settle(judge(found.where("bucket is null").select("u", "v"), own))
    roots = components(links)
    members = found.where("bucket is not null").select(F.col("bucket").alias("key"), F.col("u").alias("node"), "sketch")
    left = settle(_split(members, roots))
    if left.isEmpty():
        return roots
    chosen = settle(representatives(left))
    alike = F.bit_count(F.col("sketch").bitwiseXOR(F.col("p_sketch"))) <= 64 - AGREE
    both = left.join(chosen, "key").where((F.col("root") != F.col("p_root")) & alike)
    pairs = both.select(F.least("node", "p").alias("u"), F.greatest("node", "p").alias("v")).distinct()
    links = links.unionByName(settle(judge(pairs, own)))
    roots = components(links)
    left = settle(_split(left.drop("root"), roots))
    if left.isEmpty():
        return roots
    return components(links.unionByName(settle(links_between(left, own, profile, threshold).distinct())))


def _split(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (key, node, sketch) of buckets that are in several classes, with their roots."""
    rooted = settle(members.join(roots, "node", "left").select("key", "node", "sketch", F.coalesce("root", "node").alias("root")))
    split = settle(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"))
    return rooted.join(split, "key", "left_semi")


def wanted_nodes(pairs: DataFrame) -> DataFrame:
    return settle(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """One (node, text) per wanted node; the nodes are broadcast up to a bound and joined by a shuffle beyond it."""
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    return texts.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def classes(items: DataFrame, roots: DataFrame, *order: str) -> DataFrame:
    """Items (node and the columns of ``order``) with ``root``, the class's first in the order and its size.

    Firsts are stored, so the join with a hot class's items is one that Spark can split.
    """
    own = items.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = settle(own.groupBy("root").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("class_size")).where("class_size > 1"))
    found = own.join(first, "root", "left")
    return found.withColumns({"first": F.coalesce("first", F.struct(*order)), "class_size": F.coalesce("class_size", F.lit(1))})
