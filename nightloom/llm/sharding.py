"""Random sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records into buckets of bounded bytes with a seeded hash.
Pass two shuffles each bucket by itself with ``shuffle`` (an inside-out
Fisher-Yates) and lays the buckets end to end. That one long random order is cut
into shards whose row counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, text_of

#: Bytes of text in a bucket; a task holds one bucket at a time.
BUCKET_BYTES = 16 << 20
#: Bucket offsets are broadcast up to this many buckets (24 bytes each), joined by shuffle beyond.
BROADCAST_BUCKETS = 1_000_000


def external_shuffle(
    docs: DataFrame,
    n_shards: int = 16,
    seed: int = 42,
    bucket_bytes: int = BUCKET_BYTES,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Every record once, as ``record`` (a struct of all its columns), with ``shard`` and ``slot``.

    Law ``rows``: shard counts differ by one at most; slots run from 0 without gaps.
    The bucket is a hash of seed, key and text, so a hot source or a group of equal
    texts under many keys spreads evenly. Null keys and null texts hash as empty;
    repeated rows are all kept (they share a bucket). An empty table gives no rows.
    Columns of any name may ride along: they stay inside ``record``.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(record.alias("record"))
    size = F.octet_length(text_of(F.col(f"record.`{text}`"))) + 1
    total = rows.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    mixed = F.xxhash64(F.lit(seed), F.col(f"record.`{key}`"), F.col(f"record.`{text}`"))
    # The order within a bucket before it is shuffled: fixed by content, so a task that is
    # run again after a loss gives the same permutation.
    scattered = rows.select(
        "record", F.pmod(mixed, F.lit(n_buckets)).cast("int").alias("bucket"), F.xxhash64(mixed).alias("first_order")
    )
    starts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    in_order = Window.orderBy("bucket")
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = starts.select(
        "bucket",
        (F.sum("n").over(in_order) - F.col("n")).alias("start"),
        F.sum("n").over(everything).alias("total"),
    )
    if n_buckets <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    buckets = (
        scattered.repartitionById(n_buckets, "bucket")
        .sortWithinPartitions("bucket", "first_order")
        .groupBy("bucket")
        .agg(F.collect_list("record").alias("records"))
    )
    placed = buckets.join(starts, "bucket").select(
        "start", "total", F.posexplode(F.shuffle("records", F.lit(seed))).alias("at", "record")
    )
    place = F.col("start") + F.col("at")
    # Shard s holds places from ceil(s * total / n) up to the next shard's first.
    shard = F.expr(f"(start + at) * {n_shards} div total")
    return placed.select("record", shard.alias("shard"), place.alias("place"), "total").select(
        "record",
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, seed: int = 42, **options) -> None:
    """Write the shuffled records as Parquet under ``path/shard=N``, in slot order within a shard.

    Where the records have a column ``shard`` or ``slot`` of their own, the number's name is
    the next free one, ``shard_1`` and so on, in the path too.
    """
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    shuffled = external_shuffle(docs, n_shards, seed, **options)
    # Contiguous runs of slots make the files, so that a shard is written by several tasks.
    run = F.expr("slot div 100000").alias("run")
    (
        shuffled.repartition("shard", run)
        .sortWithinPartitions("shard", "slot")
        .select(F.col("shard").alias(shard), F.col("slot").alias(slot), "record.*")
        .write.partitionBy(shard)
        .parquet(path)
    )


def shard_digest(docs: DataFrame, n_shards: int = 16, seed: int = 42) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = text_of("record.text")
    return external_shuffle(docs, n_shards, seed).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
