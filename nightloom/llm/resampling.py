"""Importance resampling towards a target corpus, by external sort-count of hashed features.

Features are runs of one and two words, hashed into buckets. A first pass writes every
document's bucket numbers as packed 16-bit streams with the documents' offsets, which are
stored in the shared folder. For the counts each stream is sorted and run-length encoded,
and Spark sums the runs by bucket. From the two corpora's counts a bucket has a gain; a later
pass over the stored streams gathers the gains and adds them up per document at its offsets.
Weights with seeded Gumbel noise are drawn from the greatest, without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, ship
from .textkernels import ALNUM, slices, words

BUCKETS = 10_000
SHARE = 25
MIN_WORDS = 20
SEED = 7
#: Checksums of words of up to so many bytes are made for many words at once.
SHORT_BYTES = 48
#: Gains are integers: natural logarithms times this, cut down.
UNIT = 1000.0

# The remainder of every byte by the polynomial of crc32.
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & 1, (_STEP >> 1) ^ np.uint32(0xEDB88320), _STEP >> 1)
_ONES, _LOW = np.uint32(0xFFFFFFFF), np.uint32(255)


def _behind_zeros() -> np.ndarray:
    """[length, place, byte]: what a checksum's byte at a place becomes behind so many bytes of zero."""
    out = np.zeros((SHORT_BYTES + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SHORT_BYTES):
        out[n + 1] = _STEP[out[n] & _LOW] ^ (out[n] >> np.uint32(8))
    return out


_SHIFTED = _behind_zeros()


def word_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of every span of the bytes: the spans take a step together, the ended ones leave."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    first, falling = starts[order], -sizes[order]
    state = np.full(len(starts), _ONES)
    for k in range(min(int(sizes.max(initial=0)), SHORT_BYTES)):
        n = int(np.searchsorted(falling, -k))
        own = state[:n]
        state[:n] = _STEP[(own ^ data[first[:n] + k]) & _LOW] ^ (own >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = state ^ _ONES
    for i in np.flatnonzero(sizes > SHORT_BYTES):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def joined_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray) -> np.ndarray:
    """crc32 of every span, a space and the span after it, from the spans' own checksums."""
    state = own[:-1] ^ _ONES
    left = _STEP[(state ^ np.uint32(0x20)) & _LOW] ^ (state >> np.uint32(8)) ^ _ONES
    sizes = (ends - starts)[1:]
    n = np.minimum(sizes, SHORT_BYTES)
    out = own[1:].copy()
    for place in range(4):
        out ^= _SHIFTED[n, place, (left >> np.uint32(8 * place)) & _LOW]
    for i in np.flatnonzero(sizes > SHORT_BYTES):
        out[i] = zlib.crc32(data[starts[i + 1] : ends[i + 1]], int(left[i]))
    return out


def bucket_streams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets, offsets): the rows' features in packed 16-bit streams."""
    for low, high, data, offsets in slices(column):
        starts, ends, bounds, mapped = words(data, offsets, ALNUM)
        counts = np.diff(bounds)
        made = np.maximum(2 * counts - 1, 0)
        stops = np.concatenate(([0], np.cumsum(made)))
        stream = np.zeros(stops[-1], np.uint16)
        if len(starts):
            within = np.arange(len(starts)) - np.repeat(bounds[:-1], counts)
            at = np.repeat(stops[:-1], counts) + 2 * within
            own = word_checksums(mapped, starts, ends)
            stream[at] = own % BUCKETS
            pairs = np.flatnonzero(within[1:] > 0)
            stream[at[pairs] + 1] = joined_checksums(mapped, starts, ends, own)[pairs] % BUCKETS
        yield low, high, stream, stops


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for low, high, stream, stops in bucket_streams(batch.column(1)):
            columns = [pa.array([ids[low:high].to_pylist()], pa.list_(pa.int64())), pa.array([stops.tolist()], pa.list_(pa.int64())), pa.array([stream.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_ids", "offsets", "stream"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for stream in batch.column(0):
            ordered = np.sort(np.frombuffer(stream.as_buffer(), np.uint16))
            runs = np.flatnonzero(np.diff(ordered, prepend=-1))
            total[ordered[runs]] += np.diff(runs, append=len(ordered))
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])


def _gather(gains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, offsets, stream in zip(*batch.columns):
                stops = np.asarray(offsets.values)
                features, full = np.diff(stops), np.flatnonzero(np.diff(stops))
                weight = np.zeros(len(features), np.int64)
                if len(full):
                    sums = np.add.reduceat(gains.value[np.frombuffer(stream.as_buffer(), np.uint16)], stops[full])
                    weight[full] = sums // features[full]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(features), pa.array(weight)], ["doc_id", "n_features", "weight"])

    return run


def write_streams(docs: DataFrame) -> DataFrame:
    """(doc_ids, offsets, stream), stored: a row for about a megabyte of text, or one longer text."""
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return settle(own.mapInArrow(_write, "doc_ids array<long>, offsets array<long>, stream binary"))


def bucket_counts(streams: DataFrame) -> DataFrame:
    """(bucket, n): every task sorts and run-length encodes its streams and adds up the runs; at most a row a bucket."""
    return streams.select("stream").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """Per bucket the floored logarithm of how much likelier the target has it; one is added to all counts."""
    spark = source.sparkSession
    counts = spark.range(BUCKETS).select(F.col("id").alias("bucket"))
    counts = counts.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    # A row per bucket, whatever the corpus.
    rows = np.array(counts.select("bucket", "s", "t").collect(), np.int64)
    totals = rows.sum(axis=0)
    s, t = F.col("s"), F.col("t")
    ratio = (t + 1).cast("double") * F.lit(float(totals[1] + BUCKETS)) / ((s + 1).cast("double") * F.lit(float(totals[2] + BUCKETS)))
    own = spark.createDataFrame(rows.tolist(), "bucket long, s long, t long").select("bucket", F.floor(F.log(ratio) * UNIT).cast("long").alias("gain"))
    gains = np.zeros(BUCKETS, np.int64)
    found = np.array(own.collect(), np.int64)
    gains[found[:, 0]] = found[:, 1]
    return gains


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Floored Gumbel noise that only the id and the seed decide; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -UNIT).cast("long")


def drawn(scored: DataFrame, share: int = SHARE) -> DataFrame:
    """``rank`` from 1 for the first floor(share * N / 100) of the N rows with ``fit``, by score and then doc_id; else null.

    Rows are sorted by ranges of all sort keys and a row number, so that equal rows are split
    too; a row's rank is its place in its range and the sizes of the ranges before it.
    """
    row = F.monotonically_increasing_id()  # ``scored`` is read from stored streams, so it stays when a task runs again
    keys = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("row").asc()]
    ordered = settle(scored.withColumn("row", row).repartitionByRange(*keys).sortWithinPartitions(*keys))
    placed = ordered.withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    # A row per partition of the sort.
    sizes = sorted((x["part"], x["n"], x["fit"]) for x in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fit").alias("fit")).collect())
    before, starts = 0, []
    for number, n, _ in sizes:
        starts.append((number, before))
        before += n
    most = share * sum(x[2] for x in sizes) // 100
    starts = ordered.sparkSession.createDataFrame(starts, "part int, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    own = placed.withColumn("part", part.cast("int")).join(F.broadcast(starts), "part").withColumn("rank", rank)
    return own.withColumn("rank", F.when(F.col("fit") & (F.col("rank") <= most), F.col("rank"))).drop("part", "before", "at", "row")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank.

    ``weight`` is the floored mean of the gains of all features of the whole text, 0 without
    any (a null or empty text). Of the documents with at least ``min_words`` words, ``share``
    percent have a rank. Repeated rows are rows of their own; ties go to the smaller doc_id,
    a null one last. An empty table gives no rows, an empty target equal counts. Very long
    texts are streams of their own; other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    streams = write_streams(docs)
    gains = spark.sparkContext.broadcast(bucket_gains(bucket_counts(streams), bucket_counts(write_streams(target.select(F.lit(None).alias("doc_id"), "text")))))
    scored = streams.mapInArrow(_gather(gains), "doc_id long, n_features long, weight long")
    scored = scored.withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), "fit": F.col("n_features") >= max(2 * min_words - 1, 0)})
    return drawn(scored, share).select("doc_id", "n_features", "weight", "score", "rank")
