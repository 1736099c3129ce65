"""Benchmark decontamination: a prefix-filtered containment join on item-sized word windows.

A benchmark item gives windows of 13 consecutive words (a shorter item: one window of
all its words). A document contains a window only if it contains every word of it, so one
word is a sufficient prefix: the rarest of the window in the corpus. Documents' words are
joined with these prefix words; a match fixes where the window would have to begin, which
the positional bound (not before the text) and the length bound (not past its end) filter,
and the words there are then compared one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship
from .textkernels import ALNUM, slices, span_hashes, words

WINDOW = 13
#: A document is contaminated if at least one in this many of its words is hit.
HIT_SHARE = 20
#: Windows that are broadcast at once (about 300 bytes each); more are joined in blocks of this many.
BLOCK_WINDOWS = 200_000
#: The same for the benchmark's distinct words when they are counted in the corpus (8 bytes each).
BLOCK_TOKENS = 2_000_000
#: Places of windows that are compared at once; a word that many windows have as their prefix takes several steps.
STEP_PLACES = 1_000_000

_WINDOWS = "item_id string, window binary, tokens array<long>"
_HITS = "row long, doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each benchmark text: their words joined by one space, and the words' hashes."""
    for batch in batches:
        ids, out = batch.column(0), ([], [], [])
        for low, high, data, offsets in slices(batch.column(1)):
            starts, ends, bounds, mapped = words(data, offsets, ALNUM)
            hashes, raw = span_hashes(mapped, starts, ends).view(np.int64), mapped.tobytes()
            for row in range(low, high):
                first, last = bounds[row - low], bounds[row - low + 1]
                for at in range(first, max(last - WINDOW + 1, first + (last > first))):
                    end = min(at + WINDOW, last)
                    out[0].append(ids[row].as_py())
                    out[1].append(b" ".join(raw[starts[i] : ends[i]] for i in range(at, end)))
                    out[2].append(hashes[at:end].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.binary(), pa.list_(pa.int64())))], ["item_id", "window", "tokens"])


def _token_counter(tokens):
    """Counts of the given words' hashes in the texts of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.value
        if not len(known):
            return
        totals = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                starts, ends, _, mapped = words(data, offsets, ALNUM)
                hashes = span_hashes(mapped, starts, ends).view(np.int64)
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                totals += np.bincount(np.where(known[at] == hashes, at, len(known)), minlength=len(totals))
        seen = np.flatnonzero(totals[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(known[seen]), pa.array(totals[seen])], ["token", "n"])

    return count


def _merged(spans: set[tuple[int, int]] | tuple) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1]["last"]:
            out[-1]["last"] = max(out[-1]["last"], last)
        else:
            out.append({"first": first, "last": last})
    return out


def _finder(index):
    """Per document: its words, and the spans and items of the windows that occur in it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, at_offset, sizes, sequences, texts, items = index.value
        for batch in batches:
            n_words, spans, found = [], [], []
            for low, high, data, offsets in slices(batch.column(2)):
                starts, ends, bounds, mapped = words(data, offsets, ALNUM)
                hashes = span_hashes(mapped, starts, ends).view(np.int64)
                n_words += np.diff(bounds).tolist()
                own_spans: dict[int, set] = {}
                own_items: dict[int, set] = {}
                left = np.searchsorted(prefix, hashes, "left")
                hit = np.flatnonzero(prefix[np.minimum(left, len(prefix) - 1)] == hashes) if len(prefix) else np.zeros(0, np.int64)
                left = left[hit]
                n = np.searchsorted(prefix, hashes[hit], "right") - left
                upto = np.concatenate(([0], np.cumsum(n)))
                raw, first = mapped.tobytes() if len(hit) else b"", 0
                while first < len(hit):
                    last = max(first + 1, int(np.searchsorted(upto, upto[first] + STEP_PLACES, "right")) - 1)
                    own = n[first:last]
                    window = np.repeat(left[first:last] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                    at = np.repeat(hit[first:last], own)
                    begin = at - at_offset[window]
                    row = np.searchsorted(bounds, at, "right") - 1
                    keep = (begin >= bounds[row]) & (begin + sizes[window] <= bounds[row + 1])
                    begin, window, row = begin[keep], window[keep], row[keep]
                    for j in range(WINDOW):
                        inside = j < sizes[window]
                        same = ~inside | (hashes[np.minimum(begin + j, len(hashes) - 1)] == sequences[window, j])
                        begin, window, row = begin[same], window[same], row[same]
                    for b, w, r in zip(begin.tolist(), window.tolist(), row.tolist()):
                        end = b + int(sizes[w])
                        if b" ".join(raw[starts[i] : ends[i]] for i in range(b, end)) == texts[w]:
                            own_spans.setdefault(r, set()).add((b - int(bounds[r]), end - int(bounds[r])))
                            own_items.setdefault(r, set()).update(items[w])
                    first = last
                for r in range(high - low):
                    spans.append(_merged(own_spans.get(r, ())))
                    found.append(sorted(own_items.get(r, ())))
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))],
                ["row", "doc_id", "n_words", "spans", "items"],
            )

    return find


def prefix_index(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per distinct window: window, tokens, items, and its rarest word's hash and offset."""
    spark = docs.sparkSession
    windows = (
        benchmark.where(F.col("item_id").isNotNull())
        .select(F.col("item_id").cast("string").alias("item_id"), "text")
        .mapInArrow(_item_windows, _WINDOWS)
        .groupBy("window", "tokens")
        .agg(F.collect_set("item_id").alias("items"))
    )
    windows = settle(windows)
    places = windows.select("window", F.posexplode("tokens").alias("offset", "token"))
    tokens = places.select("token").distinct()
    counts = None
    # The benchmark's words are sent to the tasks in blocks of bounded size.
    n_blocks = max(1, math.ceil(tokens.count() / BLOCK_TOKENS))
    for block in range(n_blocks):
        own = tokens.where(F.pmod(F.col("token"), F.lit(n_blocks)) == block)
        known = spark.sparkContext.broadcast(np.sort(own.toPandas()["token"].to_numpy(np.int64)))
        part = docs.select("text").mapInArrow(_token_counter(known), "token long, n long")
        counts = part if counts is None else counts.unionByName(part)
    counts = counts.groupBy("token").agg(F.sum("n").alias("n"))
    by_rarity = Window.partitionBy("window").orderBy("n", "token", "offset")
    rarest = (
        places.join(counts, "token", "left")
        .select("window", "token", "offset", F.coalesce("n", F.lit(0)).alias("n"))
        .withColumn("rank", F.row_number().over(by_rarity))
        .where("rank = 1")
    )
    # A window with a word that no document has occurs in none.
    return windows.join(rarest.where("n > 0").select("window", "token", "offset"), "window")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, spans (word positions, end exclusive) and items that occur in it.

    Words are maximal runs of ASCII letters and digits and of any character above ASCII,
    with A-Z in lower case. A null or empty text has no words and no spans. Items with a
    null id or without words have no windows; equal windows of several items count for
    each. Repeated documents give repeated rows; an empty benchmark gives documents without
    hits, an empty table no rows; other columns are not looked at. Spans that overlap or
    touch are one, but for spans from several blocks of windows.
    """
    spark = docs.sparkSession
    ship(spark)
    index = settle(prefix_index(docs, benchmark))
    n_blocks = max(1, math.ceil(index.count() / BLOCK_WINDOWS))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n_blocks > 1:  # rows of several passes meet again by their number
        rows = settle(rows)
    hits = None
    for block in range(n_blocks):
        own = index.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == block).orderBy("token", "window").collect()
        sequences = np.zeros((len(own), WINDOW), np.int64)
        for i, x in enumerate(own):
            sequences[i, : len(x.tokens)] = x.tokens
        packed = (
            np.array([x.token for x in own], np.int64),
            np.array([x.offset for x in own], np.int64),
            np.array([len(x.tokens) for x in own], np.int64),
            sequences,
            [bytes(x.window) for x in own],
            [list(x["items"]) for x in own],
        )
        part = rows.mapInArrow(_finder(spark.sparkContext.broadcast(packed)), _HITS)
        hits = part if hits is None else hits.unionByName(part)
    if n_blocks > 1:
        hits = hits.groupBy("row", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
        )
    return hits.select("doc_id", "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda x, s: F.struct(
        F.greatest(x["end"], s["last"]).alias("end"), (x["n"] + F.greatest(s["last"] - F.greatest(x["end"], s["first"]), F.lit(0))).alias("n")
    )
    n_hit = F.aggregate(F.array_sort("spans"), start, add)["n"]
    rows = contamination(docs, benchmark).select("doc_id", "n_words", n_hit.alias("n_hit"), "items")
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * HIT_SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, whole; rows that share a doc_id are judged each by its own text.

    Null and empty texts have no words and stay, a very long text is judged whole. Equal rows
    go or stay together, all columns stay whatever their names, an empty table gives no rows.
    """
    key = F.xxhash64("doc_id", "text")
    flagged = contamination_digest(docs.select(key.alias("doc_id"), "text"), benchmark).where("contaminated")
    flagged = flagged.select(F.col("doc_id").alias("hit")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), key.alias("own"))
    return own.join(flagged, F.col("own") == F.col("hit"), "left_anti").select("record.*")
