"""Fuzzy line deduplication across documents: one line stays of each class of near-equal lines.

A line's signature is the MinHash of its runs of five characters; bands of five values give
candidates, the exact Jaccard similarity of the sets of runs decides, and a distributed
union-find joins the links. The first line of a class, by document and place, stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, settle, ship, text_of
from .neardup import BANDS_SCHEMA, BROADCAST_NODES, SIGNED_ENTRIES, link_classes, local_bands, sketch_of, texts_of, wanted_nodes
from .textkernels import SLICE_BYTES, Spans, among, mix, slices

#: Characters (code points) in a shingle; a shorter line has one, itself.
SHINGLE = 5
THRESHOLD = 0.8
#: A link of exactly 0.8 shares a band with probability 0.996, one of 0.9 with 0.999998.
BANDS = 14
BAND_VALUES = 5
#: Shingles whose hashes are multiplied together, so that they stay in the processor's cache.
_BLOCK = 1 << 17
#: Bytes of lines that are cut into shingles together, likewise.
_PART = 1 << 17
# Odd, and without a pattern: multiples of one number would make the same shingle the least in many rows.
_MULTIPLIERS = [np.uint32(int(x) >> 32 | 1) for x in mix(np.arange(1, BANDS * BAND_VALUES + 1, dtype=np.uint64))]


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of each row, and where each row's lines begin."""
    feeds = np.flatnonzero(data == 0x0A)
    rows = np.searchsorted(offsets, feeds, "right") - 1
    counts = 1 + np.bincount(rows, minlength=len(offsets) - 1)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    starts, ends = np.zeros(bounds[-1], np.int64), np.zeros(bounds[-1], np.int64)
    starts[bounds[:-1]], ends[bounds[1:] - 1] = offsets[:-1], offsets[1:]
    at = np.arange(len(feeds)) + rows  # feed i of the slice ends line i plus one for each row before
    ends[at], starts[at + 1] = feeds, feeds + 1
    return starts, ends, bounds


def line_shingles(data: np.ndarray, spans: Spans, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of non-empty lines in the order of their places, and where each line's begin."""
    lead = data.view(np.int8) >= -64  # not 0x80 to 0xBF
    if lead.all():  # a character is a byte
        low, high, sums, inverse = starts, ends, spans.sums, spans.inverse[: len(data)]
    else:
        chars = np.append(np.flatnonzero(lead), len(data))
        low, high = np.searchsorted(chars, starts), np.searchsorted(chars, ends)
        sums, inverse = spans.sums[chars], spans.inverse[chars[:-1]]
    hashes = np.zeros(len(sums) - 1, np.uint64)
    if len(hashes) >= SHINGLE:
        hashes[: len(hashes) - SHINGLE + 1] = (sums[SHINGLE:] - sums[:-SHINGLE]) * inverse[: len(hashes) - SHINGLE + 1]
    few = np.flatnonzero(high - low < SHINGLE)
    hashes[low[few]] = spans.short(starts[few], ends[few])
    made = np.maximum(high - low - SHINGLE + 1, 1)
    inside = np.zeros(len(sums), np.int8)
    np.add.at(inside, low, 1)
    np.subtract.at(inside, low + made, 1)
    hashes = hashes[np.cumsum(inside[:-1], dtype=np.int8).view(np.bool_)]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ hashes >> np.uint64(32), np.cumsum(made) - made


def shingled(data: np.ndarray, spans: Spans, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first line, end line, and what ``line_shingles`` gives) of lines in their order, some ``_PART`` bytes at a time."""
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _PART, "right")))
        a, b = int(starts[low]), int(ends[high - 1])
        yield low, high, *line_shingles(data[a:b], spans.part(a, b), starts[low:high] - a, ends[low:high] - a)
        low = high


def signatures(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of values per multiplier, a column per line: the least of the multiplied hashes."""
    hashes = (hashes >> np.uint64(32)).astype(np.uint32)
    ends = np.append(begin[1:], len(hashes))
    out, low = np.zeros((BANDS * BAND_VALUES, len(begin)), np.uint32), 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(ends, begin[low] + _BLOCK, "right")))
        own, at = hashes[begin[low] : ends[high - 1]], begin[low:high] - begin[low]
        buffer = np.empty_like(own)
        for k, by in enumerate(_MULTIPLIERS):
            np.minimum.reduceat(np.multiply(own, by, out=buffer), at, out=out[k, low:high])
        low = high
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key per line and band."""
    keys = np.zeros((values.shape[1], BANDS), np.uint64)
    for k, row in enumerate(values):
        band = k // BAND_VALUES
        keys[:, band] = mix(keys[:, band] ^ (row.astype(np.uint64) + np.uint64(k << 32)))
    return mix(keys + np.arange(BANDS, dtype=np.uint64))


def _blank(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of all lines have no byte above a space; what follows a line up to the next one with bytes are line feeds."""
    out, some = np.ones(len(starts), np.bool_), np.flatnonzero(ends > starts)
    if len(some):
        out[some] = np.maximum.reduceat(data, starts[some]) <= 0x20
    return out


def _line_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, order, lines, nodes) of each row: the places of its lines that are not blank, and hashes of these lines."""
    for batch in batches:
        for low, high, data, offsets in slices(batch.column(2), SLICE_BYTES >> 2):
            starts, ends, bounds = line_spans(data, offsets)
            line = np.arange(len(starts)) - np.repeat(bounds[:-1], np.diff(bounds))
            keep = ~_blank(data, starts, ends)
            nodes = Spans(data).of(starts[keep], ends[keep])
            at = np.concatenate(([0], np.cumsum(keep)))[bounds]
            packed = [
                pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (line[keep].astype(np.int32), nodes)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), *packed], ["row", "order", "lines", "nodes"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, order, line, node) of what ``_line_nodes`` gives, a row per line."""
    for batch in batches:
        n = pc.binary_length(batch.column(3)).to_numpy() // 8
        line, node = (np.frombuffer(b"".join(batch.column(i).to_pylist()), kind) for i, kind in ((2, np.int32), (3, np.int64)))
        columns = [np.repeat(batch.column(0).to_numpy(), n), np.repeat(batch.column(1).to_numpy(), n), line, node]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "order", "line", "node"])


def _distinct_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray]:
    """The slice's spans; node, start and end of each different line that is not blank, in their order."""
    starts, ends, _ = line_spans(data, offsets)
    keep = ~_blank(data, starts, ends)
    spans = Spans(data)
    nodes = spans.of(starts[keep], ends[keep])
    first = np.sort(np.unique(nodes, return_index=True)[1])
    return spans, nodes[first], starts[keep][first], ends[keep][first]


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen, keys_of, nodes_of, sketches_of = np.zeros(0, np.uint64), [], [], []
        for _, _, data, offsets in slices(batch.column(0)):
            spans, nodes, starts, ends = _distinct_lines(data, offsets)
            new = ~among(seen, nodes)
            nodes, starts, ends = nodes[new], starts[new], ends[new]
            seen = np.sort(np.concatenate((seen, nodes)))
            if len(nodes):
                values = np.concatenate([signatures(*x) for _, _, *x in shingled(data, spans, starts, ends)], axis=1)
                keys_of.append(band_keys(values).ravel().view(np.int64))
                nodes_of.append(np.repeat(nodes.view(np.int64), BANDS))
                sketches_of.append(np.repeat(sketch_of(values), BANDS))
            if sum(map(len, keys_of)) >= SIGNED_ENTRIES:
                yield from local_bands(*(np.concatenate(x) for x in (keys_of, nodes_of, sketches_of)))
                keys_of, nodes_of, sketches_of = [], [], []
        if keys_of:
            yield from local_bands(*(np.concatenate(x) for x in (keys_of, nodes_of, sketches_of)))


def _texts(picked):
    """(node, text) of the different lines of each slice, of all or of the picked ones."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                _, nodes, starts, ends = _distinct_lines(data, offsets)
                nodes = nodes.view(np.int64)
                if picked is not None:
                    own = np.flatnonzero(among(picked.value, nodes))
                    nodes, starts, ends = nodes[own], starts[own], ends[own]
                if len(nodes):
                    raw = data.tobytes()
                    lines = pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), lines], ["node", "text"])

    return texts


def _numbered(column: pa.Array) -> np.ndarray:
    """The shingles of each line: its number in the high bits, then those of the hash; the last bit is 0."""
    keys, bits = [], np.uint64(64 - max(len(column) - 1, 1).bit_length())
    for low, high, data, offsets in slices(column.cast(pa.string())):
        for first, last, hashes, begin in shingled(data, Spans(data), offsets[:-1], offsets[1:]):
            line = np.arange(low + first, low + last, dtype=np.uint64) << bits
            hashes >>= np.uint64(65) - bits
            hashes <<= np.uint64(1)
            hashes |= np.repeat(line, np.diff(np.append(begin, len(hashes))))
            keys.append(hashes)
    return np.concatenate(keys)


def _overlaps(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per pair of lines how many different shingles both have, and the sum of what each has."""
    keys, n = np.concatenate((_numbered(a), _numbered(b) | np.uint64(1))), len(a)
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    line = (keys >> np.uint64(64 - max(n - 1, 1).bit_length())).astype(np.int64)
    return np.bincount(line[1:][keys[1:] ^ keys[:-1] == 1], minlength=n), np.bincount(line, minlength=n)


def _sorted_distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _profile(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different shingles of each line, sorted, all of weight 1, and how many each has."""
    found = []
    for _, _, data, offsets in slices(column.cast(pa.string())):
        for _, _, hashes, begin in shingled(data, Spans(data), offsets[:-1], offsets[1:]):
            found += [_sorted_distinct(x) for x in np.split(hashes, begin[1:])]
    terms = np.concatenate(found)
    return terms, np.ones(len(terms)), np.array([len(x) for x in found])


def _verifier(threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, low = np.zeros(len(batch), np.bool_), 0
            size = sum(pc.binary_length(batch.column(i)).to_numpy().astype(np.int64) for i in (2, 3))
            upto = np.concatenate(([0], np.cumsum(size)))
            while low < len(batch):  # pairs of about a slice of text together
                high = max(int(np.searchsorted(upto, upto[low] + SLICE_BYTES, "right")) - 1, low + 1)
                same, own = _overlaps(*(batch.column(i).slice(low, high - low) for i in (2, 3)))
                keep[low:high] = same >= threshold * (own - same)
                low = high
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["u", "v"])

    return check


def line_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of the lines that are near-equal to a different one."""
    ship(docs.sparkSession)
    texts = docs.select(text_of().alias("text"))
    bands = texts.mapInArrow(_signer, BANDS_SCHEMA)

    def fetch(pairs: DataFrame) -> DataFrame:
        wanted = wanted_nodes(pairs)
        few = wanted.count() <= BROADCAST_NODES
        picked = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toPandas()["node"].to_numpy(np.int64))) if few else None
        # Each slice gives a line once, so copies do not pile up before they meet.
        lines = texts.mapInArrow(_texts(picked), "node long, text binary")
        return settle(lines.dropDuplicates(["node"]) if few else texts_of(lines, wanted))

    def judge(pairs: DataFrame, own: DataFrame) -> DataFrame:
        both = pairs.join(own.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
        both = both.join(own.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
        return both.select("u", "v", "a", "b").mapInArrow(_verifier(threshold), "u long, v long")

    return link_classes(bands, fetch, judge, _profile, threshold)


def dropped_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row_key, lines): per document text, the places of the lines that another one stands for.

    ``row_key`` is a hash of doc_id and text.
    """
    ship(docs.sparkSession)
    roots = line_classes(docs, threshold)
    if roots.count() <= BROADCAST_NODES:
        roots = F.broadcast(roots)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("order")
    rows = docs.select(F.xxhash64("doc_id", text_of()).alias("row"), order, text_of().alias("text"))
    # Stored with a row per document, 12 bytes a line, so that the texts are read and hashed once.
    rows = settle(rows.mapInArrow(_line_nodes, "row long, order long, lines binary, nodes binary"))
    lines = rows.mapInArrow(_lines, "row long, order long, line int, node long")
    lines = lines.join(roots, "node", "left").select("row", "order", "line", F.coalesce("root", "node").alias("root"))
    # Firsts are stored, so the join with a hot line's places is one that Spark can split.
    firsts = settle(lines.groupBy("root").agg(F.min(F.struct("order", "row", "line")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = lines.join(firsts, "root").where((F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line")))
    return later.groupBy("row").agg(F.collect_set("line").alias("lines")).select(F.col("row").alias("row_key"), "lines")


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All documents, with ``text`` less the dropped lines and a column ``dropped`` that counts them.

    Lines end at line feeds. Blank lines are never dropped; a line that repeats within a
    document is dropped there too. Of repeated rows each is treated alike (as one document
    that is there several times: what is first in it stays in every copy). Null texts stay
    null. A document all of whose lines are dropped keeps its row, with what blank lines it
    has. Other columns are kept as they are; where there is a column ``dropped`` the count
    has the next free name, ``dropped_1`` and so on. An empty table gives no rows.
    """
    gone = dropped_lines(docs, threshold).select(F.col("row_key").alias("_gone_key"), F.col("lines").alias("_gone"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    own = docs.select(F.struct(*kept).alias("_record"), F.xxhash64("doc_id", text_of()).alias("_own_key"), F.split("text", "\n", -1).alias("_lines"))
    own = own.join(gone, F.col("_own_key") == F.col("_gone_key"), "left")
    # The places that stay, by one hash set, and their lines.
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rest = F.transform(places, lambda i: F.get(F.col("_lines"), i))
    text = F.array_join(F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(rest), "\n").alias("text")
    columns = [text if c == "text" else F.col(f"_record.`{c}`").alias(c) for c in docs.columns]
    return own.select(*columns, F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(free_name(docs, "dropped")))


def lines_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 of the text that stays."""
    found = dedup_lines(docs.select("doc_id", "text", F.size(F.split(text_of(), "\n", -1)).cast("long").alias("n_lines")))
    return found.select("doc_id", "n_lines", F.col("dropped").alias("n_dropped"), F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"))
