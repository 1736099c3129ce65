"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A shingle is a run of five words; its weight in a document is how often it occurs there
times a smoothed inverse document frequency, 1 + ln((n + 1) / (df + 1)) / ln(n + 1), in 16
steps between 1 (in every document) and 2 (in one). Document frequencies are counted over
all documents, in a table of hashed cells of constant size. Each of 64 samples picks one
shingle of a document with probability proportional to its weight, consistently across
documents; bands of four samples give the candidates, and the weighted Jaccard similarity
of the whole texts decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship, text_of
from .neardup import BANDS_SCHEMA, classes, link_classes, local_bands, sketch_of, texts_of, wanted_nodes
from .textkernels import ALNUM, mix, shingles, slices, span_hashes, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 16
BAND_SAMPLES = 4
#: Document frequencies are counted in 2**24 cells by hash (one byte each when broadcast). A cell's count is
#: the sum of its shingles' frequencies: too high by (shingles of a mean text) / 2**24 of the documents on average.
CELL_BITS = 24
#: Cells are dealt to tasks in blocks of this many.
_BLOCK = 1 << 16
#: Slices whose cells make one row per block.
GROUP_SLICES = 16
#: Steps of the inverse document frequency between 1 and 2.
STEPS = 15


def _gamma_levels(bits: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**bits equal shares."""
    share = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros(len(share)), np.full(len(share), 60.0)
    for _ in range(80):
        middle = (low + high) / 2
        below = 1 - np.exp(-middle) * (1 + middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low


# A hash's 8 + 8 bits choose r from Gamma(2, 1) and b from the unit interval, 12 more bits choose ln c.
_R = np.repeat(_gamma_levels(8), 256)
_B = np.tile((np.arange(256) + 0.5) / 256, 256)
_LOG_C = np.log(_gamma_levels(12)).astype(np.float32)


def _t(log_weight: np.ndarray | float, choice: np.ndarray | slice) -> np.ndarray:
    return np.floor(log_weight / _R[choice] + _B[choice])


def _step(log_weight: np.ndarray | float, choice: np.ndarray | slice) -> np.ndarray:
    """What is taken off ln c for ln a."""
    return (_R[choice] * (_t(log_weight, choice) - _B[choice] + 1)).astype(np.float32)


_IDF = 1 + np.arange(STEPS + 1, dtype=np.float32) / STEPS
# What a shingle that occurs once takes off, by its step of idf and the hash's choice.
_ONCE = np.stack([_step(np.log(float(x)), slice(None)) for x in _IDF]).ravel()


def term_counts(column: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, per row its distinct shingles, sorted, and how often each occurs)."""
    for low, high, data, offsets in slices(column):
        starts, ends, bounds, mapped = words(data, offsets, ALNUM)
        terms, at = shingles(span_hashes(mapped, starts, ends), bounds, SHINGLE)
        yield low, [np.unique(terms[at[i] : at[i + 1]], return_counts=True) for i in range(high - low)]


class Weights:
    """The step of idf of every cell."""

    def __init__(self, steps: np.ndarray):
        self.steps = steps

    def step(self, terms: np.ndarray) -> np.ndarray:
        return self.steps[(terms & np.uint64(len(self.steps) - 1)).astype(np.int64)]

    def of(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _IDF[self.step(terms)] * counts


def samples(rows: list[tuple[np.ndarray, np.ndarray]], weights: Weights) -> np.ndarray:
    """For each (shingles, counts), at least one each: a column with a hash per sample of the shingle taken and its t."""
    terms = np.concatenate([x for x, _ in rows])
    counts = np.concatenate([x for _, x in rows])
    sizes = np.array([len(x) for x, _ in rows])
    begin = np.cumsum(sizes) - sizes
    short = (terms >> np.uint64(32)).astype(np.uint32)
    step = weights.step(terms).astype(np.int64)
    log_weight = np.log(_IDF[step].astype(np.float64) * counts)
    offset = step << 16
    often = np.flatnonzero(counts > 1)
    out = np.zeros((BANDS * BAND_SAMPLES, len(rows)), np.uint64)
    for k in range(BANDS * BAND_SAMPLES):
        h = short ^ np.uint32((k + 1) * 0x9E3779B1 & 0xFFFFFFFF)
        for shift, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h ^= h >> np.uint32(shift)
            h *= np.uint32(odd)
        h ^= h >> np.uint32(16)
        choice = (h >> np.uint32(16)).astype(np.int64)
        log_a = np.take(_LOG_C, (h & np.uint32(0xFFF)).astype(np.int64)) - np.take(_ONCE, offset + choice)
        if len(often):
            log_a[often] = _LOG_C[h[often] & np.uint32(0xFFF)] - _step(log_weight[often], choice[often])
        least = np.minimum.reduceat(log_a, begin)
        hits = np.flatnonzero(log_a == np.repeat(least, sizes))
        least = hits[np.searchsorted(hits, begin)]
        t = _t(log_weight[least], choice[least]).astype(np.int64).view(np.uint64)
        out[k] = mix(terms[least] + t * np.uint64(0x9E3779B97F4A7C15))
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key per document and band."""
    keys = np.zeros((values.shape[1], BANDS), np.uint64)
    for k, row in enumerate(values):
        keys[:, k // BAND_SAMPLES] = mix(keys[:, k // BAND_SAMPLES] ^ row)
    # A key is of its band.
    return mix(keys + np.arange(BANDS, dtype=np.uint64))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, cells): per block the cells of each document's different shingles, two bytes each."""
    for batch in batches:
        for some in batched(term_counts(batch.column(0)), GROUP_SLICES):
            found = [x for _, rows in some for x, _ in rows]
            cells = np.sort((np.concatenate(found) & np.uint64((1 << CELL_BITS) - 1)).astype(np.uint32))
            bounds = np.searchsorted(cells, np.arange(((1 << CELL_BITS) // _BLOCK) + 1) * _BLOCK)
            low = (cells & np.uint32(_BLOCK - 1)).astype(np.uint16)
            blocks = np.flatnonzero(np.diff(bounds))
            packed = [low[bounds[i] : bounds[i + 1]].tobytes() for i in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array(packed, pa.binary())], ["block", "cells"])


def _idf_steps(n: int):
    """(block, steps): the counts of each block's cells, summed over rows sorted by block, as steps of idf."""

    def of(counts: np.ndarray) -> bytes:
        idf = np.log((n + 1) / (counts + 1)) / np.log(n + 1)
        return np.rint(np.clip(idf, 0, 1) * STEPS).astype(np.uint8).tobytes()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts = None, np.zeros(_BLOCK, np.int64)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([of(counts)], pa.binary())], ["block", "steps"])
        for batch in batches:
            for own, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block is not None and own != block:
                    yield row()
                    counts[:] = 0
                block = own
                counts += np.bincount(np.frombuffer(cells.as_buffer(), np.uint16), minlength=_BLOCK)
        if block is not None:
            yield row()

    return total


def fit_weights(docs: DataFrame) -> Weights:
    """Document frequencies of all documents; a cell that no document has is that of a shingle in one at most."""
    n = docs.count()
    steps = np.full((1 << CELL_BITS) // _BLOCK * _BLOCK, STEPS, np.uint8)
    if n:
        cells = docs.select(text_of().alias("text")).mapInArrow(_cells, "block int, cells binary")
        # Without a combine on the map side a row is two bytes a shingle; a task sums the rows of a block one by one.
        totals = cells.repartition("block").sortWithinPartitions("block").mapInArrow(_idf_steps(n), "block int, steps binary")
        for row in totals.collect():  # one row per block
            steps[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.steps, np.uint8)
    return Weights(steps)


def _signer(shared):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys_of, nodes_of, sketches_of = batch.column(0).to_numpy(), [], [], []
            for low, rows in term_counts(batch.column(1)):
                own = [i for i, (terms, _) in enumerate(rows) if len(terms)]
                # Exact copies give the same entries once.
                own = [own[i] for i in np.unique(nodes[low + np.array(own, np.int64)], return_index=True)[1]]
                if own:
                    values = samples([rows[i] for i in own], shared.value)
                    keys_of.append(band_keys(values).ravel().view(np.int64))
                    nodes_of.append(np.repeat(nodes[low + np.array(own)], BANDS))
                    sketches_of.append(np.repeat(sketch_of(values), BANDS))
            if keys_of:
                keys, own, sketches = (np.concatenate(x) for x in (keys_of, nodes_of, sketches_of))
                first = np.unique(np.stack((keys, own), 1), axis=0, return_index=True)[1]
                yield from local_bands(keys[first], own[first], sketches[first])

    return sign


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: Weights) -> float:
    terms = np.concatenate((a[0], b[0]))
    own = np.concatenate((weights.of(*a), weights.of(*b)))
    order = np.argsort(terms, kind="stable")
    terms, own = terms[order], own[order]
    same = np.flatnonzero(terms[1:] == terms[:-1])
    both = np.minimum(own[same], own[same + 1]).sum(dtype=np.float64)
    total = own.sum(dtype=np.float64) - both
    return float(both / total) if total else 0.0


def _profiler(shared):
    def profile(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different shingles of each text, sorted, their weights, and how many each has."""
        found = [x for _, rows in term_counts(column) for x in rows]
        terms, counts = (np.concatenate(x) for x in zip(*found))
        return terms, shared.value.of(terms, counts).astype(np.float64), np.array([len(x) for x, _ in found])

    return profile


def _verifier(shared, threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, keep, last = batch.column(0).to_numpy(), np.zeros(len(batch), np.bool_), None
            for low in range(0, len(batch), 256):
                left, right = (batch.column(i).slice(low, 256) for i in (2, 3))
                ours = [x for _, rows in term_counts(right) for x in rows]
                for i, b in enumerate(ours):
                    if last is None or last[0] != u[low + i]:
                        last = u[low + i], next(term_counts(left.slice(i, 1)))[1][0]
                    keep[low + i] = weighted_jaccard(last[1], b, shared.value) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["u", "v"])

    return check


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, class_id (least doc_id of its class), class_size, node, root, first_node.

    ``root`` is the class itself: classes whose members have no doc_id, or that share one, differ in it.
    ``first_node`` is the text of the class's first document, the least of those with its least doc_id.

    A class is a component of the links between texts of a weighted Jaccard similarity of
    at least the threshold; equal texts are always together. Texts without words are
    linked to equal texts only; a null text is empty. Candidates share one of 16 bands, so
    a link of exactly 0.8 is found with probability 0.9998. A null doc_id is a member like
    any other and never names a class that has others. Repeated rows give repeated rows;
    an empty table gives none; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit_weights(docs))
    texts = docs.select(F.xxhash64(text_of()).alias("node"), text_of().alias("text"))
    bands = texts.mapInArrow(_signer(shared), BANDS_SCHEMA)

    def fetch(pairs: DataFrame) -> DataFrame:
        return settle(texts_of(texts, wanted_nodes(pairs)))

    def judge(pairs: DataFrame, own: DataFrame) -> DataFrame:
        both = pairs.join(own.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
        both = both.join(own.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
        return both.select("u", "v", "a", "b").mapInArrow(_verifier(shared, threshold), "u long, v long")

    roots = link_classes(bands, fetch, judge, _profiler(shared), threshold)
    ids = docs.select("doc_id", F.xxhash64(text_of()).alias("node"), F.col("doc_id").isNull().alias("unnamed"))
    return classes(ids, roots, "unnamed", "doc_id", "node").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        F.col("class_size").cast("long").alias("class_size"),
        "node",
        "root",
        F.col("first.node").alias("first_node"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the least doc_id, whole; of repeated rows one.

    Null texts are empty ones, and of rows without doc_id one stays per class that has no
    other. All columns stay whatever their names; an empty table gives no rows.
    """
    found = near_duplicates(docs, threshold)
    # Every class keeps one (doc_id, text); equal ones are repeated rows.
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("first_node")))
    first = first.select(F.col("doc_id").alias("first_id"), F.col("node").alias("first_text")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), "doc_id", F.xxhash64(text_of()).alias("text_node"))
    kept = own.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_node") == F.col("first_text")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_node"]).select("record.*")
