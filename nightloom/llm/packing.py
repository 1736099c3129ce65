"""Best-fit packing of tokenised documents by exact-complement hashing.

Lengths decide everything, so the plan is made on their histogram, at most one bin per
length up to the sequence length, however many documents there are. For each length, from
the longest down, sets of single lengths and of pair and triple sums that fill its gap
exactly are consumed as often as all their parts are available; what is left goes, longest
first, into the open sequences with the least room that still fits. The plan gives every
pattern a range of sequences, and every length in it a range of ranks; a document's place
follows from its length and its rank among equal lengths.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship
from .textkernels import NONSPACE, PieceCache, letter_cuts, slices, span_hashes

MAX_TOKENS = 4096
END_ID = 1
#: Rows of a length are ranked in parts of about so many, but 64 parts at least; a hot length spreads over them.
RANK_ROWS = 250_000
RANK_PARTS = 64
#: Low bits of a cached value that hold how many ids a piece has: more than a text of 2 GB can have.
SIZE_BITS = 31

_open: dict[str, "_Encoder"] = {}


class _Encoder:
    """Token ids of texts whose tokenizer drops white space, by cached pieces between it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(x["content"].encode() for x in spec["added_tokens"])
        # Pieces are cut at white space and between ASCII letters and signs, where this kind of tokenizer always cuts:
        # it drops white space and splits runs of letters, digits and signs. Any other one gets whole texts.
        suffix = spec["model"].get("end_of_word_suffix")
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        changes = (spec["normalizer"] or {}).get("normalizers", [])
        drops = bool(steps) and steps[0]["type"] == "Split" and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and "\\p{L}" in str(steps[0]["pattern"])
        self.cuts = bool(suffix) and drops and all(x["type"] in ("NFC", "Lowercase", "Replace") for x in changes) and not spec["post_processor"]
        suffix = suffix or "</w>"
        vocabulary = spec["model"]["vocab"]
        self.word_end = np.zeros(max(vocabulary.values()) + 1 + len(self.special), np.bool_)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.cache, self.ids, self.starts, self.n = PieceCache(), np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0
        self.filled = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _each(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece; pieces of one word each are encoded together."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) == len(pieces) and len(ends) and ends[-1] == len(ids):
            return np.split(ids, ends[:-1])
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> np.ndarray:
        plain = np.array([x.isascii() and x.isalpha() for x in pieces], np.bool_)
        found: list = [None] * len(pieces)
        for some in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            own = [pieces[i] for i in some]
            new = self._each(own) if len(some) and plain[some[0]] else [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)] if own else []
            for i, x in zip(some.tolist(), new):
                found[i] = x
        flat, sizes = np.concatenate(found), np.array([len(x) for x in found])
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.filled : self.filled + len(flat)] = flat
        # A value holds where the ids are and how many.
        values = (self.filled + np.cumsum(sizes) - sizes) << SIZE_BITS | sizes
        self.filled += len(flat)
        self.cache.add(keys, values)
        return values

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if not self.cuts:
            yield from (self.whole(x) for x in column.to_pylist())
            return
        for low, high, data, offsets in slices(column):
            inside = NONSPACE_ANY[data]
            cut = letter_cuts(data)
            cut[1:] |= ~inside[:-1]
            cut[offsets[:-1][offsets[:-1] < len(data)]] = True
            starts = np.flatnonzero(cut & inside)
            stop = np.append(cut[1:] | ~inside[1:], True)[: len(data)]
            ends = np.flatnonzero(stop & inside) + 1
            bounds = np.searchsorted(starts, offsets)
            raw = data.tobytes()
            distinct, first, where = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            if self.filled > 20_000_000:
                self.clear()
            values = self.cache.find(distinct)
            new = np.flatnonzero(values < 0)
            if len(new):
                spans = first[new]
                values[new] = self._learn(distinct[new], [raw[a:b].decode() for a, b in zip(starts[spans].tolist(), ends[spans].tolist())])
            values = values[where]
            at, sizes = values >> SIZE_BITS, values & ((1 << SIZE_BITS) - 1)
            total = np.concatenate(([0], np.cumsum(sizes)))
            ids = self.ids[np.repeat(at - total[:-1], sizes) + np.arange(total[-1])]
            odd = any(x in raw for x in self.special)
            for i in range(high - low):
                text = raw[offsets[i] : offsets[i + 1]] if odd else b""
                if any(x in text for x in self.special):  # a cut may have gone through a special string
                    yield self.whole(text.decode())
                else:
                    yield ids[total[bounds[i]] : total[bounds[i + 1]]]


NONSPACE_ANY = NONSPACE > 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _piece_maker(path: str, max_tokens: int, end_id: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _open:
            _open[path] = _Encoder(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            doc_ids = batch.column(0).to_pylist()
            for doc_id, ids in zip(doc_ids, _open[path].rows(pc.fill_null(batch.column(1), ""))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), max_tokens)):
                    own = ids[start : start + max_tokens]
                    for x, value in zip(out, (doc_id, piece, start, len(own), zlib.crc32(own.tobytes()))):
                        x.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return make


def token_pieces(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """The documents' ids, an end id after each, cut into pieces of at most ``max_tokens``.

    A null text is empty: one piece of the end id alone. Only longer documents are cut.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_piece_maker(path, max_tokens, end_id), _PIECES)


def packing_plan(counts: dict[int, int], capacity: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), from how many pieces there are of each length."""
    have = [0] * (capacity + 1)
    for length, n in counts.items():
        have[length] = n
    bits = sum(1 << x for x in range(1, capacity + 1) if have[x])
    flipped = sum(1 << (capacity - x) for x in range(1, capacity + 1) if have[x])
    plan: dict[tuple[int, ...], int] = {}

    def take(lengths: tuple[int, ...], n: int) -> None:
        nonlocal bits, flipped
        for x in lengths:
            have[x] -= n
            if not have[x]:
                bits &= ~(1 << x)
                flipped &= ~(1 << (capacity - x))

    def most(lengths: tuple[int, ...]) -> int:
        return min(have[x] // lengths.count(x) for x in set(lengths))

    def pair(total: int) -> tuple[int, int] | None:
        """The available a >= b with this sum, of the largest a."""
        found = bits & (flipped >> (capacity - total)) if total <= capacity else 0
        found &= ~((1 << ((total + 1) // 2)) - 1)
        while found:
            a = found.bit_length() - 1
            if a != total - a or have[a] > 1:
                return a, total - a
            found &= ~(1 << a)
        return None

    def complements(gap: int, longest: int) -> Iterator[tuple[int, ...]]:
        """Available combinations of one, two and three lengths with this sum, fewest first."""
        if have[gap]:
            yield (gap,)
        if found := pair(gap):
            yield found
        rest = bits & ((1 << min(gap, longest + 1)) - 1)
        while rest:
            a = rest.bit_length() - 1
            rest &= ~(1 << a)
            if 3 * a < gap:
                return
            have[a] -= 1
            found = pair(gap - a)
            have[a] += 1
            if found and found[0] <= a:
                yield (a, *found)

    for length in range(capacity, 0, -1):
        if length == capacity and have[length]:
            plan[length,] = have[length]
            take((length,), have[length])
        while have[length]:
            for others in complements(capacity - length, length):
                n = most((length, *others))
                if n:
                    plan[length, *others] = plan.get((length, *others), 0) + n
                    take((length, *others), n)
                    break
            else:
                break
    # What no exact combination takes: best fit, longest first, on groups of equal open sequences.
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    open_rooms = 0
    for length in range(capacity, 0, -1):
        left = have[length]
        while left:
            fits = open_rooms >> length << length
            if fits:
                space = (fits & -fits).bit_length() - 1
                lengths, n = room[space].popitem()
                used = min(n, left)
                if used < n:
                    room[space][lengths] = n - used
                elif not room[space]:
                    open_rooms &= ~(1 << space)
                into, lengths = space - length, (*lengths, length)
            else:
                each = min(capacity // length, left)
                used = left // each
                into, lengths = capacity - each * length, (length,) * each
                left -= used * (each - 1)
            room[into][lengths] = room[into].get(lengths, 0) + used
            if into:
                open_rooms |= 1 << into
            left -= used
    for groups in room:
        for lengths, n in groups.items():
            plan[lengths] = plan.get(lengths, 0) + n
    return sorted(plan.items(), reverse=True)


def _placer(shared):
    """Sequence and offset of each piece, from its length and rank."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first_rank, sequence, offset = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch[x] for x in names]
            columns += [pa.array(sequence[at] + rank - first_rank[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return place


def ranked(pieces: DataFrame, parts: int = RANK_PARTS) -> DataFrame:
    """``rank`` from 0 without gaps among pieces of equal length; a hot length is ranked in parts."""
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    own = pieces.withColumn("part", part)
    before = Window.partitionBy("length").orderBy("part")
    starts = own.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", (F.sum("n").over(before) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = own.withColumn("number", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "part"]).withColumn("rank", F.col("number") + F.col("before")).drop("number", "before", "part")


def pack(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every piece is in one sequence and the pieces of a sequence follow each other without
    gaps from offset 0. Null and empty texts give a piece of the end id alone; repeated rows
    are packed each; an empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    pieces = settle(token_pieces(docs, path, max_tokens, end_id))
    # One row per length, so at most max_tokens rows.
    counts = {x["length"]: x["n"] for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    entries, next_rank, next_sequence = [], dict.fromkeys(counts, 0), 0
    for lengths, n in packing_plan(counts, max_tokens):
        offset = 0
        for length in lengths:
            entries.append((length, next_rank[length], next_sequence, offset))
            next_rank[length] += n
            offset += length
        next_sequence += n
    table = np.array(sorted(entries), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((table[:, 0] << 40 | table[:, 1], table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy()))
    parts = max(RANK_PARTS, max(counts.values(), default=0) // RANK_ROWS)
    rows = ranked(pieces, parts).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return rows.mapInArrow(_placer(shared), f"{_PIECES}, sequence_id long, offset long")
