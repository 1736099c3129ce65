"""Language-model scores by a probabilistic suffix tree of words.

States are contexts of any number of preceding words. The tree grows a word at a time: a
context is a candidate if it occurs often enough in the training text and its suffix, the
context without its first word, is a state, whatever it begins with; it becomes one if its
next-word distribution diverges from that of its suffix. Growth ends when no context passes. A state has
probabilities of its own for the words that follow it often enough, with a discount; the
rest of its mass goes to other words as its suffix has them, down to add-one word
frequencies. A word is scored in the longest state that ends before it.

All thresholds are counts, so the tree grows with the corpus. Counts, candidates, states and
the finished tree are distributed tables. A word's log probability is a sum of values that
its word, its states and its pairs of a state and a next word have each, so a document's
score is a sum over keys: those of the most frequent entries are looked up where the texts
are, in a table of bounded size, and the others are joined, with the same result: a batch
names such a key once, with the documents it is in. Bitmaps of a fixed size leave out keys
that no table has; what passes by chance meets no row. Pairs of a word and the next, and of
two words and the next, are first sieved by hash cells, two bytes an occurrence: a pair is
no more frequent than its cell, so those of rare cells need no count of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, settle, ship, text_of
from .textkernels import NONSPACE, mix, slices, span_hashes, words

#: Occurrences in the training text that a context needs.
MIN_CONTEXT = 32
#: Occurrences after a context that a next word needs to have a probability of its own.
MIN_PAIR = 8
#: Least divergence, in nats, of a context's distribution from its suffix's.
DIVERGENCE = 0.02
DISCOUNT = 0.5
#: Entries of the tree that are looked up in tasks; all others are joined.
HEAD_ROWS = 500_000
#: Bits of a bitmap, as a power of two, and of those that say what is to be joined.
BITMAP_BITS = 24
JOINED_BITS = 26
#: A context's next words are dealt over this many groups, a power of two.
SALTS = 8
#: Occurrences in a part of the cells of a sieve, which one task counts.
PART_CELLS = 1 << 22
#: Words of the training text for each part of the keys that are joined; there are 16 parts at least.
PART_TOKENS = 1 << 24
#: Keys in a packed row, so that rows are well below a megabyte.
PACKED_KEYS = 1 << 14
#: Rows of the table, as a power of two, whose sums are put together at a time.
ASSEMBLED_BITS = 12
#: Texts are cut to words in slices of about this many bytes, whose arrays fit a cache.
CACHED_BYTES = 1 << 17
#: Keys of documents, or their values, that a task gathers before it gives them on.
GATHERED = 1 << 21
#: Tasks that send a bitmap or the looked-up entries to the driver, so that each sends less than a megabyte.
SENDERS = 32
#: Contexts are sieved before they are counted where more than this part of the words come after what may be their suffix.
SIEVED_SHARE = 8
#: Texts with contexts that can still be longer are stored on their own once they are this part of all texts at most.
FEW_TEXTS_SHARE = 8
#: What an entry tells of a sequence: how often a word occurs, a word's share after a context, what a context keeps for others.
#: A word that occurs often enough to be in a pair has the bit of pairs too.
WORD, PAIR, STATE = 1, 2, 4

_END = np.int64(0x0E4D)
_STATE = np.int64(0x57A7E)
_ALL = np.int64(0xA11)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIGN = np.uint64(1 << 63)
#: Masks for the first bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@contextmanager
def _cleaned(session: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that are made here go when these end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = session.conf.get(name, None)
    session.conf.set(name, "true")
    try:
        yield
    finally:
        session.conf.unset(name) if before is None else session.conf.set(name, before)


def _stored(df: DataFrame) -> DataFrame:
    """``settle``; the shuffle files that the rows came through are not kept until the driver collects its garbage."""
    with _cleaned(df.sparkSession):
        return settle(df.select("*"))


def _fetched(df: DataFrame) -> pa.Table:
    with _cleaned(df.sparkSession):
        return df.select("*").toArrow()


def _word_hashes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, equal bytes, equal hashes: of words of up to eight and sixteen bytes from one or two numbers, else by ``span_hashes``."""
    n = ends - starts
    padded = np.zeros((len(mapped) >> 3) + 4, "<u8")
    padded.view(np.uint8)[: len(mapped)] = mapped

    def eight(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes from each place on, up to eight, as a number."""
        block, shift = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        return (padded[block] >> shift | padded[block + 1] << np.uint64(1) << (np.uint64(63) - shift)) & _FIRST[np.minimum(size, 8)]

    out = mix(eight(starts, n) + _STEP)
    long = np.flatnonzero(n > 8)
    if len(long):
        out[long] = mix(out[long] + eight(starts[long] + 8, n[long] - 8) * _STEP)
        long = long[n[long] > 16]
        if len(long):
            ends = np.cumsum(n[long])
            at = np.arange(ends[-1]) + np.repeat(starts[long] - ends + n[long], n[long])
            out[long] = span_hashes(mapped[at], ends - n[long], ends)
    return out


def sequences(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, where each row's begin): hashes of a row's words and an end token."""
    for low, high, data, offsets in slices(column, CACHED_BYTES):
        starts, ends, bounds, mapped = words(data, offsets, NONSPACE)
        counts = np.diff(bounds)
        begin = bounds + np.arange(len(bounds))
        tokens = np.full(begin[-1], _END)
        tokens[np.arange(len(starts)) + np.repeat(np.arange(high - low), counts)] = _word_hashes(mapped, starts, ends).view(np.int64)
        yield low, high, tokens, begin


def pair_keys(context: np.ndarray, token: np.ndarray | np.int64) -> np.ndarray:
    return mix((context.view(np.uint64) ^ np.uint64(0xA5)) * np.uint64(0xD6E8FEB86659FD93) + np.asarray(token, np.int64).view(np.uint64)).view(np.int64)


def contexts(tokens: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By depth from one on, for each place the hash of as many tokens before it, and whether its row has these."""
    place = np.arange(len(tokens)) - np.repeat(begin[:-1], np.diff(begin))
    key, depth = np.zeros(len(tokens), np.uint64), 0
    power = np.uint64(1)
    while True:
        depth += 1
        power = np.uint64(int(power) * int(_STEP) % (1 << 64))
        key = key + np.roll(tokens, depth).view(np.uint64) * power
        yield key.view(np.int64), place >= depth


def _followed(context: pd.Series, token: pd.Series) -> pd.Series:
    """The hash of a context that is followed by one more token."""
    return pd.Series(((context.to_numpy(np.int64).view(np.uint64) + token.to_numpy(np.int64).view(np.uint64)) * _STEP).view(np.int64))


def _cell(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _entry_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """By the sequence of words that an entry is about: a pair's is its context and its word, a state's its context."""
    context = context.view(np.uint64)
    return pair_keys(np.where(token == _STATE, context, (context + token.view(np.uint64)) * _STEP).view(np.int64), _STATE)


def _set_bits(bits: int, keys: Callable):
    def set_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.unique(_cell(keys(batch.column(0).to_numpy(), batch.column(1).to_numpy()), bits))
                word, first = np.unique(cells >> 6, return_index=True)
                set_bits = np.bitwise_or.reduceat(np.uint64(1) << (cells & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(set_bits.view(np.int64))], ["word", "bits"])

    return set_


def _bits_of(found: pa.Table, bits: int) -> np.ndarray:
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def bitmap(entries: DataFrame, bits: int = BITMAP_BITS, keys: Callable = pair_keys) -> np.ndarray:
    """2 ** bits bits, of which those of all (context, token) are set; at most 2 ** (bits - 6) rows come to the driver."""
    found = entries.select("context", "token").mapInArrow(_set_bits(bits, keys), "word long, bits long")
    return _bits_of(_fetched(found.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).repartition(SENDERS)), bits)


def _may_have(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cells = _cell(keys, len(bits).bit_length() + 5)
    return (bits[cells >> 6] >> (cells & 63).astype(np.uint64) & np.uint64(1)).astype(np.bool_)


def _part_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending keys: the same as unsigned numbers in this order, and where each part, by their first bits, begins and the last ends."""
    ascending = keys.view(np.uint64) ^ _SIGN
    return ascending, np.append(np.searchsorted(ascending, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))


def _rows_of(begin: np.ndarray) -> list[tuple[int, slice]]:
    """Parts and their keys, at most ``PACKED_KEYS`` a row."""
    return [(part, slice(low, min(low + PACKED_KEYS, begin[part + 1]))) for part in range(len(begin) - 1) for low in range(begin[part], begin[part + 1], PACKED_KEYS)]


def _deltas(ascending: np.ndarray) -> bytes:
    """Ascending keys as the first and steps of as many bytes as the longest needs; the first byte tells how many these are."""
    steps = np.diff(ascending)
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8 or 1
    return bytes([width]) + ascending[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _undone(packed: bytes) -> np.ndarray:
    width = packed[0]
    steps = np.zeros(((len(packed) - 9) // width + 1, 8), np.uint8)
    steps[0] = np.frombuffer(packed, np.uint8, 8, 1)
    steps[1:, :width] = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _narrow(n: np.ndarray) -> bytes:
    """Counts at a byte each, if all are small."""
    return n.astype("<u1" if n.max() < 256 else "<i8").tobytes()


def _wide(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(packed, "<u1" if len(packed) == size else "<i8").astype(np.int64)


def _first_of(ascending: np.ndarray) -> np.ndarray:
    """Where each distinct value begins."""
    return np.flatnonzero(np.concatenate((ascending[:1] == ascending[:1], ascending[1:] != ascending[:-1])))


def _count_words(bits: int):
    """Counts of the words of a batch, packed to a row per part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens for _, _, tokens, _ in sequences(batch.column(0))]
            if found:
                tokens = np.sort(np.concatenate(found))
                first = _first_of(tokens)
                n = np.diff(np.append(first, len(tokens)))
                ascending, begin = _part_of(tokens[first], bits)
                rows = _rows_of(begin)
                columns = [pa.array([p for p, _ in rows], pa.int64()), *(pa.array(x, pa.binary()) for x in ([_deltas(ascending[x]) for _, x in rows], [_narrow(n[x]) for _, x in rows]))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "keys", "counts"])

    return count


def _add_up(least: int):
    """The words of a part with their counts: a row each if there are ``least`` occurrences, all others packed."""

    def add_up(table: pa.Table) -> pa.Table:
        keys = [_undone(x) for x in table["keys"].to_pylist()]
        n = np.concatenate([_wide(x, len(k)) for x, k in zip(table["counts"].to_pylist(), keys)])
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = _first_of(keys)
        keys, n = keys[first], np.add.reduceat(n, first)
        often, rare = n >= least, n < least
        size = np.count_nonzero(often)
        found = pa.table({"token": (keys[often] ^ _SIGN).view(np.int64), "n": n[often], "words": np.ones(size, np.int64), "keys": pa.nulls(size, pa.binary()), "counts": pa.nulls(size, pa.binary())})
        keys, n = keys[rare], n[rare]
        rows = [{"n": int(n[x].sum()), "words": len(n[x]), "keys": _deltas(keys[x]), "counts": _narrow(n[x])} for _, x in _rows_of(np.array([0, len(keys)]))]
        return pa.concat_tables([found, pa.Table.from_pylist(rows, found.schema)])

    return add_up


def _places(shared, depth: int, tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a candidate context of a depth and a next word that its suffix has a probability for."""
    candidates, below = shared[:2]
    suffix = np.zeros(len(tokens), np.int64)
    for d, (context, there) in enumerate(contexts(tokens, begin), 1):
        if d == depth:
            break
        suffix = context
    at = np.flatnonzero(there)
    at = at[_may_have(candidates, pair_keys(context[at], _STATE))]
    at = at[_may_have(below, pair_keys(suffix[at], tokens[at]))]
    return context[at], tokens[at]


def _after(shared, depth: int, tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places after contexts of a depth whose suffix may be a state, with the contexts and suffixes of these.

    A context occurs no more often than its first two words, so those must be frequent too.
    """
    states, _, frequent = shared[:3]
    suffix = np.zeros(len(tokens), np.int64)
    for d, (context, there) in enumerate(contexts(tokens, begin), 1):
        if d == depth:
            break
        suffix = context
        if d == 2:
            pair = context
    at = np.flatnonzero(there)
    at = at[_may_have(states, pair_keys(suffix[at], _STATE))]
    at = at[_may_have(frequent, pair_keys(pair[at - (depth - 2)], _STATE))]
    return at, context[at], suffix[at]


def _contexts_after(shared, depth: int, tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.int64]:
    return _after(shared, depth, tokens, begin)[1], _ALL


def _cells(shared, depth: int, bits: int, least: int, places: Callable):
    """The first 32 bits of the keys of ``places``, by their first ``bits``: how many each next 16 - bits have, and all last 16, in order.

    What a batch has more than ``least`` times is there ``least`` times.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(pair_keys(*places(shared.value, depth, tokens, begin)).view(np.uint64) >> np.uint64(32)).astype(np.uint32) for _, _, tokens, begin in sequences(batch.column(0))]
            if found:
                found = np.concatenate(found)
                found.sort()
                if len(found) > least:
                    found = found[np.concatenate((np.ones(least, np.bool_), found[least:] != found[:-least]))]
                counts = np.bincount(found >> 16, minlength=1 << 16).astype(np.uint32).reshape(1 << bits, -1)
                low = np.split(found.astype(np.uint16), np.cumsum(counts.sum(axis=1))[:-1])
                columns = [pa.array(np.arange(1 << bits)), pa.array([x.tobytes() for x in counts], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "counts", "low"])

    return cells


def _frequent_cells(least: int):
    """Bits of the cells of a part that are there ``least`` times."""

    def find(table: pa.Table) -> pa.Table:
        part, found = table["part"][0].as_py(), []
        for counts, low in zip(table["counts"].to_pylist(), table["low"].to_pylist()):
            counts = np.frombuffer(counts, np.uint32)
            high = np.arange(len(counts), dtype=np.uint32) + np.uint32(part * len(counts))
            found.append(np.repeat(high << np.uint32(16), counts) | np.frombuffer(low, np.uint16))
        found = np.concatenate(found)
        found.sort()
        first = np.flatnonzero(np.concatenate((found[:1] == found[:1], found[1:] != found[:-1])))
        cells = found[first[np.diff(np.append(first, len(found))) >= least]].astype(np.int64) >> (32 - BITMAP_BITS)
        word, first = np.unique(cells >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (cells & 63).astype(np.uint64), first) if len(word) else np.zeros(0, np.uint64)
        return pa.table({"word": word, "bits": bits.view(np.int64)})

    return find


def sieve(texts: DataFrame, shared, depth: int, total: int, least: int, places: Callable = _places) -> np.ndarray:
    """A bitmap that has all keys of ``places`` with ``least`` occurrences, and few others: at most two bytes an occurrence are shuffled.

    Parts are by the first bits of a cell and so of the bitmap. The more occurrences than 2 ** 32 there are, the more others pass.
    """
    bits = min(max(math.ceil(math.log2(max(total, 1) / PART_CELLS)), 0), 10)
    cells = texts.mapInArrow(_cells(shared, depth, bits, least, places), "part long, counts binary, low binary")
    return _bits_of(_fetched(cells.groupBy("part").applyInArrow(_frequent_cells(least), "word long, bits long").repartition(SENDERS)), BITMAP_BITS)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key is, and how many there are of it."""
    order = np.argsort(key)
    key = key[order]
    new = _first_of(key)
    return order[new], np.diff(np.append(new, len(key)))


def _packed_counts(context: np.ndarray, token: np.ndarray, suffix: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """Counts of (context, token), packed to rows per part: a context once with its tokens, and with its suffix where a token is ``_ALL``."""
    at, n = _distinct(pair_keys(context, token))
    dealt = pair_keys(context[at], token[at] & (SALTS - 1)).view(np.int64)
    order = np.argsort(dealt)
    at, n, (dealt, begin) = at[order], n[order], _part_of(dealt[order], bits)
    rows = []
    for part, x in _rows_of(begin):
        own, first = at[x], _first_of(dealt[x])
        suffixes = None if suffix is None else suffix[own[token[own] == _ALL]].tobytes()
        rows.append((part, context[own[first]].tobytes(), _narrow(np.diff(np.append(first, len(own)))), token[own].tobytes(), _narrow(n[x]), suffixes))
    names = ["part", "contexts", "sizes", "tokens", "counts", "suffixes"]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k == 0 else pa.binary()) for k, x in enumerate(zip(*rows) if rows else [()] * len(names))], names)


def _counted(min_context: int, min_pair: int):
    """Contexts and pairs of a part that occur often enough, with their counts."""

    def add_up(table: pa.Table) -> pa.Table:
        found = []
        for contexts_, sizes, tokens, counts, suffixes in zip(*(table[c].to_pylist() for c in ("contexts", "sizes", "tokens", "counts", "suffixes"))):
            context, token = np.frombuffer(contexts_, "<i8"), np.frombuffer(tokens, "<i8")
            suffix = np.zeros(len(token), np.int64)
            if suffixes:
                suffix[token == _ALL] = np.frombuffer(suffixes, "<i8")
            found.append((np.repeat(context, _wide(sizes, len(context))), token, suffix, _wide(counts, len(token))))
        context, token, suffix, n = (np.concatenate(x) for x in zip(*found))
        key = pair_keys(context, token)
        order = np.argsort(key)
        first = _first_of(key[order])
        at, n = order[first], np.add.reduceat(n[order], first)
        often = n >= np.where(token[at] == _ALL, min_context, min_pair)
        at = at[often]
        return pa.table({"context": context[at], "token": token[at], "suffix": suffix[at], "n": n[often]})

    return add_up


def _pairs(shared, depth: int, bits: int):
    """Counts of the pairs of ``_places`` that the sieve lets through, in the texts of a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieved = shared.value[2]
        for batch in batches:
            found = []
            for _, _, tokens, begin in sequences(batch.column(0)):
                context, token = _places(shared.value, depth, tokens, begin)
                through = _may_have(sieved, pair_keys(context, token))
                found.append((context[through], token[through]))
            if found:
                yield _packed_counts(*(np.concatenate(x) for x in zip(*found)), None, bits)

    return count


def _after_states(shared, depth: int, bits: int):
    """Counts of the contexts of ``_after`` that the sieve, if there is one, lets through, as pairs with ``_ALL``, and of their pairs as in ``_pairs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, sieved = shared.value[1], shared.value[3]
        for batch in batches:
            found = []
            for _, _, tokens, begin in sequences(batch.column(0)):
                at, context, suffix = _after(shared.value, depth, tokens, begin)
                if sieved is not None:
                    through = _may_have(sieved, pair_keys(context, _ALL))
                    at, context, suffix = at[through], context[through], suffix[through]
                found.append((context, np.full(len(at), _ALL), suffix))
                known = _may_have(below, pair_keys(suffix, tokens[at]))
                found.append((context[known], tokens[at[known]], np.zeros(np.count_nonzero(known), np.int64)))
            if found:
                yield _packed_counts(*(np.concatenate(x) for x in zip(*found)), bits)

    return count


def _with_states(shared, depth: int):
    """The texts that may have a state of a depth."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for low, _, tokens, begin in sequences(batch.column(0)):
                for d, (context, there) in enumerate(contexts(tokens, begin), 1):
                    if d == depth:
                        break
                at = np.flatnonzero(there)
                at = at[_may_have(shared.value[0], pair_keys(context[at], _STATE))]
                found.append(np.unique(np.searchsorted(begin, at, "right") - 1) + low)
            yield batch.take(pa.array(np.concatenate(found)))

    return choose


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = _entry_keys(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns[2:]], ["key", "value", "kind"])


def grow(training: DataFrame, counts: DataFrame, total: int, distinct: int, n_texts: int, min_context: int, min_pair: int) -> list[DataFrame]:
    """Per depth the entries (context, token, n, value) of its states, which have a token of their own, and pairs.

    A state's value is the log10 share of the suffix's probability that a word without one of its own
    keeps; a pair's is what its own probability is more than that.
    """
    session = training.sparkSession
    texts = training.select("text")  # counts: of the words that occur as often as ``min_pair``
    followed = F.pandas_udf(_followed, "long")
    denominator = float(total + distinct + 1)
    nothing = F.lit(0).cast("long")
    below = counts.select(nothing.alias("context"), "token", ((F.col("n") + 1) / denominator).alias("q"))
    candidates = _stored(
        counts.where((F.col("n") >= min_context) & (F.col("token") != int(_END))).select(
            followed(nothing, "token").alias("context"), nothing.alias("suffix"), F.col("n").alias("total")
        )
    )
    levels: list[DataFrame] = []
    states, bits = None, min(max(math.ceil(math.log2(max(total, 1) / PART_CELLS)), 4), 12)
    counts_of = lambda found: found.groupBy("part").applyInArrow(_counted(min_context, min_pair), "context long, token long, suffix long, n long")
    packed = "part long, contexts binary, sizes binary, tokens binary, counts binary, suffixes binary"
    while True:
        depth = len(levels) + 1
        after = (candidates if depth < 3 else states).agg(F.sum("total" if depth < 3 else "n")).first()[0] or 0  # places after what can be longer
        if not after:
            break
        if depth < 3:
            # Words, and words after words, that occur so often are known from the counts before.
            known = bitmap(candidates.select("context", F.lit(int(_STATE)).alias("token"))), bitmap(below)
            shared = session.sparkContext.broadcast(known)
            sieved = sieve(texts, shared, depth, total, min_pair)
            shared.destroy()
            shared = session.sparkContext.broadcast((*known, sieved))
            counted = counts_of(texts.mapInArrow(_pairs(shared, depth, bits), packed)).drop("suffix")
        else:
            # Any context whose suffix is a state, whether or not what it begins with was a candidate.
            known = bitmap(states.select("context", F.lit(int(_STATE)).alias("token"))), bitmap(below), frequent
            sieved = None
            shared = session.sparkContext.broadcast(known)
            if after > total // SIEVED_SHARE:
                sieved = sieve(texts, shared, depth, total, min_context, _contexts_after)
            elif after <= n_texts // FEW_TEXTS_SHARE:
                texts = _stored(texts.mapInArrow(_with_states(shared, depth - 1), "text string"))
            shared.destroy()
            shared = session.sparkContext.broadcast((*known, sieved))
            found = _stored(counts_of(texts.mapInArrow(_after_states(shared, depth, bits), packed)))
            whole = F.col("token") == int(_ALL)
            candidates = found.where(whole).select("context", "suffix", F.col("n").alias("total"))
            candidates = candidates.join(states.select(F.col("context").alias("suffix")).hint("merge"), "suffix", "left_semi").select("context", "suffix", "total")
            counted = found.where(~whole).select("context", "token", "n")
        rows = _stored(
            counted.join(candidates.hint("merge"), "context")
            .join(below.select(F.col("context").alias("suffix"), "token", "q").hint("merge"), ["suffix", "token"])
            .withColumn("p", (F.col("n") - DISCOUNT) / F.col("total"))
        )
        shared.destroy()  # the rows are stored, no task needs it again
        rest_p = (F.max("total") - F.sum("n") + DISCOUNT * F.count("*")) / F.max("total")
        sums = rows.groupBy("context").agg(
            rest_p.alias("rest_p"), (1 - F.sum("q")).alias("rest_q"), F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("own"), F.max("total").alias("n")
        )
        diverges = F.col("own") + F.col("rest_p") * F.log(F.col("rest_p") / F.col("rest_q")) >= DIVERGENCE
        states = _stored(sums.where(diverges).select("context", "n", F.log10(F.col("rest_p") / F.col("rest_q")).alias("value")))
        kept = rows.join(states.select("context", F.col("value").alias("backoff")).hint("merge"), "context")
        pairs = _stored(kept.select("context", "token", "n", "p", (F.log10("p") - F.log10("q") - F.col("backoff")).alias("value")))
        levels.append(pairs.drop("p").unionByName(states.withColumn("token", F.lit(int(_STATE)))))
        below = pairs.select("context", "token", F.col("p").alias("q"))
        if len(levels) == 1:
            longer = rows.where((F.col("n") >= min_context) & (F.col("token") != int(_END))).select(
                followed("context", "token").alias("context"), followed("suffix", "token").alias("suffix"), F.col("n").alias("total")
            )
            longer = _stored(longer)
            frequent = bitmap(longer.select("context", F.lit(int(_STATE)).alias("token")))
            candidates = _stored(longer.join(states.select(F.col("context").alias("suffix")).hint("merge"), "suffix", "left_semi").select("context", "suffix", "total"))
    return levels


class Head:
    """Of the most frequent sequences, found by the first bits of their keys, what they are worth as words and in the tree; and bitmaps of all other pairs and states."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, kinds: np.ndarray, pairs: np.ndarray, states: np.ndarray, longest: int):
        order = np.argsort(keys.view(np.uint64))
        keys, values, kinds = keys[order], values[order], kinds[order].astype(np.uint8)
        first = _first_of(keys)
        self.keys, self.pairs, self.states, self.longest = keys[first], pairs, states, longest
        added = lambda x: np.append(np.add.reduceat(x, first) if len(first) else x, 0.0)
        self.values, self.words = added(np.where(kinds & WORD, 0.0, values)), added(np.where(kinds & WORD, values, 0.0))
        self.kinds = np.append(np.bitwise_or.reduceat(kinds, first) if len(first) else kinds, np.uint8(0))
        self.bits = len(keys).bit_length() + 1
        self.starts = np.searchsorted(self._bucket(self.keys), np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys are in ``values``, ``words`` and ``kinds``; those that are not here have none of these."""
        bucket = self._bucket(keys)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        found = np.full(len(keys), len(self.keys))
        open_ = np.flatnonzero(at < end)
        while len(open_):
            hit = self.keys[at[open_]] == keys[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return found


_SUMS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double"
#: Keys that documents look for, entries or documents: ``_wanted``, ``_entries`` and ``_documents`` say what the columns hold.
_PACKED = "part long, kind int, block long, keys binary, counts binary, data binary"
_DOCUMENT = np.dtype([("place", "<u2"), ("held_out", "u1"), ("no_id", "u1"), ("doc_id", "<i8"), ("text", "<i8"), ("n_tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("own", "<f8")])
_WANTED, _WORDS, _TREE, _DOCUMENTS = range(4)
#: What is summed up of words, and of pairs and states.
_OF_WORDS, _OF_TREE = (("known", "<i8"), ("base", "<f8")), (("own", "<f8"),)
_SUMS_TYPE = pa.struct(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("own", pa.float64())]
)


def _by_key(rows: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """A row per key and block of 65,536 rows, with the places of the rows in the block."""
    order = np.argsort(keys, kind="stable")  # rows ascend, so those of a key do
    rows, keys = rows[order], keys[order]
    block = rows >> 16
    new = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], (keys[1:] != keys[:-1]) | (block[1:] != block[:-1]))))
    at = np.append(new, len(keys)).astype(np.int32) * 2
    places = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(at), pa.py_buffer((rows & 0xFFFF).astype(np.uint16))])
    return pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(block[new]), places, pa.nulls(len(new), _SUMS_TYPE)], ["key", "block", "places", "sums"])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    names, types = zip(*((f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in _PACKED.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(types), types)], list(names))


def _wanted(keyed: pa.RecordBatch, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_by_key``, packed to rows of a block and a part: keys, how many places each has, and these."""
    blocks = pc.unique(keyed["block"]).to_pylist()
    for block in blocks:
        own = keyed.filter(pc.equal(keyed["block"], block)) if len(blocks) > 1 else keyed
        ascending, begin = _part_of(own["key"].to_numpy(), bits)
        _, at, places = own["places"].buffers()
        at = np.frombuffer(at, np.int32)[: len(own) + 1]
        rows = []
        for part, x in _rows_of(begin):
            counts = np.diff(at[x.start : x.stop + 1]) // 2
            rows.append((part, _WANTED, block, _deltas(ascending[x]), _narrow(counts), places[at[x.start] : at[x.stop]].to_pybytes()))
        yield _packed(rows)


def _entries(bits: int):
    """Entries packed to rows per part: keys with the counts of words, and keys with the values of pairs and states."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= (1 if batch is None else GATHERED):
                context, token, n, value, kind = (x.to_numpy() for x in pa.Table.from_batches(held).combine_chunks().columns)
                key = _entry_keys(context, token)
                yield _entry_rows(_WORDS, key[kind & WORD != 0], n[kind & WORD != 0], bits)
                yield _entry_rows(_TREE, key[kind & WORD == 0], value[kind & WORD == 0], bits)
                held, size = [], 0

    return pack


def _entry_rows(which: int, key: np.ndarray, what: np.ndarray, bits: int) -> pa.RecordBatch:
    order = np.argsort(key)
    what = what[order]
    ascending, begin = _part_of(key[order], bits)
    return _packed([(part, which, None, _deltas(ascending[x]), *((_narrow(what[x]), None) if which == _WORDS else (None, what[x].tobytes()))) for part, x in _rows_of(begin)])


def _rare_words(bits: int):
    """The packed rows of ``_add_up`` as those of ``_entries``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in chain((row for batch in batches for row in batch.to_pylist()), [None]):
            if row is not None:
                tokens = _undone(row["keys"]) ^ _SIGN
                held.append((pair_keys((tokens * _STEP).view(np.int64), _STATE), _wide(row["counts"], len(tokens))))
                size += len(tokens)
            if size >= (1 if row is None else GATHERED):
                yield _entry_rows(_WORDS, *(np.concatenate(x) for x in zip(*held)), bits)
                held, size = [], 0

    return pack


def _documents(rows: np.ndarray, documents: np.ndarray, bits: int) -> pa.RecordBatch:
    """What is known of documents where they are, a row per 4,096 rows of the table; these go along with any part."""
    block = rows >> ASSEMBLED_BITS
    documents["place"] = rows & ((1 << ASSEMBLED_BITS) - 1)
    at = np.append(_first_of(block), len(rows))
    return _packed([(int(block[a]) % (1 << bits), _DOCUMENTS, int(block[a]), None, None, documents[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])])


def _word_scorer(shared, bits: int):
    """Texts, by their hashes, with the sums of the words that are looked up here, and all other words, which are joined."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, gathered, size = batch.column(0).to_numpy(), [], 0
            documents = np.zeros(len(ids), _DOCUMENT)
            documents["text"] = batch.column(1).to_numpy()
            for low, high, tokens, begin in sequences(batch.column(2)):
                row_of = np.repeat(np.arange(high - low), np.diff(begin))
                key = pair_keys((tokens.view(np.uint64) * _STEP).view(np.int64), _STATE)
                found = head.find(key)
                word = head.kinds[found] & WORD != 0
                documents["known"][low:high] = np.bincount(row_of[word], minlength=high - low)
                documents["base"][low:high] = np.bincount(row_of, head.words[found], high - low)
                gathered.append((ids[low:high][row_of[~word]], key[~word]))
                size += len(gathered[-1][1])
                if size >= GATHERED:
                    yield from _wanted(_by_key(*(np.concatenate(x) for x in zip(*gathered))), bits)
                    gathered, size = [], 0
            if size:
                yield from _wanted(_by_key(*(np.concatenate(x) for x in zip(*gathered))), bits)
            yield _documents(ids, documents, bits)

    return score


def _scorer(shared, bits: int):
    """Documents with the sums of the pairs and states that are looked up here, and the keys of others that are joined.

    A sequence may be a pair if all but its last word may be a state, and all but its first a pair (or
    a frequent word); it may be a state if all but its first word may be one.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, gathered, size = batch.column(0).to_numpy(), [], 0
            documents = np.zeros(len(ids), _DOCUMENT)
            documents["doc_id"], documents["no_id"] = pc.fill_null(batch.column(1), 0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            documents["held_out"], documents["text"] = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            for low, high, tokens, begin in sequences(batch.column(4)):
                lengths = np.diff(begin)
                row_of = np.repeat(np.arange(low, high), lengths)
                place = np.arange(len(tokens)) - np.repeat(begin[:-1], lengths)
                documents["n_tokens"][low:high] = lengths
                sequence = np.zeros(len(tokens), np.uint64)
                pair = state = np.ones(len(tokens), np.bool_)
                for length in range(1, head.longest + 1):
                    sequence = (np.roll(sequence, 1) + tokens.view(np.uint64)) * _STEP
                    there = place >= length - 1
                    as_pair, as_state = there & np.roll(state, 1) & pair, there & state
                    at = np.flatnonzero(as_pair | as_state)
                    if not len(at):
                        break
                    key = pair_keys(sequence[at].view(np.int64), _STATE)
                    found = head.find(key)
                    kind = head.kinds[found]
                    documents["own"][low:high] += np.bincount(row_of[at] - low, head.values[found], high - low)
                    pair, state = np.zeros(len(tokens), np.bool_), np.zeros(len(tokens), np.bool_)
                    joined = np.zeros(len(at), np.bool_)
                    for now, before, bit, others in ((pair, as_pair, PAIR, head.pairs), (state, as_state, STATE, head.states)):
                        here = kind & bit != 0
                        open_ = np.flatnonzero(before[at] & ~here)
                        open_ = open_[_may_have(others, key[open_])]
                        here[open_] = True
                        now[at] = here & before[at]
                        if length > 1 or bit == STATE:
                            joined[open_] = True
                    gathered.append((ids[row_of[at[joined]]], key[joined]))
                    size += len(gathered[-1][1])
                if size >= GATHERED:
                    yield from _wanted(_by_key(*(np.concatenate(x) for x in zip(*gathered))), bits)
                    gathered, size = [], 0
            if size:
                yield from _wanted(_by_key(*(np.concatenate(x) for x in zip(*gathered))), bits)
            yield _documents(ids, documents, bits)

    return score


def _row_sums(rows: list[np.ndarray], values: list[np.ndarray], words_: list[np.ndarray]) -> pa.RecordBatch:
    rows, values, is_word = (np.concatenate(x) for x in (rows, values, words_))
    row, at = np.unique(rows, return_inverse=True)
    sums = lambda x: np.bincount(at, x, len(row))
    none = [pa.nulls(len(row), f.type) for f in _SUMS_TYPE][1:4]
    return pa.RecordBatch.from_arrays([pa.array(row), *none, pa.array(sums(is_word).astype(np.int64)), pa.array(sums(values * is_word)), pa.array(sums(values))], [f.name for f in _SUMS_TYPE])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents as they are, and sums per document of the values of joined keys."""
    rows, values, words_, size = [], [], [], 0
    for batch in batches:
        documents = batch.filter(pc.is_null(batch["places"]))
        if len(documents):
            yield pa.RecordBatch.from_arrays(documents["sums"].flatten(), [f.name for f in _SUMS_TYPE])
        batch = batch.filter(pc.and_(pc.is_valid(batch["places"]), pc.is_valid(batch["value"])))
        if len(batch):
            n = pc.binary_length(batch["places"]).to_numpy() // 2
            _, at, places = batch["places"].buffers()
            at = np.frombuffer(at, np.int32)[batch["places"].offset :]
            places = np.frombuffer(places, np.uint16)[at[0] // 2 : at[len(batch)] // 2]
            rows.append(np.repeat(batch["block"].to_numpy() << 16, n) | places)
            values.append(np.repeat(batch["value"].to_numpy(), n))
            words_.append(np.repeat(batch["word"].to_numpy(), n))
            size += len(places)
        if size >= GATHERED:
            yield _row_sums(rows, values, words_)
            rows, values, words_, size = [], [], [], 0
    if size:
        yield _row_sums(rows, values, words_)


def _sums_of(packed: bytes, of: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    n = len(packed) // (2 + 8 * len(of))
    return np.frombuffer(packed, "<u2", n), [np.frombuffer(packed, kind, n, 2 * n + 8 * n * k) for k, (_, kind) in enumerate(of)]


def _joined(of: tuple):
    """What the entries of a part are worth to the documents that look for them: sums, packed to a row per 4,096 rows of the table."""

    def join(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        undone = lambda i: _undone(table["keys"][i].as_py())
        sides = []
        for which in (_WORDS, _TREE):
            at = np.flatnonzero(kinds == which).tolist()
            keys = [undone(i) for i in at]
            values = [_wide(table["counts"][i].as_py(), len(k)) if which == _WORDS else np.frombuffer(table["data"][i].as_py(), "<f8") for i, k in zip(at, keys)]
            keys, values = (np.concatenate([np.zeros(0, x), *y]) for x, y in ((np.uint64, keys), (np.float64, values)))
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            first = _first_of(keys)
            keys, values = keys[first], np.add.reduceat(values, first) if len(first) else values
            sides.append((keys, np.log10(values + 1), 1) if which == _WORDS else (keys, values, 0))

        def found() -> Iterator[pa.RecordBatch]:
            for i in np.flatnonzero(kinds == _WANTED).tolist():
                wanted, data = undone(i), table["data"][i].as_py()
                at = np.concatenate(([0], np.cumsum(_wide(table["counts"][i].as_py(), len(wanted)) * 2))).astype(np.int32)
                places = pa.Array.from_buffers(pa.binary(), len(wanted), [None, pa.py_buffer(at), pa.py_buffer(data)])
                for keys, values, word in sides:
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                        hit = np.flatnonzero(keys[at] == wanted)
                        n = len(hit)
                        columns = [np.full(n, table["block"][i].as_py()), places.take(pa.array(hit)), pa.nulls(n, _SUMS_TYPE), values[at[hit]], np.full(n, word)]
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["block", "places", "sums", "value", "word"])

        out = [(table["block"][i].as_py(), table["data"][i].as_py(), None) for i in np.flatnonzero(kinds == _DOCUMENTS).tolist()]
        for sums in _spread(found()):
            row = sums["row"].to_numpy()
            block = row >> ASSEMBLED_BITS
            columns = [(row & ((1 << ASSEMBLED_BITS) - 1)).astype("<u2"), *(sums[{"known": "n_known"}.get(name, name)].to_numpy() for name, _ in of)]
            at = np.append(_first_of(block), len(row))
            out += [(int(block[a]), None, b"".join(x[a:b].tobytes() for x in columns)) for a, b in zip(at[:-1], at[1:])]
        block, documents, sums = zip(*out) if out else ((), (), ())
        return pa.table({"block": pa.array(block, pa.int64()), "documents": pa.array(documents, pa.binary()), "sums": pa.array(sums, pa.binary())})

    return join


def _assembled(of: tuple):
    """The documents of a block with the sums of all parts."""

    def assemble(table: pa.Table) -> pa.Table:
        documents = np.concatenate([np.frombuffer(x, _DOCUMENT) for x in table["documents"].drop_null().to_pylist()])
        index = np.zeros(1 << ASSEMBLED_BITS, np.int64)
        index[documents["place"]] = np.arange(len(documents))
        for packed in table["sums"].drop_null().to_pylist():
            place, sums = _sums_of(packed, of)
            for (name, _), x in zip(of, sums):
                documents[name][index[place]] += x
        found = {"text": documents["text"]} | {name: documents[name] for name, _ in of}
        if of == _OF_TREE:
            found |= {"doc_id": pa.array(documents["doc_id"], mask=documents["no_id"] != 0), "held_out": documents["held_out"] != 0, "n_tokens": documents["n_tokens"]}
        return pa.table({k: x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for k, x in found.items()})

    return assemble


def _least_of_head(entries: DataFrame, head_rows: int) -> float:
    """The least class of counts whose entries and those of greater classes are at most ``head_rows``."""
    sizes = entries.groupBy("class").count().toPandas().sort_values("class", ascending=False)
    fit = sizes["count"].cumsum() <= head_rows
    return float(sizes["class"][fit].min()) if fit.any() else math.inf


def language_model_scores(
    docs: DataFrame, modulus: int = 7, remainder: int = 2, min_context: int = MIN_CONTEXT, min_pair: int = MIN_PAIR, head_rows: int = HEAD_ROWS
) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs of anything but ASCII white space, with A-Z in lower case, and one end
    token; a null text has the end token alone. ``base_score`` sums log10 add-one word
    frequencies, ``score`` the log10 probabilities of the suffix tree. Without training
    rows every token is unknown: each counts with the frequency of an unknown word; an empty
    table has no result rows. Repeated rows are learnt from and scored each; other columns
    are not looked at. ``head_rows`` changes no result.
    """
    if min_context < min_pair:
        raise ValueError("a context needs at least as many occurrences as a pair")
    spark = docs.sparkSession
    ship(spark)
    held_out = in_fold("doc_id", modulus, remainder)
    training = docs.where(~held_out).select(text_of().alias("text"))
    word_bits = min(max(math.ceil(math.log2(max(training.rdd.getNumPartitions(), 1))), 4), 12)
    counted = training.mapInArrow(_count_words(word_bits), "part long, keys binary, counts binary")
    counted = _stored(counted.groupBy("part").applyInArrow(_add_up(min_pair), "token long, n long, words long, keys binary, counts binary"))
    counts, rare = counted.where("token is not null").select("token", "n"), counted.where("token is null").select("keys", "counts")
    row = counted.agg(F.sum("n").alias("total"), F.sum("words").alias("distinct"), F.max(F.when(F.col("token") == int(_END), F.col("n"))).alias("texts")).first()
    total, distinct = row["total"] or 0, row["distinct"] or 0
    levels = grow(training, counts, total, distinct, row["texts"] or 0, min_context, min_pair)
    columns = ["context", "token", "n", "value", "kind"]
    kind_of = lambda x: x.cast("long").alias("kind")
    parts = [counts.select(F.lit(0).cast("long").alias("context"), "token", "n", F.log10(F.col("n") + 1).alias("value"), kind_of(F.lit(WORD | PAIR)))]
    parts += [level.select(*columns[:4], kind_of(F.when(F.col("token") == int(_STATE), STATE).otherwise(PAIR))) for level in levels]
    entries = reduce(DataFrame.unionByName, parts).withColumn("class", F.floor(F.log2("n") * 8))  # all of them are stored tables
    least = _least_of_head(entries, head_rows)
    in_head = F.col("class") >= F.lit(least)

    others = entries.where(~in_head).select(columns)
    others_of = [bitmap(others.where(F.col("kind").bitwiseAND(bit) != 0), JOINED_BITS, _entry_keys) for bit in (PAIR, STATE)]
    head = entries.where(in_head).select("context", "token", "value", "kind").mapInArrow(_with_keys, "key long, value double, kind long")
    head = _fetched(head.repartition(SENDERS))  # columns, not half a million row objects
    shared = spark.sparkContext.broadcast(Head(*(head[c].to_numpy() for c in ("key", "value", "kind")), *others_of, len(levels) + 1))
    del head, others_of
    bits = max(math.ceil(math.log2(max(total, 1) / PART_TOKENS)), 4)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_of().alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    is_word = F.col("kind").bitwiseAND(WORD) != 0

    def summed(looked_up: DataFrame, of: tuple, schema: str) -> DataFrame:
        blocks = looked_up.groupBy("part").applyInArrow(_joined(of), "block long, documents binary, sums binary")
        return blocks.groupBy("block").applyInArrow(_assembled(of), schema)

    # Words on their own, by the hashes of texts: rows have no numbers that last, and less is shuffled at a time.
    packed = rows.select("row", "hash", "text").mapInArrow(_word_scorer(shared, bits), _PACKED).unionByName(rare.mapInArrow(_rare_words(bits), _PACKED))
    packed = packed.unionByName(others.where(is_word).mapInArrow(_entries(bits), _PACKED))
    of_words = _stored(summed(packed, _OF_WORDS, "text long, known long, base double").groupBy("text").agg(F.max("known").alias("n_known"), F.max("base").alias("base")))
    packed = rows.select("row", "doc_id", "held_out", "hash", "text").mapInArrow(_scorer(shared, bits), _PACKED).unionByName(others.where(~is_word).mapInArrow(_entries(bits), _PACKED))
    scored = summed(packed, _OF_TREE, "text long, own double, doc_id long, held_out boolean, n_tokens long").join(of_words, "text")
    unknown = F.col("n_tokens") * -math.log10(total + distinct + 1)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + unknown).alias("base_score"),
        (F.col("base") + F.col("own") + unknown).alias("score"),
    )
