"""Vectorised text helpers for use inside tasks: words, hashes and shingles of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PRIME = np.uint64((1 << 31) - 1)
_PRIME_BASE = 1_640_531_527
_kept: list[tuple[np.ndarray, ...]] = []


def _series(n: int) -> tuple[np.ndarray, ...]:
    steps = np.full((2, n), [[_BASE], [_INVERSE]])
    steps[:, 0] = 1
    out = [np.multiply.accumulate(x, out=x) for x in steps]
    for base in (_PRIME_BASE, pow(_PRIME_BASE, -1, int(_PRIME))):
        x, done = np.ones(n, np.uint64), 1
        while done < n:
            more = min(done, n - done)
            x[done : done + more] = x[:more] * np.uint64(pow(base, done, int(_PRIME))) % _PRIME
            done += more
        out.append(x)
    return tuple(out)


def powers(n: int) -> tuple[np.ndarray, ...]:
    """The first n powers of a base and of its inverse, modulo 2**64 and then modulo a prime.

    Those that a slice needs are kept by the worker; those of a longer text are not.
    """
    if n > SLICE_BYTES + 1:
        return _series(n)
    if not _kept:
        _kept.append(_series(SLICE_BYTES + 1))
    return tuple(x[:n] for x in _kept[0])


class Spans:
    """Hashes of any spans of some bytes: equal bytes, equal hashes.

    A polynomial modulo 2**64 alone has strings of 1,000 bytes and more that collide for
    every base, so spans from 512 bytes on also have one modulo a prime in their hash.
    """

    def __init__(self, data: np.ndarray):
        self._power = powers(len(data) + 1)
        self._values = np.add(data, np.uint64(1), dtype=np.uint64)
        self.sums = self._summed(self._values * self._power[0][:-1])
        self.inverse = self._power[1]

    def part(self, low: int, high: int) -> Spans:
        """For spans of fewer than 512 bytes of the bytes from low to high, counted from low."""
        out = object.__new__(Spans)
        out.sums, out.inverse = self.sums[low : high + 1], self.inverse[low : high + 1]
        return out

    @staticmethod
    def _summed(terms: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        return sums

    @cached_property
    def _prime_sums(self) -> np.ndarray:
        terms = self._values * self._power[2][:-1]
        # Terms are below 2**40: 2**23 of them fit without a modulo.
        return self._summed(terms if len(terms) < 1 << 23 else terms % _PRIME)

    def short(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For spans of fewer than 512 bytes."""
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.short(starts, ends) + (ends - starts).astype(np.uint64)
        long = np.flatnonzero(ends - starts >= 512)
        if len(long):
            a, b = starts[long], ends[long]
            out[long] += ((self._prime_sums[b] - self._prime_sums[a]) % _PRIME * self._power[3][a] % _PRIME) << np.uint64(32)
        return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def among(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(wanted), np.bool_)
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted


def slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their bytes, offsets of each row in them and the end); null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + slice_bytes, "right")) - 1
        high = min(max(high, low + 1), len(column))
        own = offsets[low : high + 1]
        yield low, high, data[own[0] : own[-1]], own - own[0]
        low = high


def word_table(words: bytes) -> np.ndarray:
    """Byte to byte: 0 for bytes outside words, others themselves, A-Z in lower case."""
    table = np.zeros(256, np.uint8)
    keep = np.frombuffer(words, np.uint8)
    table[keep] = keep
    upper = np.arange(65, 91)
    table[upper] = np.where(table[upper] > 0, upper + 32, 0)
    return table


#: ASCII letters and digits and every byte above ASCII.
ALNUM = word_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Everything but ASCII white space.
NONSPACE = word_table(bytes(sorted(set(range(1, 256)) - {0x20, *range(0x09, 0x0E)})))
# A NUL byte inside a text would read as a separator: it stands as another byte that UTF-8 never has.
NONSPACE[0] = 0xFF


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, where each row's words begin, and the mapped bytes."""
    mapped = np.frombuffer(data.tobytes().translate(table.tobytes()), np.uint8)
    inside = np.zeros(len(data) + 2, np.bool_)
    inside[1:-1] = mapped != 0
    left, here, right = inside[:-2], inside[1:-1], inside[2:]
    starts, ends = here & ~left, here & ~right
    first = offsets[1:-1]
    first = first[(first > 0) & (first < len(data))]
    starts[first] = here[first]
    ends[first - 1] = here[first - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets), mapped


def span_hashes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans: equal bytes, equal hashes."""
    return Spans(mapped).of(starts, ends)


def join_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """For every position with n values from it on, one hash of these n in order."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i : i + len(out)]
    return mix(out)


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of n words, and where each row's begin.

    A row of fewer words, but not none, has one shingle: all its words.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(out_bounds[-1], np.uint64)
    joined = join_hashes(hashes, n)
    full = counts >= n
    within = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], made)
    at = np.repeat(bounds[:-1], made) + within
    whole = np.repeat(full, made)
    out[whole] = joined[at[whole]]
    for row in np.flatnonzero((counts > 0) & ~full):
        own = hashes[bounds[row] : bounds[row + 1]]
        out[out_bounds[row]] = join_hashes(own, len(own))[0] ^ np.uint64(len(own))
    return out, out_bounds


_LETTER = np.zeros(256, np.bool_)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII signs and digits; no white space, no control characters.
_SIGN = np.zeros(256, np.bool_)
_SIGN[[*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_SIGN_BEFORE = _SIGN.copy()
_SIGN_BEFORE[0x27] = False  # an apostrophe may belong to the letters after it


def letter_cuts(data: np.ndarray) -> np.ndarray:
    """Where a run of ASCII letters ends before a sign or digit, or begins after one."""
    cut = np.zeros(len(data), np.bool_)
    letter, sign = _LETTER[data], _SIGN[data]
    cut[1:] = (letter[:-1] & sign[1:]) | (_SIGN_BEFORE[data[:-1]] & letter[1:])
    return cut


class PieceCache:
    """64-bit keys to integers, within one worker: a sorted part and a recent part, bounded."""

    def __init__(self, most: int = 3_000_000, recent: int = 200_000):
        self.most, self.recent = most, recent
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.new = np.zeros(1, np.uint64), np.full(1, -1, np.int64), {}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = np.where(self.keys[at] == keys, self.values[at], -1)
        rest = np.flatnonzero(found < 0)
        if self.new and len(rest):
            found[rest] = [self.new.get(k, -1) for k in keys[rest].tolist()]
        return found

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.new.update(zip(keys.tolist(), np.asarray(values).tolist()))
        if len(self.new) > self.recent:
            if len(self.keys) + len(self.new) > self.most:
                self.clear()
                return
            keys = np.concatenate((self.keys, np.fromiter(self.new.keys(), np.uint64, len(self.new))))
            values = np.concatenate((self.values, np.fromiter(self.new.values(), np.int64, len(self.new))))
            order = np.argsort(keys, kind="stable")
            self.keys, self.values, self.new = keys[order], values[order], {}
