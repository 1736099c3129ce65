"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every string that occurs
in that text. A document is parsed greedily into longest matches; the number of phrases
times the logarithm of the automaton's text length is the cost of describing the document
in that language, and the cheapest language wins. Documents are parsed side by side, one
byte of each at a time. A long document is parsed in segments at once, each from the root;
where the one before ends in another state, the segment is parsed again from that state
until both parses are in the same state, so the result is that of one parse of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_fold, ship, text_of
from .textkernels import slices

#: Labelled text per language in an automaton, in bytes, and for all languages together. There are fewer than
#: twice as many states, of 8 bytes each, and at most as many that branch, of up to 1 kB: 260 MB are broadcast at most.
TRAIN_BYTES = 32_000
ALL_TRAIN_BYTES = 256_000
#: Labelled documents per language that this text is taken from, at most.
TRAIN_ROWS = 400
#: Bytes of a segment.
SEGMENT = 512
_SLICE = 2 << 20
#: Set in a move that begins a new phrase.
_NEW = np.int32(1 << 30)

# Bytes that are no letters read as a space: ASCII but a-z (texts are in lower case already).
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[:128] = 0x20
_NORMAL[97:123] = np.arange(97, 123)


def normalised(column: pa.Array, slice_bytes: int = _SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of texts in lower case, runs of anything but letters and non-ASCII as one space."""
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    for low, high, data, offsets in slices(lower, slice_bytes):
        data = _NORMAL[data]
        keep = np.ones(len(data), np.bool_)
        keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
        yield low, high, data[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for byte in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at, last = last, new
        while at != -1 and byte not in moves[at]:
            moves[at][byte] = new
            at = link[at]
        if at == -1:
            continue
        state = moves[at][byte]
        if length[state] == length[at] + 1:
            link[new] = state
            continue
        copy = len(moves)
        moves.append(dict(moves[state]))
        length.append(length[at] + 1)
        link.append(link[state])
        link[state] = link[new] = copy
        while at != -1 and moves[at].get(byte) == state:
            moves[at][byte] = copy
            at = link[at]
    return moves


class CrossParser:
    """The automata of all languages in one table of moves.

    A state with one move has its byte and target; one that branches has a row of targets.
    """

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        self.log_length = np.array([np.log2(max(len(texts[x]), 2)) for x in self.languages])
        seen = sorted({b for x in texts.values() for b in x} - {0})
        # Bytes to columns of the rows; column 0 is for bytes that no training text has.
        self.code = np.zeros(256, np.int32)
        self.code[seen] = np.arange(1, len(seen) + 1)
        width = self.width = len(seen) + 1
        only, target, rows, self.roots, defaults, size = [], [], [], [], [], 0
        for language in self.languages:
            moves = suffix_automaton(texts[language])
            root = size
            # Where a move is missing a phrase begins at the root; a byte that the text does not have is a phrase of its own.
            default = np.full(width, np.int32(root) | _NEW, np.int32)
            for byte, to in moves[0].items():
                if byte:
                    default[self.code[byte]] = np.int32(root + to) | _NEW
            for state, own in enumerate(moves):
                own = {self.code[byte]: root + to for byte, to in own.items() if byte}
                if state == 0 or len(own) > 1:
                    row = default.copy()
                    if state:
                        row[list(own)] = list(own.values())
                    only.append(-1)
                    target.append(len(rows))
                    rows.append(row)
                else:
                    byte, to = next(iter(own.items()), (width, 0))
                    only.append(byte)
                    target.append(to)
            self.roots.append(root)
            defaults.append(default)
            size += len(moves)
        self.only, self.target = np.array(only, np.int32), np.array(target, np.int32)
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.defaults = np.concatenate(defaults) if defaults else np.zeros(0, np.int32)

    def _move(self, state: np.ndarray, code: np.ndarray, language: np.ndarray) -> np.ndarray:
        only, target = self.only[state], self.target[state]
        missing = self.defaults[language + code]
        out = np.where(only == code, target, missing)
        branch = np.flatnonzero(only < 0)
        out[branch] = self.rows[target[branch] * self.width + code[branch]]
        return out

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many phrases each row has in each language."""
        sizes, n_languages = np.diff(offsets), len(self.languages)
        pieces = -(-sizes // SEGMENT)
        row = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[:-1][row] + SEGMENT * number
        length = np.minimum(offsets[1:][row] - begin, SEGMENT)
        codes = self.code[data]
        # Every segment from the root, the longest first.
        order = np.argsort(-length, kind="stable")
        where, active = begin[order], np.searchsorted(-length[order], -np.arange(SEGMENT), "left")
        counts = np.zeros((n_languages, len(row)), np.int64)
        ends = np.repeat(np.array(self.roots, np.int32)[:, None], len(row), axis=1)
        for i in range(n_languages):
            state, count, base = ends[i].copy(), np.zeros(len(row), np.int64), np.int64(i * self.width)
            for step in range(int(length.max()) if len(length) else 0):
                n = active[step]
                moved = self._move(state[:n], codes[where[:n] + step], base)
                count[:n] += moved >= _NEW
                state[:n] = moved & (_NEW - 1)
            counts[i, order], ends[i, order] = count, state
        # Again from where the segment before ended, in rounds while ends change.
        starts = np.repeat(np.array(self.roots, np.int32)[:, None], len(row), axis=1)
        later = np.flatnonzero(number > 0)
        language, segment = (x.ravel() for x in np.meshgrid(np.arange(n_languages), later, indexing="ij"))
        while len(segment):
            old, new = starts[language, segment], ends[language, segment - 1]
            changed = old != new
            language, segment, old, new = language[changed], segment[changed], old[changed], new[changed]
            starts[language, segment] = new
            # A segment whose parses meet ends as before; else the next one begins elsewhere.
            again = np.zeros(len(segment), np.bool_)
            at = np.arange(len(segment))
            for step in range(SEGMENT):
                over = length[segment[at]] <= step
                ends[language[at[over]], segment[at[over]]] = new[over]
                again[at[over]] = True
                at, old, new = at[~over], old[~over], new[~over]
                if not len(at):
                    break
                code, base = codes[begin[segment[at]] + step], language[at] * self.width
                a, b = self._move(old, code, base), self._move(new, code, base)
                counts[language[at], segment[at]] += (b >= _NEW).astype(np.int64) - (a >= _NEW)
                old, new = a & (_NEW - 1), b & (_NEW - 1)
                apart = old != new
                at, old, new = at[apart], old[apart], new[apart]
            if len(at):
                ends[language[at], segment[at]] = new
                again[at] = True
            follows = np.flatnonzero(again)
            follows = follows[segment[follows] + 1 < len(row)]
            follows = follows[number[segment[follows] + 1] > 0]
            language, segment = language[follows], segment[follows] + 1
        out = np.zeros((n_languages, len(sizes)), np.int64)
        for i in range(n_languages):
            out[i] = np.bincount(row, counts[i], minlength=len(sizes))
        return out


def training_texts(docs: DataFrame, held_out: Column) -> dict[str, bytes]:
    """Labelled text of the rows that are not held out: per language the first texts in hash order, up to ``TRAIN_BYTES``."""
    ship(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    # No more of a text than the budget of its language is of use.
    rows = rows.where(F.octet_length("text") > 0).select("lang", F.substring("text", 1, TRAIN_BYTES).alias("text"), F.xxhash64("doc_id", "text").alias("order"))
    # A hash takes about twice the rows wanted of each language, so that few are ranked.
    n = rows.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("order"), F.lit(1_000_000)) / 1e6
    rows = rows.join(F.broadcast(n), "lang").where((F.col("n") <= 4 * TRAIN_ROWS) | (place < 2 * TRAIN_ROWS / F.col("n")))
    in_lang = Window.partitionBy("lang").orderBy("order", "text")
    chosen = rows.withColumn("place", F.row_number().over(in_lang)).where(F.col("place") <= TRAIN_ROWS)
    budget = TRAIN_BYTES

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        parts, left = [], budget
        for text in frame.sort_values("place")["text"]:
            _, _, data, _ = next(normalised(pa.array([text], pa.string())))
            end = min(len(data), left - 1)
            while 0 < end < len(data) and data[end] & 0xC0 == 0x80:
                end -= 1
            if end > 0:
                parts.append(data[:end].tobytes())
                left -= end + 1
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "text": [b"\0".join(parts)]})

    texts = {x["lang"]: bytes(x["text"]) for x in chosen.groupBy("lang").applyInPandas(gather, "lang string, text binary").collect()}
    most = ALL_TRAIN_BYTES // max(len(texts), 1)
    return {lang: text[:most] for lang, text in texts.items() if text}


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser: CrossParser = shared.value
        for batch in batches:
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            if parser.languages:
                for low, high, data, offsets in normalised(batch.column(1)):
                    cost = parser.phrases(data, offsets) * parser.log_length[:, None]
                    own = cost.argmin(axis=0)
                    least = cost.min(axis=0)
                    cost[own, np.arange(high - low)] = np.inf
                    best[low:high] = own
                    score[low:high] = 1 - least / cost.min(axis=0)
            else:
                lettered[:] = False
            names = np.array([*parser.languages, "und"], object)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in (0, 2)], pa.array(names[np.where(lettered, best, len(names) - 1)], pa.string()), pa.array(np.where(lettered, score, 0.0))],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return predict


def language_ids(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    ``score`` is the share by which the runner-up costs more, 1 with one learnt language.
    ``und`` and 0 where the text is null or has no letter, or where nothing could be
    learnt. Ties go to the first language by name. Rows with a null language are predicted
    but not learnt from; repeated rows are predicted each; other columns are not looked at.
    """
    held_out = in_fold("doc_id", modulus, remainder)
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(training_texts(docs, held_out)))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return rows.mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double")
