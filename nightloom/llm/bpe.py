"""Byte-pair encoding and decoding with a contiguous rank array per word.

A word's parts and the ranks of its neighbouring pairs are two short arrays. The least rank
is found by a scan, the boundary behind it is deleted, and the ranks of the two neighbours
are looked up again, until no pair can be merged. A scan costs the word's length, so words
of over ``SCAN_PARTS`` parts keep the same ranks in a heap. Texts are cut at white space, and
each worker remembers the ids of the pieces that it has met, in a bounded cache.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Words of more parts than this use a heap in place of scans; the ids are the same.
SCAN_PARTS = 160
#: A worker remembers pieces of up to so many characters, and so many characters of them in all.
PIECE_CHARS = 64
CACHE_CHARS = 24_000_000
#: Ids or characters in a batch that goes back to Spark, if one text has no more.
BATCH_ITEMS = 2_000_000

_NONE = 1 << 60, -1
# White space to Python's split that the tokenizer reads as signs.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
# All versions of Unicode agree on these letters, so that Python's own normalisation serves.
_STABLE = re.compile("[\x00-\u052f]*")
# What this kind of tokenizer does to a text, its words, and the signs that stand for bytes.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD = regex.compile(_WORDS)
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {b: b for b in _PRINTED} | {256 + k: b for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_open: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts by the vocabulary, merges, normalizer and pre-tokenizer of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [x for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(x)]
        if model["type"] != "BPE" or odd or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"not a plain byte-pair tokenizer: {path}")
        if spec["decoder"] is not None:
            raise ValueError(f"only tokenizers whose tokens are joined by a space can be decoded: {path}")
        library = Tokenizer.from_file(path)  # for its normalizer and pre-tokenizer, which follow one version of Unicode
        self._normal = library.normalizer.normalize_str if library.normalizer else lambda x: x
        self._words = library.pre_tokenizer.pre_tokenize_str
        steps, changes = (spec["pre_tokenizer"] or {}).get("pretokenizers", []), (spec["normalizer"] or {}).get("normalizers", [])
        # Where the pre-tokenizer keeps nothing but such words, texts can be cut at white space first.
        cut = steps[0] if steps else {}
        self._drops_space = cut.get("invert") is True and cut["behavior"] == "Removed" and cut["pattern"].get("Regex") == _WORDS and [x["type"] for x in changes] == _NORMALIZER
        self._vocabulary: dict[str, int] = model["vocab"]
        sign = {b: chr(c) for c, b in _BYTE_OF.items()}
        self._inner = [self._vocabulary[sign[b]] for b in range(256)]
        self._last = [self._vocabulary[sign[b] + (model.get("end_of_word_suffix") or "")] for b in range(256)]
        self._pairs: dict[tuple[int, int], tuple[int, int]] = {}  # rank and merged id
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self._pairs[self._vocabulary[a], self._vocabulary[b]] = rank, self._vocabulary[a + b]
        self._special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._marks = re.compile("(" + "|".join(re.escape(x) for x in sorted(self._special, key=len, reverse=True)) + ")") if self._special else None
        names = {i: token for token, i in self._vocabulary.items()} | {i: token for token, i in self._special.items()}
        self.tokens = np.array([names.get(i) for i in range(max(names) + 1)], object)
        self._known, self._known_words = _Known(self._piece), _Known(self._word)

    def _scanned(self, parts: list[int]) -> list[int]:
        pairs = self._pairs
        ranks = [pairs.get(pair, _NONE) for pair in pairwise(parts)]
        while ranks:
            least = min(ranks)
            if least is _NONE:
                break
            i = ranks.index(least)
            parts[i] = least[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), _NONE)
            if i < len(ranks):
                ranks[i] = pairs.get((parts[i], parts[i + 1]), _NONE)
        return parts

    def _heaped(self, parts: list[int]) -> list[int]:
        pairs, n = self._pairs, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(pairs[pair][0], i) for i in range(n - 1) if (pair := (parts[i], parts[i + 1])) in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            found = pairs.get((parts[i], parts[j])) if parts[i] >= 0 and j < n else None
            if not found or found[0] != rank:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = found[1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (pair := (parts[left], parts[after[left]])) in pairs:
                    heapq.heappush(heap, (pairs[pair][0], left))
        return [x for x in parts if x >= 0]

    def _word(self, word: bytes) -> bytes:
        """Ids of one word, as bytes of the pre-tokenizer's UTF-8."""
        parts = [self._inner[c] for c in word]
        parts[-1] = self._last[word[-1]]
        return array("i", self._scanned(parts) if len(parts) <= SCAN_PARTS else self._heaped(parts)).tobytes()

    def _piece(self, piece: str) -> bytes:
        if self._drops_space and _STABLE.fullmatch(piece):
            words = _WORD.findall(unicodedata.normalize("NFC", piece).replace("\u03a3", "\u03c3").lower())
            return b"".join([self._known_words[word.encode()] for word in words])
        return b"".join([self._known_words[word.translate(_BYTE_OF).encode("latin-1")] for word, _ in self._words(self._normal(piece))])

    def _plain(self, text: str) -> bytes:
        if not self._drops_space:
            return self._piece(text)
        pieces = _SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
        return b"".join(map(self._known.__getitem__, pieces))

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text; strings of special tokens in it become these tokens."""
        if not self._marks or not any(x in text for x in self._special):
            return np.frombuffer(self._plain(text), np.int32)
        parts = self._marks.split(text)
        return np.frombuffer(b"".join(np.int32(self._special[x]).tobytes() if k % 2 else self._plain(x) for k, x in enumerate(parts)), np.int32)

    def text(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces; ids that the vocabulary does not have are passed over."""
        ids = ids[(ids >= 0) & (ids < len(self.tokens))]
        return " ".join([x for x in self.tokens[ids].tolist() if x is not None])


class _Known(dict):
    """Pieces and their ids as bytes; long pieces are not kept, and a full cache begins anew."""

    def __init__(self, make):
        super().__init__()
        self._make, self._chars = make, 0

    def __missing__(self, piece: str) -> bytes:
        found = self._make(piece) if piece else b""
        if len(piece) <= PIECE_CHARS:
            self._chars += len(piece) + 60
            if self._chars > CACHE_CHARS:
                self.clear()
                self._chars = 0
            self[piece] = found
        return found


def _encoder(path: str) -> WordEncoder:
    if path not in _open:
        _open[path] = WordEncoder(path)
    return _open[path]


def _encode(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            low, size, parts = 0, 0, []
            texts = pc.fill_null(batch.column(batch.num_columns - 1), "")
            for high, text in enumerate(texts, 1):
                parts.append(encoder.ids(text.as_py()))
                size += len(parts[-1])
                if size >= BATCH_ITEMS or high == len(texts):
                    bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts)))
                    kept = [batch.column(i)[low:high] for i in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*kept, ids], names)
                    low, size, parts = high, 0, []

    return run


def _decode(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            low, size, texts = 0, 0, []
            lists = batch.column(batch.num_columns - 1)
            for high, ids in enumerate(lists, 1):
                texts.append(encoder.text(np.asarray(pc.fill_null(ids.values, -1))) if ids.is_valid else "")
                size += len(texts[-1])
                if size >= BATCH_ITEMS or high == len(lists):
                    kept = [batch.column(i)[low:high] for i in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names)
                    low, size, texts = high, 0, []

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, one row per row of ``docs``.

    A null text is empty and has no ids, as has one of white space alone. Repeated rows and
    null ids stay. A very long text is one list of ids; a very long word is merged by a heap.
    An empty table gives no rows; other columns, whatever their names, are not looked at.
    Nothing is shuffled.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_encode(path, ["doc_id", "ids"]), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with its column ``ids`` replaced by ``text``, the tokens joined by spaces.

    Null and empty lists give an empty text, ids outside the vocabulary and nulls in a list are
    passed over. All other columns stay but one named ``text``, whose place the result takes;
    an empty table gives no rows.
    """
    ship(encoded.sparkSession)
    kept = [c for c in encoded.columns if c.lower() not in ("ids", "text")]
    own = encoded.select(*[F.col(f"`{c}`") for c in kept], F.col("ids").cast("array<int>").alias("ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(_decode(path, [*kept, "text"]), f"{schema}, text string" if schema else "text string")


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and the SHA-256 of its ids and of the text they decode to."""
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    coded = encode(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), "ids")
    return decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
