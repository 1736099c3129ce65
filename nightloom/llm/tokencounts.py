"""Token counts by a two-tier look-up of pre-tokens on the map side, with no shuffle.

A text is cut where a byte-level tokenizer always cuts: before a space that a non-space
follows, and between an ASCII letter and other ASCII signs. Tier one is a broadcast table of the hashes and token counts of
frequent pieces, taken from a bounded random sample of all documents; it only saves time. Tier two
is a cache in each Python worker, filled by the tokenizer itself for pieces tier one
misses. Hashes have 64 bits.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of
from .textkernels import PieceCache, letter_cuts, slices, span_hashes

#: Documents sampled for tier one, about (at most 20,000 characters of each), and the pieces it holds at most (9 bytes each).
WARM_DOCUMENTS = 500
TABLE_PIECES = 100_000

_SPACES = np.zeros(256, np.bool_)
# ASCII white space, and the first bytes of the wider kinds: no cut is made before those.
_SPACES[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_open: dict[str, tuple] = {}


def opened(path: str) -> tuple[Callable[[list[str]], list[int]], bool, tuple[bytes, ...], PieceCache]:
    """Once per process: counts of a list of texts; whether the tokenizer cuts as the pieces do; its special strings; the cache."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _open[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False, (), PieceCache())
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            cut = spec["pre_tokenizer"] or {}
            plain = not spec["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
            special = tuple(x["content"].encode() for x in spec["added_tokens"])
            _open[path] = (lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], plain, special, PieceCache())
    return _open[path]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, and where each row's begin."""
    space = data == 0x20
    cut = np.zeros(len(data), np.bool_)
    cut[:-1] = space[:-1] & ~_SPACES[data[1:]]
    cut |= letter_cuts(data)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    # A space at the end of a row is not followed by anything of that row.
    last = offsets[1:] - 1
    last = last[(last >= 0) & (np.diff(offsets) > 1)]
    cut[last[space[last]]] = False
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def _counter(path: str, table):
    """Per row: doc_id, n_bytes and n_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, plain, special, cache = opened(path)
        known, known_n = table.value
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            n_bytes = pc.cast(pc.binary_length(column), pa.int64())
            n_tokens = encode(column.to_pylist()) if not plain and len(column) else []
            for low, high, data, offsets in slices(column) if plain else ():
                starts, ends, bounds = pieces(data, offsets)
                distinct, first, where = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                n = np.where(known[at] == distinct, known_n[at], 0).astype(np.int64)
                missed = np.flatnonzero(n == 0)
                n[missed] = cache.find(distinct[missed])
                raw = data.tobytes()
                new = np.flatnonzero(n <= 0)
                if len(new):
                    spans = first[new]
                    n[new] = encode([raw[a:b].decode() for a, b in zip(starts[spans].tolist(), ends[spans].tolist())])
                    cache.add(distinct[new], n[new])
                sums = np.concatenate(([0], np.cumsum(n[where])))
                own = sums[bounds[1:]] - sums[bounds[:-1]]
                if any(x in raw for x in special):  # a cut may have gone through a special string
                    for i in range(high - low):
                        text = raw[offsets[i] : offsets[i + 1]]
                        if any(x in text for x in special):
                            own[i] = encode([text.decode()])[0]
                n_tokens += own.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return count


def frequent_pieces(docs: DataFrame, path: str, warm_documents: int = WARM_DOCUMENTS, table_pieces: int = TABLE_PIECES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and token counts (below 256) of the most frequent pieces of some documents."""

    texts = docs.select(F.substring(text_of(), 1, 20_000).alias("text"))
    share = min(1.0, 1.2 * warm_documents / max(docs.count(), 1))
    sample = pa.array([r.text for r in texts.sample(share, 17).limit(2 * warm_documents).collect()], pa.string())
    seen: Counter[bytes] = Counter()
    for _, _, data, offsets in slices(sample):
        starts, ends, _ = pieces(data, offsets)
        raw = data.tobytes()
        seen.update(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist()))
    found = [x.decode("utf-8", "ignore") for x, _ in seen.most_common(table_pieces) if len(x) <= 64]
    hashes, lengths = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    if found:
        counts = np.array(opened(path)[0](found))
        joined = np.frombuffer("".join(found).encode(), np.uint8)
        ends = np.cumsum([len(x.encode()) for x in found])
        hashes = span_hashes(joined, np.concatenate(([0], ends[:-1])), ends)
        keep = (counts > 0) & (counts < 256)
        order = np.argsort(hashes[keep])
        hashes, lengths = hashes[keep][order], counts[keep][order].astype(np.uint8)
    if not len(hashes):  # no look-up finds anything in a table of one impossible count
        hashes, lengths = np.zeros(1, np.uint64), np.zeros(1, np.uint8)
    return hashes, lengths


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more tokens than the limit).

    Counts are those of the library on the whole text, without added special tokens; a
    special token's string inside a text is handled as the library does by default. A null
    text counts as empty: 0 bytes and 0 tokens. Repeated rows are counted each; an empty
    table gives no rows; other columns are not looked at. Tokenizers that do not cut at spaces are run on whole texts.
    """
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(frequent_pieces(docs, path))
    counted = docs.select("doc_id", "text").mapInArrow(_counter(path, table), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
