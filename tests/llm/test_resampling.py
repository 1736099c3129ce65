"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from nightloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score string, rank string, fit int, row string, part string"


def _buckets(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)


def _brute(docs, marks, share=25, least=20, seed=7):
    source, target = Counter(), Counter()
    for _, text in docs:
        source.update(_buckets(text)[0])
    for text in marks:
        target.update(_buckets(text)[0])
    S, T = sum(source.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (S + 10000) / ((source[b] + 1) * (T + 10000))))
    rows = []
    for doc_id, text in docs:
        own, n = _buckets(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [(*r[:4], k + 1 if k < share * len(fit) // 100 else None) for k, r in enumerate(fit)]
    return sorted(drawn + [(*r[:4], None) for r in rows if r[4] < least], key=str)


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def marks(spark):
    texts = ["alpha Beta gamma " * 9, None, "", "q" * 300 + " tail", "one two three"]
    return texts, spark.createDataFrame([(t, 1) for t in texts], "text string, doc_id int")


def test_checksums_are_those_of_crc32():
    rng = np.random.default_rng(2)
    text = " ".join("".join(rng.choice(list("abé東z9"), rng.integers(1, 70))) for _ in range(3000))
    column = pa.array([text, None, "", "A", "a b", "-", "x" * 4000 + " " + "y" * 4000])
    for low, high, stream, stops in resampling.bucket_streams(column):
        for row in range(low, high):
            assert Counter(stream[stops[row - low] : stops[row - low + 1]].tolist()) == Counter(_buckets(column[row].as_py())[0])


def test_odd_rows(spark, marks):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [None, "", " \n\t", "a", "A b", long, "ünï cödé 東京 \U0001f600 " * 8, "\x00 nul", "x" * 5000] + [" ".join(f"d{k}w{i % 7} alpha beta" for i in range(20)) for k in range(40)]
    docs = list(enumerate(texts)) + [(12, texts[12])] * 60 + [(None, texts[15]), (None, texts[15]), (None, None), (12, texts[14]), (-3, texts[9])]
    frame = spark.createDataFrame([(i, t, "c", "c", 1, "c", "c") for i, t in docs], SCHEMA).repartition(5)
    found = resampling.resample(frame, marks[1])
    assert _rows(found) == _brute(docs, marks[0]) and found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    other = resampling.resample(frame, marks[1], share=100, min_words=0, seed=8)
    assert _rows(other) == _brute(docs, marks[0], 100, 0, 8)


def test_empty_tables(spark, marks):
    empty = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(empty, marks[1]).count() == 0
    docs = [(k, "one two " * (k + 8)) for k in range(9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert _rows(resampling.resample(frame, empty)) == _brute(docs, [])


def test_rows_of_one_id_and_text_are_split(spark, marks):
    frame = spark.createDataFrame([(5, "one two " * 12)] * 900, "doc_id long, text string").repartition(6)
    found = resampling.drawn(frame.selectExpr("doc_id", "47L as n_features", "0L as weight", "0L as score", "true as fit"))
    assert sorted(r.rank for r in found.where("rank is not null").collect()) == list(range(1, 226))
    assert found.count() == 900
