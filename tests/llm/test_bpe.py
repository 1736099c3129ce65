"""Encoding and decoding against the tokenizers library."""

import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nightloom.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.WordEncoder(PATH)
ODD = [
    None, "", " \n\t ", "a", "don't WE'LL 'tis o'clock!'s", "x" * 5000, "ab" * 3000, "東京" * 900, "Ωσς ΑΣ İıſ ﬁ é́ ́x", "1234 ½ ²٣", "a\x1cb\x00c d　e f",
    "<|endoftext|>A<|startoftext|><|endoftext|", "\U0001f600\U0001f600 ꟎՘ \U00010d50", " ".join(f"w{i}" for i in range(40_000)),
]


@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeABC 0123'.,!?<|>\n\x1c"), st.characters(exclude_categories=["Cs"])), max_size=80))
@settings(max_examples=400, deadline=None)
def test_ids_and_text_are_the_librarys(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ENCODER.ids(text).tolist() == ids
    assert ENCODER.text(np.array(ids, np.int64)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_scan_and_heap_make_the_same_parts():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 40, 159, 400):
        for _ in range(20):
            parts = [ENCODER._inner[c] for c in rng.choice(list(b"aetinhrx"), n)]
            assert ENCODER._scanned(list(parts)) == ENCODER._heaped(list(parts))


def test_a_full_cache_begins_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 500)
    own, text = bpe.WordEncoder(PATH), " ".join(f"word{i % 37} " for i in range(500))
    assert own.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids and len(own._known) < 20


def test_odd_rows_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_ITEMS", 1000)
    rows = [(i, t, "en", "clash", [1]) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, "a", "en", "c", None), (3, "a", "en", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, path array<int>").coalesce(2)
    found = sorted(bpe.bpe_digest(docs, PATH).collect(), key=str)
    expected = []
    for doc_id, text, *_ in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert found == sorted((type(found[0])(*x) for x in expected), key=str)
    again = bpe.decode(spark.createDataFrame([(1, [320, None, 10**6, -4, 49407], "t"), (2, None, "t"), (3, [], None)], "a long, ids array<int>, text string"), PATH).collect()
    assert [(r.a, r.text) for r in again] == [(1, LIBRARY.decode([320, 49407], skip_special_tokens=False)), (2, ""), (3, "")]
    assert bpe.bpe_digest(docs.limit(0), PATH).count() == 0


def test_query_on_real_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = queries.queries()["op12_bpe"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["byte_fallback"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.WordEncoder(str(tmp_path / "t.json"))
