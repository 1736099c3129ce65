"""Operators against brute force on small tables with nulls, empty and repeated rows, and odd columns."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nightloom.llm import components as cc
from nightloom.llm import decontamination, fingerprints, langid, lines, minhash, neardup, packing, sharding, suffixtree, tokencounts, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _words(text):
    return WORD.findall(_lower(text))


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(120).cache()


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [None, "", " \n\t", "a", "A b", "one two three four five six", "one two three four five six", "x" * 5000, long, "ünï cödé 東京 \U0001f600", "\x00 nul", "<|endoftext|> a"]
    rows = [(i, t, None if i % 3 else "en", None, None, "clash", "clash") for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s", 1, "c", "c"), (None, "no id", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def _by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_components_are_those_of_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for e in edges if e[0] != e[1] for x in e}
    found = cc.components(spark.createDataFrame(edges, "u long, v long"))
    assert {(r.node, r.root) for r in found.collect()} == {(x, find(x)) for x in linked}
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_decontamination_is_brute_force(spark, real, odd):
    items = [(1, " ".join(_words(real.first().text)[:20])), (2, "one two three"), (3, None), (None, "six"), (10, "one two three"), (4, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, text in items:
        words = _words(text)
        for a in range(max(len(words) - 12, 1 if words else 0)):
            if i is not None:
                windows.setdefault(tuple(words[a : a + 13]), set()).add(str(i))
    docs = real.select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id <> 5 and doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10_000))
    found = _by_id(decontamination.contamination_digest(docs, benchmark))
    for row in docs.collect():
        words, hit, own = _words(row.text), set(), set()
        for k in {len(w) for w in windows}:
            for a in range(len(words) - k + 1):
                if tuple(words[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    own |= windows[tuple(words[a : a + k])]
        digest = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        r = found[row.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(words), len(hit), len(own), digest)
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))
    kept = decontamination.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_decontamination_without_benchmark_or_documents(spark, odd, empty, aqe):
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        benchmark = spark.createDataFrame([], "item_id long, text string")
        rows = decontamination.contamination_digest(odd, benchmark).collect()
        assert len(rows) == odd.count() and not any(r.n_hit or r.contaminated for r in rows)
        nothing = spark.createDataFrame([(1, None), (2, ""), (None, "a")], "item_id long, text string")
        assert decontamination.decontaminate(odd, nothing).count() == odd.count()
        assert decontamination.contamination_digest(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_decontamination_in_blocks_is_the_same(spark, odd, monkeypatch):
    benchmark = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "no id")], "item_id long, text string")
    one = sorted(map(tuple, decontamination.contamination_digest(odd, benchmark).fillna(-1).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 1)
    monkeypatch.setattr(decontamination, "BLOCK_TOKENS", 2)
    monkeypatch.setattr(decontamination, "STEP_PLACES", 1)
    assert sorted(map(tuple, decontamination.contamination_digest(odd, benchmark).fillna(-1).collect())) == one


def test_fingerprints(spark, real, odd, empty):
    rows = real.select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    found = _by_id(fingerprints.fingerprint_digest(real))

    def terms(text):
        words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
        return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1 if words else 0)))

    def jaccard(a, b):
        a, b = terms(a), terms(b)
        keys = set(a) | set(b)
        return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0

    errors = []
    for at, row in enumerate(rows):
        after = rows[(at + 1) % len(rows)].text
        cut = len(row.text) // 3
        edited = row.text[: len(row.text) - cut] + after[:cut]
        r = found[row.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(row.text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(row.text, edited), r.near_next - jaccard(row.text, after)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09
    rows = fingerprints.fingerprint_digest(odd).collect()
    assert len(rows) == odd.count()
    assert len({r.fingerprint for r in rows if r.doc_id == 5}) == 1 and fingerprints.fingerprint_digest(empty).count() == 0


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for copy in range(4):
            own = list(words)
            for _ in range(copy * 2):
                own[rng.integers(0, 120)] = "changed"
            rows.append((base * 10 + copy, " ".join(own)))
    rows += [(900, ""), (901, None), (902, "short"), (903, "short"), (None, rows[0][1]), (904, "long " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("clash"), "root": F.lit(1)})
    found = {(r.doc_id, r.node): r.class_id for r in minhash.near_duplicates(docs).collect()}
    sets = {i: Counter(tuple(t.split()[k : k + 5]) for k in range(116)) for i, t in rows if i is not None and i < 200}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = len(rows)
    df = Counter(t for s in [*sets.values(), sets[0]] for t in s)  # the first text is there twice
    idf = {t: 1 + round(float(np.clip(np.log((n + 1) / (c + 1)) / np.log(n + 1), 0, 1)) * minhash.STEPS) / minhash.STEPS for t, c in df.items()}
    for a in sets:
        for b in sets:
            keys = set(sets[a]) | set(sets[b])
            low, high = (sum(f(sets[a][t], sets[b][t]) * idf[t] for t in keys) for f in (min, max))
            if low / high >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    classes = {i: c for (i, _), c in found.items()}
    assert all(classes[i] == find(i) for i in sets)
    assert classes[900] == classes[901] == 900 and classes[903] == 902 and classes[904] == 904 and classes[None] == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(classes.values()))


def test_unrelated_texts_without_or_under_one_id_stay(spark):
    texts = [" ".join(f"t{k}w{x}" for x in range(40)) for k in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0]), (7, texts[4]), (7, texts[5]), (7, texts[5]), (8, texts[6] + " more"), (9, texts[6]), (None, texts[7]), (3, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r.doc_id or 0, r.text) for r in minhash.keep_one(docs).collect())
    assert kept == sorted([(0, t) for t in texts[:4]] + [(7, texts[4]), (7, texts[5]), (8, texts[6] + " more"), (3, texts[7])])
    assert len({r.root for r in minhash.near_duplicates(docs).collect()}) == 8


def test_large_buckets_keep_their_links(spark):
    words = [f"w{x}" for x in range(150)]
    rows = [(i, " ".join(words[:i % 100] + [f"new{i}"] + words[i % 100 :])) for i in range(200)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.class_id for r in found.collect()} == {0}


def test_a_star_in_large_buckets_is_one_class(spark):
    rng = np.random.default_rng(11)
    words = [f"w{x}" for x in range(300)]
    rows = [(0, " ".join(words))]
    for i in range(1, 120):
        own = list(words)
        for at in rng.choice(np.arange(5, 300, 10), 5, replace=False):
            own[at] = f"n{i}x{at}"
        rows.append((i, " ".join(own)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert all((0, i) in near for i in range(1, 120)) and len(near) < 1000
    # Frequent shingles weigh less, so the links are counted with equal weights.
    for cut in range(3):
        docs = spark.createDataFrame([(i, t.replace("w", f"v{cut}")) for i, t in rows], "doc_id long, text string").repartition(1 + 2 * cut)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(minhash, "fit_weights", lambda _: minhash.Weights(np.full(1 << 16, minhash.STEPS, np.uint8)))
            assert {r.class_id for r in minhash.near_duplicates(docs).collect()} == {0}


@pytest.mark.parametrize("block", [1 << 19, 1 << 13])
def test_large_buckets_decide_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block)
    rng = np.random.default_rng(8)
    base = rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 120)
    texts = ["".join(base)]
    for _ in range(500):  # edits near the threshold, so that most pairs are no links
        own = base.copy()
        for at in rng.choice(np.arange(3, 115, 9), rng.integers(2, 7), replace=False):
            own[at] = rng.choice(list("0123"))
        texts.append("".join(own))
    docs = spark.createDataFrame([("\n".join(texts[i : i + 20]),) for i in range(0, len(texts), 20)], "text string").repartition(4)
    column = pa.array(texts)
    (_, _, data, offsets), = lines.slices(column)
    spans = lines.Spans(data)
    nodes = spans.of(offsets[:-1], offsets[1:]).view(np.int64)
    keys = lines.band_keys(lines.signatures(*lines.line_shingles(data, spans, offsets[:-1], offsets[1:])))
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in np.flatnonzero((keys[:i] == keys[i]).any(axis=1)):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    whole = Counter(find(i) for i in range(len(texts)))
    assert len(whole) > 20 and max(whole.values()) > 50
    found = {r.node: r.root for r in lines.line_classes(docs).collect()}
    assert {frozenset(i for i in range(len(texts)) if find(i) == c) for c in whole if whole[c] > 1} == {
        frozenset(i for i in range(len(texts)) if found.get(int(nodes[i])) == c) for c in set(found.values())
    }


def _line_jaccard(a, b):
    a, b = ({t[i : i + 5] for i in range(max(len(t) - 4, 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_line_dedup_is_brute_force(spark, empty):
    rng = np.random.default_rng(4)
    signs = {"latin": list("abcdefghij "), "han": list("東京都大学生活中国語日本人山川田口"), "cyrillic": list("абвгдежзиклмн ")}
    pool = []
    for alphabet in signs.values():
        for _ in range(12):
            line = "".join(rng.choice(alphabet, rng.integers(50, 80)))
            pool.append(line)
            for _ in range(rng.integers(1, 4)):  # one character of a line of 50 to 80 changed, then another
                at = int(rng.integers(0, len(line)))
                line = line[:at] + "#" + line[at + 1 :]
                pool.append(line)
    thue = "0"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("01", "10"))
    pool += ["x" * 300, "a", "b", "", " \t", "word " * 20_000, thue, thue.translate(str.maketrans("01", "10"))]
    texts = ["\n".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(1, 6))) for _ in range(60)] + [None, ""]
    rows = [(int(i), t) for i, t in enumerate(texts)] + [(7, texts[8]), (None, texts[9]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"row": F.lit(1), "lines": F.lit(2), "root": F.lit(3), "dropped": F.lit(4), "_gone": F.lit(5)})
    lines_of = sorted({x for _, t in rows for x in (t or "").split("\n") if any(c > " " for c in x)})
    parent = {x: x for x in lines_of}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines_of):
        for b in lines_of[:i]:
            if _line_jaccard(a, b) >= 0.8:
                parent[find(a)] = find(b)
    # The first place of each class stays; rows alike in id and text are one document.
    places, distinct = {}, sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: x[:2])
    for null, i, t in distinct:
        for at, x in enumerate(t.split("\n")):
            if x in parent:
                places.setdefault(find(x), []).append((null, i, t, at))
    found = lines.dedup_lines(docs)
    assert found.columns == [*docs.columns, "dropped_1"] and found.count() == len(rows)
    kept = Counter()
    for r in found.collect():
        source = [t for i, t in rows if i == r.doc_id]
        assert r.dropped == 4 and (r.text is None) == (source == [None])
        n = [len((t or "").split("\n")) for t in source]
        assert not r.text or len(r.text.split("\n")) + r.dropped_1 in n
        for x in set((r.text or "").split("\n")):
            if x in parent:
                kept[find(x), r.doc_id] += 1
    classes = Counter(c for c, _ in kept)
    assert set(classes) == set(places) and max(classes.values()) == 1  # each class stays in one document
    order = lambda p: (p[0], p[1])
    for (c, doc_id) in kept:
        assert order(min(places[c], key=order)) == (doc_id is None, doc_id or 0)
    assert lines.lines_digest(empty).count() == 0


def test_line_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, f"{base}\n\nown line number one"), (2, f"{base}!\nown line number two\n"), (3, base.replace("dog", "fog")), (4, None), (5, ""), (6, "a\na\nb"), (7, "b"), (7, "b"), (None, base + "?")]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = sorted(((r.doc_id or 0), r.text, r.dropped) for r in found.collect() if r.doc_id != 4)
    assert texts == [(0, "", 1), (1, rows[0][1], 0), (2, "own line number two\n", 1), (3, "", 1), (5, "", 0), (6, "a\nb", 1), (7, "", 1), (7, "", 1)]


def test_kneser_ney_is_a_distribution(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "DISCOUNT", 1.0)
    monkeypatch.setattr(toxicity, "CONTEXT_PRIOR", 3.0)
    rng = np.random.default_rng(6)
    texts = [(" ".join(f"w{x}" for x in rng.zipf(1.6, 40) % 12) + (" vile foul" * 3 if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(40)] + [("", 1), (None, 0)]
    words, contexts, pairs, unknown = toxicity.smoothed(spark.createDataFrame(texts, "text string, toxic int").repartition(3))
    before = [Counter(), Counter()]
    for text, c in texts:
        own = (text or "").split()
        before[c].update(zip(["", *own], own))
    least = min(len(before[0]), len(before[1]))
    n = [Counter(w for _, w in x) for x in before]
    vocabulary = sorted(set(n[0]) | set(n[1]))
    hashed = {w: int(toxicity._bigrams(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1][0]) for w in vocabulary}
    p = {}
    for c in (0, 1):
        d = {w: max(n[c][w] * least / len(before[c]) - 1, 0) / least for w in vocabulary}
        share = {w: (0.99 * n[0][w] / len(before[0]) + 0.01 * n[1][w] / len(before[1])) * least / (least + 0.5) for w in vocabulary}
        rest = 0.02 * (1 - sum(d.values())) + 0.98
        p[c] = {hashed[w]: 0.02 * d[w] + rest * share[w] for w in vocabulary}
        assert abs(unknown[c] - rest * 0.5 / (least + 0.5)) < 1e-12 and abs(sum(p[c].values()) + unknown[c] - 1) < 1e-9
        assert all(abs(r[f"p{c}"] - p[c][r["word"]]) < 1e-12 for _, r in words.astype({"word": object}).iterrows())
        for _, context in contexts.astype({"before": object}).iterrows():
            own = pairs[pairs["before"] == context["before"]]
            rest = 1 - sum(p[c][w] for w in own["word"])
            assert len(own) and abs(own[f"q{c}"].sum() + context[f"b{c}"] * rest - 1) < 1e-9
    assert len(pairs) > 10


def test_toxicity_is_learnt_and_bounded(spark, odd, empty, labels):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join([f"w{x}" for x in rng.zipf(1.5, 60) % 300] + ["vile", "foul"] * (3 * (i % 4 == 0)))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(800)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity_digest(docs, marks).collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    rows = toxicity.toxicity_digest(odd, marks).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.drop_toxic(odd, marks.limit(0)).count() == odd.count()
    assert toxicity.toxicity_digest(empty, marks).count() == 0


def test_sharding(spark, real, odd, empty, tmp_path):
    for docs in (real, odd, empty):
        rows = sharding.shard_digest(docs, 4).collect()
        counts = Counter(r.shard for r in rows)
        assert len(rows) == docs.count() and (not rows or max(counts.values()) - min(counts[s] for s in range(4)) <= 1)
        for shard, n in counts.items():
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    rows = sharding.external_shuffle(real, 4, bucket_bytes=20_000)
    order = [r.doc_id for r in rows.orderBy("shard", "slot").select("record.doc_id").collect()]
    assert sorted(order) == sorted(r.doc_id for r in real.collect()) and order != sorted(order)
    again = sharding.external_shuffle(real, 4, bucket_bytes=20_000)
    assert order == [r.doc_id for r in again.orderBy("shard", "slot").select("record.doc_id").collect()]
    other = sharding.external_shuffle(real, 4, seed=7, bucket_bytes=20_000)
    assert order != [r.doc_id for r in other.orderBy("shard", "slot").select("record.doc_id").collect()]
    sharding.write_shards(real, str(tmp_path / "shards"), 4)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == real.count()


@pytest.mark.parametrize("segment", [3, 16, 512])
def test_cross_parsing_counts_phrases(monkeypatch, segment):
    texts = {"a": b"abcabxab cdabca\0ccab", "b": b"xyzab yxxz zzab"}
    parser = langid.CrossParser(texts)
    rng = np.random.default_rng(2)
    rows = [bytes(rng.choice(list(b"abcxyz q"), n).tolist()) for n in (0, 1, 5, 40, 511, 512, 513, 1500) for _ in range(5)]
    rows += [b"abcabxab cdabca" * 200, b"xyzab yxxz zzab" * 40 + b"q", b"\xff" * 1100]
    monkeypatch.setattr(langid, "SEGMENT", segment)
    offsets = np.cumsum([0, *map(len, rows)])
    found = parser.phrases(np.frombuffer(b"".join(rows), np.uint8), offsets)
    for i, row in enumerate(rows):
        for k, language in enumerate(parser.languages):
            n = 0
            j = 0
            while j < len(row):
                end = j + 1
                while end <= len(row) and row[j:end] in texts[language]:
                    end += 1
                j, n = max(end - 1, j + 1), n + 1
            assert found[k, i] == n


def test_languages(spark, real, odd, empty):
    rows = langid.language_ids(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
    # The whole prediction by brute force: the fewest phrases, weighted by the logarithm of the training text's length.
    trained = langid.training_texts(real, langid.in_fold("doc_id", 4, 2))
    parser = langid.CrossParser(trained)
    found = _by_id(langid.language_ids(real))
    for row in real.limit(25).collect():
        text = re.sub("[^a-z\x80-\U0010ffff]+", " ", row.text.lower()).encode()
        costs = []
        for language in parser.languages:
            own, at, n = trained[language], 0, 0
            while at < len(text):
                end = at + 1
                while end <= len(text) and text[at:end] in own:
                    end += 1
                at, n = max(end - 1, at + 1), n + 1
            costs.append(n * np.log2(max(len(own), 2)))
        assert found[row.doc_id].lang_pred == parser.languages[int(np.argmin(costs))]
        assert abs(found[row.doc_id].score - (1 - min(costs) / sorted(costs)[1])) < 1e-9
    long = spark.createDataFrame([(i, "wort und satz oder so " * 3000 if i % 2 else "palabra y frase o eso " * 3000, "de" if i % 2 else "es") for i in range(12)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == ("de" if r.doc_id % 2 else "es") for r in langid.language_ids(long).collect())
    found = langid.language_ids(odd).collect()
    assert len(found) == odd.count() and {r.lang_pred for r in found if r.doc_id in (0, 1, 2)} == {"und"}
    assert langid.language_ids(empty).count() == 0


def test_packing_plan_is_whole_and_tight():
    rng = np.random.default_rng(0)
    for scale in (1, 50):
        counts = Counter((rng.zipf(1.3, 4000) % 4096 + 1).tolist())
        counts = {k: v * scale for k, v in counts.items()}
        plan = packing.packing_plan(counts)
        used = Counter()
        for lengths, n in plan:
            assert sum(lengths) <= 4096 and n > 0
            for x in lengths:
                used[x] += n
        assert used == counts
        total = sum(k * v for k, v in counts.items())
        assert sum(n for _, n in plan) <= -(-total // 4096) * 1.02 + 1
    assert packing.packing_plan({4095: 2, 1: 2}) == [((4095, 1), 2)]
    assert packing.packing_plan({}) == []


def test_packing_has_the_librarys_ids(spark, odd, real, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(real.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = packing.pack(docs, path).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
    for sequence in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and own[-1].offset + own[-1].length <= 4096
    assert packing.pack(empty, path).count() == 0 and packing.pack(odd, path).select("doc_id").count() >= odd.count()


def test_packing_keeps_all_ids_of_a_long_piece(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "a b " + "0123456789" * 110_000 + " c"
    ids = np.array([*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1], "<u4")
    rows = sorted(packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).collect(), key=lambda r: r.start)
    assert len(ids) > 1 << 20 and sum(r.length for r in rows) == len(ids)
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(ids[a : a + 4096].tobytes()) for a in range(0, len(ids), 4096)]


def _colliding():
    """Two different texts of 4096 letters that every polynomial modulo 2**64 takes for one."""
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_pieces_that_collide_in_a_polynomial_have_their_own_ids(spark):
    texts = _colliding()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        for row in tokencounts.token_counts(docs, path).collect():
            assert row.n_tokens == len(library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        rows = sorted(packing.pack(docs, path).collect(), key=lambda r: (r.doc_id, r.start))
        for i, text in enumerate(texts):
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
            assert [r.ids_crc32 for r in rows if r.doc_id == i] == [zlib.crc32(ids[a : a + 4096].tobytes()) for a in range(0, len(ids), 4096)]
    assert lines.dedup_lines(docs).where("dropped > 0").count() == 0 or _line_jaccard(*texts) >= 0.8


def test_token_counts_are_the_librarys(spark, odd, empty):
    rng = np.random.default_rng(1)
    signs = [" ", "  ", "\n", "\t", "a", "B", "é", "　", "\x85", "\xa0", "\x1c", "1", ".", ",", "'s", "<|endoftext|>", "中", "́", " \n", "\x00", "😀", " the", "'"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(400)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = _by_id(tokencounts.token_counts(docs, path))
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, len((text or "").encode()), n > 512)
    assert tokencounts.token_counts(odd, path).count() == odd.count() and tokencounts.token_counts(empty, path).count() == 0


def test_language_model(spark, real, odd, empty):
    docs = real.select("doc_id", "text").unionByName(odd.where("doc_id <> 5").select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    rows = docs.collect()
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", _lower(r.text)), None] for r in rows}
    counts = Counter(t for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in own)
    total, distinct = sum(counts.values()), len(counts)
    found = _by_id(suffixtree.language_model_scores(docs))
    for i, own in tokens.items():
        base = sum(np.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    held = [r for r in found.values() if r.held_out and r.doc_id < 5000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert suffixtree.language_model_scores(odd).count() == odd.count() and suffixtree.language_model_scores(empty).count() == 0


def _tree_log_p(own_texts, min_context, min_pair):
    """The suffix tree by brute force: a function of the words before a word, and it, to its log10 probability."""
    unigrams = Counter(t for own in own_texts for t in own)
    total, distinct = sum(unigrams.values()), len(unigrams)
    states, depth = {}, 0

    def p(context, t):
        while context and context not in states:
            context = context[1:]
        if not context:
            return (unigrams[t] + 1) / (total + distinct + 1)
        own, share = states[context]
        return own[t] if t in own else share * p(context[1:], t)

    grown = True
    while grown:  # every context of a depth, from all substrings
        depth += 1
        after: dict = {}
        for own in own_texts:
            for i in range(depth, len(own)):
                after.setdefault(tuple(own[i - depth : i]), Counter())[own[i]] += 1
        grown = {}
        for c, follow in after.items():
            n = sum(follow.values())
            own = {t: (m - 0.5) / n for t, m in follow.items() if m >= min_pair}
            if n >= min_context and (depth == 1 or c[1:] in states) and own:
                rest, rest_q = 1 - sum(own.values()), 1 - sum(p(c[1:], t) for t in own)
                if sum(x * np.log(x / p(c[1:], t)) for t, x in own.items()) + rest * np.log(rest / rest_q) >= suffixtree.DIVERGENCE:
                    grown[c] = (own, rest / rest_q)
        states |= grown
    return p, states, unigrams


def test_a_context_grows_from_its_suffix_whatever_it_begins_with(spark):
    """(b) tells nothing, (c) and (b c) do, and (d b c) tells more."""
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(300):
        words = rng.choice(list("bcdefgh"), 60).tolist()
        for k in range(2, 60):
            if words[k - 3 : k] == ["d", "b", "c"]:
                words[k] = "e"
            elif words[k - 1] == "c":
                words[k] = rng.choice(["f", "f", words[k]] if words[k - 2] == "b" else ["h", "g", words[k]])
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = [[*t.split(), None] for t in texts]
    p, states, _ = _tree_log_p([own for i, own in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2], 32, 8)
    assert ("b",) not in states and ("b", "c") in states and ("d", "b", "c") in states
    found = _by_id(suffixtree.language_model_scores(docs))
    for i, own in enumerate(tokens):
        wanted = sum(np.log10(p(tuple(own[:k]), t)) for k, t in enumerate(own))
        assert abs(found[i].score - wanted) < 1e-9 * abs(wanted), texts[i]
    with pytest.raises(ValueError):
        suffixtree.language_model_scores(docs, min_context=4, min_pair=5)


@pytest.mark.parametrize("head_rows", [40, 1_000_000])
def test_suffix_tree_scores_are_brute_force(spark, head_rows):
    rng = np.random.default_rng(4)
    phrases = ["the cat sat on the mat", "the dog sat on the rug and slept", "a cat and a dog", "on the rug a dog slept and the cat", "on the mat"]
    texts = [" ".join(rng.choice(phrases, rng.integers(1, 5))) + f" w{i % 9}" for i in range(60)] + ["the cat sat on the unseen thing", "", None, "never met"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = [[*(t or "").split(), None] for t in texts]
    p, states, unigrams = _tree_log_p([own for i, own in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2], 6, 2)
    assert max(map(len, states)) >= 3
    found = _by_id(suffixtree.language_model_scores(docs, min_context=6, min_pair=2, head_rows=head_rows))
    for i, own in enumerate(tokens):
        wanted = sum(np.log10(p(tuple(own[:k]), t)) for k, t in enumerate(own))
        assert abs(found[i].score - wanted) < 1e-9 * max(1, abs(wanted)), texts[i]
    for context in [(), *states]:  # one more word stands for all unknown ones
        assert abs(sum(p(context, t) for t in [*unigrams, "unknown"]) - 1) < 1e-9


def test_sieve_passes_every_frequent_pair_and_few_others(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 200) % 5000) for _ in range(50)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    tokens = [np.concatenate([own for _, _, own, _ in suffixtree.sequences(pa.array([t]))]) for t in texts]
    counts = Counter((a, b) for own in tokens for a, b in zip(own[:-1].tolist(), own[1:].tolist()))
    all_bits = np.full(1 << (suffixtree.BITMAP_BITS - 6), np.uint64((1 << 64) - 1))
    for part_cells in (1 << 22, 1000):  # one part, and sixteen
        monkeypatch.setattr(suffixtree, "PART_CELLS", part_cells)
        shared = spark.sparkContext.broadcast((all_bits, all_bits))
        bits = suffixtree.sieve(docs, shared, 1, sum(map(len, tokens)), 8)
        context = np.array([a for a, _ in counts], np.int64).view(np.uint64) * suffixtree._STEP
        passed = suffixtree._may_have(bits, suffixtree.pair_keys(context.view(np.int64), np.array([b for _, b in counts], np.int64)))
        frequent = np.array([n >= 8 for n in counts.values()])
        assert frequent.any() and passed[frequent].all() and passed[~frequent].sum() <= 2


def test_a_batch_names_a_joined_key_once_with_its_documents():
    rows, keys = np.repeat(np.arange(65_530, 65_542), 3), np.tile(np.array([7, -9, 7]), 12)
    found = suffixtree._by_key(rows, keys).to_pylist()
    assert [(r["key"], r["block"]) for r in found] == [(-9, 0), (-9, 1), (7, 0), (7, 1)]
    again = [(r["block"] * 65_536 + int(p), r["key"]) for r in found for p in np.frombuffer(r["places"], np.uint16)]
    assert sorted(again) == sorted(zip(rows.tolist(), keys.tolist()))
    joined = pa.record_batch([*(suffixtree._by_key(rows, keys).column(i) for i in (1, 2, 3)), pa.array([0.5, 0.5, 2.0, None]), pa.array([1, 1, 0, None], pa.int64())], ["block", "places", "sums", "value", "word"])
    sums = {r["row"]: r for batch in suffixtree._spread(iter([joined])) for r in batch.to_pylist()}
    assert (sums[65_530]["own"], sums[65_530]["base"], sums[65_530]["n_known"]) == (4.5, 0.5, 1)
    assert (sums[65_541]["own"], sums[65_541]["base"], sums[65_541]["n_known"]) == (0.5, 0.5, 1)


def test_growing_the_tree_leaves_no_shuffle_files(spark, real):
    folders = [str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    left = lambda: {f for folder in folders for f in Path(folder).rglob("shuffle_*.data")}
    before = left()
    scores = suffixtree.language_model_scores(real.select("doc_id", "text"))
    assert sum(f.stat().st_size for f in left() - before) < 100_000  # of small counts; 219,823 with those of the tree
    assert scores.count() == real.count()


@pytest.mark.parametrize("bits", [4, 7])
def test_joined_keys_are_packed_and_their_sums_are_those_of_every_place(bits):
    rng = np.random.default_rng(3)
    rows, keys = np.sort(rng.integers(65_000, 67_000, 40_000)), rng.integers(-(1 << 63), 1 << 63, 20_000)[rng.integers(0, 20_000, 40_000)]
    wanted = [b for batch in suffixtree._wanted(suffixtree._by_key(rows, keys), bits) for b in batch.to_pylist()]
    assert sum(len(r["keys"]) + len(r["data"]) for r in wanted) < 10 * len(rows)  # some 19 bytes each as rows of a join
    context = np.unique(rng.integers(-(1 << 62), 1 << 62, 20_000))
    own = suffixtree._entry_keys(context, np.full(len(context), suffixtree._STATE))
    keys = np.where(rng.random(len(keys)) < 0.5, own[rng.integers(0, len(own), len(keys))], keys)
    order = np.argsort(own)
    wanted = [b for batch in suffixtree._wanted(suffixtree._by_key(rows, keys), bits) for b in batch.to_pylist()]
    context, known = context[order][::2], own[order][::2]
    n, value = rng.integers(1, 100, len(known)), rng.normal(size=len(known))
    kind = np.where(np.arange(len(known)) % 3 == 0, suffixtree.WORD, suffixtree.PAIR)
    entries = pa.record_batch([pa.array(np.tile(x, 2)) for x in (context, np.full(len(known), suffixtree._STATE), n, value)] + [pa.array(np.append(kind, np.full(len(kind), suffixtree.STATE)))], ["context", "token", "n", "value", "kind"])
    packed = wanted + [b for batch in suffixtree._entries(bits)(iter([entries])) for b in batch.to_pylist()]
    sums = np.zeros((3, 67_000))
    for part in {r["part"] for r in packed}:
        table = pa.Table.from_pylist([r for r in packed if r["part"] == part], pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("keys", "counts", "data"))]))
        for of, to in ((suffixtree._OF_WORDS, sums[:2]), (suffixtree._OF_TREE, sums[2:])):
            for r in suffixtree._joined(of)(table).to_pylist():
                place, own = suffixtree._sums_of(r["sums"], of)
                for x, y in zip(to, own):
                    np.add.at(x, (r["block"] << suffixtree.ASSEMBLED_BITS) + place.astype(int), y)
    at = np.searchsorted(known, keys).clip(max=len(known) - 1)
    hit = known[at] == keys
    at, of, word = at[hit], rows[hit], kind[at[hit]] == suffixtree.WORD
    base = np.where(word, np.log10(n[at] + 1.0), 0)
    for k, x in enumerate((word, base, np.where(word, base, value[at]) + value[at])):
        assert np.allclose(sums[k], np.bincount(of, x, 67_000), atol=1e-9)


def test_counts_of_contexts_are_packed_and_add_up():
    rng = np.random.default_rng(9)
    context, token = rng.integers(0, 400, 60_000) * 7919 << 40, rng.integers(-50, 50, 60_000) * 104_729
    token[::3], suffix = suffixtree._ALL, context ^ 5
    batches = [suffixtree._packed_counts(context[a : a + 20_000], token[a : a + 20_000], suffix[a : a + 20_000], 4) for a in range(0, 60_000, 20_000)]
    assert sum(b.num_rows for b in batches) <= 60  # not a row for each of 30,000 counts
    table, found = pa.Table.from_batches(batches), []
    for part in set(table["part"].to_pylist()):
        found += suffixtree._counted(50, 3)(table.filter(pa.compute.equal(table["part"], part))).to_pylist()
    counts = Counter(zip(context.tolist(), token.tolist()))
    assert {(r["context"], r["token"]): r["n"] for r in found} == {k: n for k, n in counts.items() if n >= (50 if k[1] == suffixtree._ALL else 3)} and len(found) > 1000
    assert all(r["suffix"] == r["context"] ^ 5 for r in found if r["token"] == suffixtree._ALL)


def test_band_entries_are_packed_and_give_all_pairs(spark):
    rng = np.random.default_rng(5)
    sizes = np.concatenate((rng.integers(1, 12, 3000), [24, 25, 90]))
    keys = np.repeat(rng.integers(-(1 << 63), 1 << 63, len(sizes)), sizes)
    nodes = rng.permutation(len(keys)).astype(np.int64)
    sketches = np.where(np.arange(len(keys)) % 50, 0, -1)
    deal = rng.permutation(len(keys))
    packed = [[*neardup.local_bands(keys[own], nodes[own], sketches[own])] for own in np.array_split(np.append(deal, deal[:500]), 3)]
    assert all(sum(batch.num_rows for batch in x) <= min((1 << neardup.PART_BITS) + 2, len(deal) // 3 * 0.6) for x in packed)
    rows = pa.Table.from_batches([batch for x in packed for batch in x])
    found = neardup.candidates(spark.createDataFrame(rows).repartition(3)).collect()
    pairs, members = {(r.u, r.v) for r in found if r.bucket is None}, {(r.bucket, r.u, r.sketch) for r in found if r.bucket is not None}
    large = np.repeat(sizes, sizes) > neardup.ALL_PAIRS
    assert members == set(zip(keys[large].tolist(), nodes[large].tolist(), sketches[large].tolist()))
    end = np.cumsum(sizes)
    possible = {tuple(sorted((int(nodes[i]), int(nodes[j])))): sizes[k] for k in range(len(sizes)) for i in range(end[k] - sizes[k], end[k]) for j in range(end[k] - sizes[k], i) if sketches[i] == sketches[j]}
    assert pairs <= set(possible) and {x for x, n in possible.items() if n <= neardup.ALL_PAIRS} <= pairs


def test_overlaps_of_lines_count_different_shingles():
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abé"), rng.integers(1, 60))) for _ in range(200)]
    a, b = pa.array(texts[:100]), pa.array([t[: i % 50] + u[-20:] for i, (t, u) in enumerate(zip(texts[:100], texts[100:]))])
    same, both = lines._overlaps(a.cast(pa.binary()), b.cast(pa.binary()))
    sets = [[{t[i : i + 5] for i in range(max(len(t) - 4, 1))} for t in x.to_pylist()] for x in (a, b)]
    assert same.tolist() == [len(x & y) for x, y in zip(*sets)] and both.tolist() == [len(x) + len(y) for x, y in zip(*sets)]
