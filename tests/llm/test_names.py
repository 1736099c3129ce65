"""Columns of the user's that have names which the operators use inside."""

import pytest

from nightloom.llm import decontamination, lines, minhash, sharding, toxicity

NAMES = [
    "_own_key", "_key", "_id", "_node", "_text_node", "_gone", "_gone_key", "_lines", "_record", "record", "own", "hit", "row", "run", "shard", "slot", "node", "root",
    "first", "first_id", "first_text", "text_node", "class_id", "bucket", "place", "start", "total", "at", "dropped", "tox_score", "order", "key", "item_id", "Shard", "words",
]


@pytest.fixture(scope="module")
def named(spark):
    base = [" ".join(f"d{k}w{x}" for x in range(40)) for k in range(4)]
    rows = [(k, t) for k, t in enumerate([*base, base[0] + " more", None, "", base[1]])] + [(2, base[2]), (None, base[3])]
    own = [n for n in NAMES if n != "Shard"]
    return spark.createDataFrame([(i, t, *[f"{n}{i}" for n in own]) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in own)).coalesce(2)


def _keep(found, named):
    assert found.columns == named.columns
    rows = found.collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in named.columns[2:])
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


def test_decontaminate(spark, named):
    marks = spark.createDataFrame([(1, " ".join(f"d2w{x}" for x in range(13)))], "item_id long, text string")
    assert [x[1] for x in _keep(decontamination.decontaminate(named, marks), named)] == [0, 1, 3, 4, 5, 6, 7, 0]


def test_keep_one(named):
    assert [x[1] for x in _keep(minhash.keep_one(named), named)] == [0, 1, 2, 3, 5]


def test_drop_toxic(spark, named):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(_keep(toxicity.drop_toxic(named, labels), named)) == 10


def test_dedup_lines(named):
    found = lines.dedup_lines(named)
    assert found.columns == [*named.columns, "dropped_1"] and found.count() == 10


def test_write_shards(spark, named, tmp_path):
    sharding.write_shards(named, str(tmp_path / "s"), 3)
    found = spark.read.parquet(str(tmp_path / "s"))
    assert set(found.columns) == {*named.columns, "shard_1", "slot_1"} and found.count() == 10
    assert {r.slot_1 for r in found.where("shard_1 = 0").collect()} == set(range(4))
