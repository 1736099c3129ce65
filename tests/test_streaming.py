"""Streams against the batch operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.operators import islands
from nightloom.streaming import online, stateful


def _rows(seed=2, n=400):
    rng = np.random.default_rng(seed)
    out = []
    for rec in range(3):
        level = np.repeat(rng.random(n // 5) < 0.5, 5)
        for i in range(n):
            out.append((rec, i, bool(rng.random() > 0.1), bool(level[i] ^ (rng.random() < 0.05)), float(rng.integers(80, 99))))
    return out


@pytest.fixture
def run(spark, tmp_path):
    def go(rows, schema, query, batches, name):
        """The rows in so many files, one a batch; the stream's results."""
        for k in range(batches):
            part = spark.createDataFrame(rows[k], schema).withColumn("ts", F.timestamp_seconds(F.col("i") + 1_700_000_000)).coalesce(1)
            part.write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        started = query(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start()
        started.awaitTermination(240)
        assert started.exception() is None
        return spark.table(name)

    return go


SCHEMA = "rec long, i long, valid boolean, flag boolean, value double"


def test_late_samples_give_the_batch_result(spark, run):
    rows = _rows()
    batch = spark.createDataFrame(rows, SCHEMA)
    expected = {tuple(r) for r in islands.bridged_runs(batch, F.col("valid"), F.col("flag"), ["value"], least=4).select("rec", "start", "end", "value").collect()}
    rng = np.random.default_rng(1)
    # Samples come up to 25 s late, across batches; the last rows only move the watermark on.
    late = sorted(rows, key=lambda r: r[1] + rng.integers(0, 25))
    parts = [late[k * len(late) // 6 : (k + 1) * len(late) // 6] for k in range(6)]
    end = [(9, 5000 + k, True, False, 90.0) for k in range(2)]
    found = run([*parts, end[:1], end[1:]], SCHEMA, lambda s: stateful.detected_runs(s, 4), 8, "late_runs")
    assert {(r.rec, r.start, r.end, r.nadir) for r in found.collect()} == expected and len(expected) > 30


def test_a_silent_recording_gives_up_its_state(run):
    rows = [[(0, i, True, i in (3, 4, 5), 90.0) for i in range(9)], [(1, 4000, True, False, 90.0)], [(1, 9000, True, False, 90.0)], [(0, 9100, True, True, 90.0), (0, 9105, True, False, 90.0)], [(1, 9900, True, False, 90.0)], [(1, 9901, True, False, 90.0)]]
    found = run(rows, SCHEMA, lambda s: stateful.detected_runs(s, 2, idle_ms=60_000), 6, "silent")
    assert sorted((r.rec, r.start, r.end) for r in found.collect()) == [(0, 3, 6), (0, 9100, 9105)]


def test_tumbling_and_sliding_windows_equal_batch_ones(spark, run):
    rows = [(r, i, v, f, x) for r, i, v, f, x in _rows(3, 100)]
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("i") + 1_700_000_000))
    expected = {tuple(r) for r in stateful.tumbling(batch, "10 seconds").collect()}
    found = run([rows, [(8, 9000, True, True, 1.0)], [(8, 9900, True, True, 1.0)]], SCHEMA, lambda s: stateful.tumbling(s, "10 seconds"), 3, "tumbled")
    assert {tuple(r) for r in found.where("rec < 8").collect()} == expected


def test_sliding_streams(spark, run):
    rows = _rows(4, 60)
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("i") + 1_700_000_000))
    expected = {tuple(r) for r in online.sliding(batch).collect()}
    found = run([rows, [(8, 9000, True, True, 1.0)], [(8, 9900, True, True, 1.0)]], SCHEMA, lambda s: online.sliding(s), 3, "slid")
    assert {tuple(r) for r in found.where("rec < 8").collect()} == expected


def test_sessions_merge_short_gaps(spark, run):
    rows = [(0, i, True, i in (1, 2, 3, 7, 30, 31), 1.0) for i in range(40)]
    found = run([rows, [(8, 9000, True, True, 1.0)], [(8, 9900, True, True, 1.0)]], SCHEMA, lambda s: online.sessions(s), 3, "sessions")
    own = sorted((int(r.start.timestamp()) - 1_700_000_000, r.n) for r in found.where("rec = 0").collect())
    assert own == [(1, 4), (30, 2)]
