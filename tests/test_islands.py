import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nightloom.operators import frames, islands


def _rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_runs_at_the_end(spark):
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1])], "rec long, i long, f int")
    assert _rows(islands.runs(df, F.col("f") == 1), "start", "end") == [(0, 2)]
    assert _rows(islands.runs(df, F.col("f") == 1, open_at_end=True), "start", "end") == [(0, 2), (3, 6)]
    assert _rows(islands.runs(df, F.col("f") == 1, least=3), "start", "end") == []


def _bridged(flags, least):
    out, start = [], None
    for i, f in enumerate(flags):
        if f is None:
            continue
        if f and start is None:
            start = i
        elif not f and start is not None:
            if i - start >= least:
                out.append((start, i))
            start = None
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([True, False, None]), min_size=1, max_size=40), st.sampled_from([1, 2, 3, 7, 100]))
def test_bridged_runs_are_a_state_machine(spark, flags, size):
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate(flags)], "rec long, i long, f boolean")
    found = islands.bridged_runs(df, F.col("f").isNotNull(), F.col("f"), least=2, size=size)
    assert _rows(found, "start", "end") == _bridged(flags, 2)


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([(0, 0, 2), (0, 2, 3), (0, 5, 9), (0, 6, 7), (1, 1, 2)], "rec long, start long, end long")
    merged = islands.merge(df)
    assert _rows(merged, "rec", "start", "end") == [(0, 0, 3), (0, 5, 9), (1, 1, 2)]
    assert _rows(islands.merge(merged), "rec", "start", "end") == _rows(merged, "rec", "start", "end")


def test_class_runs_keep_the_open_one(spark):
    rows = [(0, 0, 1, 0.9), (0, 30, 1, 0.9), (0, 60, 2, 0.9), (0, 90, 2, 0.1), (0, 120, 0, 0.9), (0, 150, 4, 0.5)]
    df = spark.createDataFrame(rows, "rec long, start long, label int, conf double")
    assert _rows(islands.class_runs(df, 0.3, 60), "type", "start", "end") == [(1, 0, 90), (2, 60, 120), (4, 150, 210)]


def test_split_long(spark):
    df = spark.createDataFrame([(0, 0.0, 150.0), (0, 200.0, 320.0)], "rec long, start double, end double")
    assert _rows(islands.split_long(df, 120.0, 60.0), "start", "end") == [(0.0, 75.0), (75.0, 150.0), (200.0, 320.0)]


def test_suppression(spark):
    rows = [(0, 0, 0.0, 10.0, 0.5), (0, 1, 1.0, 11.0, 0.9), (0, 2, 20.0, 30.0, 0.5), (0, 3, 21.0, 31.0, 0.5)]
    df = spark.createDataFrame(rows, "rec long, ord long, start double, end double, avg_conf double")
    assert _rows(islands.suppressed(df, 0.3), "ord") == [(1,), (2,)]


def test_thinning_is_greedy(spark):
    df = spark.createDataFrame([(0, j) for j in (0, 5, 10, 19, 20, 31)], "rec long, j long")
    assert _rows(islands.thinned(df, 10), "j") == [(0,), (10,), (20,), (31,)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=30), st.integers(0, 7), st.sampled_from([1, 4, 9, 100]))
def test_centred_sums_are_frames(spark, values, half, size):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "rec long, i long, v long")
    for r in frames.centred_sums(df, "v", half, "s", "n", size=size).collect():
        own = [x for x in values[max(0, r.i - half) : r.i + half + 1] if x is not None]
        assert (r.s, r.n) == (sum(own), len(own))


def test_percentile_takes_a_member_by_floor(spark):
    df = spark.createDataFrame([(0, i, float(i)) for i in range(121)], "rec long, i long, v double")
    middle = frames.sliding_percentile(df, "v", 60, 0.95, "p").where("i = 60").first()
    assert middle.p == 114.0


def test_interpolation_is_that_of_numpy(spark):
    values = [3.0, 5.0, 4.0, 4.0, 9.0]
    signal = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "rec long, i long, v double")
    times = [0.0, 0.1, 0.55, 1.3, 1.99, 2.0, 7.0]
    grid = spark.createDataFrame([(0, t) for t in times], "rec long, t double")
    found = dict(_rows(frames.interpolate(signal, 2.0, grid, "v"), "t", "v"))
    expected = np.interp(times, np.arange(5) / 2.0, values)
    assert np.allclose([found[t] for t in times], expected)


def test_tiles_leave_out_the_exact_fit(spark):
    for n, tiles in ((60, 0), (61, 1), (91, 2)):
        df = spark.createDataFrame([(0, i, i) for i in range(n)], "rec long, i long, v long")
        assert frames.tiles(df, 60, 30, ["v"]).count() == tiles


def test_chains_are_judged_in_few_groups_and_none_is_cut(spark, monkeypatch):
    """A thousand chains are a group, not a thousand; a chain that begins in a group is in it whole."""
    rows = [(r, k, 10.0 * (k // 3) + k % 3, 10.0 * (k // 3) + k % 3 + 5, (k * 7 % 11) / 11) for r in (1, 2) for k in range(3000)]
    df = spark.createDataFrame(rows, "rec long, ord long, start double, end double, avg_conf double")
    own = islands.in_groups(df, "start", "end", ["ord"])
    assert own.select("rec", "_chain").distinct().count() == 2000 and own.select("rec", "_group").distinct().count() == 2
    whole = sorted(map(tuple, islands.suppressed(df, 0.3).collect()))
    monkeypatch.setattr(islands, "TOGETHER", 7)
    cut = islands.in_groups(df, "start", "end", ["ord"])
    assert cut.select("rec", "_group").distinct().count() > 200 and cut.select("rec", "_chain", "_group").distinct().count() == 2000
    assert sorted(map(tuple, islands.suppressed(df, 0.3).collect())) == whole


def test_events_without_a_start_meet_none(spark):
    rows = [(1, 1, 0.0, 10.0, 0.9), (1, 2, None, 9.0, 0.8), (1, 3, 1.0, 10.0, 0.5), (1, 4, 30.0, 40.0, 0.4), (1, 5, 31.0, 40.0, 0.3)]
    df = spark.createDataFrame(rows, "rec long, ord long, start double, end double, avg_conf double")
    assert _rows(islands.suppressed(df, 0.3), "ord") == [(1,), (2,), (4,)]
