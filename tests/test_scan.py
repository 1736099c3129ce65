"""The scan of the flow in chunks against plain loops over the whole signal."""

from dataclasses import replace

import numpy as np
import pytest

from nightloom.config import DEFAULT
from nightloom.operators import detect, frames, scan

RATE = 4
CELLS = [(0.1, 0.3), (0.1, 0.5), (0.6, 0.1), (0.3, 0.6)]


def _signal(seed, seconds):
    rng = np.random.default_rng(seed)
    level = np.repeat(rng.choice([0, 2, 30, 60, 100], seconds // 5 + 1), 5 * RATE)[: seconds * RATE]
    return (level * rng.choice([-1, 1], len(level)) + rng.integers(0, 3, len(level))).astype(np.int64)


def _features(x):
    n, half = len(x), RATE // 2
    env = np.array([np.abs(x[max(0, i - half) : i + half + 1]).mean() for i in range(n)])
    slow = np.array([env[k : k + RATE].max() for k in range(0, n, RATE)])
    base = []
    for k in range(len(slow)):
        frame = np.sort(slow[max(0, k - 60) : k + 61])
        base.append(frame[min(int(len(frame) * 0.95), len(frame) - 1)])
    base = np.array(base)
    at, part = np.arange(n) // RATE, np.arange(n) % RATE / RATE
    return env, base[at] * (1 - part) + base[np.minimum(at + 1, len(base) - 1)] * part


def _runs(valid, flag):
    out, start = [], None
    for i in np.flatnonzero(valid):
        if flag[i] and start is None:
            start = int(i)
        elif not flag[i] and start is not None:
            out.append((start, int(i)))
            start = None
    return out


def _brute(x):
    env, base = _features(x)
    out = set()
    for c, (a, h) in enumerate(CELLS):
        out |= {("apnea", c, *r) for r in _runs(np.ones(len(x), bool), (env < base * a) & (base > 1))}
        ratio = env / np.where(base > 0, base, 1)
        out |= {("hypopnea", c, *r) for r in _runs(base >= 1, (ratio <= 1 - h) & (ratio > a))}
    smooth = np.array([env[max(0, i - 60) : i + 61].mean() for i in range(len(x))])
    return out, smooth


@pytest.fixture(scope="module")
def flow(spark):
    signals = {0: _signal(1, 700), 3: _signal(2, 61), 4: np.zeros(400, np.int64), 5: _signal(4, 3)}
    # A stretch below the noise floor that is longer than what a chunk sees of its neighbours.
    signals[6] = np.concatenate((_signal(5, 200), np.zeros(4 * 400, np.int64), _signal(6, 150)))
    rows = [(r, j, int(v)) for r, x in signals.items() for j, v in enumerate(x)]
    return signals, spark.createDataFrame(rows, "rec long, j long, flow long").repartition(3).cache()


@pytest.mark.parametrize("seconds", [1, 7, 60, 600, 5000])
def test_runs_are_those_of_the_whole_signal(flow, seconds):
    signals, df = flow
    found = scan.scan(df, RATE, replace(DEFAULT, chunk_sec=seconds), CELLS).collect()
    for rec, x in signals.items():
        own = {(r.kind, r.cell, r.start, r.end) for r in found if r.rec == rec and r.kind in ("apnea", "hypopnea")}
        expected, smooth = _brute(x)
        assert own == expected
        turns = {(r.kind, r.start) for r in found if r.rec == rec and r.kind in ("peak", "trough")}
        clear = np.abs(np.diff(smooth)) > 1e-9
        for i in range(1, len(x) - 1):
            if clear[i - 1] and clear[i]:
                assert (("peak", i) in turns) == (smooth[i] > smooth[i - 1] and smooth[i] > smooth[i + 1])
                assert (("trough", i) in turns) == (smooth[i] < smooth[i - 1] and smooth[i] < smooth[i + 1])


def test_kernel_and_windows_agree(flow):
    df = flow[1]
    own = frames.envelope(df, RATE // 2, size=28)
    slow = frames.sliding_percentile(frames.downsample_max(own, "env", RATE), "env", 60, 0.95, "baseline", size=9)
    expected = {(r.rec, r.j): (r.env, r.baseline) for r in frames.upsample(slow, "baseline", RATE, own, size=9).collect()}
    assert {(r.rec, r.j): (r.env, r.baseline) for r in detect.flow_features(df, RATE, replace(DEFAULT, chunk_sec=50)).collect()} == expected


@pytest.mark.parametrize("length, seconds", [(1, 60), (37, 20), (240, 60), (5000, 600), (5000, 7)])
def test_stretches_of_samples_give_what_rows_give(spark, flow, length, seconds):
    signals, df = flow
    rows = [(r, k, x[k : k + length].tolist()) for r, x in signals.items() for k in range(0, len(x), length)]
    stretches = spark.createDataFrame(rows, "rec long, first long, samples array<long>").repartition(3)
    config = replace(DEFAULT, chunk_sec=seconds)
    found = [sorted(map(str, scan.scan(x, RATE, config, CELLS).collect())) for x in (df, stretches)]
    assert found[0] == found[1]


@pytest.mark.parametrize("seconds", [1, 10, 600])
def test_snoring_windows(spark, seconds):
    rng = np.random.default_rng(7)
    x = np.where(np.arange(480) // 40 % 2 == 0, rng.normal(0, 20, 480), rng.normal(0, 0.5, 480))
    df = spark.createDataFrame([(1, j, float(v)) for j, v in enumerate(x)], "rec long, j long, flow double")
    config = replace(DEFAULT, chunk_sec=seconds)
    rows = {r.w: r for r in detect.snore_windows(df, RATE, config).collect()}
    assert sorted(rows) == list(range(119))
    flags = []
    for w in range(119):
        own = x[w * RATE : (w + 2) * RATE]
        d = np.diff(own)
        rms = np.sqrt((own**2).mean())
        hf = np.sqrt((d**2).mean()) / rms if rms > 0.1 else 0
        zcr = np.mean((d[1:] >= 0) != (d[:-1] >= 0))
        assert np.allclose((rows[w].rms, rows[w].hf_ratio, rows[w].zcr), (rms, hf, zcr))
        flags.append(hf > 0.5 and zcr > 0.3 and rms > 2)
    own = {(r.start, r.end) for r in scan.scan(df, RATE, config).where("kind = 'snore'").collect()}
    assert own == set(_runs(np.ones(119, bool), np.array(flags)))


def test_samples_that_are_no_numbers_are_told(spark):
    rows = [(1, j, float("nan") if j == 130 else 5.0) for j in range(200)] + [(2, j, 5.0) for j in range(200)]
    found = scan.scan(spark.createDataFrame(rows, "rec long, j long, flow double"), RATE, replace(DEFAULT, chunk_sec=20)).where("kind = 'broken'").collect()
    assert [r.rec for r in found] == [1]
