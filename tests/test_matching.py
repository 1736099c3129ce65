"""One-to-one matching of events against brute force."""

import itertools

import numpy as np

from nightloom.operators import matching


def _iou(a, b):
    both = max(min(a[1], b[1]) - max(a[0], b[0]), 0)
    whole = (a[1] - a[0]) + (b[1] - b[0]) - both
    return both / whole if whole > 0 else 0.0


def _frame(spark, rows):
    return spark.createDataFrame([(r, k, float(s), float(e), t) for r, own in rows.items() for k, (s, e, t) in enumerate(own)], "rec long, id long, start double, end double, type int")


def _brute(truth, found, least):
    out = set()
    for rec in truth:
        pairs = sorted((-_iou(t, p), i, j) for (i, t), (j, p) in itertools.product(enumerate(truth[rec]), enumerate(found.get(rec, []))) if _iou(t, p) >= least)
        left, right = set(), set()
        for n, i, j in pairs:
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                out.add((rec, i, j, round(-n, 12)))
    return out


def test_matching_is_greedy_and_one_to_one(spark):
    rng = np.random.default_rng(1)
    side = lambda n: [(s, s + d, int(t)) for s, d, t in zip(rng.integers(0, 900, n), rng.integers(5, 90, n), rng.integers(1, 5, n))]
    truth, found = {1: side(60), 2: side(5), 3: side(30), 5: [(0, 10, 1)]}, {1: side(70), 2: [], 3: side(30), 5: [(0, 5, 1), (5, 10, 1)]}
    for least in (0.5, 0.1):
        pairs = matching.matched(_frame(spark, truth), _frame(spark, found), least)
        assert {(r.rec, r.truth, r.found, round(r.iou, 12)) for r in pairs.collect()} == _brute(truth, found, least)


def test_report_counts_hits_of_the_type(spark):
    truth = _frame(spark, {1: [(0, 10, 1), (20, 30, 2), (50, 60, 2)]})
    found = _frame(spark, {1: [(0, 10, 1), (20, 30, 1), (80, 90, 4)]})
    rows = {r.type: (r.labelled, r.found, r.hits, r.hits_of_type, r.precision, r.recall) for r in matching.match_report(truth, found, matching.matched(truth, found)).collect()}
    assert rows == {1: (1, 2, 1, 1, 0.5, 1.0), 2: (2, 0, 1, 0, 0.0, 0.0), 4: (0, 1, 0, 0, 0.0, 0.0)}
