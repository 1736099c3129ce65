"""The threshold grid's totals and the three-way comparison."""

import pytest

from nightloom.operators import compare, tuning


def test_the_grid_has_the_pairs_that_leave_room():
    grid = tuning.cells()
    assert len(grid) == 32 and (0.1, 0.7) in grid and (0.6, 0.3) in grid and (0.6, 0.4) not in grid and (0.3, 0.7) not in grid


def test_totals_drop_failed_cells_and_unlabelled_recordings(spark):
    rows = [(1, 0, 0.1, 0.3, 4, 6, False), (2, 0, 0.1, 0.3, 1, 0, False), (9, 0, 0.1, 0.3, 50, 50, False)]
    rows += [(1, 1, 0.1, 0.4, 9, 9, False), (2, 1, 0.1, 0.4, None, None, True)]
    rows += [(1, 2, 0.1, 0.5, 8, 5, False), (2, 2, 0.1, 0.5, 0, 0, False), (1, 3, 0.1, 0.6, 6, 5, False), (2, 3, 0.1, 0.6, 2, 0, False)]
    events = spark.createDataFrame(rows, "rec long, cell int, apnea double, hypopnea double, apneas long, hypopneas long, failed boolean")
    truth = spark.createDataFrame([(1, 9), (2, 3), (5, 99)], "rec long, true_events long")
    totals = tuning.grid_totals(events, truth)
    found = {r.cell: (r.version, r.events, r.true_events, r.error, r.best) for r in totals.collect()}
    assert found == {0: ("v1.0-A0.1-H0.3", 11, 12, 1, True), 2: ("v1.0-A0.1-H0.5", 13, 12, 1, False), 3: ("v1.0-A0.1-H0.6", 13, 12, 1, False)}
    assert tuple(tuning.best_cell(totals).first()) == (0.1, 0.3, 5, 6, 11, 1)
    assert tuning.best_cell(totals.limit(0)).count() == 0


@pytest.fixture
def sides(spark):
    truth = compare.truth_counts(spark.createDataFrame([("patient_001", x) for x in ("OBSTR", "obstr", "Cntrl", "HYPOP", "RERA")] + [("patient_003", "MIXED")], "rec string, t string"))
    detected = spark.createDataFrame([("patient_001", 12.5, "Mild", 0.5), ("patient_002", 40.0, "Severe", 0.0)], "rec string, ahi double, osa_severity string, hours double")
    predicted = spark.createDataFrame([("patient_001", 3.0, 1, 2, 3, 4), ("patient_002", 7.125, 0, 0, 0, 1)], "rec string, ahi double, obstr long, cntrl long, mixed long, hypop long")
    return truth, detected, predicted


def test_labels_count_in_any_case(sides):
    assert {r.rec: tuple(r)[1:] for r in sides[0].collect()} == {"patient_001": (2, 1, 0, 1, 4), "patient_003": (0, 0, 1, 0, 1)}


def test_errors_take_what_both_have(sides):
    truth, detected, _ = sides
    errors = compare.index_errors(truth, detected)
    assert [tuple(r) for r in errors.collect()] == [("patient_001", 8.0, 12.5, 4.5)]
    assert tuple(compare.mean_error(errors).first()) == (1, 4.5, 4.5)


def test_comparison_has_all_sides(sides):
    found = {r.rec: r for r in compare.comparison(*sides).collect()}
    assert sorted(found) == ["patient_001", "patient_002", "patient_003"]
    assert (found["patient_002"].true_ahi, found["patient_002"].osa_severity, found["patient_002"].true_obstr) == (0.0, "Severe", 0)
    assert (found["patient_003"].detector_ahi, found["patient_003"].model_ahi, found["patient_003"].osa_severity, found["patient_003"].true_mixed) == (0.0, 0.0, "N/A", 1)


def test_the_report_is_one_text_in_order(sides, tmp_path):
    compare.write_markdown(compare.markdown(compare.comparison(*sides)), str(tmp_path / "report"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text == """# Comparison of labels, detector and network

## Index (events per hour)
| Patient | Labels | Detector | Network | Severity |
|-|-|-|-|-|
| patient_001 | **8.00** | 12.50 | 3.00 | Mild |
| patient_002 | **0.00** | 40.00 | 7.13 | Severe |
| patient_003 | **0.00** | 0.00 | 0.00 | N/A |

## Events by class
| Patient | Class | Labels | Network |
|-|-|-|-|
| patient_001 | Obstructive | 2 | 1 |
| patient_001 | Central | 1 | 2 |
| patient_001 | Mixed | 0 | 3 |
| patient_001 | Hypopnea | 1 | 4 |
| patient_002 | Obstructive | 0 | 0 |
| patient_002 | Central | 0 | 0 |
| patient_002 | Mixed | 0 | 0 |
| patient_002 | Hypopnea | 0 | 1 |
| patient_003 | Obstructive | 0 | 0 |
| patient_003 | Central | 0 | 0 |
| patient_003 | Mixed | 1 | 0 |
| patient_003 | Hypopnea | 0 | 0 |
"""
