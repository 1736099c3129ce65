import itertools
import json
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from nightloom import catalog
from nightloom.operators import report

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings", "labels")
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def _sorted(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF).toPandas()
    result = duck.sql(ORACLE[name])
    expected = pd.DataFrame(result.fetchall(), columns=[c[0] for c in result.description])
    assert sorted(found.columns) == sorted(expected.columns)
    assert _sorted(found) == _sorted(expected)


def _windows(duck):
    """The model windows of the tables, from SQL: their places."""
    return {(r[0], r[1]) for r in duck.sql(ORACLE["model_windows"]).fetchall()}


@pytest.mark.parametrize("name", ["cnn_forward", "mira_forward"])
def test_every_window_has_a_class(spark, duck, name):
    rows = catalog.queries()[name](spark, SF).collect()
    assert {(r.rec, r.start) for r in rows} == _windows(duck) and len(rows) == len(_windows(duck))
    assert all(0 <= r.label < 5 and 0.2 <= r.conf <= 1 for r in rows)


def test_report_texts_say_what_the_indices_are(spark, duck):
    rows = {r.rec: r for r in catalog.queries()["report_texts"](spark, SF).collect()}
    indices = duck.sql(ORACLE["kpi_indices"]).df().set_index("rec")
    counts = duck.sql(ORACLE["event_counts"]).df().set_index("rec")
    minutes = duck.sql(ORACLE["position_minutes"]).df()
    assert set(rows) == set(indices.index)
    for rec, row in rows.items():
        text, found = row.text.split("\n"), json.loads(row.json)
        assert found["report"]["ahi"] == pytest.approx(indices.ahi[rec]) and len(found["events"]) >= counts.loc[rec].sum()
        assert [e["start_sec"] for e in found["events"]] == sorted(e["start_sec"] for e in found["events"])
        assert any(x.startswith(f"  AHI: {indices.ahi[rec]:.1f} events/hr") for x in text) and f"  ODI: {indices.odi[rec]:.1f} events/hr" in text
        assert f"  Snore: {counts.snore_count[rec]}" in text and f"  Cheyne-Stokes: {indices.csr_duration_min[rec]:.1f} min" in text
        own = minutes[minutes.rec == rec].sort_values(["minutes", "position"], ascending=[False, True])
        assert [x.split()[0] for x in text[text.index("POSITIONS") + 1 :]] == own.position.tolist()


def test_negatives_meet_no_event_and_not_each_other(spark, duck):
    rows = catalog.queries()["negatives"](spark, SF).collect()
    events = {}
    for rec, s, e in duck.sql(ORACLE["apnea_runs"]).fetchall():
        events.setdefault(rec, []).append(int(s + (e - s) / 2))
    for rec in {r.rec for r in rows}:
        own = sorted(r.centre for r in rows if r.rec == rec)
        assert len(own) <= len(events[rec]) and all(b - a >= 10 for a, b in zip(own, own[1:]))
        assert all(abs(c - e) >= 10 for c in own for e in events[rec])
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, catalog.queries()["negatives"](spark, SF).collect()))


@pytest.mark.parametrize("name", ["temporal_nms", "patient_ahi", "event_matching"])
def test_other_queries_give_rows(spark, name):
    """Their operators have brute-force tests of their own."""
    assert catalog.queries()[name](spark, SF).count() > 0


def test_a_short_training(spark):
    rows = catalog.queries()["cnn_training"](spark, "/root/testdata/sf0.01").collect()
    assert [r.epoch for r in rows] == [1, 2] and all(r.train_loss > 0 and r.test_loss > 0 for r in rows)


@pytest.mark.parametrize("name", ["resample_grid", "event_windows", "alignment_ratio"])
def test_rows_that_are_made_are_not_broadcast(spark, name):
    """Rows made of few others look small to the planner, at any size."""
    found = catalog.queries()[name](spark, SF)
    found.collect()
    lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = lambda x: re.search(r"[A-Z]", x).start() if re.search(r"[A-Z]", x) else 0
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            inside = list(itertools.takewhile(lambda x: depth(x) > depth(line), lines[at + 1 :]))
            assert not any("Generate explode(sequence" in x for x in inside), "\n".join(lines)


def test_every_query_is_tested():
    tested = {"cnn_forward", "mira_forward", "report_texts", "negatives", "temporal_nms", "patient_ahi", "event_matching", "cnn_training"}
    assert set(catalog.queries()) - set(ORACLE) == tested


def test_texts_go_to_files_or_are_printed(spark, tmp_path, capsys):
    texts = spark.createDataFrame([(1, "one\nmore"), (2, "two")], "rec long, text string")
    report.emit(texts, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out/rec=1").glob("part-*")) == "one\nmore\n"
    report.emit(texts)
    assert capsys.readouterr().out == "one\nmore\ntwo\n"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 8
