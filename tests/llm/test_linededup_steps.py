"""Steps of line dedup that decide its cost: passes over the texts and rounds of the components."""

import numpy as np
import pyarrow as pa
import pytest

from nightloom.llm import components as cc
from nightloom.llm import lines
from nightloom.llm.textkernels import Spans


def _jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    found = work()
    made = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, made


@pytest.mark.parametrize("most", [0, 40, 500_000])
def test_few_edges_take_one_pass_and_many_take_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(cc, "TASK_EDGES", most)
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 8)], "u long, v long").repartition(6)
    found, jobs = _jobs(spark, f"components-{most}", lambda: {(r.node, r.root) for r in cc.components(edges).collect()})
    assert found == {(i, 100) for i in range(100, 161)} | {(7, 7), (8, 7), (9, 7)}
    assert most < 100 or jobs <= 12


def test_lines_are_numbered_from_texts_read_once():
    text = ["a\n\nline of twelve\n aéß ", "", None, "\n\n", "x" * 600 + "\ny"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(10, 15)), pa.array(text)], ["row", "order", "text"])
    empty = batch.slice(0, 0)
    packed = list(lines._line_nodes(iter([empty, batch])))
    assert sum(map(len, packed)) == 5  # a row per text
    found = [tuple(r.values()) for x in lines._lines(iter([packed[0].slice(0, 0), *packed])) for r in x.to_pylist()]
    assert [x[:3] for x in found] == [(0, 10, 0), (0, 10, 2), (0, 10, 3), (4, 14, 0), (4, 14, 1)]
    raw = np.frombuffer(b"line of twelve", np.uint8)
    assert found[1][3] == Spans(raw).of(np.array([0]), np.array([14])).view(np.int64)[0]


def test_shingles_do_not_depend_on_the_parts_they_are_cut_in(monkeypatch):
    column = pa.array([("grün " * i + "tail %d\n" % i) * 3 for i in range(1, 30)])
    whole = lines.line_shingles
    ((_, _, data, offsets),) = lines.slices(column)
    starts, ends, _ = lines.line_spans(data, offsets)
    keep = ~lines._blank(data, starts, ends)
    hashes, begin = whole(data, Spans(data), starts[keep], ends[keep])
    monkeypatch.setattr(lines, "_PART", 200)
    parts = list(lines.shingled(data, Spans(data), starts[keep], ends[keep]))
    assert len(parts) > 5
    assert np.array_equal(np.concatenate([x[2] for x in parts]), hashes)
    assert np.array_equal(np.diff(np.concatenate([x[3] + 0 for x in parts])[:3]), np.diff(begin[:3]))
    assert np.array_equal(lines.signatures(hashes, begin), np.concatenate([lines.signatures(*x[2:]) for x in parts], axis=1))
