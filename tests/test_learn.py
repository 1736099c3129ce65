import numpy as np

from nightloom.operators import learn
from nightloom.streaming import online


def test_parameter_count_and_shapes():
    network = learn.CNN(3)
    trainable = sum(x["w"].size + x["b"].size + x["gamma"].size + x["beta"].size for x in network.layers) + sum(x.size for x in network.head)
    assert trainable == 9605
    assert network(np.zeros((2, 600, 3))).shape == (2, 5)
    assert learn.Mira(3)(np.random.default_rng(0).normal(size=(2, 20, 3))).shape == (2, 5)


def test_rotation_keeps_lengths_and_depends_on_distance_only():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 1, 1, 1, 8))
    at = lambda v, t: learn.Mira.rotate(v, np.array([float(t)]))
    assert np.allclose(np.linalg.norm(at(x, 5)), np.linalg.norm(x))
    assert np.allclose((at(x, 3) * at(y, 5)).sum(), (at(x, 13) * at(y, 15)).sum())


def test_class_weights_mean_one(spark):
    counts = spark.createDataFrame([(0, 100), (1, 4), (2, 9)], "label int, n long")
    rows = {r.label: r.weight for r in learn.class_weights(counts, 2.0).collect()}
    assert abs(sum(rows.values()) - 3) < 1e-9 and rows[1] > rows[2] > rows[0]


def test_classification_without_support_is_zero(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1)], "truth int, predicted int")
    rows = {r.label: r for r in learn.classification_report(pairs, [0, 1, 2]).collect()}
    assert rows[0].recall == 0.5 and rows[1].recall == 0.0 and rows[2].f1 == 0.0


def test_online_runs_equal_batch_runs(spark, tmp_path):
    flags = [0, 1, 1, 0, 1, 0, 1, 1, 1]
    rows = spark.createDataFrame([(0, i, bool(f)) for i, f in enumerate(flags)], "rec long, i long, flag boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = online.online_runs(stream, 2).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.start, r.end) for r in spark.table("found").collect()] == [(1, 3)]
