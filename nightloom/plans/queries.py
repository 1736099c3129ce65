"""The registered queries: operators applied to the signal view and to the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightloom.config import DEFAULT
from nightloom.functions import scalar
from nightloom.operators import compare, detect, frames, islands, learn, matching, report, scan, training, tuning
from nightloom.plans.signal_view import RATE, signal_view
from nightloom.sources import edf_source, tensors
from nightloom.storage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str) -> Query:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_events, _labels, _embeddings, _documents = (_table(x) for x in ("events", "labels", "embeddings", "documents"))


class _View:
    """What the queries share, made once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        view = signal_view(spark, sf_dir)
        self.view, self.slow, self.flow = view, view["slow"], view["flow"]

    @property
    def features(self) -> DataFrame:
        return detect.flow_features(self.flow, RATE)

    @property
    def found(self) -> DataFrame:
        return scan.scan(self.flow, RATE)

    @property
    def spo2(self) -> DataFrame:
        return detect.spo2_features(self.slow)

    @property
    def desats(self) -> DataFrame:
        return detect.desaturations(self.spo2)

    @property
    def apneas(self) -> DataFrame:
        return detect.apneas(self.found, self.slow, RATE)

    @property
    def hypopneas(self) -> DataFrame:
        return detect.hypopneas(self.found, self.spo2, self.desats, RATE)

    @property
    def events(self) -> DataFrame:
        return detect.all_events(self.view, RATE)

    @property
    def indices(self) -> DataFrame:
        return report.indices(self.events, self.slow)


def _on_view(make: Callable[[_View], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(_View(spark, sf_dir))


def _downsampled(v: _View) -> DataFrame:
    return frames.downsample_max(frames.envelope(v.flow, RATE // 2), "env", RATE)


def _seconds(df: DataFrame) -> DataFrame:
    return df.select("rec", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"))


def _resampled(v: _View) -> DataFrame:
    # At 2.5 a second, as long as the recording: g / 2.5 is less than its last second. Every second but the last has its own places.
    last = v.slow.groupBy("rec").agg(F.max("i").alias("n"))
    grid = v.slow.select("rec", "i").join(last, "rec").where("i < n")
    grid = grid.select("rec", F.explode(F.expr("sequence((5 * i + 1) div 2, (5 * i + 6) div 2 - 1)")).alias("g")).withColumn("t", F.col("g") / F.lit(2.5))
    signal = v.slow.select("rec", "i", F.col("spo2").cast("double").alias("value"))
    return frames.interpolate(signal, 1.0, grid, "value").select("rec", F.col("g").cast("long").alias("g"), F.round("value", 9).alias("value"))


def _norm_stats(v: _View) -> DataFrame:
    stats = learn.norm_stats(v.slow, ["effort", "pulse", "spo2"])
    return stats.select("channel", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def _zscore(v: _View) -> DataFrame:
    return learn.zscores(v.slow, learn.norm_stats(v.slow, ["spo2"]), "spo2").select("rec", "i", F.round("z", 6).alias("z"))


def _derived(v: _View) -> DataFrame:
    own = frames.differences(v.slow, "spo2", "spo2_deriv")
    return own.select("rec", "i", "spo2_deriv", F.round(scalar.effort_ratio(F.col("effort"), F.col("amp")), 9).alias("effort_ratio"))


def _total(values: str) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _model_windows(v: _View) -> DataFrame:
    own = frames.tiles(v.slow, 60, 30, ["spo2"])
    return own.select("rec", F.col("start").cast("long").alias("start"), _total("spo2").alias("spo2_sum"), F.size("spo2").cast("long").alias("n"))


def _event_windows(v: _View) -> DataFrame:
    runs = detect.apnea_runs(v.found, RATE)
    own = learn.event_windows(runs, v.slow, 30, ["spo2"])
    return own.select("rec", "start_sec", _total("spo2").alias("spo2_sum"), F.size("spo2").cast("long").alias("n"))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).select("vec_id", F.slice("embedding", 1, 5).cast("array<double>").alias("logits"))


def _argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select("vec_id", scalar.argmax(F.col("logits")).cast("long").alias("label"), F.array_max("logits").alias("top"))


def _softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _logits(spark, sf_dir).select("vec_id", F.posexplode(scalar.softmax(F.col("logits"))).alias("k", "p"))
    return own.select("vec_id", F.col("k").cast("long").alias("k"), F.round("p", 9).alias("p"))


def _experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.top_experts(_embeddings(spark, sf_dir).select("vec_id", F.slice("embedding", 1, 8).alias("logits")), "vec_id", 2)


def _class_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir).withColumn("rec", F.col("user_id") % 8)
    own = own.withColumn("i", F.row_number().over(Window.partitionBy("rec").orderBy("ts", "event_id")) - 1)
    return own.select("rec", (F.col("i") * 30).cast("long").alias("start"), F.expr("(event_id * 7 div 3) % 3").alias("label"), (F.col("event_id") % 10 / F.lit(10.0)).alias("conf"))


def _run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = islands.class_runs(_class_windows(spark, sf_dir), DEFAULT.confidence, 60)
    return own.select("rec", "type", "start", F.col("end").cast("double").alias("end"), F.round("avg_conf", 9).alias("avg_conf"), "n")


def _split(v: _View) -> DataFrame:
    own = v.hypopneas.select("rec", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"))
    return islands.split_long(own, 12.0, 6.0).select("rec", F.col("part").cast("long").alias("part"), F.col("start").alias("start_sec"), F.col("end").alias("end_sec"))


def _nms(v: _View) -> DataFrame:
    own = v.slow.selectExpr("rec", "i as ord", "cast(i as double) as start", "cast(i + 4 + c % 13 as double) as end", "(c % 50) / 50.0D as avg_conf")
    return _seconds(islands.suppressed(own, DEFAULT.overlap))


def _iou(v: _View) -> DataFrame:
    a = detect.cheyne_stokes(v.found, v.slow, RATE).select("rec", F.col("start_sec").alias("s1"), F.col("end_sec").alias("e1"))
    b = v.desats.select("rec", F.col("start_sec").alias("s2"), F.col("end_sec").alias("e2"))
    own = islands.overlapping(a, b, F.expr("s1 < e2 and s2 < e1"))
    return own.select("rec", "s1", "s2", scalar.temporal_iou(*[F.col(x) for x in ("s1", "e1", "s2", "e2")]).alias("iou"))


def _gate(v: _View) -> DataFrame:
    return learn.desaturation_gate(v.hypopneas, v.slow, 30, 10, 30, DEFAULT.gate_drop)


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.confusion(_labels(spark, sf_dir).select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted")))


def _classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.classification_report(_labels(spark, sf_dir).select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted")), [0, 1])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted"))


def _averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learn.report_averages(learn.classification_report(_pairs(spark, sf_dir), [0, 1]))
    return found.select(*[F.round(x, 9).alias(x) for x in found.columns if x != "support"], "support")


def _truth(v: _View) -> DataFrame:
    return compare.truth_counts(v.view["truth"])


def _detected(v: _View) -> DataFrame:
    return v.indices.withColumnRenamed("valid_duration_hours", "hours")


def _predictions(v: _View) -> DataFrame:
    """The index of runs of made window labels, neither split nor suppressed."""
    windows = v.slow.where("i % 30 = 0").selectExpr("rec", "i as start", "(i div 30) * 7 div 3 % 5 as label", "(i div 30) % 10 / 10.0D as conf")
    return learn.inferred_index(islands.class_runs(windows, DEFAULT.confidence, 60), v.slow)


def _mae(v: _View) -> DataFrame:
    found = compare.mean_error(compare.index_errors(_truth(v), _detected(v)))
    return found.select("recordings", F.round("mae", 9).alias("mae"), F.round("worst", 9).alias("worst"))


def _model_mae(v: _View) -> DataFrame:
    predicted = _predictions(v).withColumnRenamed("duration_hrs", "hours")
    found = compare.index_errors(_truth(v), predicted)
    return found.select("rec", F.round("true_ahi", 9).alias("true_ahi"), F.round("ahi", 9).alias("ahi"), F.round("error", 9).alias("error"))


def _compared(v: _View) -> DataFrame:
    return compare.comparison(_truth(v), _detected(v), _predictions(v))


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _documents(spark, sf_dir).groupBy(F.md5(F.col("text").cast("binary")).alias("digest"))
    return own.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def _grid(v: _View) -> DataFrame:
    return learn.threshold_grid(v.features)


def _grid_events(v: _View) -> DataFrame:
    return tuning.grid_events(v.view, RATE)


def _grid_totals(v: _View) -> DataFrame:
    return tuning.grid_totals(_grid_events(v), _truth(v))


def _alignment(v: _View) -> DataFrame:
    features = v.features.select("rec", "j", "env")
    runs = detect.apnea_runs(v.found, RATE)
    inside = runs.select("rec", F.explode(F.sequence((F.col("start_sec") * RATE).cast("long"), (F.col("end_sec") * RATE).cast("long") - 1)).alias("j"))
    q = features.hint("merge").join(inside, ["rec", "j"]).groupBy("rec").agg(F.percentile("env", 0.5).alias("q"))
    t = features.groupBy("rec").agg(F.percentile("env", 0.5).alias("t"))
    return q.join(t, "rec").select("rec", F.round(F.col("q") / F.col("t"), 9).alias("ratio"))


def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir).select((F.col("user_id") % 8).alias("rec"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("c"))
    own = own.groupBy("rec", F.window("ts", "60 seconds", "30 seconds").alias("w")).agg(F.count("*").alias("n"), F.sum("c").alias("total"))
    return own.select("rec", F.unix_seconds("w.start").alias("window_start"), "n", "total")


def _labelled_windows(v: _View) -> DataFrame:
    """Made labels of the windows, and the part that their recording is in."""
    split = learn.patient_split(v.slow.select("rec").distinct(), 0.2, 42)
    return v.slow.where("i % 30 = 0").selectExpr("rec", "i as start", "cast((i div 30) * 7 div 3 % 5 as int) as label").join(split, "rec")


def _balanced(v: _View) -> DataFrame:
    return training.balanced_batches(_labelled_windows(v).drop("split"), 64, 42, 0).select("batch", "label", F.col("place").cast("long").alias("place"), "rec", "start")


_CHANNELS = ["spo2", "effort", "pulse"]


def _training_windows(v: _View) -> DataFrame:
    return frames.tiles(v.slow, 60, 30, _CHANNELS).withColumn("start", F.col("start").cast("long")).join(_labelled_windows(v), ["rec", "start"])


def _dataset(v: _View) -> DataFrame:
    """The windows written as a dataset and read again: their channels' sums."""
    spark = v.slow.sparkSession
    folder = f"{shared_folder(spark)}/dataset-{uuid.uuid4().hex}"
    tensors.write_dataset(_training_windows(v), folder, _CHANNELS, 60, stats=learn.norm_stats(v.slow, _CHANNELS))
    rows, _ = tensors.read_dataset(spark, folder, _CHANNELS, 60)
    x = tensors.window_array(F.col("x"), 60, 3)
    total = lambda k: F.aggregate(x, F.lit(0.0), lambda a, r: a + r[k].cast("double")).cast("long")
    return rows.select("rec", "start", "split", F.col("label").cast("long").alias("label"), *[total(k).alias(c) for k, c in enumerate(_CHANNELS)])


def _training(v: _View) -> DataFrame:
    """The epochs of a short training of the small network."""
    stats = {x["channel"]: (x["mean"], x["std"]) for x in learn.norm_stats(v.slow, _CHANNELS).collect()}  # a row per channel
    _, log = training.train(_training_windows(v), _CHANNELS, stats, training.Plan(epochs=2, together=8))
    return v.slow.sparkSession.createDataFrame([tuple(r.values()) for r in log], "epoch long, train_loss double, train_acc double, test_loss double, test_acc double")


def _class_histogram(v: _View) -> DataFrame:
    return learn.class_histogram(_labelled_windows(v).where("label <> 3"), 5, 2.0).select("label", "n", F.round("weight", 9).alias("weight"))


def _matching(v: _View) -> DataFrame:
    """Labelled events against those of the detectors."""
    truth = v.view["truth"].where("upper(t) <> 'OTHER'").selectExpr("rec", "cast(s as long) as id", "s as start", "s + d as end")
    found = v.events.where(F.col("event_type").isin("Obstructive", "Central", "Mixed", "Hypopnea"))
    found = found.select("rec", (F.col("start_sec") * RATE).cast("long").alias("id"), F.col("start_sec").alias("start"), F.col("end_sec").alias("end"))
    return matching.matched(truth, found, 0.3)


def _edf_roundtrip(v: _View) -> DataFrame:
    """Two signals of every recording written as recordings, and read again."""
    spark = v.slow.sparkSession
    parts = frames.packed(v.slow, ["spo2", "effort"], size=DEFAULT.chunk_sec)
    row = lambda k, label, unit, x: F.struct(F.lit(k).alias("signal"), F.lit(label).alias("label"), F.lit(unit).alias("unit"), F.lit(1.0).alias("sample_rate"), F.col(x).cast("array<double>").alias("samples"))
    signals = parts.select(F.format_string("patient_%03d/recording", "rec").alias("recording"), "chunk", F.inline(F.array(row(0, "SaO2", "%", "spo2"), row(1, "Resp thorax", "", "effort"))))
    folder = f"{shared_folder(spark)}/edf-{uuid.uuid4().hex}"
    edf_source.write_recordings(signals, folder)
    chunks = spark.read.format("edf").load(folder)
    rows = chunks.select(F.regexp_extract("path", "patient_([0-9]+)/", 1).cast("long").alias("rec"), "label", "first", F.posexplode("samples").alias("k", "value"))
    return rows.select("rec", "label", (F.col("first") + F.col("k")).alias("i"), F.round("value", 6).alias("value"))


def _class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return learn.class_weights(counts, 2.0).select("label", "n", F.round("weight", 9).alias("weight"))


def _report(v: _View) -> DataFrame:
    return v.indices.select("rec", "seconds", "valid_sec", "total_ahi_events", "desaturation_count", "ahi", "odi", "mean_spo2", "min_spo2", "t90", "t88")


def _report_texts(v: _View) -> DataFrame:
    """The text and JSON of every report."""
    events = v.events
    found = report.indices(events, v.slow)
    return report.as_text(found, report.position_minutes(v.slow)).join(report.as_json(found, events), "rec")


def _predicted(v: _View, kernel) -> DataFrame:
    channels = ["spo2", "effort", "pulse"]
    stats = {x["channel"]: (x["mean"], x["std"]) for x in learn.norm_stats(v.slow, channels).collect()}  # a row per channel
    return learn.predict_windows(frames.tiles(v.slow, 60, 30, channels), channels, kernel, stats)


def _inferred(v: _View) -> DataFrame:
    """Windows with a made label and confidence, taken to the network's index."""
    windows = v.slow.where("i % 30 = 0").selectExpr("rec", "i as start", "(i div 30) * 7 div 3 % 5 as label", "(i div 30) % 10 / 10.0D as conf")
    return learn.inferred_index(learn.inferred_events(windows, v.slow, 60), v.slow)


def queries() -> dict[str, Query]:
    v = _on_view
    return {
        "signal_view": v(lambda x: x.slow.select("rec", "i", "c", "effort", "spo2", "pulse", "position")),
        "flow_view": v(lambda x: x.flow),
        "envelope": v(lambda x: frames.envelope(x.flow, RATE // 2).select("rec", "j", "env")),
        "downsample_max": v(lambda x: _downsampled(x)),
        "baseline_percentile": v(lambda x: frames.sliding_percentile(_downsampled(x), "env", 60, 0.95, "baseline").select("rec", "i", "baseline")),
        "baseline_upsample": v(lambda x: x.features.select("rec", "j", "baseline")),
        "spo2_baseline": v(lambda x: x.spo2.select("rec", "i", "spo2_base")),
        "sentinel_segments": v(lambda x: _seconds(detect.sentinel_segments(x.slow, "spo2", DEFAULT.spo2_sentinel))),
        "excluded_merged": v(lambda x: _seconds(detect.excluded(x.slow))),
        "sqi": v(lambda x: report.signal_quality(x.slow)),
        "valid_duration": v(lambda x: report.valid_seconds(x.slow)),
        "apnea_runs": v(lambda x: detect.apnea_runs(x.found, RATE)),
        "apnea_classified": v(lambda x: detect.classified(detect.apnea_runs(x.found, RATE), x.slow).select("rec", "start_sec", "end_sec", "event_type")),
        "apnea_nadir_position": v(lambda x: x.apneas.select("rec", "event_type", "start_sec", "end_sec", "position", "spo2_nadir")),
        "desaturation": v(lambda x: x.desats.select("rec", "start_sec", "end_sec", "position", "spo2_nadir", "spo2_drop")),
        "hypopnea": v(lambda x: x.hypopneas.select("rec", "start_sec", "end_sec", "position", "spo2_nadir")),
        "csr_peaks": v(lambda x: detect.csr_extrema(x.found, RATE, peaks=True)),
        "csr_troughs": v(lambda x: detect.csr_extrema(x.found, RATE, peaks=False)),
        "csr_segments": v(lambda x: detect.cheyne_stokes(x.found, x.slow, RATE).select("rec", "start_sec", "end_sec", "position")),
        "snore_windows": v(lambda x: detect.snore_windows(x.flow, RATE).select("rec", "w", F.round("hf_ratio", 9).alias("hf_ratio"), "zcr", F.round("rms", 9).alias("rms"), "snoring")),
        "snore_events": v(lambda x: detect.snores(x.found, x.slow).select("rec", "start_sec", "end_sec", "position")),
        "all_events": v(lambda x: x.events.drop("rank")),
        "event_counts": v(lambda x: report.event_counts(x.events)),
        "oxygen_metrics": v(lambda x: report.oxygen(x.slow)),
        "position_minutes": v(lambda x: report.position_minutes(x.slow)),
        "kpi_indices": v(lambda x: x.indices.select("rec", "ahi", "ahi_supine", "ahi_non_supine", "odi", "csr_duration_min")),
        "severity": v(lambda x: x.indices.select("rec", "ahi", "osa_severity", "positional_osa")),
        "clinical_report": v(_report),
        "report_texts": v(_report_texts),
        "resample_grid": v(_resampled),
        "norm_stats": v(_norm_stats),
        "zscore": v(_zscore),
        "derived_channels": v(_derived),
        "model_windows": v(_model_windows),
        "event_windows": v(_event_windows),
        "negatives": v(lambda x: learn.negative_windows(detect.apnea_runs(x.found, RATE), x.slow, 5, 42)),
        "edf_roundtrip": v(_edf_roundtrip),
        "alignment_check": v(lambda x: compare.alignment(x.flow, x.view["truth"], RATE).select("rec", "events", F.round("ratio", 6).alias("ratio"), "verdict")),
        "balanced_batches": v(_balanced),
        "dataset_roundtrip": v(_dataset),
        "cnn_training": v(_training),
        "class_histogram": v(_class_histogram),
        "event_matching": v(_matching),
        "config_version": v(lambda x: x.slow.groupBy("rec").agg(F.count("*").alias("n")).select("rec", scalar.config_version(F.col("rec"), F.col("n")).alias("version"))),
        "class_weights": _class_weights,
        "argmax_windows": _argmax,
        "softmax_windows": _softmax,
        "topk_experts": _experts,
        "runlength_events": _run_lengths,
        "split_long": v(_split),
        "temporal_nms": v(_nms),
        "iou_pairs": v(_iou),
        "desat_gate": v(_gate),
        "confusion": _confusion,
        "classification_report": _classification,
        "confusion_dense": lambda spark, sf_dir: learn.dense_confusion(_pairs(spark, sf_dir), [0, 1, 2]),
        "report_averages": _averages,
        "patient_ahi": v(_inferred),
        "ahi_mae": v(_mae),
        "duplicates": _duplicates,
        "patient_split": v(lambda x: learn.patient_split(x.slow.select("rec").distinct(), 0.2, 42)),
        "grid_search": v(_grid),
        "grid_events": v(lambda x: _grid_events(x).drop("failed")),
        "grid_totals": v(_grid_totals),
        "grid_argmin": v(lambda x: tuning.best_cell(_grid_totals(x))),
        "truth_counts": v(_truth),
        "model_errors": v(_model_mae),
        "comparison": v(lambda x: _compared(x).select("rec", *[F.round(c, 9).alias(c) for c in ("true_ahi", "detector_ahi", "model_ahi")], "osa_severity", "true_severity", "true_obstr", "true_hypop", "model_obstr", "model_hypop")),
        "comparison_report": v(lambda x: compare.markdown(_compared(x))),
        "alignment_ratio": v(_alignment),
        "stream_sliding": _sliding,
        "cnn_forward": v(lambda x: _predicted(x, learn.CNN(3, seed=1))),
        "mira_forward": v(lambda x: _predicted(x, learn.Mira(3, seed=1))),
    }
