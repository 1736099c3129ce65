"""Windows as a dataset with a shape, its statistics, and networks' weights, as tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATS = "channel string, mean double, std double"
META = "channels array<string>, window int, classes int, columns array<string>"
WEIGHTS = "name string, shape array<int>, values array<double>"


def write_dataset(windows: DataFrame, path: str, channels: Sequence[str], window: int, classes: int = 5, stats: DataFrame | None = None) -> None:
    """Windows (split, label, an array per channel, other columns) as ``path/windows/split=...``, one array of ``window * channels`` floats each.

    Time goes before channels in the array. What the dataset looks like is written last: one
    without it is not whole. A window of another length, or a label that is no class, is an error.
    """
    lengths = [F.size(F.col(c)) == window for c in channels]
    good = lengths[0]
    for x in lengths[1:]:
        good = good & x
    good = good & F.col("label").between(0, classes - 1)
    rows = F.flatten(F.transform(F.arrays_zip(*channels), lambda t: F.array(*[t[c].cast("float") for c in channels])))
    kept = [c for c in windows.columns if c not in channels]
    x = F.when(good, rows).otherwise(F.raise_error(F.lit("a window of another shape or class")).cast("array<float>"))
    windows.select(*kept, x.alias("x")).write.mode("overwrite").partitionBy("split").parquet(f"{path}/windows")
    if stats is not None:
        write_stats(stats, f"{path}/stats")
    spark = windows.sparkSession
    spark.createDataFrame([(list(channels), window, classes, kept)], META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_dataset(spark: SparkSession, path: str, channels: Sequence[str] | None = None, window: int | None = None) -> tuple[DataFrame, dict]:
    """The windows and what they look like; an error if that is not what is asked for, or a row is of another shape."""
    meta = spark.read.schema(META).json(f"{path}/meta").first()
    found = {"channels": list(meta.channels), "window": meta.window, "classes": meta.classes}
    for name, wanted in (("channels", list(channels) if channels is not None else None), ("window", window)):
        if wanted is not None and wanted != found[name]:
            raise ValueError(f"the dataset has {name} {found[name]}, not {wanted}")
    size = len(found["channels"]) * found["window"]
    good = (F.size("x") == size) & F.col("label").between(0, found["classes"] - 1)
    x = F.when(good, F.col("x")).otherwise(F.raise_error(F.lit(f"a window that is not of {size} values or whose label is no class")).cast("array<float>"))
    return spark.read.parquet(f"{path}/windows").withColumn("x", x), found


def write_stats(stats: DataFrame, path: str) -> None:
    """(channel, mean, std) as JSON, a line per channel."""
    stats.select("channel", "mean", "std").coalesce(1).write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """(channel, mean, std), from lines or from one document ``{channel: {mean, std}}``."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<mean:double,std:double>>").alias("m"))
    nested = whole.select(F.explode("m").alias("channel", "s")).select("channel", "s.mean", "s.std").where("mean is not null")
    return spark.read.schema(STATS).json(path).where("channel is not null").unionByName(nested)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(patient, obstr, cntrl, mixed, hypop, ahi, duration_hrs, events) of ``mlx_results.json`` documents under ``patient_N`` folders."""
    event = "array<struct<type:int,start:double,end:double,avg_conf:double,desat:double>>"
    rows = spark.read.schema(f"obstr long, cntrl long, mixed long, hypop long, ahi double, duration_hrs double, event_list {event}").json(path, multiLine=True)
    return rows.withColumn("patient", F.regexp_extract(F.input_file_name(), r"patient_[0-9]+", 0)).withColumnRenamed("event_list", "events")


def window_array(x: Column, window: int, channels: int) -> Column:
    """The array of a dataset's window as rows of channels."""
    return F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda t: F.slice(x, t * channels + 1, channels))


def write_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    rows = [(name, list(map(int, w.shape)), np.asarray(w, float).ravel().tolist()) for name, w in weights.items()]
    spark.createDataFrame(rows, WEIGHTS).write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """A network's weights; a row per layer, whose sizes the network fixes."""
    return {r.name: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def write_run(spark: SparkSession, info: dict, path: str) -> None:
    """What a training run was and how its epochs went, as one JSON document."""
    spark.createDataFrame([(json.dumps(info, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
