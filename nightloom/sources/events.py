"""Labelled events, results and logs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions.scalar import label_code

EVENTS = "events array<struct<t:string,s:double,d:double>>"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(patient, type, start_sec, end_sec) of ``events.json`` files; types without a code are left out."""
    rows = spark.read.schema(EVENTS).json(path, multiLine=True)
    rows = rows.select(F.regexp_extract(F.input_file_name(), r"patient_[0-9]+", 0).alias("patient"), F.explode("events").alias("e"))
    return rows.select("patient", label_code(F.col("e.t")).alias("type"), F.col("e.s").alias("start_sec"), (F.col("e.s") + F.col("e.d")).alias("end_sec")).where("type is not null")


def write_results(results: DataFrame, path: str) -> None:
    """JSON by run and patient; results of other parameters are never overwritten."""
    results.write.mode("append").partitionBy("run_id", "patient").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """The rows of a run, one per grid cell or epoch, as one more CSV file with one header."""
    rows.coalesce(1).write.mode("append").option("header", "true").csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All runs' rows of a log."""
    return spark.read.schema(schema).option("header", "true").csv(path)
