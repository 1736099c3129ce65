"""Labels against the detectors and the network: counts, errors of the index, a report in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nightloom.functions.scalar import LABEL_CODES, label_code, safe_ratio, severity
from nightloom.operators.frames import CHUNK, framed_sum

#: Columns of counts, by label; the same names everywhere.
COUNTS = {"OBSTR": "obstr", "CNTRL": "cntrl", "MIXED": "mixed", "HYPOP": "hypop"}
_TITLES = {"obstr": "Obstructive", "cntrl": "Central", "mixed": "Mixed", "hypop": "Hypopnea"}


def truth_counts(truth: DataFrame) -> DataFrame:
    """(rec, obstr, cntrl, mixed, hypop, true_events) of labelled events (rec, t); labels in any case, others do not count."""
    own = truth.select("rec", label_code(F.upper("t")).alias("code"))
    each = [F.count_if(F.col("code") == LABEL_CODES[label]).alias(name) for label, name in COUNTS.items()]
    return own.groupBy("rec").agg(*each, F.count("code").alias("true_events"))


def index_errors(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(rec, true_ahi, ahi, error) of the recordings that both have; the truth is by the predictions' hours.

    ``truth`` has rec and true_events, ``predicted`` rec, ahi and hours.
    """
    own = truth.select("rec", "true_events").join(predicted.select("rec", "ahi", "hours"), "rec")
    own = own.withColumn("true_ahi", safe_ratio(F.col("true_events"), F.col("hours")))
    return own.select("rec", "true_ahi", "ahi", F.abs(F.col("ahi") - F.col("true_ahi")).alias("error"))


def mean_error(errors: DataFrame) -> DataFrame:
    """(recordings, mae, worst)."""
    return errors.agg(F.count("*").alias("recordings"), F.avg("error").alias("mae"), F.max("error").alias("worst"))


def comparison(truth: DataFrame, detected: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row per recording that any of the three has: true_ahi, detector_ahi, model_ahi, osa_severity and counts of both.

    ``truth`` is that of ``truth_counts``, ``detected`` has rec, ahi, osa_severity and hours (the
    denominator of the truth too), ``predicted`` rec, ahi and the counts. What is missing is 0,
    a missing severity N/A; a recording without hours has a true index of 0.
    """
    own = detected.select("rec", F.col("ahi").alias("detector_ahi"), "osa_severity", "hours")
    model = predicted.select("rec", F.col("ahi").alias("model_ahi"), *[F.col(x).alias(f"model_{x}") for x in COUNTS.values()])
    labels = truth.select("rec", "true_events", *[F.col(x).alias(f"true_{x}") for x in COUNTS.values()])
    out = labels.join(own, "rec", "full_outer").join(model, "rec", "full_outer")
    numbers = ["true_events", "detector_ahi", "hours", "model_ahi", *[f"{x}_{y}" for x in ("true", "model") for y in COUNTS.values()]]
    out = out.na.fill(0, numbers).na.fill("N/A", ["osa_severity"])
    out = out.withColumn("true_ahi", safe_ratio(F.col("true_events"), F.col("hours")))
    return out.select("rec", "true_ahi", "detector_ahi", "model_ahi", "osa_severity", severity(F.col("true_ahi")).alias("true_severity"), *numbers[4:])


def alignment(flow: DataFrame, truth: DataFrame, rate: int, seconds: int = 10, most: float = 0.7, size: int = CHUNK) -> DataFrame:
    """(rec, events, ratio, verdict): whether labelled apneas lie where the flow is low.

    ``ratio`` is the median, over the apneas of ``truth`` (rec, t, s, d), of the flow at their middle
    to the recording's median flow, the flow being a mean of the distance from its mean over
    ``seconds``. Labels of another recording have a ratio near 1: from ``most`` on it is a MISMATCH.
    """
    width = seconds * rate
    means = flow.groupBy("rec").agg(F.avg("flow").alias("_mean"), F.max("j").alias("_last"))
    own = flow.select("rec", "j", "flow").join(means, "rec").withColumn("_d", F.abs(F.col("flow") - F.col("_mean")))
    own = framed_sum(own, "_d", width // 2, width - width // 2 - 1, "_sum", at="j", size=size).select("rec", "j", "_last", (F.col("_sum") / width).alias("env"))
    centre = F.floor((F.col("s") + F.col("d") / 2) * rate)
    events = truth.where(F.upper("t").isin("OBSTR", "CNTRL", "MIXED")).select("rec", centre.alias("j"))
    at = own.join(events, ["rec", "j"]).where((F.col("j") >= width) & (F.col("j") < F.col("_last") + 1 - width))
    low = at.groupBy("rec").agg(F.percentile("env", 0.5).alias("_event"), F.count("*").alias("events"))
    whole = own.groupBy("rec").agg(F.percentile("env", 0.5).alias("_all"))
    ratio = F.col("_event") / (F.col("_all") + 1e-9)
    return low.join(whole, "rec").select("rec", "events", ratio.alias("ratio"), F.when(ratio < most, "OK").otherwise("MISMATCH").alias("verdict"))


def _row(*cells: Column | str) -> Column:
    parts = [F.lit("|")]
    for x in cells:
        parts += [F.lit(" "), F.lit(x) if isinstance(x, str) else x.cast("string"), F.lit(" |")]
    return F.concat(*parts)


def markdown(compared: DataFrame) -> DataFrame:
    """(section, rec, line_no, line): the report's lines, in this order; headings have no recording and come first in a section."""
    spark = compared.sparkSession
    two = lambda x: F.format_string("%.2f", x)
    named = isinstance(compared.schema["rec"].dataType, StringType)
    name = F.col("rec") if named else F.format_string("patient_%03d", F.col("rec"))
    ahi = compared.select(
        F.lit(0).alias("section"), "rec", F.lit(0).alias("line_no"),
        _row(name, F.concat(F.lit("**"), two("true_ahi"), F.lit("**")), two("detector_ahi"), two("model_ahi"), F.col("osa_severity")).alias("line"),
    )
    kinds = [F.struct(F.lit(k).alias("line_no"), _row(name, title, F.col(f"true_{x}"), F.col(f"model_{x}")).alias("line")) for k, (x, title) in enumerate(_TITLES.items())]
    counts = compared.select(F.lit(1).alias("section"), "rec", F.inline(F.array(*kinds)))
    heads = [
        (0, ["# Comparison of labels, detector and network", "", "## Index (events per hour)", "| Patient | Labels | Detector | Network | Severity |", "|-|-|-|-|-|"]),
        (1, ["", "## Events by class", "| Patient | Class | Labels | Network |", "|-|-|-|-|"]),
    ]
    rows = [(section, None, k, line) for section, lines in heads for k, line in enumerate(lines)]
    headings = spark.createDataFrame(rows, f"section int, rec {'string' if named else 'long'}, line_no int, line string")
    return headings.unionByName(ahi).unionByName(counts)


def write_markdown(lines: DataFrame, path: str) -> None:
    """The lines as text; the files' names are in the order of the lines."""
    lines.orderBy("section", F.col("rec").asc_nulls_first(), "line_no").select("line").write.mode("overwrite").text(path)
