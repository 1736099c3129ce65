"""Clinical indices of a recording, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.config import DEFAULT, Config
from nightloom.functions.scalar import BREATHING_EVENTS, near, position_label, safe_ratio, severity
from nightloom.operators.detect import excluded

_COUNTED = ("Obstructive", "Central", "Mixed", "Unclassified", "Hypopnea", "Desaturation", "Snore")


def _oxygen(config: Config) -> list[Column]:
    v = F.when(F.col("spo2").between(config.spo2_low, config.spo2_high), F.col("spo2"))
    share = lambda below: safe_ratio(F.count_if(v < below) * 100, F.count(v))
    return [safe_ratio(F.sum(v), F.count(v)).alias("mean_spo2"), F.coalesce(F.min(v).cast("double"), F.lit(0.0)).alias("min_spo2"), share(90).alias("t90"), share(88).alias("t88")]


def _quality(config: Config) -> list[Column]:
    good = lambda c, s: F.count_if(~near(F.col(c), s, config.sentinel_tolerance)) / F.count("*")
    return [F.lit(1.0).alias("sqi_flow"), good("spo2", config.spo2_sentinel).alias("sqi_spo2"), good("pulse", config.pulse_sentinel).alias("sqi_pulse")]


def oxygen(slow: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(rec, mean_spo2, min_spo2, t90, t88) over valid SpO2; zeros where there is none."""
    return slow.groupBy("rec").agg(*_oxygen(config))


def signal_quality(slow: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(rec, sqi_flow, sqi_spo2, sqi_pulse): shares of samples that are not the sentinel."""
    return slow.groupBy("rec").agg(*_quality(config))


def valid_seconds(slow: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(rec, seconds, valid_sec): the length, and the length less excluded segments."""
    gone = excluded(slow, config).groupBy("rec").agg(F.sum(F.col("end") - F.col("start")).alias("_gone"))
    total = slow.groupBy("rec").agg(F.count("*").alias("seconds"))
    return total.join(gone, "rec", "left").select("rec", "seconds", (F.col("seconds") - F.coalesce("_gone", F.lit(0))).alias("valid_sec"))


def position_minutes(slow: DataFrame) -> DataFrame:
    """(rec, position, minutes) of the positions that occur."""
    label = position_label(F.col("position").cast("double")).alias("position")
    return slow.groupBy("rec", label).agg((F.count("*") / F.lit(60.0)).alias("minutes"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("event_type") == x).alias(f"{x.lower()}_count") for x in _COUNTED]


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("rec").agg(*_counts())


def indices(events: DataFrame, slow: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per recording with all counts, indices, oxygen and quality figures."""
    breathing = F.col("event_type").isin(*BREATHING_EVENTS)
    supine = F.col("position") == "Supine"
    # One grouping of the events serves all counts, so that the detectors run once.
    sums = events.groupBy("rec").agg(
        F.sum(F.when(F.col("event_type") == "Excluded", F.col("end_sec") - F.col("start_sec")).otherwise(0.0)).cast("long").alias("_gone"),
        *_counts(),
        F.count_if(breathing).alias("total_ahi_events"), F.count_if(breathing & supine).alias("_supine"),
        F.sum(F.when(F.col("event_type") == "CheyneStokes", F.col("end_sec") - F.col("start_sec")).otherwise(0.0)).alias("_csr"),
    )
    # One grouping of the samples serves everything else.
    supine_sec = F.count_if(position_label(F.col("position").cast("double")) == "Supine").alias("_supine_sec")
    whole = slow.groupBy("rec").agg(F.count("*").alias("seconds"), supine_sec, *_oxygen(config), *_quality(config))
    out = whole.join(sums, "rec", "left").na.fill(0)
    out = out.withColumn("valid_sec", F.col("seconds") - F.col("_gone")).drop("_gone")
    hourly = lambda n, sec: F.when(sec > 0, n / (sec / F.lit(3600.0))).otherwise(0.0)
    n: Column = F.col("total_ahi_events")
    out = out.withColumns(
        {
            "ahi": hourly(n, F.col("valid_sec")),
            "ahi_supine": hourly(F.col("_supine"), F.col("_supine_sec")),
            "ahi_non_supine": hourly(n - F.col("_supine"), F.col("seconds") - F.col("_supine_sec")),
            "odi": hourly(F.col("desaturation_count"), F.col("valid_sec")),
            "csr_duration_min": F.col("_csr") / 60.0,
            "recording_duration_hours": F.col("seconds") / F.lit(3600.0),
            "valid_duration_hours": F.col("valid_sec") / F.lit(3600.0),
        }
    )
    positional = (F.col("ahi_non_supine") > 0) & (F.try_divide("ahi_supine", "ahi_non_supine") > 2)
    return out.withColumns({"osa_severity": severity(F.col("ahi")), "positional_osa": F.coalesce(positional, F.lit(False))}).drop("_supine", "_supine_sec", "_csr")


def as_json(report: DataFrame, events: DataFrame, pretty: bool = False) -> DataFrame:
    """(rec, json): the report and the list of events in order of start; nulls are left out."""
    one = F.struct("start_sec", "rank", "event_type", "end_sec", (F.col("end_sec") - F.col("start_sec")).alias("duration_sec"), "position", "spo2_nadir", "spo2_drop")
    rows = events.groupBy("rec").agg(F.array_sort(F.collect_list(one)).alias("events"))
    fields = F.struct(*[c for c in report.columns if c != "rec"]).alias("report")
    return report.join(rows, "rec", "left").select("rec", F.to_json(F.struct(fields, F.col("events")), {"pretty": str(pretty).lower()}).alias("json"))


def as_text(report: DataFrame, minutes: DataFrame) -> DataFrame:
    """(rec, text): everything in the report in a fixed layout; positions by minutes from the most, equal ones by name."""
    each = minutes.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct((-F.col("minutes")).alias("neg"), "position"))).alias("_p"))
    own = report.join(each, "rec", "left")
    whole = F.col("recording_duration_hours") * 60
    lines = F.transform("_p", lambda x: F.format_string("  %-10s %6.1f min  (%.0f%%)", x["position"], -x["neg"], safe_ratio(-x["neg"] * 100, whole)))
    share = lambda c: F.col(c) * 100
    hourly = lambda title, c: F.format_string(f"  {title} %.1f events/hr", c)
    counts = [F.format_string(f"  {x}: %d", f"{x.lower()}_count") for x in _COUNTED]
    return own.select(
        "rec",
        F.concat_ws(
            "\n",
            F.lit("RECORDING"),
            F.format_string("  Duration: %.1f hours, valid: %.1f hours", "recording_duration_hours", "valid_duration_hours"),
            F.format_string("  Signal quality: flow %.0f%%, SpO2 %.0f%%, pulse %.0f%%", share("sqi_flow"), share("sqi_spo2"), share("sqi_pulse")),
            F.lit("INDICES"),
            F.format_string("  AHI: %.1f events/hr (%s)", "ahi", "osa_severity"),
            hourly("AHI, supine:", "ahi_supine"),
            hourly("AHI, elsewhere:", "ahi_non_supine"),
            F.concat(F.lit("  Positional: "), F.when(F.col("positional_osa"), "Yes").otherwise("No")),
            hourly("ODI:", "odi"),
            F.lit("OXYGEN"),
            F.format_string("  SpO2: mean %.1f%%, lowest %.0f%%", "mean_spo2", "min_spo2"),
            F.format_string("  Below 90: %.1f%% of time, below 88: %.1f%%", "t90", "t88"),
            F.lit("EVENTS"),
            *counts,
            F.format_string("  Counted in the AHI: %d", "total_ahi_events"),
            F.format_string("  Cheyne-Stokes: %.1f min", "csr_duration_min"),
            F.lit("POSITIONS"),
            F.array_join(lines, "\n"),
        ).alias("text"),
    )


def emit(texts: DataFrame, path: str | None = None) -> None:
    """Each recording's text as a file under ``path/rec=N``, or printed, one after the other, without a path."""
    if path is not None:
        texts.select("rec", "text").write.mode("overwrite").partitionBy("rec").text(path)
        return
    for row in texts.orderBy("rec").toLocalIterator():  # a partition at a time
        print(row["text"])
