"""Detector thresholds tried over a grid, against the counts that a person has labelled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightloom.config import DEFAULT, Config
from nightloom.operators import scan
from nightloom.operators.detect import confirmed, desaturations, in_seconds, spo2_features
from nightloom.storage import stored

# The grid's thresholds.
APNEA = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
HYPOPNEA = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)


def cells(apnea: Sequence[float] = APNEA, hypopnea: Sequence[float] = HYPOPNEA) -> list[scan.Cell]:
    """The pairs of thresholds in which a hypopnea may leave more flow than an apnea."""
    return [(a, h) for a in apnea for h in hypopnea if h < 1.0 - a]


def grid_events(view: dict[str, DataFrame], rate: int, grid: Sequence[scan.Cell] | None = None, config: Config = DEFAULT) -> DataFrame:
    """(rec, cell, apnea, hypopnea, apneas, hypopneas, failed): what the detectors find in every recording, by cell.

    The flow is scanned once with all thresholds; a recording with samples that are no numbers
    has failed and has no counts.
    """
    grid = list(grid) if grid is not None else cells()
    slow = view["slow"]
    found = scan.scan(view["flow"], rate, config, grid)
    spo2 = stored(spo2_features(slow, config).select("rec", "i", "position", "spo2", "spo2_base"))
    stopped = in_seconds(scan.flow_runs(found, "apnea"), rate, config).groupBy("rec", "cell").agg(F.count("*").alias("apneas"))
    reduced = confirmed(in_seconds(scan.flow_runs(found, "hypopnea"), rate, config), spo2, desaturations(spo2, config), config)
    reduced = reduced.groupBy("rec", "cell").agg(F.count("*").alias("hypopneas"))
    each = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(a).alias("apnea"), F.lit(h).alias("hypopnea")) for i, (a, h) in enumerate(grid)])
    broken = found.where("kind = 'broken'").select("rec", F.lit(True).alias("failed")).distinct()
    out = slow.select("rec").distinct().select("rec", F.inline(each))
    out = out.join(stopped, ["rec", "cell"], "left").join(reduced, ["rec", "cell"], "left").join(broken, "rec", "left")
    out = out.withColumn("failed", F.coalesce("failed", F.lit(False)))
    counted = lambda x: F.when(~F.col("failed"), F.coalesce(x, F.lit(0))).alias(x)
    return out.select("rec", "cell", "apnea", "hypopnea", counted("apneas"), counted("hypopneas"), "failed")


def grid_totals(events: DataFrame, truth: DataFrame) -> DataFrame:
    """(cell, version, apnea, hypopnea, apneas, hypopneas, events, true_events, error, best) per cell.

    ``truth`` has rec and true_events; recordings without labels are passed over. A cell in
    which a recording has failed is left out. ``best`` tells a cell whose error is less than that
    of all cells before it.
    """
    own = events.join(truth.select("rec", "true_events"), "rec").groupBy("cell", "apnea", "hypopnea")
    own = own.agg(*[F.sum(x).alias(x) for x in ("apneas", "hypopneas", "true_events")], F.bool_or("failed").alias("failed")).where("not failed")
    total = F.col("apneas") + F.col("hypopneas")
    own = own.withColumns({"events": total, "error": F.abs(total - F.col("true_events")), "version": F.format_string("v1.0-A%.1f-H%.1f", "apnea", "hypopnea")})
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per cell
    own = own.withColumn("best", F.col("error") < F.coalesce(F.min("error").over(before), F.col("error") + 1))
    return own.select("cell", "version", "apnea", "hypopnea", "apneas", "hypopneas", "events", "true_events", "error", "best")


def best_cell(totals: DataFrame) -> DataFrame:
    """(apnea, hypopnea, apneas, hypopneas, events, error) of the cell with the least error, the first of equal ones; no row without cells."""
    first = F.min_by(F.struct("apnea", "hypopnea", "apneas", "hypopneas", "events", "error"), F.struct("error", "cell")).alias("b")
    return totals.agg(first).where("b is not null").select("b.*")
