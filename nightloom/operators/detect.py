"""Event detectors over a signal view.

A signal view is a dict of DataFrames: ``slow`` (rec, i, effort, spo2, pulse, position; one
row a second) and ``flow`` (rec, j, flow; ``rate`` rows a second). Events are rows of
(rec, event_type, start_sec, end_sec, position, spo2_nadir, spo2_drop).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.config import DEFAULT, Config
from nightloom.functions.scalar import near, position_label
from nightloom.operators import frames, islands, scan
from nightloom.storage import stored


def flow_features(flow: DataFrame, rate: int, config: Config = DEFAULT) -> DataFrame:
    """(rec, j, flow, env, baseline, smooth, turn): envelope over a second, baseline as its sliding high percentile, turning points."""
    return scan.features(flow, rate, config)


def spo2_features(slow: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return frames.valid_mean(slow, "spo2", config.spo2_low, config.spo2_high, config.baseline_half_sec, config.spo2_fallback, "spo2_base", size=config.chunk_sec)


def at_position(events: DataFrame, slow: DataFrame) -> DataFrame:
    """Adds the body position at the middle of each event, Unknown outside the recording."""
    codes = slow.select("rec", F.col("i").alias("_mid"), F.col("position").alias("_code"))
    own = events.withColumn("_mid", F.floor((F.col("start_sec") + F.col("end_sec")) / 2))
    own = own.join(codes, ["rec", "_mid"], "left")
    return own.withColumn("position", F.coalesce(position_label(F.col("_code").cast("double")), F.lit("Unknown"))).drop("_mid", "_code")


def with_seconds(events: DataFrame, slow: DataFrame, low: Column, high: Column, values: list[str], aggregates: list[Column]) -> DataFrame:
    """Events with aggregates of ``_i`` and the values at the seconds floor(low) up to floor(high), by an equi-join on each second.

    An event without such a second stays, with the aggregates of no row.
    """
    seconds = F.when(F.floor(high) > F.floor(low), F.sequence(F.floor(low), F.floor(high) - 1)).otherwise(F.array().cast("array<bigint>"))
    own = events.withColumn("_i", F.explode_outer(seconds)).join(slow.select("rec", F.col("i").alias("_i"), *values), ["rec", "_i"], "left")
    return own.groupBy(*events.columns).agg(*aggregates)


def with_nadir(events: DataFrame, slow: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds the least valid SpO2 from an event's start to 30 s after its end; null if there is none."""
    valid = F.when(F.col("spo2").between(config.spo2_low, config.spo2_high), F.col("spo2").cast("double"))
    return with_seconds(events, slow, F.col("start_sec"), F.col("end_sec") + config.post_event_sec, ["spo2"], [F.min(valid).alias("spo2_nadir")])


def in_seconds(runs: DataFrame, rate: int, config: Config = DEFAULT) -> DataFrame:
    """Runs of at least the least length, with start_sec and end_sec in place of samples."""
    own = runs.where(F.col("end") - F.col("start") >= int(config.min_event_sec * rate))
    return own.withColumns({"start_sec": F.col("start") / rate, "end_sec": F.col("end") / rate}).drop("start", "end")


def apnea_runs(found: DataFrame, rate: int, config: Config = DEFAULT) -> DataFrame:
    """(rec, start_sec, end_sec) of stopped flow, from a scan."""
    return in_seconds(scan.flow_runs(found, "apnea"), rate, config).drop("cell")


def classified(apneas: DataFrame, slow: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds event_type from the variance of the effort: flat, flat only at first, or there throughout."""
    zero = F.lit(0).cast(slow.schema["effort"].dataType)
    samples = F.array_sort(F.collect_list(F.when(F.col("effort").isNotNull(), F.struct("_i", "effort"))))
    own = with_seconds(apneas, slow, F.col("start_sec"), F.col("end_sec"), ["effort"], [samples.alias("_x")])
    own = own.withColumn("_x", F.col("_x.effort"))

    def variance(x: Column) -> Column:
        n, s, q = F.size(x), F.aggregate(x, zero, lambda a, y: a + y), F.aggregate(x, zero, lambda a, y: a + y * y)
        return F.when(n > 0, (n * q - s * s) / (n * n)).otherwise(0.0)

    half = F.expr("size(_x) div 2").cast("int")
    first, second = F.slice("_x", F.lit(1), half), F.slice("_x", half + 1, F.size("_x") - half)
    low = config.effort_variance
    kind = (
        F.when(F.size("_x") == 0, "Unclassified")
        .when(variance(F.col("_x")) < low, "Central")
        .when((variance(first) < low) & (variance(second) >= low), "Mixed")
        .otherwise("Obstructive")
    )
    return own.withColumn("event_type", kind).drop("_x")


def apneas(found: DataFrame, slow: DataFrame, rate: int, config: Config = DEFAULT) -> DataFrame:
    own = classified(apnea_runs(found, rate, config), slow, config)
    return at_position(with_nadir(own, slow, config), slow)


def dropped(config: Config = DEFAULT) -> Column:
    return F.col("spo2_base") - F.col("spo2") >= config.desaturation_drop


def desaturations(spo2: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Runs of valid SpO2 at least 3 below its baseline, bridging invalid samples."""
    valid = F.col("spo2").between(config.spo2_low, config.spo2_high)
    found = islands.bridged_runs(spo2, valid, dropped(config), ["spo2"], ["spo2_base"], least=int(config.desaturation_min_sec), size=config.chunk_sec)
    nadir = F.col("spo2").cast("double")
    found = found.select(
        "rec", F.lit("Desaturation").alias("event_type"), F.col("start").cast("double").alias("start_sec"), F.col("end").cast("double").alias("end_sec"),
        nadir.alias("spo2_nadir"), (F.col("spo2_base") - nadir).alias("spo2_drop"),
    )
    return at_position(found, spo2)


def confirmed(candidates: DataFrame, spo2: DataFrame, desats: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The runs (rec, cell, start_sec, end_sec) that a drop of SpO2 follows or accompanies, up to 30 s after them.

    Drops are seconds of valid SpO2 below the baseline, taken as runs, and desaturations; both
    are looked up by the minute, not by all pairs of a recording.
    """
    valid = F.col("spo2").between(config.spo2_low, config.spo2_high)
    seconds = islands.runs(spo2, valid & dropped(config), open_at_end=True, size=config.chunk_sec)
    # A run meets floor(from) up to floor(until) if its first second ends by then, an event if it begins before.
    drops = seconds.select("rec", (F.col("start") + 1).cast("double").alias("s2"), F.col("end").cast("double").alias("e2"), F.lit(True).alias("_whole"))
    drops = drops.unionByName(desats.select("rec", F.col("start_sec").alias("s2"), F.col("end_sec").alias("e2"), F.lit(False).alias("_whole")))
    own = candidates.withColumns({"s1": F.col("start_sec"), "e1": F.col("end_sec") + config.post_event_sec})
    on = (F.col("e2") > F.col("s1")) & ((F.col("s2") < F.col("e1")) | (F.col("_whole") & (F.col("s2") == F.col("e1"))))
    return islands.overlapping(own, drops, on).select(*candidates.columns).distinct()


def hypopneas(found: DataFrame, spo2: DataFrame, desats: DataFrame, rate: int, config: Config = DEFAULT) -> DataFrame:
    """Runs of reduced flow, from a scan, that a drop of SpO2 confirms."""
    runs = in_seconds(scan.flow_runs(found, "hypopnea"), rate, config)
    own = confirmed(runs, spo2, desats, config).drop("cell").withColumn("event_type", F.lit("Hypopnea"))
    return at_position(with_nadir(own, spo2, config), spo2)


def csr_extrema(found: DataFrame, rate: int, config: Config = DEFAULT, peaks: bool = True) -> DataFrame:
    """(rec, j): strict local extrema of the envelope smoothed over 30 s, at least 20 s apart, from a scan."""
    return islands.thinned(scan.points(found, "peak" if peaks else "trough"), int(config.csr_distance_sec * rate))


def cheyne_stokes(found: DataFrame, slow: DataFrame, rate: int, config: Config = DEFAULT) -> DataFrame:
    """Three or more consecutive cycles between peaks of 40 to 90 s, where there are three peaks and troughs."""
    peaks, troughs = (csr_extrema(found, rate, config, x) for x in (True, False))
    enough = [x.groupBy("rec").count().where(F.col("count") >= 3).select("rec") for x in (peaks, troughs)]
    peaks = peaks.join(enough[0], "rec", "left_semi").join(enough[1], "rec", "left_semi")
    order = Window.partitionBy("rec").orderBy("j")
    cycles = peaks.withColumns({"_next": F.lead("j").over(order), "_o": F.row_number().over(order)})
    length = (F.col("_next") - F.col("j")) / rate
    valid = cycles.where(length.between(config.csr_low_sec, config.csr_high_sec))
    valid = valid.withColumn("_group", F.col("_o") - F.row_number().over(order))
    own = valid.groupBy("rec", "_group").agg(F.min("j").alias("_s"), F.max("_next").alias("_e"), F.count("*").alias("_n"))
    own = own.where(F.col("_n") >= config.csr_cycles)
    own = own.select("rec", F.lit("CheyneStokes").alias("event_type"), (F.col("_s") / rate).alias("start_sec"), (F.col("_e") / rate).alias("end_sec"))
    return at_position(own, slow)


def snore_windows(flow: DataFrame, rate: int, config: Config = DEFAULT) -> DataFrame:
    """(rec, w, rms, hf_ratio, zcr, snoring) of complete windows of 2 s every second; w is the window's second."""
    return scan.snore_windows(flow, rate, config)


def snore_runs(found: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(rec, event_type, start_sec, end_sec) of snoring seconds in a row, from a scan."""
    own = scan.flow_runs(found, "snore").where(F.col("end") - F.col("start") >= int(config.snore_min_sec))
    return own.select("rec", F.lit("Snore").alias("event_type"), F.col("start").cast("double").alias("start_sec"), F.col("end").cast("double").alias("end_sec"))


def snores(found: DataFrame, slow: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return at_position(snore_runs(found, config), slow)


def sentinel_segments(slow: DataFrame, channel: str, sentinel: float, config: Config = DEFAULT) -> DataFrame:
    return islands.runs(slow, near(F.col(channel), sentinel, config.sentinel_tolerance), open_at_end=True, size=config.chunk_sec)


def excluded(slow: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(rec, start, end) of merged sentinel runs of SpO2 and pulse."""
    both = sentinel_segments(slow, "spo2", config.spo2_sentinel, config).unionByName(sentinel_segments(slow, "pulse", config.pulse_sentinel, config))
    return islands.merge(both)


def all_events(view: dict[str, DataFrame], rate: int, config: Config = DEFAULT) -> DataFrame:
    """Every detector's events, with ``rank`` in the order in which the detectors come.

    The flow is scanned once for all of them; positions and nadirs are looked up for all
    events together.
    """
    slow = view["slow"]
    found, spo2 = scan.scan(view["flow"], rate, config), stored(spo2_features(slow, config).select("rec", "i", "position", "spo2", "spo2_base"))
    desats = desaturations(spo2, config).drop("position")
    gone = excluded(slow, config).select("rec", F.lit("Excluded").alias("event_type"), F.col("start").cast("double").alias("start_sec"), F.col("end").cast("double").alias("end_sec"))
    runs = in_seconds(scan.flow_runs(found, "hypopnea"), rate, config)
    hypo = confirmed(runs, spo2, desats, config).drop("cell").withColumn("event_type", F.lit("Hypopnea"))
    breathing = classified(apnea_runs(found, rate, config), slow, config).withColumn("rank", F.lit(2)).unionByName(hypo.withColumn("rank", F.lit(3)))
    others = [(gone, 0), (desats, 1), (cheyne_stokes(found, slow, rate, config).drop("position"), 4), (snore_runs(found, config), 5)]
    out = with_nadir(breathing, slow, config)
    for part, rank in others:
        out = out.unionByName(part.withColumn("rank", F.lit(rank)), allowMissingColumns=True)
    out = at_position(out, slow).withColumn("position", F.when(F.col("event_type") == "Excluded", "Unknown").otherwise(F.col("position")))
    return out.select("rec", "event_type", "start_sec", "end_sec", "position", "spo2_nadir", "spo2_drop", "rank")
