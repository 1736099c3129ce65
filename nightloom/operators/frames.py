"""Frames over regular signals. ``by`` is the recording, ``at`` the sample number from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FIRST, _NOW = Window.unboundedPreceding, Window.currentRow
#: Samples of a chunk. No frame needs more of a recording in one place than a chunk and the samples around it.
CHUNK = 2400


def chunked(df: DataFrame, before: int, after: int, by: str = "rec", at: str = "i", size: int = CHUNK) -> DataFrame:
    """The rows of every chunk of ``size`` samples, with those up to ``before`` and ``after`` it.

    ``_chunk`` is the chunk that a row serves, ``_mine`` whether it lies in it. A row serves
    several chunks near their edges only.
    """
    out = df.withColumn("_home", F.expr(f"{at} div {size}"))
    if not before and not after:
        return out.withColumns({"_chunk": F.col("_home"), "_mine": F.lit(True)}).drop("_home")
    first, last = F.greatest(F.lit(0).cast("long"), F.expr(f"({at} - {after}) div {size}")), F.expr(f"({at} + {before}) div {size}")
    return out.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_mine", F.col("_chunk") == F.col("_home")).drop("_home")


def _in_chunk(by: str, at: str):
    return Window.partitionBy(by, "_chunk").orderBy(at)


def centred_sums(df: DataFrame, value: str, half: int, total: str, count: str, by: str = "rec", at: str = "i", size: int = CHUNK) -> DataFrame:
    """Sum and count of the non-null values up to ``half`` samples away, by differences of running sums in chunks.

    The cost does not depend on the frame's width. Whole-number values keep sums exact.
    """
    order, everything = _in_chunk(by, at), Window.partitionBy(by, "_chunk")
    running = order.rowsBetween(_FIRST, _NOW)
    out = chunked(df, half + 1, half, by, at, size)
    out = out.withColumns({"_run_sum": F.sum(F.coalesce(value, F.lit(0))).over(running), "_run_n": F.count(value).over(running)})
    ends = {"_run_sum": F.sum(F.coalesce(value, F.lit(0))).over(everything), "_run_n": F.count(value).over(everything)}
    span = lambda c: F.coalesce(F.lead(c, half).over(order), ends[c]) - F.coalesce(F.lag(c, half + 1).over(order), F.lit(0))
    out = out.withColumns({total: span("_run_sum"), count: span("_run_n")})
    return out.where("_mine").drop("_run_sum", "_run_n", "_chunk", "_mine")


def framed_sum(df: DataFrame, value: str, before: int, after: int, total: str, by: str = "rec", at: str = "i", size: int = CHUNK) -> DataFrame:
    """Sum of a value without nulls over the frame from ``before`` to ``after``, cut at the ends."""
    order, everything = _in_chunk(by, at), Window.partitionBy(by, "_chunk")
    out = chunked(df, before + 1, after, by, at, size).withColumn("_run", F.sum(value).over(order.rowsBetween(_FIRST, _NOW)))
    last = F.coalesce(F.lead("_run", after).over(order), F.sum(value).over(everything))
    return out.withColumn(total, last - F.coalesce(F.lag("_run", before + 1).over(order), F.lit(0))).where("_mine").drop("_run", "_chunk", "_mine")


def envelope(flow: DataFrame, half: int, scale: int = 1, by: str = "rec", at: str = "j", size: int = CHUNK) -> DataFrame:
    """Mean absolute value over a centred frame, clipped at the ends, as ``env``; sum and count stay beside it."""
    out = flow.withColumn("_a", F.abs("flow"))
    return centred_sums(out, "_a", half, "env_sum", "env_n", by, at, size).withColumn("env", F.col("env_sum") / F.col("env_n") / scale).drop("_a")


def downsample_max(df: DataFrame, value: str, step: int, by: str = "rec", at: str = "j") -> DataFrame:
    """(by, i, value): the greatest of each run of ``step`` samples; a short last run counts."""
    return df.groupBy(by, F.expr(f"{at} div {step}").alias("i")).agg(F.max(value).alias(value))


def sliding_percentile(df: DataFrame, value: str, half: int, share: float, out: str, by: str = "rec", at: str = "i", size: int = CHUNK) -> DataFrame:
    """The value at place trunc(n * share), at most n - 1, of the sorted frame."""
    own = chunked(df, half, half, by, at, size)
    frame = F.array_sort(F.collect_list(value).over(_in_chunk(by, at).rowsBetween(-half, half)))
    place = F.least(F.floor(F.size("_frame") * F.lit(share)), F.size("_frame") - 1).cast("int")
    own = own.withColumn("_frame", frame).where("_mine")
    return own.withColumn(out, F.get("_frame", place)).drop("_frame", "_chunk", "_mine")


def _knots(signal: DataFrame, value: str, by: str, size: int) -> DataFrame:
    """(by, _i, _b, _next): every sample and the one after it, the last one its own."""
    own = chunked(signal.select(by, "i", F.col(value).alias("_b")), 0, 1, by, "i", size)
    own = own.withColumn("_next", F.coalesce(F.lead("_b", 1).over(_in_chunk(by, "i")), F.col("_b"))).where("_mine")
    return own.select(by, F.col("i").alias("_i"), "_b", "_next")


def upsample(slow: DataFrame, value: str, step: int, fast: DataFrame, by: str = "rec", at: str = "j", size: int = CHUNK) -> DataFrame:
    """``fast`` with ``value`` of the slow signal, linear between its samples, level after the last."""
    out = fast.withColumn("_i", F.expr(f"{at} div {step}")).join(_knots(slow, value, by, size), [by, "_i"])
    part = F.expr(f"cast({at} % {step} as double)") / step
    return out.withColumn(value, F.col("_b") * (1 - part) + F.col("_next") * part).drop("_i", "_b", "_next")


def valid_mean(df: DataFrame, value: str, low: float, high: float, half: int, fallback: float, out: str, by: str = "rec", at: str = "i", size: int = CHUNK) -> DataFrame:
    """Mean of the valid values in a centred frame, the fallback where there is none."""
    own = df.withColumn("_v", F.when(F.col(value).between(low, high), F.col(value)))
    own = centred_sums(own, "_v", half, "_sum", "_count", by, at, size)
    return own.withColumn(out, F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count")).otherwise(fallback)).drop("_v", "_sum", "_count")


def differences(df: DataFrame, value: str, out: str, by: str = "rec", at: str = "i", size: int = CHUNK) -> DataFrame:
    """Value less the value before, 0 for the first."""
    own = chunked(df, 1, 0, by, at, size)
    own = own.withColumn(out, F.col(value) - F.coalesce(F.lag(value).over(_in_chunk(by, at)), F.col(value)))
    return own.where("_mine").drop("_chunk", "_mine")


def packed(df: DataFrame, values: list[str], by: str = "rec", at: str = "i", size: int = CHUNK) -> DataFrame:
    """One row per chunk: ``chunk``, its first sample number, ``n``, and an array per value, in order."""
    rows = F.array_sort(F.collect_list(F.struct(at, *values)))
    out = df.groupBy(by, F.expr(f"{at} div {size}").alias("chunk")).agg(rows.alias("_rows"))
    return out.select(by, "chunk", F.get(f"_rows.{at}", F.lit(0)).alias("first"), F.size("_rows").alias("n"), *[F.col(f"_rows.{v}").alias(v) for v in values])


def pieces(spans: DataFrame, keys: list[str], length: int, df: DataFrame, values: list[str], by: str = "rec", at: str = "i") -> DataFrame:
    """``spans`` (keys, by, _low) with the ``length`` values from ``_low`` on as arrays, by an equi-join on every sample.

    A piece is there only if the recording has a sample after it.
    """
    own = spans.withColumn(at, F.explode(F.sequence(F.col("_low"), F.col("_low") + length))).join(df.select(by, at, *values).hint("merge"), [by, at])
    own = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at, *values))).alias("_rows")).where(F.size("_rows") == length + 1)
    return own.select(*keys, *[F.slice(F.col(f"_rows.{v}"), 1, length).alias(v) for v in values])


def tiles(df: DataFrame, window: int, stride: int, values: list[str], by: str = "rec", at: str = "i") -> DataFrame:
    """Windows of ``window`` samples every ``stride``; one that would end exactly at the end is left out."""
    first, last = F.greatest(F.lit(0).cast("long"), F.expr(f"({at} - {window} + {stride - 1}) div {stride}")), F.expr(f"{at} div {stride}")
    own = df.select(by, at, *values, F.explode(F.sequence(first, last)).alias("_tile"))
    own = own.groupBy(by, (F.col("_tile") * stride).alias("start")).agg(F.array_sort(F.collect_list(F.struct(at, *values))).alias("_rows")).where(F.size("_rows") == window + 1)
    return own.select(by, F.col("start").cast("int").alias("start"), *[F.slice(F.col(f"_rows.{v}"), 1, window).alias(v) for v in values])


def interpolate(signal: DataFrame, rate: float, grid: DataFrame, value: str, by: str = "rec", size: int = CHUNK) -> DataFrame:
    """``grid`` (by, t) with the signal (by, i at ``rate`` a second), linear between samples, level outside."""
    last = signal.groupBy(by).agg(F.max("i").alias("_last"))
    out = grid.join(last, by).withColumn("_x", F.least(F.greatest(F.col("t") * rate, F.lit(0.0)), F.col("_last").cast("double")))
    # A grid may be made of few rows, whose sizes say nothing of it: it is never broadcast.
    out = out.withColumn("_i", F.floor("_x")).join(_knots(signal, value, by, size).hint("merge"), [by, "_i"])
    return out.withColumn(value, F.col("_b") + (F.col("_next") - F.col("_b")) * (F.col("_x") - F.col("_i"))).drop("_i", "_x", "_b", "_next", "_last")
