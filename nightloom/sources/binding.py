"""Which signal of a recording is which channel, by ordered rules."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``pattern`` binds a label to ``channel``; ``position`` is the signal taken where no label does."""

    channel: str
    pattern: str
    position: int | None = None


# What labels begin with, and what they hold in lower case, in order.
BY_PREFIX = (
    Rule("flow", "Resp nasal"), Rule("effort", "Resp thorax"), Rule("pulse", "Pulse"), Rule("spo2", "SaO2"),
    Rule("position", "Position"), Rule("acc_x", "Acc x"), Rule("acc_y", "Acc y"), Rule("acc_z", "Acc z"),
)
BY_SUBSTRING = (Rule("flow", "flow", 0), Rule("flow", "nasal", 0), Rule("spo2", "sao2", 1), Rule("spo2", "spo2", 1), Rule("thorax", "thorax", 2))


def _table(rules: Sequence[Rule]) -> Column:
    """The rules as rows beside each label: a list as long as the rules that a caller wrote."""
    return F.inline(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(r.channel).alias("channel"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(rules)]))


def _for_all(headers: DataFrame, found: DataFrame, rules: Sequence[Rule], strict: bool) -> DataFrame:
    positions = {r.channel: r.position for r in rules}
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(p).cast("int").alias("position")) for c, p in positions.items()]))
    wanted = headers.groupBy("path").agg(F.max("signal").alias("last")).select("path", "last", each)
    out = wanted.join(found, ["path", "channel"], "left")
    by_position = F.col("signal").isNull()
    signal = F.coalesce("signal", F.when(F.col("position") <= F.col("last"), F.col("position")))
    if strict:
        missing = F.concat(F.lit("no signal for channel "), F.col("channel"), F.lit(" in "), F.col("path"))
        signal = F.coalesce(signal, F.raise_error(missing).cast("int"))
    return out.select("path", "channel", signal.alias("signal"), by_position.alias("by_position"))


def bind_by_prefix(headers: DataFrame, rules: Sequence[Rule] = BY_PREFIX, strict: bool = True) -> DataFrame:
    """(path, channel, signal, by_position): the first signal whose label begins with a rule's pattern.

    ``headers`` has path, signal and label. A channel without a signal and a position is an
    error that names both; without ``strict`` its signal is null.
    """
    own = headers.where(F.col("label").isNotNull())
    found = own.select("path", "signal", "label", _table(rules)).where(F.expr("startswith(label, pattern)"))
    found = found.groupBy("path", "channel").agg(F.min("signal").alias("signal"))
    return _for_all(own, found, rules, strict)


def bind_by_substring(headers: DataFrame, rules: Sequence[Rule] = BY_SUBSTRING, strict: bool = True) -> DataFrame:
    """(path, channel, signal, by_position): a label belongs to the first rule whose pattern it holds in any case, the last such signal counts.

    A channel that no label belongs to is the signal at its rule's position.
    """
    own = headers.where(F.col("label").isNotNull())
    found = own.select("path", "signal", "label", _table(rules)).where(F.expr("contains(lower(label), pattern)"))
    found = found.groupBy("path", "signal").agg(F.min_by("channel", "rank").alias("channel"))
    found = found.groupBy("path", "channel").agg(F.max("signal").alias("signal"))
    return _for_all(own, found, rules, strict)


def bound_samples(chunks: DataFrame, binding: DataFrame) -> DataFrame:
    """The chunks of bound signals, with their channel."""
    return chunks.join(binding.select("path", "channel", "signal"), ["path", "signal"])
