"""Column expressions for labels, safe ratios, overlaps and class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Position codes, event types that count towards the index, label codes.
POSITIONS = {1: "Upright", 2: "Prone", 3: "Left", 4: "Supine", 5: "Right"}
BREATHING_EVENTS = ("Obstructive", "Central", "Mixed", "Unclassified", "Hypopnea")
LABEL_CODES = {"OBSTR": 1, "CNTRL": 2, "MIXED": 3, "HYPOP": 4}


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d as double, 0 where d is not positive."""
    return F.when(d > 0, n.cast("double") / d).otherwise(0.0)


def position_label(code: Column) -> Column:
    """Label of a position code; codes are cut to whole numbers from 0 to 255 first."""
    whole = F.when(F.isnan(code), 0).otherwise(F.floor(F.least(F.greatest(code, F.lit(0.0)), F.lit(255.0))).cast("int"))
    out = F.lit("Unknown")
    for value, label in POSITIONS.items():
        out = F.when(whole == value, label).otherwise(out)
    return out


def severity(ahi: Column) -> Column:
    return F.when(ahi < 5, "Normal").when(ahi < 15, "Mild").when(ahi < 30, "Moderate").otherwise("Severe")


def near(value: Column, sentinel: float, tolerance: float = 0.5) -> Column:
    return F.abs(value - sentinel) < tolerance


def temporal_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap of two intervals over their union, 0 where the union is empty."""
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0.0))
    union = (e1 - s1) + (e2 - s2) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    """Place of the greatest value from 0; the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def label_code(label: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, code in LABEL_CODES.items():
        out = F.when(label == name, code).otherwise(out)
    return out


def effort_ratio(thorax: Column, flow: Column) -> Column:
    return F.least(F.greatest(F.abs(thorax) / (F.abs(flow) + 1e-6), F.lit(0.0)), F.lit(10.0))


def config_version(*values: Column) -> Column:
    """First 8 hex digits of the md5 of the values as JSON."""
    return F.substring(F.md5(F.to_json(F.struct(*values)).cast("binary")), 1, 8)
