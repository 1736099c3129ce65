"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document's terms are its runs of five words, weighted by how often they occur. For every
sample k and term, hashes give r and c from Gamma(2, 1) and b from the unit interval; with
t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r, the term with the least a is the
sample, together with its t. Two documents agree in a sample with the probability of their
generalised Jaccard similarity, sum of minima over sum of maxima of the weights.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

SAMPLES = 32
SHINGLE = 5
#: Text bytes of a range of ids that is worked on together, and how many ranges there are at most.
RANGE_BYTES = 4 << 20
MOST_RANGES = 50_000
#: Ranges are cut at this many quantiles of the ids at most, then evenly within each.
QUANTILES = 256
_LEVELS = 256
#: Bits of a sample that say which term and t it is; those above order the samples.
_NAME_BITS = 26


def _gamma_levels() -> tuple[list[float], list[float]]:
    """Quantiles of Gamma(2, 1) at the middles of equal shares, and their logarithms."""
    share = (np.arange(_LEVELS) + 0.5) / _LEVELS
    low, high = np.zeros(_LEVELS), np.full(_LEVELS, 60.0)
    for _ in range(80):  # bisection on 1 - exp(-x) (1 + x)
        middle = (low + high) / 2
        below = 1 - np.exp(-middle) * (1 + middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low.tolist(), np.log(low).tolist()


def exploded_terms(rows: DataFrame, text: str) -> DataFrame:
    """The rows once per distinct term of the text, with ``term`` and ``weight`` in place of the text.

    Terms are hashes of the runs of five words; a weight is how often a term occurs. Words
    are runs of letters and digits in lower case. A text of fewer words, but not none, has
    one term, all its words; a text without words gives one row of nulls.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c != text]
    words = F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")
    # Separate steps: each array is made once and then looked into.
    rows = rows.select(*kept, F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    run = ", ".join(f"_h[i + {j}]" for j in range(SHINGLE))
    rows = rows.select(
        *kept,
        F.expr(
            f"""sort_array(case when size(_h) >= {SHINGLE} then transform(sequence(0, size(_h) - {SHINGLE}), i -> xxhash64({run}))
            when size(_h) > 0 then array(aggregate(_h, xxhash64(size(_h)), (x, y) -> xxhash64(x, y))) else array() end)"""
        ).alias("_g"),
    )
    # In the sorted array a term's last place and the place before its first give its weight.
    ends = F.expr("case when size(_g) = 0 then array() else filter(sequence(0, size(_g) - 1), i -> i = size(_g) - 1 or _g[i] <> _g[i + 1]) end")
    rows = rows.select(*kept, "_g", ends.alias("_e")).select(*kept, "_g", "_e", F.posexplode_outer("_e").alias("_i", "_p"))
    return rows.select(
        *kept, F.expr("_g[_p]").alias("term"), F.expr("_p - if(_i = 0, -1, _e[if(_i = 0, 0, _i - 1)])").alias("weight")
    )


def samples(terms: DataFrame, n: int = SAMPLES) -> tuple[DataFrame, list[Column]]:
    """One term's values in n samples, as whole numbers: the least of a document is its sample.

    The high bits hold ln a + 64 in steps of 2**-30, the low bits a hash of term and t.
    ``terms`` has term and log_weight and gets the hashes, each of which serves two samples.
    """
    gamma, log_gamma = (F.expr(f"array({', '.join(f'{x!r}D' for x in level)})") for level in _gamma_levels())
    terms = terms.select("*", *[F.xxhash64("term", F.lit(j)).alias(f"_h{j}") for j in range((n + 1) // 2)])
    out = []
    for k in range(n):
        part = lambda at: F.shiftright(f"_h{k // 2}", k % 2 * 32 + at).bitwiseAND(_LEVELS - 1)  # noqa: E731, B023
        r, log_c, b = F.get(gamma, part(0).cast("int")), F.get(log_gamma, part(8).cast("int")), (part(16) + 0.5) / float(_LEVELS)
        t = F.floor(F.col("log_weight") / r + b)
        order = F.floor((log_c - r * (t - b) - r + 64.0) * float(1 << 30))
        name = F.shiftright("term", 21).bitwiseXOR(t * 40503).bitwiseAND((1 << _NAME_BITS) - 1)
        out.append(F.shiftleft(order, _NAME_BITS).bitwiseOR(name))
    return terms, out


def with_next(docs: DataFrame) -> DataFrame:
    """range, place, doc_id, text and next_text, in descending order of doc_id; last of a range is a row ``halo``.

    The next of the last document is the first. Ids are dealt into ranges of about equal
    size; each range also gets the first document of the range after it, as its halo, so
    that a range is worked on without the others. Null ids come after all others; equal ids
    are in the order of a hash of the text.
    """
    rows = docs.select(
        "doc_id", text_of().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("tie")
    )
    bytes_of = rows.agg(F.sum(F.octet_length("text").cast("long") + 64).alias("n")).first()["n"] or 0
    n_ranges = min(max(1, math.ceil(bytes_of / RANGE_BYTES)), MOST_RANGES)
    n_cuts = min(n_ranges, QUANTILES)
    cuts = [i / n_cuts for i in range(n_cuts)] + [1.0]
    found = rows.agg(F.percentile_approx("key", cuts, 10_000).alias("at")).first()["at"] or [0, 0]
    bounds = sorted(set(found))
    within = math.ceil(n_ranges / n_cuts)
    array = F.array(*[F.lit(int(x)) for x in bounds])
    # The quantile an id lies in, from 0, and the part of that quantile.
    quantile = F.greatest(F.size(F.filter(array, lambda x: x <= F.col("key"))) - 1, F.lit(0))
    rows = rows.withColumn("quantile", quantile.cast("int"))
    if within > 1:
        low = F.get(array, F.col("quantile")).cast("double")
        high = F.coalesce(F.get(array, F.col("quantile") + 1), F.get(array, F.col("quantile"))).cast("double")
        part = F.floor((F.col("key").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * within)
        part = F.least(F.greatest(part, F.lit(0)), F.lit(within - 1))
    else:
        part = F.lit(0)
    rows = rows.select("doc_id", "text", "key", "tie", (F.col("quantile") * within + part).cast("int").alias("range"))
    tops = rows.groupBy("range").agg(F.max(F.struct("key", "tie")).alias("top"))
    # One row per range: which range the first document of this one goes to as a halo.
    by_range = Window.orderBy("range")
    over_all = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select(
        "top.key", "top.tie", F.col("range").alias("_range"), F.coalesce(F.lead("range").over(by_range), F.first("range").over(over_all)).alias("to")
    )
    match = (F.col("key") == F.col("_key")) & (F.col("tie") == F.col("_tie")) & (F.col("range") == F.col("_range"))
    tops = F.broadcast(tops.withColumnsRenamed({"key": "_key", "tie": "_tie"}))  # MOST_RANGES rows at most
    halo = rows.join(tops, match).select("doc_id", "text", "key", "tie", F.col("to").alias("range"), F.lit(True).alias("halo"))
    both = rows.withColumn("halo", F.lit(False)).unionByName(halo)
    order = Window.partitionBy("range").orderBy("halo", F.desc("key"), "tie")
    return both.repartitionById(len(bounds) * within, "range").select(
        "range", F.row_number().over(order).alias("place"), "doc_id", "text", "halo", F.lead("text").over(order).alias("next_text")
    )


def _likeness(a: str, b: str) -> Column:
    same = F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.get(F.col(a), i).eqNullSafe(F.get(F.col(b), i)))
    return F.size(same) / float(SAMPLES)


def _written(samples: str) -> Column:
    """The samples as text, eight hex digits each; empty for a text without words."""
    digits = F.transform(F.col(samples), lambda x: F.lpad(F.hex(F.xxhash64(x).bitwiseAND(0xFFFFFFFF)), 8, "0"))
    return F.when(F.col(samples)[0].isNull(), "").otherwise(F.concat_ws("", digits))


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty. Texts without words have an empty fingerprint; two of them are
    alike in every sample and like no other text. A single document is its own next one.
    Repeated rows are kept, next to each other; other columns are not looked at.
    """
    rows = with_next(docs)
    n_chars = F.char_length("text")
    rows = rows.select("range", "place", "doc_id", "text", "next_text", "halo", n_chars.alias("n_chars"), F.floor(n_chars / 3).cast("int").alias("cut"))
    edited = F.concat(F.expr("substring(text, 1, n_chars - cut)"), F.expr("substring(coalesce(next_text, ''), 1, cut)"))
    rows = rows.select("range", "place", "doc_id", "halo", "n_chars", "text", edited.alias("edited"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    texts = F.when(F.col("halo"), F.array("text")).otherwise(F.array("text", "edited"))
    rows = rows.select("range", "place", "doc_id", "halo", "n_chars", "sha", F.posexplode(texts).alias("which", "body"))
    keys = ["range", "place", "doc_id", "halo", "n_chars", "sha"]
    terms = exploded_terms(rows, "body").select(*keys, "which", "term", F.ln("weight").alias("log_weight"))
    terms, values = samples(terms)
    least = [F.min(x).alias(f"s{k}") for k, x in enumerate(values)]
    of_texts = terms.groupBy(*keys, "which").agg(*least)
    both = [F.max(F.when(F.col("which") == i, F.col(f"s{k}"))).alias(f"s{i}_{k}") for i in (0, 1) for k in range(SAMPLES)]
    signed = of_texts.groupBy(*keys).agg(*both).select(*keys, *[F.array(*[f"s{i}_{k}" for k in range(SAMPLES)]).alias(f"of{i}") for i in (0, 1)])
    order = Window.partitionBy("range").orderBy("place")
    signed = signed.withColumn("of_next", F.lead("of0").over(order)).where("not halo")
    return signed.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.lower(F.hex("sha")).alias("edited_sha256"),
        _written("of0").alias("fingerprint"),
        _written("of1").alias("edited_fingerprint"),
        _likeness("of0", "of1").alias("near_edited"),
        _likeness("of0", "of_next").alias("near_next"),
    )
