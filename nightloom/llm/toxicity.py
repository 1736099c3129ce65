"""Toxicity by class-conditional Kneser-Ney models of words.

Each class, toxic and ordinary, has a bigram model with absolute discounting: what the
discount takes from a context's pairs is given to the class's continuation distribution (in
how many contexts a word occurs), and what it takes there to the shared continuation
counts. Both orders are mixed with the shared counts of the same order, in which toxic text
has a small share. Every distribution sums to one. Counts of the larger class are scaled to
the smaller one's and the weights are alike, so an expression too rare to survive the
discount has nearly the same probability in both classes and says nothing. The shared
weight is high: expressions the classes have in common then differ by little, and those
that one class alone has stand out. A document's score is a logistic function of the
difference of its two log-likelihoods per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_fold, settle, ship
from .textkernels import ALNUM, mix, slices, span_hashes, words

#: About how many labelled rows of each class the models are counted on, and how many calibrate the score, at most.
MODEL_ROWS = 12_000
CALIBRATION_ROWS = 6_000
#: Taken off every count of a class, of pairs and of words, and given to the next lower order.
DISCOUNT = 3.0
#: Weight of the shared counts, and of toxic text in them.
SHARED_WEIGHT = 0.98
TOXIC_SHARE = 0.01
#: Occurrences that a context is taken to have beside those counted, all given to the backoff.
CONTEXT_PRIOR = 2_000.0
THRESHOLD = 0.7
#: Slices that are counted together before the shuffle.
COUNTED_SLICES = 4

_START = np.int64(0x5EED)


def _bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word's predecessor and of the word, and where each row's begin."""
    starts, ends, bounds, mapped = words(data, offsets, ALNUM)
    word = span_hashes(mapped, starts, ends).view(np.int64)
    before = np.roll(word, 1)
    first = bounds[:-1][np.diff(bounds) > 0]
    before[first] = _START
    return before, word, bounds


def _pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return before * np.int64(-7046029254386353131) + (word ^ (word >> 29))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(before, word, toxic, n, left) of the texts of each batch; left has a bit for each kind of word before the pair."""
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for some in batched(slices(batch.column(0)), COUNTED_SLICES):
            parts = []
            for low, high, data, offsets in some:
                before, word, bounds = _bigrams(data, offsets)
                earlier = np.where(before == _START, _START, np.roll(before, 1))
                bit = mix(earlier.view(np.uint64)) % np.uint64(63)
                parts.append(pd.DataFrame({"before": before, "word": word, "toxic": np.repeat(toxic[low:high], np.diff(bounds)), "bit": bit}))
            frame = pd.concat(parts)
            frame = frame.groupby(["before", "word", "toxic", "bit"], sort=False).size().reset_index(name="n")
            frame["left"] = np.int64(1) << frame["bit"].astype("int64")
            frame = frame.groupby(["before", "word", "toxic"], sort=False)[["n", "left"]].sum().reset_index()
            yield pa.RecordBatch.from_pandas(frame.astype({"toxic": "int32", "n": "int64", "left": "int64"}), preserve_index=False)


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[DataFrame, DataFrame]:
    """Texts with labels for the models and for calibration, disjoint, of rows that are not held out.

    A row is taken if a hash of its id is below the share that gives ``MODEL_ROWS`` of its
    class, or ``CALIBRATION_ROWS`` in all; then the ids can be broadcast to the documents.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out)
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    calibrating = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(5)) == 0
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1e6
    own = own.select("doc_id", "toxic", calibrating.alias("calibrating"), place.alias("place"))
    n = {(r.toxic, r.calibrating): r.n for r in own.groupBy("toxic", "calibrating").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, MODEL_ROWS / max(n.get((1, False), 0), 1)).otherwise(MODEL_ROWS / max(n.get((0, False), 0), 1))
    chosen = own.where(~F.col("calibrating") & (F.col("place") < share))
    rest = own.where(F.col("calibrating") & (F.col("place") < CALIBRATION_ROWS / max(n.get((0, True), 0) + n.get((1, True), 0), 1)))
    texts = docs.select("doc_id", "text")
    pick = lambda ids: texts.join(F.broadcast(ids.select("doc_id", "toxic")), "doc_id").select("text", "toxic")
    return pick(chosen), pick(rest)


class KneserNeyContrast:
    """Log-likelihood ratio of the two classes, as sorted look-up tables of words, contexts and pairs."""

    def __init__(self, words: pd.DataFrame, contexts: pd.DataFrame, pairs: pd.DataFrame, unknown: tuple[float, float]):
        """words: p0, p1; contexts: what b0, b1 of p0, p1 words get there that have no pair of their own; pairs: q0, q1."""
        self.unknown = float(np.log(unknown[1] / unknown[0]))
        own = words.sort_values("word")
        self.words, self.word_ratio = own["word"].to_numpy(np.int64), np.log(own["p1"].to_numpy() / own["p0"].to_numpy())
        own = contexts.sort_values("before")
        self.contexts, self.context_ratio = own["before"].to_numpy(np.int64), np.log(own["b1"].to_numpy() / own["b0"].to_numpy())
        keys = _pair_key(pairs["before"].to_numpy(np.int64), pairs["word"].to_numpy(np.int64))
        order = np.argsort(keys)
        self.pairs, self.pair_ratio = keys[order], np.log(pairs["q1"].to_numpy() / pairs["q0"].to_numpy())[order]

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def ratios(self, column: pa.Array) -> np.ndarray:
        """Mean log-likelihood ratio per word of each text; 0 without words."""
        out = []
        for _, _, data, offsets in slices(column):
            before, word, bounds = _bigrams(data, offsets)
            # Each distinct word is looked up once.
            distinct, where = np.unique(word, return_inverse=True)
            ratio = self._find(self.words, self.word_ratio, distinct, self.unknown)[where]
            ratio = ratio + self._find(self.contexts, self.context_ratio, before, 0.0)
            pair = self._find(self.pairs, self.pair_ratio, _pair_key(before, word), np.nan)
            sums = np.concatenate(([0.0], np.cumsum(np.where(np.isnan(pair), ratio, pair))))
            n = np.diff(bounds)
            out.append((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1))
        return np.concatenate(out) if out else np.zeros(0)


def smoothed(texts: DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, tuple[float, float]] | None:
    """Count and smooth: words, contexts and pairs with their probabilities by class, and that of an unknown word.

    Only words and pairs that survive the discount in a class are collected; all others have
    the probability that the lower order gives them. ``None`` without texts of both classes.
    """
    counts = texts.mapInArrow(_count, "before long, word long, toxic int, n long, left long")
    of = lambda c, name: F.when(F.col("toxic") == c, F.col(name)).otherwise(0)
    by_class = [F.sum(of(c, "n")).alias(f"n{c}") for c in (0, 1)] + [F.bit_or(of(c, "left")).alias(f"left{c}") for c in (0, 1)]
    pairs = settle(counts.groupBy("before", "word").agg(*by_class))
    sums = [F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)] + [F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"k{c}") for c in (0, 1)]
    row = pairs.agg(*sums).first()
    if not row["n0"] or not row["n1"]:
        return None
    cut = lambda n: F.greatest(F.col(n) - F.lit(DISCOUNT), F.lit(0.0))
    mixture = lambda a, b: F.col(a) * (1 - TOXIC_SHARE) + F.col(b) * TOXIC_SHARE
    own, shared = 1 - SHARED_WEIGHT, SHARED_WEIGHT
    # Continuation counts: the contexts of each word, scaled to the class that has fewer; an unknown word has half of one.
    contexts_of = float(min(row["k0"], row["k1"]))
    continued = [(F.sum((F.col(f"n{c}") > 0).cast("long")) * (contexts_of / row[f"k{c}"])).alias(f"n{c}") for c in (0, 1)]
    unigrams = settle(pairs.groupBy("word").agg(*continued))
    kept_mass = unigrams.agg(*[(F.sum(cut(f"n{c}")) / contexts_of).alias(f"d{c}") for c in (0, 1)]).first()
    continuation = mixture("n0", "n1") / (contexts_of + 0.5)
    p = [(own * cut(f"n{c}") / contexts_of + (own * (1 - kept_mass[f"d{c}"]) + shared) * continuation).alias(f"p{c}") for c in (0, 1)]
    unknown = tuple((own * (1 - kept_mass[f"d{c}"]) + shared) * 0.5 / (contexts_of + 0.5) for c in (0, 1))
    words_of = unigrams.select("word", *p, (F.greatest("n0", "n1") > DISCOUNT).alias("telling"))
    # Pairs. One that continues few different texts, as a passage that is copied, is no evidence for a class.
    tokens = float(min(row["n0"], row["n1"]))
    lasting = lambda c: F.when(F.bit_count(f"left{c}") > DISCOUNT, F.col(f"n{c}")).otherwise(0.0)
    scaled = [(F.col(f"n{c}") * (tokens / row[f"n{c}"])).alias(f"n{c}") for c in (0, 1)]
    equal = pairs.select("before", "word", *scaled, *[(lasting(c) * (tokens / row[f"n{c}"])).alias(f"e{c}") for c in (0, 1)])
    kept = F.greatest("e0", "e1") > DISCOUNT
    when_kept = lambda x: F.sum(F.when(kept, x).otherwise(0.0))
    contexts = equal.groupBy("before").agg(
        *[(F.sum(f"n{c}") + CONTEXT_PRIOR).alias(f"of{c}") for c in (0, 1)],
        *[when_kept(cut(f"e{c}")).alias(f"own{c}") for c in (0, 1)],
        (F.sum(mixture("n0", "n1")) + CONTEXT_PRIOR).alias("of"),
        when_kept(mixture("n0", "n1")).alias("common"),
        F.max(kept).alias("kept"),
    )
    # What a context leaves to the lower order: 1 in a context that keeps no pair.
    left_over = [(own * (1 - F.col(f"own{c}") / F.col(f"of{c}")) + shared * (1 - F.col("common") / F.col("of"))).alias(f"b{c}") for c in (0, 1)]
    contexts = settle(contexts.where("kept").select("before", "of0", "of1", "of", *left_over))
    both = equal.where(kept).join(contexts, "before").join(words_of.drop("telling"), "word")
    q = [
        (own * cut(f"e{c}") / F.col(f"of{c}") + shared * mixture("n0", "n1") / F.col("of") + F.col(f"b{c}") * F.col(f"p{c}")).alias(f"q{c}") for c in (0, 1)
    ]
    found = both.select("before", "word", *q).toPandas()
    return words_of.where("telling").drop("telling").toPandas(), contexts.select("before", "b0", "b1").toPandas(), found, unknown


def _contrast(texts: DataFrame) -> KneserNeyContrast:
    found = smoothed(texts)
    if found is None:  # one class alone tells nothing
        nothing = pd.DataFrame({x: np.zeros(0) for x in ("word", "before", "p0", "p1", "b0", "b1", "q0", "q1")})
        return KneserNeyContrast(nothing, nothing, nothing, (1.0, 1.0))
    return KneserNeyContrast(*found)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> tuple[float, float, float, float]:
    """Centre, scale, intercept and slope of a logistic fit on one feature (Newton's method)."""
    if not len(x) or y.min() == y.max():
        return 0.0, 1.0, -2.0, 1.0
    centre, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.column_stack((np.ones(len(x)), (x - centre) / scale))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return centre, scale, float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column):
    """A broadcast (model, calibration), learnt from the labelled rows that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    model_texts, calibration_texts = labelled(docs, labels, held_out)
    model = _contrast(model_texts)
    shared = spark.sparkContext.broadcast(model)

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.ratios(batch.column(0))), batch.column(1)], ["ratio", "toxic"])

    points = calibration_texts.mapInArrow(ratios, "ratio double, toxic int").toPandas()
    return spark.sparkContext.broadcast((model, _logistic(points["ratio"].to_numpy(), points["toxic"].to_numpy(float))))


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out_modulus: int = 3, held_out_remainder: int = 1) -> DataFrame:
    """All columns of ``docs`` (doc_id and text among them) with ``tox_score``.

    A null text counts as empty; an empty text, or one without words, has ratio 0. With no
    labelled rows, or rows of one class only, every score is low and alike. Labels that
    are neither 0 nor 1 are not used; several labels of an id count as the highest.
    Rows are scored each by their own text alone; an empty table gives no rows.
    """
    learnt = fit(docs, labels, in_fold("doc_id", held_out_modulus, held_out_remainder))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model, (centre, scale, intercept, slope) = learnt.value
        z = intercept + slope * (model.ratios(pa.array(texts, pa.string())) - centre) / scale
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn("tox_score", score(F.coalesce("text", F.lit(""))))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return toxicity_scores(docs.select("doc_id", "text"), labels).select(
        "doc_id",
        in_fold("doc_id", 3, 1).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the operator does not call toxic, whole."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), "doc_id", "text")
    return toxicity_scores(own, labels).where(F.col("tox_score") < THRESHOLD).select("record.*")
