"""The learning track: statistics, splits, windows, small networks as Arrow kernels, metrics and grids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightloom.config import DEFAULT, Config
from nightloom.operators.frames import pieces
from nightloom.operators.islands import class_runs, split_long, suppressed
from nightloom.shipping import ship_library


def norm_stats(df: DataFrame, channels: list[str]) -> DataFrame:
    """(channel, mean, std) pooled over all recordings, weighting each by its length; std divides by n."""
    long = df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in channels]), F.array(*[F.col(c).cast("double") for c in channels]))).alias("channel", "v"))
    return long.groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def zscores(df: DataFrame, stats: DataFrame, channel: str) -> DataFrame:
    own = F.broadcast(stats.where(F.col("channel") == channel))
    return df.crossJoin(own).withColumn("z", (F.col(channel) - F.col("mean")) / (F.col("std") + 1e-9)).drop("channel", "mean", "std")


def event_windows(events: DataFrame, slow: DataFrame, half: int, values: list[str]) -> DataFrame:
    """A window of ``half`` samples to either side of each event's middle, if it lies within the recording."""
    centre = F.floor(F.col("start_sec") + (F.col("end_sec") - F.col("start_sec")) / 2)
    spans = events.select("rec", "start_sec", (centre - half).alias("_low")).where("_low >= 0")
    return pieces(spans, ["rec", "start_sec"], 2 * half, slow, values)


def negative_windows(events: DataFrame, slow: DataFrame, half: int, seed: int, attempts: int = 20) -> DataFrame:
    """(rec, centre): seeded random windows that meet no event window and not each other, up to one per event.

    Candidates are hashes; those near events go by an anti join on stretches of a window's
    length, the rest are taken in turn, those that no chain of overlaps connects apart.
    """
    n = slow.groupBy("rec").agg(F.count("*").alias("n"))
    wanted = events.groupBy("rec").agg(F.count("*").alias("wanted")).join(n, "rec").where(F.col("n") > 2 * half)
    # Every event makes its share of a recording's tries; they are many more than the rows they are made of, so none is broadcast.
    numbered = events.select("rec", (F.row_number().over(Window.partitionBy("rec").orderBy("start_sec")) - 1).cast("long").alias("_o"))
    tries = numbered.join(wanted, "rec").withColumn("k", F.explode(F.expr(f"sequence(_o * {attempts}, _o * {attempts} + {attempts - 1})")))
    centre = F.lit(half) + F.pmod(F.xxhash64("rec", "k", F.lit(seed)), F.col("n") - 2 * half)
    tries = tries.select("rec", "k", "wanted", centre.alias("centre"))
    taken = events.select("rec", F.floor(F.col("start_sec") + (F.col("end_sec") - F.col("start_sec")) / 2).alias("_c"))
    taken = taken.withColumn("_stretch", F.floor(F.col("_c") / (2 * half)))
    stretch = F.floor(F.col("centre") / (2 * half))
    near = tries.withColumn("_stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1))).join(taken.hint("merge"), ["rec", "_stretch"])
    near = near.where(F.abs(F.col("_c") - F.col("centre")) < 2 * half).select("rec", "k").distinct()
    free = tries.join(near.hint("merge"), ["rec", "k"], "left_anti")
    kept = suppressed(free.select("rec", F.col("k").alias("ord"), (F.col("centre") - half).alias("start"), (F.col("centre") + half).alias("end"), F.lit(0.0).alias("avg_conf")), 0.0)
    kept = kept.join(wanted.select("rec", "wanted"), "rec").withColumn("_place", F.row_number().over(Window.partitionBy("rec").orderBy("ord")))
    return kept.where("_place <= wanted").select("rec", (F.col("start") + half).cast("long").alias("centre"))


def patient_split(patients: DataFrame, share: float, seed: int) -> DataFrame:
    """(rec, split): the first ceil(share * n) in the order of a seeded hash are the test part."""
    order = F.row_number().over(Window.orderBy(F.md5(F.concat(F.col("rec").cast("string"), F.lit(f"-{seed}")).cast("binary"))))
    own = patients.withColumns({"_r": order, "_n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    return own.select("rec", F.when(F.col("_r") <= F.ceil(F.col("_n") * share), "test").otherwise("train").alias("split"))


def class_weights(counts: DataFrame, factor: float) -> DataFrame:
    """Inverse roots of the counts, times ``factor`` but for class 0, with mean 1."""
    raw = 1 / (F.sqrt("n") + 1) * F.when(F.col("label") > 0, factor).otherwise(1.0)
    own = counts.withColumn("_w", raw)
    everything = Window.partitionBy(F.lit(1))
    return own.withColumn("weight", F.col("_w") / F.sum("_w").over(everything) * F.count("*").over(everything)).drop("_w")


def class_histogram(rows: DataFrame, classes: int, factor: float) -> DataFrame:
    """(label, n, weight) of every class, 0 for those that do not occur; the weights' sum is the number of classes."""
    sums = rows.agg(*[F.count_if(F.col("label") == c).alias(f"_{c}") for c in range(classes)])
    counts = sums.select(F.inline(F.array(*[F.struct(F.lit(c).cast("long").alias("label"), F.col(f"_{c}").alias("n")) for c in range(classes)])))
    return class_weights(counts, factor)


def top_experts(logits: DataFrame, token: str, k: int) -> DataFrame:
    """(token, expert, place): the k greatest logits; equal ones by number."""
    own = logits.select(token, F.posexplode("logits").alias("expert", "x"))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy(token).orderBy(F.desc("x"), "expert"))).where(F.col("place") <= k)
    return own.select(token, F.col("expert").cast("long").alias("expert"), F.col("place").cast("long").alias("place"))


def desaturation_gate(events: DataFrame, slow: DataFrame, back: int, into: int, after: int, drop: float) -> DataFrame:
    """(rec, start_sec, base, nadir) of the events whose raw SpO2 falls by at least ``drop``."""
    own = events.select("rec", "start_sec", "end_sec", F.floor("start_sec").alias("_s"), F.floor("end_sec").alias("_e"))
    own = own.withColumn("i", F.explode(F.sequence(F.greatest(F.col("_s") - back, F.lit(0)), F.col("_e") + after - 1)))
    own = own.join(slow.select("rec", "i", "spo2").hint("merge"), ["rec", "i"])
    base = F.max(F.when(F.col("i") < F.col("_s") + into, F.col("spo2"))).alias("base")
    nadir = F.min(F.when(F.col("i") >= F.col("_s"), F.col("spo2"))).alias("nadir")
    return own.groupBy("rec", "start_sec").agg(base, nadir).where(F.col("base") - F.col("nadir") >= drop)


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def dense_confusion(pairs: DataFrame, classes: list[int]) -> DataFrame:
    """(truth, predicted, n) for every pair of classes, 0 where there is none: one scan with conditional counts."""
    cells = [(t, p) for t in classes for p in classes]
    sums = [F.count_if((F.col("truth") == t) & (F.col("predicted") == p)).alias(f"_{i}") for i, (t, p) in enumerate(cells)]
    rows = F.array(*[F.struct(F.lit(t).alias("truth"), F.lit(p).alias("predicted"), F.col(f"_{i}").alias("n")) for i, (t, p) in enumerate(cells)])
    return pairs.agg(*sums).select(F.inline(rows))


def report_averages(by_class: DataFrame) -> DataFrame:
    """(accuracy, macro and weighted precision, recall and f1) from a classification report of all classes."""
    names, n = ("precision", "recall", "f1"), F.sum("support")
    mean = [F.avg(x).alias(f"macro_{x}") for x in names]
    weighted = [F.coalesce(F.try_divide(F.sum(F.col(x) * F.col("support")), n), F.lit(0.0)).alias(f"weighted_{x}") for x in names]
    hits = F.sum(F.col("recall") * F.col("support"))
    return by_class.agg(F.coalesce(F.try_divide(hits, n), F.lit(0.0)).alias("accuracy"), *mean, *weighted, n.alias("support"))


def classification_report(pairs: DataFrame, classes: list[int]) -> DataFrame:
    """(label, precision, recall, f1, support); zero where a denominator is."""
    sums = []
    for c in classes:
        sums += [F.count_if((F.col("truth") == c) & (F.col("predicted") == c)).alias(f"tp{c}"), F.count_if(F.col("predicted") == c).alias(f"pr{c}"), F.count_if(F.col("truth") == c).alias(f"su{c}")]
    rows = pairs.agg(*sums).select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"tp{c}").alias("tp"), F.col(f"pr{c}").alias("pr"), F.col(f"su{c}").alias("su")) for c in classes])).alias("x")).select("x.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.select(
        "label", ratio(F.col("tp").cast("double"), F.col("pr")).alias("precision"), ratio(F.col("tp").cast("double"), F.col("su")).alias("recall"),
        ratio(F.col("tp") * 2.0, F.col("pr") + F.col("su")).alias("f1"), F.col("su").alias("support"),
    )


def threshold_grid(features: DataFrame) -> DataFrame:
    """Samples below each apnea threshold and in each hypopnea band: one scan with a pair of counts per cell."""
    cells = [(a / 10, h / 10) for a in range(1, 7) for h in range(1, 8) if h / 10 < 1 - a / 10]
    r = F.col("env") / F.col("baseline")
    sums = []
    for i, (a, h) in enumerate(cells):
        sums += [F.count_if(r < a).alias(f"_b{i}"), F.count_if((r <= 1 - F.lit(h)) & (r > a)).alias(f"_n{i}")]
    row = lambda i, a, h: F.struct(F.lit(a).alias("apnea"), F.lit(h).alias("hypopnea"), F.col(f"_b{i}").alias("below"), F.col(f"_n{i}").alias("between_n"))
    return features.where("baseline >= 1").agg(*sums).select(F.inline(F.array(*[row(i, a, h) for i, (a, h) in enumerate(cells)])))


def inferred_events(windows: DataFrame, slow: DataFrame, length: float, config: Config = DEFAULT) -> DataFrame:
    """(rec, type, start, end, avg_conf) of a network's windows (rec, start, label, conf), in seconds.

    Runs of equal classes; those under 10 s go, those over ``split_above_sec``
    are split and pass; of the others a hypopnea (class 4) needs a fall of raw SpO2; then
    greedy suppression. ``slow`` has rec, i and spo2, one row a second.
    """
    runs = class_runs(windows, config.confidence, length).where(F.col("end") - F.col("start") >= 10)
    runs = split_long(runs.withColumns({"start": F.col("start").cast("double"), "end": F.col("end").cast("double")}), config.split_above_sec, config.split_part_sec)
    judged = runs.where((F.col("type") == 4) & ~F.col("was_split")).select("rec", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"))
    passed = desaturation_gate(judged, slow, 30, 10, 30, config.gate_drop).select("rec", F.col("start_sec").alias("start"), F.lit(True).alias("_passed"))
    kept = runs.join(passed, ["rec", "start"], "left").where((F.col("type") != 4) | F.col("was_split") | F.col("_passed"))
    in_order = Window.partitionBy("rec").orderBy("start", "part")
    kept = kept.withColumn("ord", F.row_number().over(in_order))
    alone = suppressed(kept.select("rec", "ord", "start", "end", "avg_conf"), config.overlap)
    return alone.join(kept.select("rec", "ord", "type"), ["rec", "ord"]).select("rec", "type", "start", "end", "avg_conf")


def inferred_index(events: DataFrame, slow: DataFrame) -> DataFrame:
    """(rec, obstr, cntrl, mixed, hypop, duration_hrs, ahi) of every recording; one without events has zeros."""
    names = {1: "obstr", 2: "cntrl", 3: "mixed", 4: "hypop"}
    counts = events.groupBy("rec").agg(*[F.count_if(F.col("type") == k).alias(x) for k, x in names.items()])
    hours = slow.groupBy("rec").agg((F.count("*") / F.lit(3600.0)).alias("duration_hrs"))
    out = hours.join(counts, "rec", "left").na.fill(0, list(names.values()))
    total = sum((F.col(x) for x in names.values()), F.lit(0))
    return out.select("rec", *names.values(), "duration_hrs", (total / F.col("duration_hrs")).alias("ahi"))


class CNN:
    """Three strided convolutions with normalisation and ReLU, mean over time, one linear layer."""

    shapes = ((16, 5), (32, 5), (64, 3))

    def __init__(self, channels: int, classes: int = 5, seed: int = 0):
        rng, width, self.layers = np.random.default_rng(seed), channels, []
        for out, kernel in self.shapes:
            weight = rng.normal(0, (2 / (width * kernel)) ** 0.5, (out, kernel, width))
            self.layers.append({"w": weight, "b": np.zeros(out), "gamma": np.ones(out), "beta": np.zeros(out), "mean": np.zeros(out), "var": np.ones(out)})
            width = out
        self.head = rng.normal(0, width**-0.5, (width, classes)), np.zeros(classes)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Logits of a batch (n, time, channels)."""
        for layer in self.layers:
            kernel = layer["w"].shape[1]
            padded = np.pad(x, ((0, 0), (kernel // 2, kernel // 2), (0, 0)))
            view = np.lib.stride_tricks.sliding_window_view(padded, kernel, axis=1)[:, ::2]
            x = np.einsum("ntck,okc->nto", view, layer["w"]) + layer["b"]
            x = (x - layer["mean"]) / np.sqrt(layer["var"] + 1e-5) * layer["gamma"] + layer["beta"]
            x = np.maximum(x, 0)
        return x.mean(axis=1) @ self.head[0] + self.head[1]


_ERF_CELLS = 4096  # of the table, per unit
_ERF_AT = np.arange(6 * _ERF_CELLS + 1) / _ERF_CELLS
_ERF = np.array([math.erf(a) for a in _ERF_AT])
_ERF_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-(_ERF_AT**2))
#: Values that are worked on at a time, so that they stay in a core's cache.
_ERF_BLOCK = 8192
#: Windows that a network sees at a time, for the same reason.
WINDOWS = 32


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, by two derivatives at the nearest place of a table; right to 1e-12."""
    flat = np.ascontiguousarray(x, dtype=float).reshape(-1)
    out = np.empty_like(flat)
    for low in range(0, len(flat), _ERF_BLOCK):
        own = flat[low : low + _ERF_BLOCK]
        a = np.minimum(np.abs(own), 6.0)
        k = (a * _ERF_CELLS + 0.5).astype(np.int64)
        d = a - k / _ERF_CELLS
        np.copysign(_ERF[k] + _ERF_SLOPE[k] * d * (1 - _ERF_AT[k] * d), own, out=out[low : low + _ERF_BLOCK])
    return out.reshape(np.shape(x))


class Linear:
    """An affine map with weights and, if wanted, a bias within one over the root of its width."""

    def __init__(self, rng: np.random.Generator, width: int, out: int, bias: bool = True):
        bound = width**-0.5
        self.w = rng.uniform(-bound, bound, (width, out))
        self.b = rng.uniform(-bound, bound, out) if bias else np.zeros(out)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


class Norm:
    """Features brought to mean 0 and deviation 1, with a gain and a bias."""

    def __init__(self, dims: int):
        self.gain, self.bias = np.ones(dims), np.zeros(dims)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * self.gain + self.bias


class Expert:
    """Two layers, four times as wide between them."""

    def __init__(self, rng: np.random.Generator, dims: int):
        self.up, self.down = Linear(rng, dims, 4 * dims), Linear(rng, 4 * dims, dims)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = self.up(x)
        flat = h.reshape(-1)
        for low in range(0, len(flat), _ERF_BLOCK):
            own = flat[low : low + _ERF_BLOCK]
            own *= 0.5 * (1 + erf(own / math.sqrt(2)))
        return self.down(h)


class Block:
    """Rotary attention and a mixture of experts, each on normalised features and added to them."""

    def __init__(self, rng: np.random.Generator, dims: int, heads: int, experts: int, top: int):
        self.heads, self.top = heads, top
        self.before_attention, self.before_experts = Norm(dims), Norm(dims)
        self.query, self.key, self.value, self.out = (Linear(rng, dims, dims, bias=False) for _ in range(4))
        self.experts, self.shared = [Expert(rng, dims) for _ in range(experts)], Expert(rng, dims)
        self.gate, self.shared_gate = Linear(rng, dims, experts), Linear(rng, dims, 1)

    def attend(self, x: np.ndarray, t: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        n, time, dims = x.shape
        q, k, v = (f(x).reshape(n, time, self.heads, -1).swapaxes(1, 2) for f in (self.query, self.key, self.value))
        q, k = Mira.rotate(q, t), Mira.rotate(k, t)
        score = q @ k.swapaxes(-1, -2) / np.sqrt(q.shape[-1])
        score = score if mask is None else score + mask
        score = np.exp(score - score.max(-1, keepdims=True))
        return self.out(((score / score.sum(-1, keepdims=True)) @ v).swapaxes(1, 2).reshape(n, time, dims))

    def mixture(self, x: np.ndarray) -> np.ndarray:
        """Each token by its top experts alone, equal gates by number, and by the shared one."""
        tokens = x.reshape(-1, x.shape[-1])
        gate = self.gate(tokens)
        chosen = np.argsort(-gate, -1, kind="stable")[:, : self.top]
        share = np.take_along_axis(gate, chosen, -1)
        share = np.exp(share - share.max(-1, keepdims=True))
        share /= share.sum(-1, keepdims=True)
        out = self.shared(tokens) / (1 + np.exp(-self.shared_gate(tokens)))
        for number, expert in enumerate(self.experts):
            token, place = np.nonzero(chosen == number)
            if len(token):
                out[token] += share[token, place, None] * expert(tokens[token])
        return out.reshape(x.shape)

    def __call__(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        x = x + self.attend(self.before_attention(x), t)
        return x + self.mixture(self.before_experts(x))


class Mira:
    """Rotary attention blocks with a mixture of experts, a Runge-Kutta step of the last state, a linear layer."""

    def __init__(self, channels: int, classes: int = 5, dims: int = 64, layers: int = 2, heads: int = 4, experts: int = 8, top: int = 2, seed: int = 0):
        assert dims % heads == 0
        rng = np.random.default_rng(seed)
        self.embed = Linear(rng, channels, dims)
        self.blocks = [Block(rng, dims, heads, experts, top) for _ in range(layers)]
        self.flow = Linear(rng, dims + 1, 2 * dims), Linear(rng, 2 * dims, dims)
        self.norm, self.head = Norm(dims), Linear(rng, dims, classes)

    @staticmethod
    def rotate(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Pairs of neighbouring features turned by time; x is (n, heads, time, d)."""
        half = x.shape[-1] // 2
        angle = t[:, None] * 10000.0 ** (-np.arange(half) / half)
        a, b, out = x[..., 0::2], x[..., 1::2], np.empty_like(x)
        out[..., 0::2], out[..., 1::2] = a * np.cos(angle) - b * np.sin(angle), a * np.sin(angle) + b * np.cos(angle)
        return out

    def step(self, h: np.ndarray, dt: float) -> np.ndarray:
        """Four Runge-Kutta steps of the latent state; the net gets the length of a step."""
        inner, outer = self.flow
        s = dt / 4
        f = lambda y: outer(np.tanh(inner(np.concatenate((y, np.full((len(y), 1), s)), 1))))
        for _ in range(4):
            k1 = f(h)
            k2 = f(h + s / 2 * k1)
            k3 = f(h + s / 2 * k2)
            k4 = f(h + s * k3)
            h = h + s / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        return h

    def __call__(self, x: np.ndarray) -> np.ndarray:
        t = np.arange(x.shape[1], dtype=float)
        x = self.embed(x)
        for block in self.blocks:
            x = block(x, t)
        x = self.norm(x)
        return self.head(x.mean(axis=1) + self.step(x[:, -1], 1.0))


def predict_windows(windows: DataFrame, channels: list[str], network, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(rec, start, label, conf) of each window; ``stats`` has the training data's mean and deviation by channel.

    The network is broadcast and run on small batches.
    """
    ship_library(windows.sparkSession)
    shared = windows.sparkSession.sparkContext.broadcast(network)
    mean, deviation = (np.array([stats[c][i] for c in channels]) for i in (0, 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), WINDOWS):
                part = frame.iloc[low : low + WINDOWS]
                x = np.stack([np.stack(part[c].to_list()) for c in channels], -1).astype(float)
                logits = shared.value((x - mean) / (deviation + 1e-9))
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                yield pd.DataFrame({"rec": part["rec"], "start": part["start"], "label": p.argmax(1), "conf": p.max(1)})

    return windows.mapInPandas(run, "rec long, start long, label long, conf double")
