"""One scan of the flow signal: what every detector needs of it, for any number of thresholds at once.

The signal is dealt to chunks, each with the samples around it that its widest frame reaches,
in one exchange. A kernel per chunk makes envelope, baseline and smoothed envelope, and gives
the fragments of runs that lie in the chunk, the turning points and the snoring seconds; only
these few rows go on. Runs across the edges of chunks are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.config import DEFAULT, Config
from nightloom.operators.frames import chunked
from nightloom.operators.islands import stitched
from nightloom.shipping import ship_library
from nightloom.storage import stored

#: An apnea threshold (what remains of the flow) and a hypopnea threshold (what it drops by).
Cell = tuple[float, float]
FEATURES = "rec long, j long, flow double, env_sum double, env_n long, env double, baseline double, smooth double, turn int"
FOUND = "rec long, kind string, cell int, chunk long, start long, end long, stop long, edge boolean"


@dataclass
class _Chunk:
    """A chunk's samples and those around it; ``low`` and ``high`` bound its own."""

    rec: int
    number: int
    j: np.ndarray
    flow: np.ndarray
    low: int
    high: int

    @property
    def mine(self) -> slice:
        return slice(*np.searchsorted(self.j, (self.low, self.high)))


def _sums(values: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the values up to ``half`` places away."""
    n = len(values)
    total = np.concatenate(([0], np.cumsum(values)))
    low, high = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    return total[high] - total[low], high - low


def _percentiles(values: np.ndarray, half: int, share: float) -> np.ndarray:
    """The value at place trunc(n * share), at most n - 1, of each sorted frame of up to ``half`` places away."""
    width = 2 * half + 1
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(values, half, constant_values=np.inf), width)
    n = np.minimum(np.arange(len(values)) + half + 1, len(values)) - np.maximum(np.arange(len(values)) - half, 0)
    place = np.minimum(np.floor(n * share).astype(np.int64), n - 1)
    return np.sort(frames, axis=1)[np.arange(len(values)), place]


@dataclass
class _Frames:
    env_sum: np.ndarray
    env_n: np.ndarray
    env: np.ndarray
    baseline: np.ndarray
    smooth: np.ndarray


def _frames(chunk: _Chunk, rate: int, config: Config) -> _Frames:
    """Right for the chunk's own samples and those next to it; further out the frames are cut."""
    total, n = _sums(np.abs(chunk.flow), rate // 2)
    env = total / n
    second = chunk.j // rate
    starts = np.flatnonzero(np.diff(second, prepend=-1))
    # A first or last second that is cut short by the chunk's surroundings is in no frame of its own samples.
    base = _percentiles(np.maximum.reduceat(env, starts), config.baseline_half_sec, config.baseline_share)
    behind = np.append(base[1:], base[-1:])
    at, part = second - second[0], (chunk.j % rate) / rate
    half = int(config.csr_smooth_sec * rate) // 2
    # Where all counts divide 60, whole multiples of the envelope keep the smoothing exact for whole samples.
    exact = np.issubdtype(total.dtype, np.integer) and not (60 % np.unique(n)).any()
    smooth, count = _sums(total * (60 // n) if exact else env, half)
    return _Frames(total, n, env, base[at] * (1 - part) + behind[at] * part, smooth / count)


def _turns(chunk: _Chunk, smooth: np.ndarray) -> np.ndarray:
    """1 at a strict peak, -1 at a strict trough, 0 elsewhere and at the signal's ends."""
    out = np.zeros(len(smooth), np.int32)
    left, here, right = smooth[:-2], smooth[1:-1], smooth[2:]
    out[1:-1] = ((here > left) & (here > right)).astype(np.int32) - ((here < left) & (here < right))
    return out


def _fragments(at: np.ndarray, valid: np.ndarray, flag: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(start, end, stop, edge) of the runs of flagged samples among the valid ones from ``low`` up to ``high``; end is -1 if not known."""
    places, flags = at[valid], flag[valid]
    a, b = np.searchsorted(places, (low, high))
    own = flags[a:b]
    starts = np.flatnonzero(own & ~np.concatenate(([False], own[:-1])))
    stops = np.flatnonzero(own & ~np.concatenate((own[1:], [False])))
    behind = np.append(places, -1)[np.minimum(a + stops + 1, len(places))]
    return places[a + starts], behind, places[a + stops] + 1, (starts == 0) | (stops == len(own) - 1)


def _snoring(chunk: _Chunk, rate: int, config: Config) -> tuple[np.ndarray, ...]:
    """(second, rms, hf_ratio, zcr, snoring) of the complete windows of 2 s from each of the chunk's seconds on, and one more."""
    size = 2 * rate
    seconds = np.arange(chunk.low // rate, -(-chunk.high // rate) + 1)
    begin = np.searchsorted(chunk.j, seconds * rate)
    whole = begin + size <= len(chunk.j)
    seconds, begin = seconds[whole], begin[whole]
    if not len(seconds):
        return seconds, *[np.zeros(0)] * 3, np.zeros(0, np.bool_)
    x = np.lib.stride_tricks.sliding_window_view(chunk.flow, size)[begin]
    d = np.diff(x, axis=1)
    rms = np.sqrt((x * x).sum(axis=1) / size)
    change = np.sqrt((d * d).sum(axis=1) / (size - 1))
    hf = np.where(rms > config.snore_rms_floor, change / np.where(rms > 0, rms, 1), 0.0)
    zcr = ((d[:, 1:] >= 0) != (d[:, :-1] >= 0)).sum(axis=1) / float(size - 2)
    return seconds, rms, hf, zcr, (hf > config.snore_ratio) & (zcr > config.snore_crossings) & (rms > config.snore_rms)


def _opened(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Chunk]:
    for batch in batches:
        for rec, number, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            first, second = rows.values.field(0), rows.values.field(1)
            if pa.types.is_list(second.type):  # stretches of samples, each from a number on
                starts, sizes = np.asarray(first), np.diff(np.asarray(second.offsets))
                order = np.argsort(starts, kind="stable")
                ends = np.cumsum(sizes)
                j = np.arange(sizes.sum()) + np.repeat(starts - (ends - sizes), sizes)
                flow = np.asarray(second.flatten())
                order = np.concatenate([np.arange(ends[k] - sizes[k], ends[k]) for k in order])
            else:
                j, flow = np.asarray(first), np.asarray(second)
                order = np.argsort(j)
            chunk = _Chunk(rec, number, j[order], flow[order], number * size, (number + 1) * size)
            if chunk.mine.stop > chunk.mine.start:
                yield chunk


def _feature_rows(rate: int, size: int, config: Config):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _opened(batches, size):
            made, own = _frames(chunk, rate, config), chunk.mine
            columns = [np.full(own.stop - own.start, chunk.rec), chunk.j[own], chunk.flow[own].astype(float), made.env_sum[own].astype(float), made.env_n[own], made.env[own], made.baseline[own], made.smooth[own], _turns(chunk, made.smooth)[own]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["rec", "j", "flow", "env_sum", "env_n", "env", "baseline", "smooth", "turn"])

    return run


def _found_rows(rate: int, size: int, config: Config, cells: Sequence[Cell]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _opened(batches, size):
            out: list[tuple] = []

            def add(kind: str, cell: int, found: Sequence[np.ndarray], number: int = chunk.number, rec: int = chunk.rec, out: list = out) -> None:
                for start, end, stop, edge in zip(*(x.tolist() for x in found)):
                    out.append((rec, kind, cell, number, start, end if end >= 0 else None, stop, edge))

            everything = np.ones(len(chunk.j), np.bool_)
            if not np.isfinite(chunk.flow[chunk.mine]).all():
                out.append((chunk.rec, "broken", 0, chunk.number, chunk.low, None, None, False))
            with np.errstate(invalid="ignore", divide="ignore"):
                made = _frames(chunk, rate, config)
                ratio, valid = made.env / made.baseline, made.baseline >= config.noise_floor
                for apnea in dict.fromkeys(a for a, _ in cells):
                    flag = (made.env < made.baseline * apnea) & (made.baseline > config.noise_floor)
                    found = _fragments(chunk.j, everything, flag, chunk.low, chunk.high)
                    for cell in (c for c, x in enumerate(cells) if x[0] == apnea):
                        add("apnea", cell, found)
                for cell, (apnea, drop) in enumerate(cells):
                    add("hypopnea", cell, _fragments(chunk.j, valid, (ratio <= 1 - drop) & (ratio > apnea), chunk.low, chunk.high))
            own_valid = chunk.j[chunk.mine][valid[chunk.mine]]
            if len(own_valid):
                out.append((chunk.rec, "valid", 0, chunk.number, int(own_valid[0]), None, None, False))
            turn = _turns(chunk, made.smooth)[chunk.mine]
            for kind, way in (("peak", 1), ("trough", -1)):
                out += [(chunk.rec, kind, 0, chunk.number, j, None, None, False) for j in chunk.j[chunk.mine][turn == way].tolist()]
            seconds, *_, snoring = _snoring(chunk, rate, config)
            add("snore", 0, _fragments(seconds, np.ones(len(seconds), np.bool_), snoring, chunk.low // rate, chunk.high // rate))
            types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], [x.split()[0] for x in FOUND.split(", ")])

    return run


def _snore_rows(rate: int, size: int, config: Config):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _opened(batches, size):
            seconds, *values = _snoring(chunk, rate, config)
            own = seconds < chunk.high // rate
            yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), chunk.rec)), *[pa.array(x[own]) for x in (seconds, *values)]], ["rec", "w", "rms", "hf_ratio", "zcr", "snoring"])

    return run


def flow_chunks(flow: DataFrame, rate: int, config: Config = DEFAULT) -> DataFrame:
    """(rec, _chunk, rows): the samples of every chunk and those that its frames reach, in one exchange.

    ``flow`` has a row per sample (rec, j, flow), or one per stretch of samples (rec, first,
    samples), as the source of recordings gives them; stretches are cut and sent whole.
    """
    ship_library(flow.sparkSession)
    before, size = config.baseline_half_sec * rate + rate // 2, config.chunk_sec * rate
    if "samples" in flow.columns:
        after = before + rate
        own = flow.select(F.col("rec").cast("long").alias("rec"), F.col("first").cast("long").alias("first"), "samples").where(F.size("samples") > 0)
        end = F.col("first") + F.size("samples")
        targets = F.sequence(F.greatest(F.lit(0).cast("long"), F.expr(f"(first - {after}) div {size}")), F.expr(f"(first + size(samples) - 1 + {before}) div {size}"))
        own = own.withColumn("_chunk", F.explode(targets))
        low, high = F.greatest("first", F.col("_chunk") * size - before), F.least(end, (F.col("_chunk") + 1) * size + after)
        part = F.slice("samples", (low - F.col("first") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
        return own.select("rec", "_chunk", F.struct(low.alias("first"), part.alias("samples")).alias("_part")).groupBy("rec", "_chunk").agg(F.collect_list("_part").alias("rows"))
    own = chunked(flow.select(F.col("rec").cast("long").alias("rec"), F.col("j").cast("long").alias("j"), "flow"), before, before + rate, "rec", "j", size)
    return own.groupBy("rec", "_chunk").agg(F.collect_list(F.struct("j", "flow")).alias("rows"))


def features(flow: DataFrame, rate: int, config: Config = DEFAULT) -> DataFrame:
    """(rec, j, flow, env_sum, env_n, env, baseline, smooth, turn) of every sample."""
    return flow_chunks(flow, rate, config).mapInArrow(_feature_rows(rate, config.chunk_sec * rate, config), FEATURES)


def snore_windows(flow: DataFrame, rate: int, config: Config = DEFAULT) -> DataFrame:
    """(rec, w, rms, hf_ratio, zcr, snoring) of complete windows of 2 s every second; w is the window's second."""
    return flow_chunks(flow, rate, config).mapInArrow(_snore_rows(rate, config.chunk_sec * rate, config), "rec long, w long, rms double, hf_ratio double, zcr double, snoring boolean")


def scan(flow: DataFrame, rate: int, config: Config = DEFAULT, cells: Sequence[Cell] | None = None) -> DataFrame:
    """(rec, kind, cell, start, end): all that one pass over the flow finds, stored.

    Kinds are the runs ``apnea``, ``hypopnea`` (of each cell) and ``snore`` (in seconds), put
    together across chunks, those that reach the end dropped; the points ``peak`` and ``trough``;
    and ``broken`` for chunks with samples that are no numbers. The default cell is the config's.
    """
    cells = list(cells) if cells is not None else [(config.apnea_remaining, config.hypopnea_drop)]
    # A few rows a chunk, which every detector reads.
    found = stored(flow_chunks(flow, rate, config).mapInArrow(_found_rows(rate, config.chunk_sec * rate, config, cells), FOUND))
    # Where a hypopnea's chunk ends below the noise floor, it goes on to the next sample above it.
    firsts = found.where("kind = 'valid'").select("rec", F.lit("hypopnea").alias("kind"), "chunk", F.col("start").alias("next"))
    runs = stitched(found.where("edge is not null and kind in ('apnea', 'hypopnea', 'snore')"), firsts, ["rec", "kind", "cell"])
    others = found.where("kind in ('peak', 'trough', 'broken')")
    columns = ["rec", "kind", "cell", "start", "end"]
    return stored(runs.where("end is not null").select(columns).unionByName(others.select(columns)))


def flow_runs(found: DataFrame, kind: str) -> DataFrame:
    """(rec, cell, start, end) of the runs of a kind."""
    return found.where(F.col("kind") == kind).select("rec", "cell", "start", "end")


def points(found: DataFrame, kind: str) -> DataFrame:
    return found.where(F.col("kind") == kind).select("rec", F.col("start").alias("j"))
