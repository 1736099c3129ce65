"""European Data Format recordings: header, sample and annotation parsing, a reader over any store, a writer's bytes.

Recordings are ``.edf`` files, and in ``.mmrx`` archives the largest member that ends in
``.edf`` and does not have ``Events`` in its path. ``edf_source`` has the registered source.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The widths of the header's per-signal fields, in order.
_WIDTHS = (16, 80, 8, 8, 8, 8, 8, 80, 8, 32)
ANNOTATIONS = "EDF Annotations"
SIGNAL_SCHEMA = "path string, signal int, label string, unit string, sample_rate double, start_time timestamp_ntz, duration_sec double, samples array<double>"


@dataclass
class Header:
    start: str
    header_bytes: int
    records: int
    record_sec: float
    labels: list[str]
    units: list[str]
    physical: list[tuple[float, float]]
    digital: list[tuple[float, float]]
    per_record: list[int]
    kind: str = ""

    @property
    def discontinuous(self) -> bool:
        return self.kind.startswith("EDF+D")

    @property
    def seconds(self) -> float:
        return self.records * self.record_sec

    def rate(self, signal: int) -> float:
        return self.per_record[signal] / self.record_sec if self.record_sec else 0.0


def _number(text: str, default: float) -> float:
    try:
        return float(text)
    except ValueError:
        return default


def start_time(date: str, time: str) -> str:
    """ISO time of ``dd.mm.yy`` and ``hh.mm.ss``; years from 85 are 19yy; a bad date is 2000-01-01."""
    part = lambda text, i, default: int(_number((text.split(".") + ["", "", ""])[i], default))
    day, month, year = part(date, 0, 1), part(date, 1, 1), part(date, 2, 0)
    hour, minute, second = (part(time, i, 0) for i in range(3))
    try:
        return str(np.datetime64(f"{year + (1900 if year >= 85 else 2000):04d}-{month:02d}-{day:02d}T{hour:02d}:{minute:02d}:{second:02d}"))
    except ValueError:
        return "2000-01-01T00:00:00"


def parse_header(data: bytes) -> Header:
    """Errors for a bad header size, record count (also -1), record duration or signal count."""
    text = lambda at, n: data[at : at + n].decode("ascii", "replace").strip()
    if len(data) < 256:
        raise ValueError("shorter than an EDF header")
    records, n = int(text(236, 8)), int(text(252, 4))
    if records < 0:
        raise ValueError("the number of records is not known")
    starts = 256 + n * np.concatenate(([0], np.cumsum(_WIDTHS)))
    field = lambda k: [text(int(starts[k]) + i * _WIDTHS[k], _WIDTHS[k]) for i in range(n)]
    pair = lambda k, low, high: [(_number(a, low), _number(b, high)) for a, b in zip(field(k), field(k + 1))]
    return Header(
        start_time(text(168, 8), text(176, 8)), int(text(184, 8)), records, float(text(244, 8)), field(0), field(2),
        pair(3, 0.0, 1.0), pair(5, -32768.0, 32767.0), [int(_number(x, 0)) for x in field(8)], text(192, 44),
    )


def header_size(start: bytes) -> int:
    """Bytes of the whole header, from its first 256."""
    if len(start) < 256:
        raise ValueError("shorter than an EDF header")
    return 256 * (int(start[252:256].decode("ascii", "replace")) + 1)


def to_physical(digital: np.ndarray, header: Header, signal: int) -> np.ndarray:
    (low, high), (dlow, dhigh) = header.physical[signal], header.digital[signal]
    with np.errstate(divide="ignore", invalid="ignore"):
        return low + (digital.astype(float) - dlow) * (high - low) / (dhigh - dlow)


def deinterleaved(records: bytes, header: Header) -> list[np.ndarray]:
    """Digital samples of each signal, of whole records and as far as a last one goes."""
    width = sum(header.per_record)
    raw = np.frombuffer(records, "<i2", count=len(records) // 2)
    whole = len(raw) // width if width else 0
    table, rest = raw[: whole * width].reshape(whole, width), raw[whole * width :]
    starts = np.concatenate(([0], np.cumsum(header.per_record)))
    return [np.concatenate((table[:, a:b].ravel(), rest[a:b])) for a, b in zip(starts[:-1], starts[1:])]


def record_onset(annotations: bytes) -> float | None:
    """Seconds at which a record begins: the first time-stamped list of its annotations; None without one."""
    first = annotations.split(b"\x14", 1)
    if len(first) < 2:
        return None
    try:
        return float(first[0].split(b"\x15")[0].lstrip(b"\x00"))
    except ValueError:
        return None


def record_onsets(records: bytes, header: Header) -> list[float]:
    """The onset of every whole record, from its annotation signal; an error if one has none."""
    width = sum(header.per_record)
    signals = [i for i, label in enumerate(header.labels) if label == ANNOTATIONS]
    if not signals or not width:
        raise ValueError("no annotations that say when a record begins")
    at = 2 * sum(header.per_record[: signals[0]])
    size = 2 * header.per_record[signals[0]]
    starts = range(0, len(records) - 2 * width + 1, 2 * width)
    onsets = [record_onset(records[s + at : s + at + size]) for s in starts]
    if None in onsets:
        raise ValueError("fewer annotations than records")
    return onsets


def placed(samples: np.ndarray, onsets: list[float], per_record: int, record_sec: float, fill: float = 0.0) -> np.ndarray:
    """The samples of records at their onsets, ``fill`` between them.

    The signal is as long as the last record's end; a record that would go beyond it is left
    out, and one that overlaps an earlier one takes its place.
    """
    rate = per_record / record_sec
    n = len(samples) // per_record if per_record else 0
    if len(onsets) < n:
        raise ValueError("fewer onsets than records")
    out = np.full(int(np.rint((onsets[-1] + record_sec) * rate)) if onsets else 0, fill, samples.dtype)
    for onset, record in zip(onsets, samples[: n * per_record].reshape(n, per_record) if n else ()):
        at = int(np.rint(onset * rate))
        if at >= 0 and at + per_record <= len(out):
            out[at : at + per_record] = record
    return out


def parse_signals(data: bytes, header: Header, wanted: set[str] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(signal, physical samples); samples stop where the data do, the duration stays the header's.

    The records of a discontinuous recording are at their onsets, with zeros between them.
    """
    width = sum(header.per_record)
    records = data[header.header_bytes :][: 2 * header.records * width]
    onsets = record_onsets(records, header) if header.discontinuous else None
    for i, digital in enumerate(deinterleaved(records, header)):
        if wanted is None or header.labels[i] in wanted:
            samples = to_physical(digital, header, i)
            yield i, samples if onsets is None or header.labels[i] == ANNOTATIONS else placed(samples, onsets, header.per_record[i], header.record_sec)


def open_main_member(file):
    """The archive's largest recording, the first of equal ones, as a file; ``file`` is an open archive."""
    archive = zipfile.ZipFile(file)
    own = [x for x in archive.infolist() if x.filename.endswith(".edf") and "Events" not in x.filename]
    if not own:
        raise ValueError("no recording in the archive")
    return archive.open(max(own, key=lambda x: x.file_size))


def main_member(data) -> bytes:
    """The bytes of an archive's main recording, from its bytes or an open file."""
    with open_main_member(io.BytesIO(data) if isinstance(data, bytes) else data) as member:
        return member.read()


def write_edf(
    signals: list[tuple[str, str, int, np.ndarray]], record_sec: float = 1.0, start: str = "01.01.24", time: str = "22.00.00", low: float = -3276.8, high: float = 3276.7,
    onsets: list[float] | None = None,
) -> bytes:
    """Bytes of a recording: (label, unit, samples per record, values) per signal; with ``onsets`` a discontinuous one."""
    records = max(-(-len(x) // n) for _, _, n, x in signals)
    digital = []
    for _, _, n, values in signals:
        values = np.pad(np.asarray(values, float), (0, records * n - len(values)))
        digital.append(np.clip(np.round((values - low) / (high - low) * 65535 - 32768), -32768, 32767).astype("<i2").reshape(records, n))
    meta = [(label, unit, n, (low, high), (-32768, 32767)) for label, unit, n, _ in signals]
    if onsets is not None:
        marks = [b"" if x is None else f"+{x:g}".encode() + b"\x14\x14\x00" for x in onsets]
        digital.append(np.stack([np.frombuffer(m.ljust(32, b"\x00"), "<i2") for m in marks]))
        meta.append((ANNOTATIONS, "", 16, (-1, 1), (-32768, 32767)))
    return encode_header(meta, records, record_sec, start, time, "EDF+C" if onsets is None else "EDF+D") + np.concatenate(digital, axis=1).tobytes()


def encode_header(signals: list[tuple], records: int, record_sec: float, start: str, time: str, kind: str = "EDF+C") -> bytes:
    """Header bytes; a signal is (label, unit, samples per record, physical range, digital range)."""
    pad = lambda x, n: (f"{x:.8g}" if isinstance(x, float) else str(x)).ljust(n)[:n].encode("ascii", "replace")
    blank = [""] * len(signals)
    fields = [
        [x[0] for x in signals], blank, [x[1] for x in signals], [float(x[3][0]) for x in signals], [float(x[3][1]) for x in signals],
        [int(x[4][0]) for x in signals], [int(x[4][1]) for x in signals], blank, [x[2] for x in signals], blank,
    ]
    size = 256 * (len(signals) + 1)
    head = pad(0, 8) + pad("", 80) + pad("", 80) + pad(start, 8) + pad(time, 8) + pad(size, 8) + pad(kind, 44) + pad(records, 8) + pad(record_sec, 8) + pad(len(signals), 4)
    return head + b"".join(pad(v, w) for w, values in zip(_WIDTHS, fields) for v in values)


def _rows(paths_and_data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in paths_and_data:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out: dict[str, list] = {x: [] for x in ("path", "signal", "label", "unit", "sample_rate", "start_time", "duration_sec", "samples", "error")}
            try:
                data = data if path.endswith(".edf") else main_member(data)
                header = parse_header(data)
                for i, samples in parse_signals(data, header):
                    row = (path, i, header.labels[i], header.units[i], header.rate(i), np.datetime64(header.start).astype("datetime64[us]").item(), header.seconds, samples.tolist(), None)
                    for column, value in zip(out.values(), row):
                        column.append(value)
            except (ValueError, zipfile.BadZipFile) as e:
                for column, value in zip(out.values(), (path, None, None, None, None, None, None, None, str(e))):
                    column.append(value)
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.timestamp("us"), pa.float64(), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types)], list(out))


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    """One row per signal of every recording below the path; a file that fails gives one row with ``error``.

    Files are found and read by Spark, so the path may be in any store it can read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("path").endswith(".mmrx") | (F.col("path").endswith(".edf") & ~F.col("path").endswith("_Events.edf")))
    return files.select("path", "content").mapInArrow(_rows, f"{SIGNAL_SCHEMA}, error string")


def bound_channel(signals: DataFrame, prefix: str) -> DataFrame:
    """Per recording the first signal whose label begins with the prefix."""
    own = signals.where(F.col("label").startswith(prefix))
    return own.groupBy("path").agg(F.min_by(F.struct("label", "sample_rate", "samples"), "signal").alias("_s")).select("path", "_s.*")


def long_form(signals: DataFrame, recording: Column, value: str) -> DataFrame:
    """(rec, i, value) of packed signals."""
    return signals.select(recording.alias("rec"), F.posexplode("samples").alias("i", value)).withColumn("i", F.col("i").cast("long"))
