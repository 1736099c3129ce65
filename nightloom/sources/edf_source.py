"""``spark.read.format("edf")`` and ``df.write.format("edf")``: recordings as a data source.

Files are listed on the driver, which reads none of them. A large recording is read by several
tasks, a chunk of records at a time; small ones share a task. With ``content`` "header" only
headers are read, a row per signal. ``labels`` (a JSON list), and filters on the label where
Spark pushes them down, leave out signals. Paths are local or of any store that Arrow can open.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from nightloom.shipping import ship_library
from nightloom.sources import edf

SAMPLES = (
    "path string, signal int, label string, unit string, sample_rate double, start_time timestamp_ntz, duration_sec double,"
    " chunk long, first long, samples array<double>, error string"
)
HEADERS = (
    "path string, signal int, label string, unit string, sample_rate double, start_time timestamp_ntz, duration_sec double,"
    " samples_per_record int, records long, record_sec double, discontinuous boolean, error string"
)
#: Columns that a writer needs.
WRITTEN = ("recording", "signal", "label", "unit", "sample_rate", "chunk", "samples")
#: Files are read in parts of about so many bytes.
PART_BYTES = 64 << 20


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class _Part(InputPartition):
    files: list[str]
    part: int = 0
    parts: int = 1


def _is_recording(path: str) -> bool:
    return path.endswith(".mmrx") or (path.endswith(".edf") and not path.endswith("_Events.edf"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.headers = options["path"], options.get("content", "samples") == "header"
        self.chunk_sec = float(options.get("chunk_sec", 600))
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.labels = set(json.loads(options["labels"])) if "labels" in options else None
        self.names = schema.names

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is not None and f.attribute == ("label",):
                self.labels = set(values) if self.labels is None else self.labels & set(values)
            yield f  # rows of unreadable files have no label, so Spark judges again

    def partitions(self) -> list[InputPartition]:
        store, root = open_store(self.path)
        if store.get_file_info(root).type == pafs.FileType.Directory:
            found = [x for x in store.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and _is_recording(x.path)]
        else:
            found = [store.get_file_info(root)]
        out, held, size = [], [], 0
        for x in sorted(found, key=lambda x: x.path):
            if x.size > PART_BYTES and x.path.endswith(".edf") and not self.headers:
                n = -(-x.size // PART_BYTES)
                out += [_Part([x.path], k, n) for k in range(n)]
                continue
            if held and size + x.size > PART_BYTES:
                out.append(_Part(held))
                held, size = [], 0
            held.append(x.path)
            size += 4096 if self.headers else x.size
        return [*out, _Part(held)] if held or not out else out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        for path in partition.files:
            try:
                with store.open_input_file(path) as file:
                    rows = self._headers(file, path) if self.headers else self._samples(file, path, partition)
                    for row in rows:
                        yield self._batch(row)
            except (ValueError, OSError, zipfile.BadZipFile) as e:
                if self.strict:
                    raise
                if partition.part == 0:
                    yield self._batch({"path": [path], "error": [f"{type(e).__name__}: {e}"]})

    def _batch(self, columns: dict[str, list]) -> pa.RecordBatch:
        types = {
            "signal": pa.int32(), "sample_rate": pa.float64(), "start_time": pa.timestamp("us"), "duration_sec": pa.float64(), "chunk": pa.int64(), "first": pa.int64(),
            "samples": pa.list_(pa.float64()), "samples_per_record": pa.int32(), "records": pa.int64(), "record_sec": pa.float64(), "discontinuous": pa.bool_(),
        }
        n = len(columns["path"])
        return pa.RecordBatch.from_arrays([pa.array(columns.get(x, [None] * n), types.get(x, pa.string())) for x in self.names], self.names)

    @staticmethod
    def _described(header: edf.Header, path: str, signals: list[int], seconds: float) -> dict[str, list]:
        start, n = np.datetime64(header.start).astype("datetime64[us]").item(), len(signals)
        return {
            "path": [path] * n, "signal": signals, "label": [header.labels[i] for i in signals], "unit": [header.units[i] for i in signals],
            "sample_rate": [header.rate(i) for i in signals], "start_time": [start] * n, "duration_sec": [seconds] * n,
        }

    def _wanted(self, header: edf.Header) -> list[int]:
        return [i for i, x in enumerate(header.labels) if self.labels is None or x in self.labels]

    @staticmethod
    def _opened(file, path: str):
        """The recording's bytes from the start, as a file; an archive's main member is unpacked."""
        if path.endswith(".edf"):
            return file
        import io

        return io.BytesIO(edf.main_member(file))

    def _header(self, file) -> edf.Header:
        start = file.read(256)
        return edf.parse_header(start + file.read(edf.header_size(start) - 256))

    def _headers(self, file, path: str) -> Iterator[dict[str, list]]:
        if not path.endswith(".edf"):
            with edf.open_main_member(file) as member:
                header = self._header(member)
        else:
            header = self._header(file)
        own, n = self._wanted(header), len(self._wanted(header))
        yield self._described(header, path, own, header.seconds) | {
            "samples_per_record": [header.per_record[i] for i in own], "records": [header.records] * n, "record_sec": [header.record_sec] * n, "discontinuous": [header.discontinuous] * n,
        }

    def _samples(self, file, path: str, partition: _Part) -> Iterator[dict[str, list]]:
        file = self._opened(file, path)
        header = self._header(file)
        signals = [i for i in self._wanted(header) if header.labels[i] != edf.ANNOTATIONS]
        width = 2 * sum(header.per_record)
        step = max(1, round(self.chunk_sec / header.record_sec)) if header.record_sec > 0 else max(1, header.records)
        if header.discontinuous:  # where records lie is known from all of them
            if partition.part == 0:
                file.seek(header.header_bytes)
                records = file.read(header.records * width)
                onsets = edf.record_onsets(records, header)
                seconds = max(onsets[-1] + header.record_sec, 0.0) if onsets else 0.0
                digital = edf.deinterleaved(records, header)
                whole = {i: edf.placed(edf.to_physical(digital[i], header, i), onsets, header.per_record[i], header.record_sec) for i in signals}
                sizes = {i: step * header.per_record[i] for i in signals}
                for k in range(max((-(-len(whole[i]) // sizes[i]) for i in signals if sizes[i]), default=0)):
                    yield self._chunk(header, path, signals, k, step, seconds, {i: whole[i][k * sizes[i] : (k + 1) * sizes[i]] for i in signals})
            return
        chunks = -(-header.records // step)
        for k in range(chunks * partition.part // partition.parts, chunks * (partition.part + 1) // partition.parts):
            file.seek(header.header_bytes + k * step * width)
            data = file.read(min(step, header.records - k * step) * width)
            digital = edf.deinterleaved(data, header)
            yield self._chunk(header, path, signals, k, step, header.seconds, {i: edf.to_physical(digital[i], header, i) for i in signals})

    def _chunk(self, header: edf.Header, path: str, signals: list[int], k: int, step: int, seconds: float, samples: dict[int, np.ndarray]) -> dict[str, list]:
        own = [i for i in signals if len(samples[i])]
        return self._described(header, path, own, seconds) | {
            "chunk": [k] * len(own), "first": [k * step * header.per_record[i] for i in own], "samples": [samples[i] for i in own],
        }


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Each task writes its recordings under a name of its own; the commit gives them their names."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        missing = [x for x in WRITTEN if x not in schema.names]
        if missing:
            raise ValueError(f"columns are missing: {', '.join(missing)}")
        self.path, self.overwrite = options["path"], overwrite
        self.record_sec = float(options.get("record_sec", 1))
        self.low, self.high = float(options.get("physical_min", -3276.8)), float(options.get("physical_max", 3276.7))
        self.start, self.time = options.get("start_date", "01.01.24"), options.get("start_clock", "22.00.00")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Written:
        store, root = open_store(self.path)
        store.create_dir(f"{root}/{self.staging}", recursive=True)
        files, current, signals = [], None, {}

        def flush() -> None:
            if current is None:
                return
            own = [(label, unit, max(1, round(rate * self.record_sec)), np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])])) for _, (label, unit, rate, parts) in sorted(signals.items())]
            data = edf.write_edf(own, self.record_sec, self.start, self.time, self.low, self.high)
            name = f"{root}/{self.staging}/{uuid.uuid4().hex}"
            with store.open_output_stream(name) as out:
                out.write(data)
            files.append((name, current))

        for row in rows:
            if row["recording"] != current:
                flush()
                current, signals = row["recording"], {}
            parts = signals.setdefault(row["signal"], (row["label"], row["unit"] or "", row["sample_rate"], []))[3]
            parts.append((row["chunk"] or 0, np.asarray(row["samples"], float)))
        flush()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = open_store(self.path)
        files = [x for m in messages if m for x in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a recording's rows came from several tasks, or apart: deal and sort them by recording")
        if self.overwrite:
            for x in store.get_file_info(pafs.FileSelector(root, recursive=True)):
                if x.is_file and x.path.endswith(".edf"):
                    store.delete_file(x.path)
        for temporary, name in files:
            target = f"{root}/{name}.edf"
            store.create_dir(target.rpartition("/")[0], recursive=True)
            store.move(temporary, target)
        self._clear(store, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*open_store(self.path))

    def _clear(self, store: pafs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class EdfSource(DataSource):
    """Options: path; content (samples or header); chunk_sec; labels; mode (PERMISSIVE or FAILFAST)."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return HEADERS if self.options.get("content", "samples") == "header" else SAMPLES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``edf`` a format of the session, to which filters on the label are pushed down."""
    ship_library(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdfSource)


def write_recordings(signals: DataFrame, path: str, **options) -> None:
    """One ``recording.edf`` per recording of (recording, signal, label, unit, sample_rate, chunk, samples)."""
    register(signals.sparkSession)
    own = signals.select(*WRITTEN).repartition("recording").sortWithinPartitions("recording", "signal", "chunk")
    own.write.format("edf").options(**options).mode("append").save(path)


def samples_of(chunks: DataFrame, value: str) -> DataFrame:
    """(path, i, value): a row per sample of the chunks of a signal."""
    return chunks.select("path", "first", F.posexplode("samples").alias("_k", value)).select("path", (F.col("first") + F.col("_k")).alias("i"), value)


def preview(chunks: DataFrame, k: int = 10) -> DataFrame:
    """(path, signal, label, n, least, greatest, mean, first) per signal; ``first`` has up to ``k`` values from its first chunk."""
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return chunks.where("samples is not null").groupBy("path", "signal", "label").agg(
        F.sum(F.size("samples")).alias("n"), F.min(F.array_min("samples")).alias("least"), F.max(F.array_max("samples")).alias("greatest"),
        (F.sum(total) / F.sum(F.size("samples"))).alias("mean"), F.min_by(F.slice("samples", 1, k), "first").alias("first"),
    )
