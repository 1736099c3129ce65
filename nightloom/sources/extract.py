"""Recordings out of archives, one folder per patient, so that a second run has nothing to do."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.shipping import ship_library
from nightloom.sources import edf
from nightloom.sources.edf_source import open_store
from nightloom.storage import stored

STATUS = "patient string, status string, note string, bytes long"
RECORDING, ARCHIVE = "recording.edf", "recording.mmrx"


def is_readable(data: bytes) -> bool:
    """Whether the bytes are a continuous recording of some length."""
    try:
        header = edf.parse_header(data)
    except ValueError:
        return False
    return not header.discontinuous and header.seconds > 0 and len(data) > header.header_bytes


def made_continuous(data: bytes) -> bytes:
    """A discontinuous recording with its records at their onsets and physical zeros between them.

    Ranges, labels and the start stay; the annotations go, as they have done their part.
    """
    header = edf.parse_header(data)
    records = data[header.header_bytes :][: 2 * header.records * sum(header.per_record)]
    onsets = edf.record_onsets(records, header)
    if not onsets or header.record_sec <= 0:
        raise ValueError("no records")
    n = max(1, int(np.ceil((onsets[-1] + header.record_sec) / header.record_sec - 1e-9)))
    meta, columns = [], []
    for i, digital in enumerate(edf.deinterleaved(records, header)):
        if header.labels[i] == edf.ANNOTATIONS:
            continue
        (low, high), (dlow, dhigh) = header.physical[i], header.digital[i]
        zero = int(np.clip(np.rint(dlow - low * (dhigh - dlow) / (high - low)), -32768, 32767)) if high != low else 0
        own = edf.placed(digital, onsets, header.per_record[i], header.record_sec, zero)
        own = np.pad(own, (0, max(0, n * header.per_record[i] - len(own))), constant_values=zero)[: n * header.per_record[i]]
        columns.append(own.astype("<i2").reshape(n, header.per_record[i]))
        meta.append((header.labels[i], header.units[i], header.per_record[i], (low, high), (dlow, dhigh)))
    date, clock = (data[a:b].decode("ascii", "replace") for a, b in ((168, 176), (176, 184)))
    return edf.encode_header(meta, n, header.record_sec, date, clock) + np.concatenate(columns, axis=1).tobytes()


def chosen(archive) -> tuple[bytes, str]:
    """The recording to take from an archive, and why: the largest readable one, else the largest that can be made continuous."""
    with zipfile.ZipFile(archive) as opened:
        members = [x for x in opened.infolist() if x.filename.endswith(".edf") and not x.filename.endswith("_Events.edf")]
        if not members:
            raise ValueError("no recording in the archive")
        members.sort(key=lambda x: -x.file_size)
        readable = 0
        best: tuple[bytes, str] | None = None
        for member in members:
            data = opened.read(member)
            if is_readable(data):
                readable += 1
                best = best or (data, member.filename)
        if best:
            left = len(members) - readable
            return best[0], f"took {best[1]}" + (f", {left} unreadable" if left else "")
        for member in members:
            try:
                data = made_continuous(opened.read(member))
            except ValueError:
                continue
            if is_readable(data):
                return data, f"took {member.filename}, made continuous"
    raise ValueError(f"none of {len(members)} recordings is readable")


def _extract(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(root)
        for batch in batches:
            rows = []
            for patient, folder, recording, archive in zip(*(batch[x].to_pylist() for x in ("patient", "folder", "recording", "archive"))):
                if recording:
                    rows.append((patient, "skipped", "there already", None))
                    continue
                if not archive:
                    rows.append((patient, "failed", "neither recording nor archive", None))
                    continue
                try:
                    inside = open_store(archive)[1]
                    with store.open_input_file(inside) as file:
                        data, note = chosen(file)
                    # Written under a name of its own and renamed when whole, so that a lost task leaves no half.
                    target = open_store(folder)[1]
                    staged = f"{target}/_staging-{uuid.uuid4().hex}"
                    with store.open_output_stream(staged) as out:
                        out.write(data)
                    store.move(staged, f"{target}/{RECORDING}")
                    rows.append((patient, "ok", note, len(data)))
                except (ValueError, OSError, zipfile.BadZipFile, RuntimeError) as e:
                    rows.append((patient, "failed", f"{type(e).__name__}: {e}", None))
            types = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["patient", "status", "note", "bytes"])

    return run


def patients(spark: SparkSession, raw: str) -> DataFrame:
    """(patient, folder, recording, archive) of the folders ``patient_N`` that hold files; names only, nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(raw).select("path")
    own = files.select("path", F.regexp_extract("path", r"/(patient_[0-9]+)/[^/]+$", 1).alias("patient"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    own = own.where("patient <> ''").withColumn("folder", F.regexp_replace("path", r"/[^/]+$", ""))
    named = lambda name: F.max(F.when(F.col("name") == name, F.col("path")))
    return own.groupBy("patient", "folder").agg(named(RECORDING).alias("recording"), named(ARCHIVE).alias("archive"))


def extract_recordings(spark: SparkSession, raw: str, manifest: str) -> DataFrame:
    """The rows (patient, status, note, bytes) that this run adds to the manifest; ok, skipped or failed.

    Patients whose recording is there and who are in the manifest as ok or skipped are left out,
    so a second run adds nothing; failed ones are tried again. Every task works on one archive
    at a time.
    """
    ship_library(spark)
    own = patients(spark, raw)
    try:
        known = spark.read.parquet(manifest).where("status in ('ok', 'skipped')").select("patient").distinct()
        done = own.where("recording is not null").join(known, "patient", "left_semi").select("patient")
        own = own.join(done, "patient", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    # A patient per task at most: archives are large and few.
    found = stored(own.repartition("patient").mapInArrow(_extract(raw), STATUS))
    if not found.isEmpty():
        found.write.mode("append").parquet(manifest)
    return found
