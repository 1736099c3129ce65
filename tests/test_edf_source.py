"""The registered source, channel rules, annotation onsets and extraction."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.sources import binding, edf, edf_source, events, extract


def _bytes(seconds=25, seed=1, onsets=None, record_sec=1.0):
    rng = np.random.default_rng(seed)
    return edf.write_edf([("Resp nasal", "%", 10, np.round(rng.normal(0, 50, 10 * seconds), 1)), ("SaO2 x", "%", 1, 90 + np.arange(seconds) % 8)], record_sec, onsets=onsets)


def _zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, data in members.items():
            out.writestr(name, data)


@pytest.fixture
def source(spark, monkeypatch):
    edf_source.register(spark)
    return lambda path, **options: spark.read.format("edf").options(**options).load(str(path))


def test_samples_come_in_chunks(spark, source, tmp_path):
    (tmp_path / "patient_001").mkdir()
    (tmp_path / "patient_001/recording.edf").write_bytes(_bytes())
    (tmp_path / "patient_001/x_Events.edf").write_bytes(b"none")
    _zip(tmp_path / "night.mmrx", {"a/small.edf": _bytes(3), "a/large.edf": _bytes(25, 2), "a/Events.edf": _bytes(90)})
    (tmp_path / "bad.edf").write_bytes(b"short")
    df = source(tmp_path, chunk_sec=10)
    rows = df.where("error is null").collect()
    assert {(r.path.rsplit("/", 1)[1], r.label, r.chunk, r.first, len(r.samples)) for r in rows} == {
        (name, label, k, k * 10 * n, (10, 10, 5)[k] * n) for name in ("recording.edf", "night.mmrx") for label, n in (("Resp nasal", 10), ("SaO2 x", 1)) for k in range(3)
    }
    one = np.concatenate([r.samples for r in sorted((r for r in rows if r.path.endswith(".edf") and r.signal == 0), key=lambda r: r.chunk)])
    assert np.allclose(one, np.round(np.random.default_rng(1).normal(0, 50, 250), 1), atol=1e-6)
    assert [r.path.rsplit("/", 1)[1] for r in df.where("error is not null").collect()] == ["bad.edf"]
    flow = edf_source.samples_of(df.where("label = 'SaO2 x' and path like '%recording.edf'"), "v").collect()
    assert sorted((r.i, round(r.v)) for r in flow) == [(i, 90 + i % 8) for i in range(25)]
    with pytest.raises(Exception, match="shorter than an EDF header"):
        source(tmp_path, mode="FAILFAST").count()


def test_signals_are_left_out_by_option_and_by_filter(source, tmp_path):
    (tmp_path / "r.edf").write_bytes(_bytes())
    assert {r.label for r in source(tmp_path, labels='["SaO2 x"]').collect()} == {"SaO2 x"}
    reader = edf_source._Reader({"path": str(tmp_path)}, source(tmp_path).schema)
    list(reader.pushFilters([edf_source.EqualTo(("label",), "Resp nasal")]))
    assert reader.labels == {"Resp nasal"}
    assert source(tmp_path).where("label = 'Resp nasal'").select(F.sum(F.size("samples"))).first()[0] == 250


def test_a_large_recording_is_read_in_parts(source, tmp_path, monkeypatch):
    (tmp_path / "r.edf").write_bytes(_bytes(50))
    monkeypatch.setattr(edf_source, "PART_BYTES", 300)
    reader = edf_source._Reader({"path": str(tmp_path), "chunk_sec": "7"}, source(tmp_path).schema)
    parts = reader.partitions()
    assert len(parts) > 3
    chunks = [(r["signal"], r["chunk"], len(r["samples"])) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(chunks) == [(s, k, n * (7 if k < 7 else 1)) for s, n in ((0, 10), (1, 1)) for k in range(8)]


def test_header_mode_reads_no_samples(source, tmp_path):
    data = _bytes()
    head = edf.header_size(data[:256])
    (tmp_path / "r.edf").write_bytes(data[:head])  # there are none to read
    _zip(tmp_path / "n.mmrx", {"x.edf": _bytes(onsets=[float(2 * i) for i in range(25)])})
    rows = source(tmp_path, content="header").orderBy("path", "signal").collect()
    assert [(r.label, r.sample_rate, r.duration_sec, r.discontinuous) for r in rows] == [
        ("Resp nasal", 10.0, 25.0, True), ("SaO2 x", 1.0, 25.0, True), (edf.ANNOTATIONS, 16.0, 25.0, True), ("Resp nasal", 10.0, 25.0, False), ("SaO2 x", 1.0, 25.0, False),
    ]
    assert str(rows[3].start_time) == "2024-01-01 22:00:00" and rows[3].records == 25 and rows[3].error is None


def test_written_recordings_are_read_again(spark, source, tmp_path):
    rng = np.random.default_rng(3)
    values = {k: np.round(rng.normal(0, 90, 90), 1) for k in range(3)}
    rows = [(f"patient_{k}/recording", 0, "Pulse", "bpm", 3.0, c, x[30 * c : 30 * c + 30].tolist()) for k, x in values.items() for c in range(3)]
    df = spark.createDataFrame(rows, "recording string, signal int, label string, unit string, sample_rate double, chunk long, samples array<double>").repartition(4)
    edf_source.write_recordings(df, str(tmp_path / "out"))
    found = {r.path.rsplit("/", 2)[1]: r.samples for r in source(tmp_path / "out").collect()}
    assert all(np.allclose(found[f"patient_{k}"], x, atol=1e-6) for k, x in values.items())
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    with pytest.raises(Exception, match="several tasks"):
        df.write.format("edf").mode("append").save(str(tmp_path / "apart"))
    with pytest.raises(Exception, match="columns are missing"):
        df.drop("chunk").write.format("edf").mode("append").save(str(tmp_path / "none"))


def _placed(values, onsets, n):
    total = round((onsets[-1] + 1) * n)
    out = [0.0] * total
    for k, onset in enumerate(onsets):
        at = round(onset * n)
        if 0 <= at and at + n <= total:
            out[at : at + n] = values[k * n : (k + 1) * n]
    return out


@pytest.mark.parametrize("onsets", [[0, 1, 2, 3], [0, 1, 5.5, 9], [0, 0.5, 1, 4], [3, 9, 1, 4], [0, 1, 1, 8]])
def test_records_lie_at_their_onsets(source, tmp_path, onsets):
    onsets = [float(x) for x in onsets]
    flow = np.round(np.random.default_rng(2).normal(0, 40, 40), 1)
    data = edf.write_edf([("Resp nasal", "", 10, flow)], onsets=onsets)
    (tmp_path / "r.edf").write_bytes(data)
    rows = source(tmp_path, chunk_sec=3).orderBy("chunk").collect()
    expected = _placed(flow.tolist(), onsets, 10)
    assert np.allclose(np.concatenate([r.samples for r in rows]), expected, atol=1e-6)
    assert {r.duration_sec for r in rows} == {onsets[-1] + 1} and [r.first for r in rows] == [30 * r.chunk for r in rows]
    again = extract.made_continuous(data)
    header = edf.parse_header(again)
    assert extract.is_readable(again) and not extract.is_readable(data) and header.start == edf.parse_header(data).start
    samples = dict(edf.parse_signals(again, header))[0]
    assert np.allclose(samples[: len(expected)], expected, atol=0.051) and not np.round(samples[len(expected) :], 0).any()


def test_a_record_without_an_onset_is_an_error(source, tmp_path):
    (tmp_path / "r.edf").write_bytes(edf.write_edf([("Resp nasal", "", 10, np.ones(40))], onsets=[0.0, None, 2.0, 3.0]))
    assert "fewer annotations than records" in source(tmp_path).first().error
    assert edf.record_onset(b"+12.5\x153\x14text\x14\x00") == 12.5 and edf.record_onset(b"\x00\x00") is None


def _headers(spark, **recordings):
    return spark.createDataFrame([(p, i, x) for p, labels in recordings.items() for i, x in enumerate(labels)], "path string, signal int, label string")


def test_prefix_rules_take_the_first_and_miss_none(spark):
    labels = ["Battery", "Resp nasal 2", "Resp nasal", "SaO2", "Pulse", "Resp thorax", "Position", "Acc x", "Acc y", "Acc z"]
    found = {r.channel: r.signal for r in binding.bind_by_prefix(_headers(spark, a=labels)).collect()}
    assert found == {"flow": 1, "effort": 5, "pulse": 4, "spo2": 3, "position": 6, "acc_x": 7, "acc_y": 8, "acc_z": 9}
    short = _headers(spark, a=labels, b=labels[:9], c=[x.lower() for x in labels])
    with pytest.raises(Exception, match="no signal for channel"):
        binding.bind_by_prefix(short).collect()
    found = binding.bind_by_prefix(short, strict=False).where("signal is null").collect()
    assert {(r.path, r.channel) for r in found if r.path == "b"} == {("b", "acc_z")} and sum(r.path == "c" for r in found) == 8


def test_substring_rules_take_the_last_and_fall_back(spark):
    headers = _headers(spark, a=["FLOW", "Nasal thorax", "SpO2", "Resp Thorax", "sao2 b"], b=["x", "y", "z"], c=["thorax", "thorax 2"])
    found = {(r.path, r.channel): (r.signal, r.by_position) for r in binding.bind_by_substring(headers).collect()}
    assert {k[1]: v for k, v in found.items() if k[0] == "a"} == {"flow": (1, False), "spo2": (4, False), "thorax": (3, False)}
    assert {k[1]: v for k, v in found.items() if k[0] == "b"} == {"flow": (0, True), "spo2": (1, True), "thorax": (2, True)}
    assert {k[1]: v for k, v in found.items() if k[0] == "c"} == {"flow": (0, True), "spo2": (1, True), "thorax": (1, False)}
    with pytest.raises(Exception, match="no signal for channel (spo2|thorax)"):
        binding.bind_by_substring(_headers(spark, a=["flow"])).collect()


def test_bound_samples(source, tmp_path):
    (tmp_path / "r.edf").write_bytes(_bytes())
    bound = binding.bind_by_substring(source(tmp_path, content="header").where("label <> 'SaO2 x'"), [binding.Rule("flow", "nasal", 0)])
    assert [(r.channel, len(r.samples)) for r in binding.bound_samples(source(tmp_path), bound).collect()] == [("flow", 250)]


def test_a_second_extraction_has_nothing_to_do(spark, tmp_path):
    raw, manifest = tmp_path / "raw", str(tmp_path / "manifest")
    for k in range(1, 7):
        (raw / f"patient_00{k}").mkdir(parents=True)
    own = lambda k: raw / f"patient_00{k}"
    _zip(own(1) / "recording.mmrx", {"a/s.edf": _bytes(3), "b/l.edf": _bytes(9), "b/l_Events.edf": _bytes(99), "c.edf": b"broken" * 9999})
    (own(2) / "recording.edf").write_bytes(b"as it is")
    (own(3) / "notes.txt").write_bytes(b"x")
    (own(4) / "recording.mmrx").write_bytes(b"no archive")
    _zip(own(5) / "recording.mmrx", {"d.edf": _bytes(4, onsets=[0.0, 1.0, 5.0, 6.0])})
    _zip(own(6) / "recording.mmrx", {"x_Events.edf": _bytes(4)})
    found = {r.patient: r for r in extract.extract_recordings(spark, str(raw), manifest).collect()}
    assert {k: r.status for k, r in found.items()} == {"patient_001": "ok", "patient_002": "skipped", "patient_003": "failed", "patient_004": "failed", "patient_005": "ok", "patient_006": "failed"}
    assert found["patient_001"].note == "took b/l.edf, 1 unreadable" and found["patient_005"].note.endswith("made continuous")
    assert (own(1) / "recording.edf").read_bytes() == _bytes(9) and edf.parse_header((own(5) / "recording.edf").read_bytes()).seconds == 7
    assert not list(raw.rglob("_staging*"))
    _zip(own(6) / "recording.mmrx", {"x.edf": _bytes(4)})
    again = {r.patient: r.status for r in extract.extract_recordings(spark, str(raw), manifest).collect()}
    assert again == {"patient_003": "failed", "patient_004": "failed", "patient_006": "ok"}
    (own(3) / "notes.txt").unlink()
    (own(4) / "recording.mmrx").unlink()
    assert extract.extract_recordings(spark, str(raw), manifest).count() == 0
    assert spark.read.parquet(manifest).count() == 9
    (own(1) / "recording.edf").unlink()
    assert [r.patient for r in extract.extract_recordings(spark, str(raw), manifest).collect()] == ["patient_001"]
    assert (own(1) / "recording.edf").exists()


def test_preview(source, tmp_path):
    (tmp_path / "r.edf").write_bytes(_bytes())
    rows = {r.label: r for r in edf_source.preview(source(tmp_path, chunk_sec=10)).collect()}
    flow = np.round(np.random.default_rng(1).normal(0, 50, 250), 1)
    assert rows["Resp nasal"].n == 250 and np.allclose((rows["Resp nasal"].least, rows["Resp nasal"].greatest, rows["Resp nasal"].mean), (flow.min(), flow.max(), flow.mean()), atol=1e-6)
    assert np.allclose(rows["Resp nasal"].first, flow[:10], atol=1e-6) and rows["SaO2 x"].n == 25


def test_a_log_grows_by_a_file_a_run(spark, tmp_path):
    rows = spark.createDataFrame([("v1", 0.1, 3), ("v2", 0.2, 4)], "version string, apnea double, error long").repartition(2)
    for _ in range(2):
        events.append_log(rows, str(tmp_path / "log"))
    files = list((tmp_path / "log").glob("part-*"))
    assert len(files) == 2 and all(f.read_text().count("version") == 1 for f in files)
    assert events.read_log(spark, str(tmp_path / "log"), "version string, apnea double, error long").where("error = 4").count() == 2
