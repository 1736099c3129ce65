import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.sources import edf


def _bytes(seconds=5):
    rng = np.random.default_rng(1)
    return edf.write_edf([("Resp nasal", "%", 10, rng.normal(0, 50, 10 * seconds)), ("SaO2", "%", 1, np.full(seconds, 95.0))])


def test_round_trip(spark, tmp_path):
    data = _bytes()
    (tmp_path / "patient_001").mkdir()
    (tmp_path / "patient_001/recording.edf").write_bytes(data)
    (tmp_path / "patient_001/x_Events.edf").write_bytes(b"no recording")
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as out:
        out.writestr("a/small.edf", _bytes(2))
        out.writestr("a/large.edf", data)
        out.writestr("a/Events/larger.edf", _bytes(9))
    (tmp_path / "patient_001/night.mmrx").write_bytes(archive.getvalue())
    (tmp_path / "patient_001/bad.edf").write_bytes(b"short")
    rows = edf.read_edf(spark, str(tmp_path)).collect()
    assert sum(r.error is not None for r in rows) == 1
    good = [r for r in rows if r.error is None]
    assert len(good) == 4 and {r.duration_sec for r in good} == {5.0}
    flow = next(r for r in good if r.label == "Resp nasal")
    assert flow.sample_rate == 10 and len(flow.samples) == 50
    assert str(flow.start_time) == "2024-01-01 22:00:00"
    assert np.allclose(flow.samples, np.random.default_rng(1).normal(0, 50, 50), atol=0.06)
    signals = edf.read_edf(spark, str(tmp_path)).where("error is null")
    assert edf.bound_channel(signals, "Resp").count() == 2
    assert edf.long_form(signals.where(F.col("label") == "SaO2"), F.col("path"), "spo2").count() == 10


def test_truncated_data_keep_the_headers_duration():
    data = _bytes()[:-15]
    header = edf.parse_header(data)
    assert header.records == 5
    assert sum(len(x) for _, x in edf.parse_signals(data, header)) < 55


def test_year_pivot_and_bad_dates():
    assert edf.start_time("02.03.85", "01.02.03").startswith("1985-03-02T01:02:03")
    assert edf.start_time("02.03.84", "01.02.03").startswith("2084")
    assert edf.start_time("31.02.20", "x").startswith("2000-01-01")


def test_unknown_record_count_is_an_error():
    data = bytearray(_bytes())
    data[236:244] = b"-1      "
    with pytest.raises(ValueError):
        edf.parse_header(bytes(data))


def test_gaps_are_zero():
    out = edf.placed(np.ones(20), [0.0, 3.0], 10, 1.0)
    assert len(out) == 40 and out[:10].all() and out[30:].all() and not out[10:30].any()
