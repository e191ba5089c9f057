"""Signals: generated tones through files, quality, features and conversion."""

from __future__ import annotations

import struct
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quern.operators import signals
from quern.sources import audio

RATE = 16000


def tone(hz: float, seconds: float = 1.0, peak: float = 0.5) -> np.ndarray:
    return peak * np.sin(2 * np.pi * hz * np.arange(int(RATE * seconds)) / RATE)


def table(spark: SparkSession, **named: np.ndarray):
    return spark.createDataFrame([(k, RATE, [float(v) for v in x]) for k, x in named.items()], "path string, sr int, samples array<float>")


def test_tone_quality(spark: SparkSession) -> None:
    alternating = np.tile([1.0, -1.0], RATE // 2)
    got = {r.path: r for r in signals.quality(table(spark, a=tone(440), zero=np.zeros(RATE), full=alternating, short=tone(440, 0.1), none=np.zeros(0))).collect()}
    assert (got["a"].mean_rms, got["a"].silence_ratio, got["a"].flags, got["a"].duration) == (0.35355, 0.0, None, 1.0)
    assert got["zero"].flags == ["high-silence", "all-zero"] and (got["zero"].peak, got["zero"].silence_ratio) == (0.0, 1.0)
    assert got["full"].flags == ["clipping"] and got["full"].clip_ratio == 1.0
    assert got["short"].flags == ["too-short"]
    assert got["none"].peak is None
    frames = signals.frame_rms(table(spark, a=tone(440), short=tone(440, 0.03))).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in frames} == {"a": 20, "short": 1}


def test_tone_features(spark: SparkSession) -> None:
    got = {r.path: r for r in signals.features(table(spark, a=tone(440), b=tone(200), c=tone(100), none=np.zeros(0), one=np.ones(1)), signals.FEATURES).collect()}
    a = got["a"]
    assert (a.rms_db, a.peak_freq_hz, a.spec_centroid_hz, a.f0_median_hz, a.zcr) == (-9.03, 437.5, 440.0, 444.4, 0.10994)
    assert a.bandwidth_90_hz == pytest.approx(31.25, abs=0.1) and a.spec_rolloff85_hz == pytest.approx(453.125, abs=0.1)
    assert (got["b"].f0_median_hz, got["c"].f0_median_hz) == (200.0, 2000.0)
    assert got["none"].f0_mean_hz is None and got["one"].zcr is None
    with pytest.raises(ValueError, match="unknown features"):
        signals.features(table(spark, a=tone(440)), ("tempo",))
    assert signals.features(table(spark, a=tone(440)), ("zcr",)).columns == ["path", "zcr"]


def test_crossing_rate_agrees(spark: SparkSession) -> None:
    t = table(spark, a=tone(440), b=tone(333))
    native = {r.path: r.zcr for r in signals.crossing_rate(t).collect()}
    assert native == {r.path: r.zcr for r in signals.features(t, ("zcr",)).collect()}


def test_files(spark: SparkSession, tmp_path: Path) -> None:
    """WAV of several widths, stereo, headerless PCM; what can't be read becomes a row with an error."""
    x = tone(440)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "mono.wav").write_bytes(audio.wav16(RATE, x))
    with wave.open(str(tmp_path / "stereo.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(4)
        w.setframerate(8000)
        w.writeframes((np.stack([x, -x], axis=1) * (2**31 - 1)).astype("<i4").tobytes())
    with wave.open(str(tmp_path / "eight.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes((x * 127 + 128).astype(np.uint8).tobytes())
    (tmp_path / "raw.pcm").write_bytes((x * 32767).astype("<i2").tobytes())
    floats = x.astype("<f4").tobytes()
    (tmp_path / "float.wav").write_bytes(b"RIFF" + struct.pack("<I", 36 + len(floats)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, RATE, RATE * 4, 4, 32) + b"data" + struct.pack("<I", len(floats)) + floats)
    (tmp_path / "bad.wav").write_bytes(b"not a sound")
    (tmp_path / "song.mp3").write_bytes(b"ID3")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "odd.xyz").write_text("x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.read(spark, str(tmp_path), pcm_sr=RATE).collect()}
    assert set(rows) == {"mono.wav", "stereo.wav", "eight.wav", "raw.pcm", "float.wav", "bad.wav", "song.mp3"}
    for name, near in (("mono.wav", 1e-4), ("eight.wav", 0.016), ("raw.pcm", 1e-4), ("float.wav", 1e-6)):
        assert rows[name].error is None and np.allclose(rows[name].samples, x, atol=near), name
    assert rows["stereo.wav"].channels == 2 and np.allclose(rows["stereo.wav"].samples, 0, atol=1e-6)
    assert all(rows[n].error and rows[n].samples is None for n in ("bad.wav", "song.mp3"))
    heads = {r.path.rsplit("/", 1)[1]: r for r in audio.read(spark, str(tmp_path), header_only=True).collect()}
    assert heads["mono.wav"].samples is None and heads["mono.wav"].frames == RATE and heads["raw.pcm"].error
    small = {r.path.rsplit("/", 1)[1]: r for r in audio.read(spark, str(tmp_path), pcm_sr=RATE, limit=20_000).collect()}
    assert "over the limit" in small["mono.wav"].error and small["eight.wav"].error is None
    kinds = {r.name: r.kind for r in audio.listing(spark, str(tmp_path)).collect()}
    assert (kinds["mono.wav"], kinds["notes.txt"], kinds["odd.xyz"]) == ("audio", "other", "unsupported")


def test_conversion(spark: SparkSession) -> None:
    row = signals.converted(table(spark, a=tone(440, 2.0)), sr=8000, trim="0:00-0:01", normalize=True).first()
    want = 0.99 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    assert row.sr == 8000 and len(row.samples) == 8000
    assert np.abs(np.array(row.samples)[200:-200] - want[200:-200]).max() < 0.02
    assert row.wav[:4] == b"RIFF" and len(row.wav) == 44 + 2 * 8000
    same = signals.converted(table(spark, a=tone(440)), sr=RATE).first()
    assert np.allclose(same.samples, tone(440), atol=1e-6)
    assert signals.trim_range("1:30-2:00") == (90.0, 120.0)
    with pytest.raises(ValueError):
        signals.trim_range("5")


def test_audit_summary(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("b", ["x"], None), ("a", ["y"], None), ("c", None, "bad"), ("d", None, None)], "path string, flags array<string>, error string")
    r = signals.audit_summary(rows).first()
    assert (r.n_audio, r.n_flagged, r.n_errors) == (4, 2, 1)
    assert [tuple(x) for x in r.flagged] == [("a", ["y"]), ("b", ["x"])] and [tuple(x) for x in r.errors] == [("c", "bad")]


def test_cepstra_by_definition() -> None:
    """Mel triangles, logarithms and the cosine transform, coefficient by coefficient."""
    from quern.functions import kernels

    rng = np.random.default_rng(2)
    for sr in (8000, 16000):
        x = rng.normal(0, 0.1, 3000)
        power = kernels.power_spectrum(x)
        assert power.shape == (8, 513)
        frame = x[256 : 256 + 1024] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1024) / 1023))
        direct = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(1024) / 1024))) ** 2 for k in (0, 7, 512)]
        assert np.allclose(power[1, [0, 7, 512]], direct)
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        top = min(7800.0, sr / 2)
        edges = [int(np.floor(1025 * 700 * (10 ** ((mel(50.0) + i * (mel(top) - mel(50.0)) / 27) / 2595) - 1) / sr)) for i in range(28)]
        logs = np.zeros((8, 26))
        for t in range(8):
            for b in range(26):
                low, mid, high = edges[b : b + 3]
                total = sum(power[t, k] * (k - low) / (mid - low) for k in range(low, mid)) + sum(power[t, k] * (high - k) / (high - mid) for k in range(mid, high))
                logs[t, b] = np.log(total + 1e-12)
        want = [np.mean([np.sqrt(2 / 26) * sum(logs[t, i] * np.cos(np.pi * k * (2 * i + 1) / 52) for i in range(26)) for t in range(8)]) for k in range(1, 14)]
        assert np.allclose(kernels.cepstrum(power, sr), want)
