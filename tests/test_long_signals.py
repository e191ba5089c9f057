"""Signals in blocks against the same signals whole."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import kernels
from quern.operators import long_signals, ordered, signals
from quern.plans import catalog
from quern.plans import tables as t
from quern.sources import audio


@pytest.fixture(scope="module")
def whole() -> dict[str, tuple[int, np.ndarray]]:
    """Tones and noise of many lengths about the sizes of frames and blocks, at several rates."""
    rng = np.random.default_rng(7)
    out = {}
    for k, n in enumerate((1, 2, 500, 639, 640, 641, 1023, 1024, 1025, 1279, 1280, 2047, 2048, 2049, 4096, 5000, 9000)):
        x = 0.4 * np.sin(2 * np.pi * (150 + 37 * k) * np.arange(n) / 16000) + rng.normal(0, 0.05, n)
        out[f"s{n}"] = (16000 if k % 3 else 8000, x.astype(np.float32))
    out["quiet"] = (16000, np.zeros(3000, np.float32))
    return out


@pytest.fixture(scope="module")
def arrays(spark: SparkSession, whole: dict) -> DataFrame:
    return spark.createDataFrame([(k, sr, x.tolist()) for k, (sr, x) in whole.items()], "path string, sr int, samples array<float>")


@pytest.fixture(scope="module")
def samples(arrays: DataFrame) -> DataFrame:
    return long_signals.cut(arrays).repartition(5, F.rand(3))


def close(a: float | None, b: float | None, unit: float) -> bool:
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= unit * 1.001


def test_features_of_blocks(arrays: DataFrame, samples: DataFrame) -> None:
    want = {r.path: r.asDict() for r in signals.features(arrays, signals.FEATURES).collect()}
    got = {r.path: r.asDict() for r in long_signals.features(samples, signals.FEATURES, size=2048).collect()}
    assert got.keys() == want.keys()
    units = {"duration_s": 1e-9, "rms_db": 0.01, "zcr": 1e-5} | {f"mfcc_{i:02d}": 1e-4 for i in range(1, 14)}
    for path, row in want.items():
        for name, value in row.items():
            assert name == "path" or close(got[path][name], value, units.get(name, 0.1)), (path, name, got[path][name], value)


def test_features_of_a_few(samples: DataFrame) -> None:
    assert long_signals.features(samples, ("zcr", "duration"), size=2048).columns == ["path", "duration_s", "rms_db", "zcr"]
    with pytest.raises(ValueError, match="unknown features"):
        long_signals.features(samples, ("tempo",))
    assert long_signals.features(samples.limit(0), signals.FEATURES).collect() == []
    odd = samples.select("path", F.when(F.col("path") != "s500", F.col("sr")).alias("sr"), "pos", F.when(F.col("path") != "s640", F.col("value")).alias("value"))
    assert {r.path for r in samples.select("path").distinct().collect()} - {r.path for r in long_signals.features(odd, ("zcr",)).collect()} == {"s500", "s640"}


def test_spectra_of_blocks(arrays: DataFrame, samples: DataFrame) -> None:
    rows = lambda df: {(r.path, r.frame): (r.centroid, r.rolloff, r.peak, r.band) for r in df.collect()}
    want, got = rows(signals.spectra(arrays, 256, 96)), rows(long_signals.spectra(samples, 256, 96, size=700))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("sr", [8000, 11025, 16000, 22050])
def test_resampling_in_blocks(whole: dict, samples: DataFrame, sr: int) -> None:
    """Every block is what the whole signal gives, to the last bit."""
    found: dict[str, dict] = {}
    for r in long_signals.resampled(samples, sr, size=900).collect():
        found.setdefault(r.path, {})[r.block] = r.samples
    for path, (rate, x) in whole.items():
        want = kernels.resampled(x.astype(np.float64), rate, sr)
        got = np.concatenate([found[path][b] for b in sorted(found[path])])
        assert np.array_equal(got, want), path
    x = np.random.default_rng(1).normal(0, 1, 5000)
    y = kernels.resampled(x, 16000, 11025)
    part = kernels.resampled(x[900:2100], 16000, 11025, first=900, start=700, size=600)
    assert np.array_equal(part, y[700:1300])


def test_converted_files(arrays: DataFrame, samples: DataFrame) -> None:
    want = {r.path: (len(r.wav), hashlib.sha256(r.wav).hexdigest()) for r in signals.converted(arrays, 11025, normalize=True).collect()}
    got = {r.path: (r.n_bytes, r.sha256) for r in long_signals.digests(long_signals.wav_parts(long_signals.converted(samples, 11025, True, size=900))).collect()}
    assert got == want
    assert long_signals.wav_header(8000, 100) == audio.wav16(8000, np.zeros(100))[:44]


def test_users_against_numpy(spark: SparkSession, sf: str) -> None:
    """The queries over the supplied tables, against each user's whole series."""
    series: dict[str, list] = {}
    for r in t.table(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 500).cast("float").alias("v")).orderBy("event_id").collect():
        series.setdefault(str(r.user_id), []).append(r.v)
    arrays = spark.createDataFrame([(k, 16000, v) for k, v in series.items()], "path string, sr int, samples array<float>")
    want = {r.path: r.asDict() for r in signals.features(arrays, signals.FEATURES).collect()}
    got = {r.path: r.asDict() for r in catalog.QUERIES["features_users"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(close(got[p][c], want[p][c], 0.1 if c.endswith("hz") else 0.01) for p in want for c in want[p] if c != "path")
    files = {r.path: (len(r.samples), hashlib.sha256(r.wav).hexdigest()) for r in signals.converted(arrays.withColumn("sr", F.lit(100)), sr=80, normalize=True).collect()}
    assert {r.path: (r.n, r.wav_sha256) for r in catalog.QUERIES["converted_users"](spark, sf).collect()} == files


@pytest.mark.parametrize("by", [[], ["g"]])
def test_order_statistics(spark: SparkSession, by: list[str]) -> None:
    rng = np.random.default_rng(9)
    groups = {g: rng.normal(0, 1, n).round(2) for g, n in ((0, 1), (1, 2), (2, 7), (3, 5000), (4, 3001))}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [(5, None), (3, None)]
    counts = spark.createDataFrame(rows, "g int, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    if not by:
        counts, groups = counts.groupBy("v").agg(F.sum("n").alias("n")), {0: np.concatenate(list(groups.values()))}
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r["g"] if by else 0, r.share): r.value for r in ordered.order_statistics(counts, by, "v", "n", shares).collect()}
    assert got.keys() == {(g, s) for g in groups for s in shares}
    assert all(np.isclose(got[g, s], np.percentile(x, 100 * s)) for g, x in groups.items() for s in shares)


def test_median_of_ten_million(spark: SparkSession) -> None:
    """One group of ten million different values, and small ones beside it."""
    rows = spark.range(0, 10_000_000, 1, 8).select(F.when(F.col("id") % 1000 == 0, F.col("id") % 7).otherwise(F.lit(-1)).alias("g"), (F.xxhash64("id") / 2**40).alias("v"))
    got = {r.g: r.value for r in ordered.order_statistics(rows.groupBy("g", "v").agg(F.count("*").alias("n")), ["g"], "v", "n", [0.5]).collect()}
    want = rows.groupBy("g").agg(F.expr("median(v)").alias("m")).collect()
    assert got == {r.g: pytest.approx(r.m) for r in want} and len(got) == 8
