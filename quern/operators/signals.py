"""Quality, features and conversion of signals: rows ``path, sr, samples array<float>`` (other columns are kept apart)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import kernels
from quern.functions.numbers import rounded
from quern.operators.ordered import at_places
from quern.sources.audio import wav16

FEATURES = ("duration", "peak_freq", "bandwidth", "spectral", "f0", "mfcc", "zcr")


def _mean_square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.greatest(F.size(x), F.lit(1))


def frame_rms(signals: DataFrame, frame_ms: int = 50) -> DataFrame:
    """``path, frame, rms`` of frames that do not overlap; the tail is left out, a shorter signal is one frame."""
    n = F.greatest((F.col("sr") * frame_ms / 1000).cast("int"), F.lit(1))
    s = signals.where("size(samples) > 0").select("path", "samples", n.alias("n"), F.size("samples").alias("len"))
    frames = F.when(F.col("len") < F.col("n"), F.array("samples")).otherwise(F.transform(F.sequence(F.lit(0), F.floor(F.col("len") / F.col("n")).cast("int") - 1), lambda i: F.slice("samples", i * F.col("n") + 1, F.col("n"))))
    return s.select("path", F.posexplode(frames).alias("frame", "x")).select("path", "frame", F.sqrt(_mean_square(F.col("x"))).alias("rms"))


def quality(signals: DataFrame, **limits: float) -> DataFrame:
    """``path, duration, peak, clip_ratio, silence_ratio, mean_rms, flags`` (null if none, in fixed order); all limits are strict.

    limits: ``min_sec`` 0.2, ``max_sec`` 120, ``clip_ratio`` 0.01, ``silence_ratio`` 0.8. Signals without samples get
    nulls, as headers alone do.
    """
    s = signals.withColumn("peak", F.array_max(F.transform("samples", lambda v: F.abs(v.cast("double")))))
    clip = F.size(F.filter("samples", lambda v: F.abs(v.cast("double")) >= 0.99)) / F.nullif(F.size("samples"), F.lit(0))
    return _judged(s.select("path", (F.size("samples") / F.col("sr")).alias("duration"), "peak", clip.alias("clip")), frame_rms(signals), **limits)


def file_quality(files: DataFrame, **limits: float) -> DataFrame:
    """``quality`` of decoded files (``path, sr, samples, error``), with their ``error``, in one pass over the samples."""
    n = F.greatest((F.col("sr") * 50 / 1000).cast("int"), F.lit(1))
    x, size = F.col("samples"), F.size("samples")
    whole = F.transform(F.sequence(F.lit(0), F.floor(size / n).cast("int") - 1), lambda i: F.sqrt(_mean_square(F.slice(x, i * n + 1, n))))
    rms = F.when(size == 0, F.array().cast("array<double>")).when(size < n, F.array(F.sqrt(_mean_square(x)))).otherwise(whole)
    s = files.select("path", "error", (size / F.col("sr")).alias("duration"), F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))).alias("peak"), (F.size(F.filter(x, lambda v: F.abs(v.cast("double")) >= 0.99)) / F.nullif(size, F.lit(0))).alias("clip"), F.when(x.isNotNull(), rms).alias("frames"))
    low = F.greatest(0.01 * F.col("peak"), F.lit(1e-5))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / F.nullif(F.size(a), F.lit(0))
    s = s.select("path", "error", "duration", "peak", "clip", mean(F.transform("frames", lambda v: (v < low).cast("double"))).alias("silence"), mean(F.col("frames")).alias("rms"))
    return _flagged(s, **limits).select("path", "error", *_QUALITY)


def _judged(s: DataFrame, frames: DataFrame, **limits: float) -> DataFrame:
    """The roll-up of ``path, duration, peak, clip`` and frames, with flags."""
    f = frames.join(s.select("path", "peak"), "path").groupBy("path").agg(F.avg((F.col("rms") < F.greatest(0.01 * F.col("peak"), F.lit(1e-5))).cast("double")).alias("silence"), F.avg("rms").alias("rms"))
    return _flagged(s.join(f, "path", "left"), **limits).select("path", *_QUALITY)


_QUALITY = ("duration", "peak", "clip_ratio", "silence_ratio", "mean_rms", "flags")


def _flagged(s: DataFrame, min_sec: float = 0.2, max_sec: float = 120.0, clip_ratio: float = 0.01, silence_ratio: float = 0.8) -> DataFrame:
    """The rounded columns of ``_QUALITY`` from ``duration, peak, clip, silence, rms``; other columns stay."""
    flags = F.array_compact(F.array(F.when(F.col("clip") > clip_ratio, "clipping"), F.when(F.col("silence") > silence_ratio, "high-silence"), F.when(F.col("duration") < min_sec, "too-short"), F.when(F.col("duration") > max_sec, "too-long"), F.when(F.col("peak") == 0, "all-zero")))
    named = {"duration": rounded("duration", 3), "peak": rounded("peak", 4), "clip_ratio": rounded("clip", 5), "silence_ratio": rounded("silence", 3), "mean_rms": rounded("rms", 5), "flags": F.when(F.size(flags) > 0, flags)}
    return s.withColumns(named)


def sample_frames(samples: DataFrame, frame_ms: int = 50) -> DataFrame:
    """``path, frame, rms`` like ``frame_rms``, of signals of any length as rows ``path, sr, pos, value``, by one grouping."""
    n = F.greatest((F.col("sr") * frame_ms / 1000).cast("long"), F.lit(1))
    v = F.col("value").cast("double")
    frames = samples.groupBy("path", n.alias("n"), F.floor(F.col("pos") / n).alias("frame")).agg(F.sum(v * v).alias("squares"), F.count("*").alias("k"))
    # the tail of a signal is left out unless it is its only frame
    return frames.where("k = n OR frame = 0").select("path", F.col("frame").cast("int").alias("frame"), F.sqrt(F.col("squares") / F.col("k")).alias("rms"))


def sample_quality(samples: DataFrame, **limits: float) -> DataFrame:
    """``quality`` of signals of any length as rows ``path, sr, pos, value``."""
    v = F.abs(F.col("value").cast("double"))
    s = samples.groupBy("path").agg((F.count("*") / F.first("sr")).alias("duration"), F.max(v).alias("peak"), (F.count_if(v >= 0.99) / F.count("*")).alias("clip"))
    return _judged(s, sample_frames(samples), **limits)


def rate_histogram(signals: DataFrame) -> DataFrame:
    return signals.where("sr IS NOT NULL").groupBy("sr").agg(F.count("*").alias("n"))


def lower_quantiles(values: DataFrame, column: str, shares: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """``share, value``: the value at place ``min(int(n * share), n - 1)`` in order, from 0."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    place = lambda s: F.least(F.floor(F.col("size") * F.lit(s)), F.col("size") - 1)
    found = at_places(counts, [], "v", "n", F.array(*map(place, shares)))
    asked = F.filter(F.array(*map(F.lit, shares)), lambda s: F.least(F.floor(F.col("size") * s), F.col("size") - 1) == F.col("place"))
    return found.select(F.explode(asked).alias("share"), "value")


def audit_summary(rows: DataFrame) -> DataFrame:
    """``n_audio, n_flagged, n_errors``, the first 50 flagged files with their flags and 10 failed ones with their error, of rows ``path, flags, error``."""
    flagged = rows.where("flags IS NOT NULL").select("path", "flags").orderBy("path").limit(50).agg(F.sort_array(F.collect_list(F.struct("path", "flags"))).alias("flagged"))
    failed = rows.where("error IS NOT NULL").select("path", "error").orderBy("path").limit(10).agg(F.sort_array(F.collect_list(F.struct("path", "error"))).alias("errors"))
    return rows.agg(F.count("*").alias("n_audio"), F.count("flags").alias("n_flagged"), F.count("error").alias("n_errors")).join(flagged).join(failed)  # one row each


def features(signals: DataFrame, wanted: tuple[str, ...] = ("duration", "peak_freq", "bandwidth", "spectral", "f0")) -> DataFrame:
    """Acoustic features of each signal, one column each; those not wanted are left out, an unknown name is an error."""
    if bad := [f for f in wanted if f not in FEATURES]:
        raise ValueError(f"unknown features: {bad}")
    names = {"duration": ["duration_s", "rms_db"], "peak_freq": ["peak_freq_hz"], "bandwidth": ["bandwidth_90_hz"], "spectral": ["spec_centroid_hz", "spec_rolloff85_hz"], "f0": ["f0_mean_hz", "f0_median_hz", "f0_range_hz"], "mfcc": [f"mfcc_{i:02d}" for i in range(1, 14)], "zcr": ["zcr"]}
    columns = [c for f in FEATURES if f in wanted for c in names[f]]

    def of(sr: int, x: np.ndarray) -> dict[str, float]:
        out: dict[str, float] = {}
        if "duration" in wanted:
            out |= {"duration_s": round(len(x) / sr, 3), "rms_db": round(20 * np.log10((np.sqrt(np.mean(x**2)) if len(x) else 0.0) + 1e-12), 2)}
        if {"peak_freq", "bandwidth", "spectral", "mfcc"} & set(wanted):
            power = kernels.power_spectrum(x)
            shape = kernels.spectral_shape(power, sr)
            out |= {"peak_freq_hz": round(float(np.median(shape["peak"])), 1), "bandwidth_90_hz": round(float(np.median(shape["band"])), 1), "spec_centroid_hz": round(float(shape["centroid"].mean()), 1), "spec_rolloff85_hz": round(float(shape["rolloff"].mean()), 1)}
            if "mfcc" in wanted:
                out |= {f"mfcc_{i:02d}": round(float(v), 4) for i, v in enumerate(kernels.cepstrum(power, sr), 1)}
        if "f0" in wanted and len(f0 := kernels.pitch(x, sr)):
            out |= {"f0_mean_hz": round(float(f0.mean()), 1), "f0_median_hz": round(float(np.median(f0)), 1), "f0_range_hz": round(float(np.percentile(f0, 95) - np.percentile(f0, 5)), 1)}
        if "zcr" in wanted and len(x) != 1:
            out["zcr"] = round(float(np.abs(np.diff(np.sign(x))).mean()), 5) if len(x) else 0.0
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(sr, np.asarray(x, np.float64)) if sr and x is not None else {} for sr, x in zip(batch.column("sr").to_pylist(), (v.values.to_numpy() if v.is_valid else None for v in batch.column("samples")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array([r.get(c) for r in rows], pa.float64()) for c in columns]], ["path", *columns])

    return signals.select("path", "sr", "samples").mapInArrow(run, ", ".join(["path string", *[f"{c} double" for c in columns]]))


def spectra(signals: DataFrame, n_fft: int = 1024, hop: int = 256) -> DataFrame:
    """``path, frame, centroid, rolloff, peak, band`` in Hz of each signal's overlapping frames."""
    names = ("centroid", "rolloff", "peak", "band")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sr, x in zip(batch.column("path").to_pylist(), batch.column("sr").to_pylist(), batch.column("samples"), strict=True):
                shape = kernels.spectral_shape(kernels.power_spectrum(np.asarray(x.values.to_numpy(), np.float64), n_fft, hop), sr, n_fft)
                n = len(shape["peak"])
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32()), *[pa.array(shape[c].astype(np.float64)) for c in names]], ["path", "frame", *names])

    known = signals.where("sr IS NOT NULL AND samples IS NOT NULL").select("path", "sr", "samples")
    return known.mapInArrow(run, "path string, frame int, " + ", ".join(f"{c} double" for c in names))


def crossing_rate(signals: DataFrame) -> DataFrame:
    """``path, zcr``: the mean change of sign between neighbours (a crossing counts 2), in expressions alone."""
    pairs = F.zip_with(F.slice("samples", 2, F.size("samples")), F.slice("samples", 1, F.size("samples") - 1), lambda a, b: F.abs(F.signum(a) - F.signum(b)))
    zcr = F.when(F.size("samples") > 1, F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / (F.size("samples") - 1))
    return signals.where("size(samples) <> 1 AND samples IS NOT NULL").select("path", F.coalesce(rounded(zcr, 5), F.lit(0.0)).alias("zcr"))


def trim_range(text: str) -> tuple[float, float]:
    """``from-to`` in seconds, each ``s`` or ``m:s``."""
    parts = text.split("-")
    if len(parts) != 2:
        raise ValueError(f"a range is from-to, not {text!r}")
    seconds = lambda x: sum(float(v) * 60**i for i, v in enumerate(reversed(x.split(":"))))
    return seconds(parts[0]), seconds(parts[1])


def converted(signals: DataFrame, sr: int = 16000, trim: str | None = None, normalize: bool = False) -> DataFrame:
    """``path, sr, samples, wav`` (the bytes of a 16-bit file): trimmed, resampled, and scaled to a peak of 0.99 if asked.

    Signals may have ``channels``, whose samples then alternate; they are kept.
    """
    span = trim_range(trim) if trim else None
    many = F.coalesce("channels", F.lit(1)) if "channels" in signals.columns else F.lit(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.asarray(row["samples"] or [], np.float64)
                x = x.reshape(-1, row["many"]) if len(x) % row["many"] == 0 else x[:, None]
                if span:
                    x = x[int(span[0] * row["sr"]) : int(span[1] * row["sr"])]
                x = np.stack([kernels.resampled(c, row["sr"], sr) for c in x.T], axis=1)
                if normalize and x.size and np.abs(x).max() > 0:
                    x = x / np.abs(x).max() * 0.99
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([sr], pa.int32()), pa.array([x.reshape(-1).astype(np.float32)], pa.list_(pa.float32())), pa.array([wav16(sr, x)], pa.binary())], ["path", "sr", "samples", "wav"])

    return signals.where("sr IS NOT NULL").select("path", "sr", "samples", many.cast("int").alias("many")).mapInArrow(run, "path string, sr int, samples array<float>, wav binary")
