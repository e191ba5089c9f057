"""Signals of any length, as rows ``path, sr, pos, value`` (places from 0, without gaps): features, spectra, conversion.

No task holds a whole signal. Samples are dealt to blocks of a fixed number of places; a block also gets the samples of
its neighbours that its frames reach into. Frames belong to the block that they start in, so that each is worked out once.
Sums go up from blocks; medians and percentiles come from how often each value occurs (``ordered.order_statistics``).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import reduce
from math import gcd

import numpy as np
import pyarrow as pa
from numpy.typing import NDArray
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import kernels
from quern.functions.numbers import rounded
from quern.operators.ordered import order_statistics
from quern.operators.signals import FEATURES
from quern.sources.shared import kept

#: Samples of a block.
BLOCK = 1 << 16
N_FFT, HOP = 1024, 256
#: Parts of a second that a pitch frame is long, and that the next begins after.
PITCH_MS, PITCH_HOP_MS = 40.0, 20.0
Floats = NDArray[np.float64]


def blocks(samples: DataFrame, size: int = BLOCK, before: Column | int = 0, after: Column | int = 0) -> DataFrame:
    """``path, sr, block, first, samples``: the samples of each block with up to ``before`` and ``after`` (at most ``size``) of its neighbours'.

    ``first`` is the place of the first sample that a row holds.
    """
    own, inside = F.floor(F.col("pos") / size), F.col("pos") % size
    to = F.array_compact(F.array(own, F.when((inside < after) & (own > 0), own - 1), F.when(inside >= size - F.lit(before), own + 1)))
    dealt = samples.select("path", "sr", "pos", F.col("value").cast("float").alias("value"), own.alias("own"), F.explode(to).alias("block"))
    held = dealt.groupBy("path", "block").agg(F.max("sr").alias("sr"), F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"), F.count_if(F.col("own") == F.col("block")).alias("n"))
    return held.where("n > 0").select("path", "sr", "block", F.element_at("s", 1)["pos"].alias("first"), F.transform("s", lambda x: x["value"]).alias("samples"))


def cut(signals: DataFrame) -> DataFrame:
    """Rows ``path, sr, pos, value`` of signals as arrays."""
    return signals.select("path", "sr", F.posexplode("samples").alias("pos", "value"))


def _spectral_frames(x: Floats, start: int, size: int, n_fft: int, hop: int) -> Floats:
    """The frames that begin in a block of ``size`` at ``start``; a whole signal that is shorter than one frame is padded."""
    if start == 0 and len(x) < n_fft:
        x = np.pad(x, (0, n_fft - len(x)))
    begin = -start % hop
    if len(x) < n_fft or begin >= min(size, len(x) - n_fft + 1):
        return np.zeros((0, n_fft))
    return np.lib.stride_tricks.sliding_window_view(x, n_fft)[begin:size:hop]


def _power(frames: Floats, n_fft: int) -> Floats:
    return np.abs(np.fft.rfft(frames * np.hanning(n_fft), axis=1)) ** 2


def spectra(samples: DataFrame, n_fft: int = N_FFT, hop: int = HOP, size: int = BLOCK) -> DataFrame:
    """``path, frame, centroid, rolloff, peak, band`` in Hz of each signal's overlapping frames."""
    names = ("centroid", "rolloff", "peak", "band")
    size = max(size, n_fft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, sr, block, _, x in _rows(batches):
            frames = _spectral_frames(x, block * size, size, n_fft, hop)
            shape = kernels.spectral_shape(_power(frames, n_fft), sr, n_fft)
            number = -(-block * size // hop) + np.arange(len(frames))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(frames), pa.string()), pa.array(number, pa.int64()), *[pa.array(shape[c].astype(np.float64)) for c in names]], ["path", "frame", *names])

    known = samples.where("sr IS NOT NULL AND value IS NOT NULL")
    return blocks(known, size, after=n_fft).mapInArrow(run, "path string, frame long, " + ", ".join(f"{c} double" for c in names))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, Floats]]:
    for batch in batches:
        plain = [batch.column(c).to_pylist() for c in ("path", "sr", "block", "first")]
        for *row, x in zip(*plain, batch.column("samples"), strict=True):
            yield *row, np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)


def _counted(values: Floats) -> list[dict]:
    found, n = np.unique(values, return_counts=True)
    return [{"v": v, "n": k} for v, k in zip(found.tolist(), n.tolist(), strict=True)]


def _part(sr: int, start: int, size: int, x: Floats, wanted: tuple[str, ...]) -> dict:
    """What one block adds: sums and, of values whose middle is asked for, how often each occurs."""
    own = x[:size]
    out: dict = {"n": len(own), "squares": float((own**2).sum())}
    pairs = np.diff(np.sign(x[: size + 1]))
    out |= {"crossings": float(np.abs(pairs).sum()), "pairs": len(pairs)}
    if {"peak_freq", "bandwidth", "spectral", "mfcc"} & set(wanted):
        power = _power(_spectral_frames(x, start, size, N_FFT, HOP), N_FFT)
        shape = kernels.spectral_shape(power, sr, N_FFT)
        out |= {"frames": len(power), "centroid": float(shape["centroid"].sum()), "rolloff": float(shape["rolloff"].sum()), "peak": _counted(shape["peak"]), "band": _counted(shape["band"])}
        if "mfcc" in wanted:
            out["mfcc"] = (kernels.cepstrum(power, sr) * len(power)).tolist() if len(power) else [0.0] * 13
    if "f0" in wanted:
        out["pitch"] = _counted(kernels.pitch(x, sr, frame_ms=PITCH_MS, hop_ms=PITCH_HOP_MS, start=start, own=size))
    return out


def features(samples: DataFrame, wanted: tuple[str, ...] = ("duration", "peak_freq", "bandwidth", "spectral", "f0"), size: int = BLOCK) -> DataFrame:
    """``signals.features`` of signals of any length, one row each: the same numbers as of the whole signal.

    Samples without a rate or a value take no part; a signal without any has no row.
    """
    reach = F.greatest(F.lit(N_FFT), (F.col("sr") * (PITCH_MS / 1000)).cast("int")) + 1
    known = samples.where("sr > 0 AND value IS NOT NULL")
    return features_of_blocks(blocks(known, size, after=reach), wanted, size)


def features_of_blocks(blocks: DataFrame, wanted: tuple[str, ...], size: int) -> DataFrame:
    """``features`` of rows ``path, sr, block, first, samples``, whose blocks also hold what their frames reach into.

    That is 1,025 samples and a pitch frame and one more after the block, whichever is more. Rows without a rate (files
    that could not be read) take no part.
    """
    if bad := [f for f in wanted if f not in FEATURES]:
        raise ValueError(f"unknown features: {bad}")
    blocks = blocks.where("sr > 0").select("path", "sr", "block", "first", "samples")
    counts = "array<struct<v: double, n: bigint>>"
    schema = f"path string, sr int, n long, squares double, crossings double, pairs long, frames long, centroid double, rolloff double, peak {counts}, band {counts}, mfcc array<double>, pitch {counts}"
    kinds = pa.list_(pa.struct([("v", pa.float64()), ("n", pa.int64())]))
    types = {"path": pa.string(), "sr": pa.int32(), "n": pa.int64(), "squares": pa.float64(), "crossings": pa.float64(), "pairs": pa.int64(), "frames": pa.int64(), "centroid": pa.float64(), "rolloff": pa.float64(), "peak": kinds, "band": kinds, "mfcc": pa.list_(pa.float64()), "pitch": kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for path, sr, block, _, x in _rows(batches):
            held.append({"path": path, "sr": sr} | _part(sr, block * size, size, x, wanted))
            if len(held) >= 256:
                yield pa.RecordBatch.from_pylist(held, pa.schema(types))
                held = []
        yield pa.RecordBatch.from_pylist(held, pa.schema(types))

    parts = kept(blocks.mapInArrow(run, schema))
    sums = [F.sum(c).alias(c) for c in ("n", "squares", "crossings", "pairs", "frames", "centroid", "rolloff")]
    mfcc = [F.sum(F.col("mfcc")[i]).alias(f"_mfcc{i}") for i in range(13)] if "mfcc" in wanted else []
    out = parts.groupBy("path").agg(F.max("sr").alias("sr"), *sums, *mfcc)
    middle = {"peak_freq": ("peak", (0.5,)), "bandwidth": ("band", (0.5,)), "f0": ("pitch", (0.05, 0.5, 0.95))}
    asked = [middle[f] for f in wanted if f in middle]
    if asked:
        listed = [parts.select("path", F.lit(kind).alias("kind"), F.explode(kind).alias("x")).select("path", "kind", "x.v", "x.n") for kind, _ in asked]
        values = reduce(DataFrame.unionByName, listed).groupBy("path", "kind", "v").agg(F.sum("n").alias("n"))
        shares = {kind: shares for kind, shares in asked}
        found = order_statistics(values, ["path", "kind"], "v", "n", sorted({s for _, some in asked for s in some}))
        pick = lambda kind, s: F.max(F.when((F.col("kind") == kind) & (F.col("share") == s), F.col("value")))
        out = out.join(found.groupBy("path").agg(*[pick(kind, s).alias(f"_{kind}{s}") for kind, some in shares.items() for s in some]), "path", "left")
    if "f0" in wanted:
        mean = parts.select("path", F.explode("pitch").alias("x")).groupBy("path").agg((F.sum(F.col("x.v") * F.col("x.n")) / F.sum("x.n")).alias("_f0"))
        out = out.join(mean, "path", "left")
    frames = F.nullif(F.col("frames"), F.lit(0))
    named = {
        "duration": {"duration_s": rounded(F.col("n") / F.col("sr"), 3), "rms_db": rounded(20 * F.log10(F.sqrt(F.col("squares") / F.col("n")) + 1e-12), 2)},
        "peak_freq": {"peak_freq_hz": lambda: rounded("`_peak0.5`", 1)},
        "bandwidth": {"bandwidth_90_hz": lambda: rounded("`_band0.5`", 1)},
        "spectral": {"spec_centroid_hz": rounded(F.col("centroid") / frames, 1), "spec_rolloff85_hz": rounded(F.col("rolloff") / frames, 1)},
        "f0": {"f0_mean_hz": lambda: rounded("_f0", 1), "f0_median_hz": lambda: rounded("`_pitch0.5`", 1), "f0_range_hz": lambda: rounded(F.col("`_pitch0.95`") - F.col("`_pitch0.05`"), 1)},
        "mfcc": {f"mfcc_{i + 1:02d}": (lambda i=i: rounded(F.col(f"_mfcc{i}") / frames, 4)) for i in range(13)},
        "zcr": {"zcr": rounded(F.col("crossings") / F.nullif(F.col("pairs"), F.lit(0)), 5)},
    }
    columns = [(c() if callable(c) else c).alias(name) for f in FEATURES if f in wanted for name, c in named[f].items()]
    return out.select("path", *columns)


def resampled(samples: DataFrame, sr: int = 16000, size: int = BLOCK, zeros: int = 10) -> DataFrame:
    """``path, sr, block, samples``: signals at another rate, block by block; every block is what the whole signal would give.

    A block of the result answers a whole number of periods of both rates, and sees as many samples around its own as
    the filter is long. Signals are told apart by their rate first, as that decides the size of their blocks.
    """
    known = samples.where("sr > 0 AND value IS NOT NULL")
    out = None
    for rate in sorted(r.sr for r in known.select("sr").distinct().collect()):  # the rates that occur, a handful
        up, down = sr // gcd(rate, sr), rate // gcd(rate, sr)
        own = max(1, size // down) * down
        reach = zeros * max(up, down) // up + 2
        own = max(own, -(-reach // down) * down)

        def run(batches: Iterator[pa.RecordBatch], rate=rate, up=up, down=down, own=own) -> Iterator[pa.RecordBatch]:
            for path, _, block, first, x in _rows(batches):
                n = min(own, first + len(x) - block * own)  # the block's own samples
                y = kernels.resampled(x, rate, sr, zeros, first=first, start=block * own // down * up, size=-(-n * up // down))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sr], pa.int32()), pa.array([block], pa.int64()), pa.array([y], pa.list_(pa.float64()))], ["path", "sr", "block", "samples"])

        part = blocks(known.where(F.col("sr") == rate), own, reach, reach).mapInArrow(run, "path string, sr int, block long, samples array<double>")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else blocks(known, size).select("path", "sr", "block", F.col("samples").cast("array<double>"))


def converted(samples: DataFrame, sr: int = 16000, normalize: bool = False, size: int = BLOCK) -> DataFrame:
    """``path, sr, block, frames, pcm``: 16-bit samples of signals at another rate, scaled to a peak of 0.99 if asked, block by block."""
    out = resampled(samples, sr, size)
    if normalize:
        out = kept(out)
        peak = out.groupBy("path").agg(F.max(F.array_max(F.transform("samples", F.abs))).alias("peak"))
        out = out.join(peak, "path")
    else:
        out = out.withColumn("peak", F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, block, peak, x in zip(b.column("path").to_pylist(), b.column("block").to_pylist(), b.column("peak").to_pylist(), b.column("samples"), strict=True):
                y = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                y = y / peak * 0.99 if peak else y
                pcm = (np.clip(y, -1.0, 1.0) * 32767.0).astype("<i2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sr], pa.int32()), pa.array([block], pa.int64()), pa.array([len(y)], pa.int64()), pa.array([pcm], pa.binary())], ["path", "sr", "block", "frames", "pcm"])

    return out.select("path", "block", "peak", "samples").mapInArrow(run, "path string, sr int, block long, frames long, pcm binary")


def wav_header(sr: int, frames: int, channels: int = 1) -> bytes:
    """The 44 bytes before the samples of a 16-bit WAV."""
    size = 2 * channels * frames
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, sr, 2 * channels * sr, 2 * channels, 16) + b"data" + struct.pack("<I", size)


def wav_parts(pcm: DataFrame) -> DataFrame:
    """``path, part, content``: each signal's file in parts, the header before the blocks (``path, sr, block, frames, pcm``)."""
    head = pcm.groupBy("path").agg(F.max("sr").alias("sr"), F.sum("frames").alias("frames"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [wav_header(sr, n) for sr, n in zip(b.column("sr").to_pylist(), b.column("frames").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([-1] * len(content), pa.int64()), pa.array(content, pa.binary())], ["path", "part", "content"])

    return pcm.select("path", F.col("block").alias("part"), F.col("pcm").alias("content")).unionByName(head.mapInArrow(run, "path string, part long, content binary"))


def digests(parts: DataFrame) -> DataFrame:
    """``path, n_bytes, sha256`` of contents in parts (``path, part, content``), one part in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, whole, size = None, None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([last]), pa.array([size], pa.int64()), pa.array([whole.hexdigest()])], ["path", "n_bytes", "sha256"])
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                if path != last:
                    if last is not None:
                        yield row()
                    last, whole, size = path, hashlib.sha256(), 0
                data = content.as_buffer()
                whole.update(data)
                size += data.size
        if last is not None:
            yield row()

    dealt = parts.repartition("path").sortWithinPartitions("path", "part")
    return dealt.select("path", "content").mapInArrow(run, "path string, n_bytes long, sha256 string")
