"""Audio files as rows: listing, WAV headers, samples of WAV and headerless PCM, and a WAV writer.

Files are read by Spark's binary source, so any store that Spark reads will do. A file that can't be decoded becomes a
row with ``error``; it never fails the job.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings.
AUDIO = ("wav", "pcm", "mp3", "flac", "m4a", "ogg", "aac", "wma")
OTHER = ("txt", "csv", "json", "md", "png", "jpg", "jpeg", "pdf", "py", "log")
LIMIT = 300 << 20
SCHEMA = "path string, sr int, channels int, frames long, width int, samples array<float>, error string"


def listing(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """``path, name, size, modified, kind`` (audio, other, unsupported) of files, without reading them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.when(ending.isin(*AUDIO), "audio").when(ending.isin(*OTHER), "other").otherwise("unsupported")
    return reader.load(path).select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), kind.alias("kind"))


def header(data: bytes) -> tuple[int, int, int, int, int, int]:
    """(rate, channels, frames, bytes per sample, where the samples start, format code) of a WAV; ValueError if it is none."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 24 <= len(data):
            code, channels, sr, _, _, bits = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
            if code == 0xFFFE and size >= 40:
                code = struct.unpack("<H", data[at + 32 : at + 34])[0]
            form = (sr, channels, bits // 8, code)
        elif name == b"data":
            if form is None or not form[1] or not form[2]:
                break
            sr, channels, width, code = form
            size = min(size, len(data) - at - 8)
            return sr, channels, size // (channels * width), width, at + 8, code
        at += 8 + size + size % 2
    raise ValueError("a WAV file without format or samples")


def samples(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (frames by channels) of a WAV, integers scaled to [-1, 1]."""
    sr, channels, frames, width, start, code = header(data)
    raw = data[start : start + frames * channels * width]
    if code == 3 and width in (4, 8):
        x = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    elif code == 1 and width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif code == 1 and width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif code == 1 and width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / 2147483648).astype(np.float32)
    elif code == 1 and width == 4:
        x = (np.frombuffer(raw, "<i4") / 2147483648).astype(np.float32)
    else:
        raise ValueError(f"WAV format {code} of {width} bytes is not supported")
    return sr, x.reshape(-1, channels)


def pcm(data: bytes, sr: int | None, dtype: str) -> tuple[int, np.ndarray]:
    if not sr:
        raise ValueError("headerless PCM needs a rate")
    scale = {"int16": ("<i2", 32768), "int32": ("<i4", 2147483648)}
    if dtype not in scale:
        raise ValueError(f"PCM of {dtype} is not supported")
    kind, most = scale[dtype]
    size = np.dtype(kind).itemsize
    return sr, (np.frombuffer(data[: len(data) // size * size], kind) / most).astype(np.float32)[:, None]


def read(spark: SparkSession, path: str, pcm_sr: int | None = None, pcm_dtype: str = "int16", header_only: bool = False, limit: int = LIMIT, pattern: str | None = None, channels: bool = False) -> DataFrame:
    """``path, sr, channels, frames, width, samples`` (the mean of the channels)``, error`` of the audio files below a path.

    Files over ``limit`` bytes are not read and become error rows; ``header_only`` leaves ``samples`` null. With
    ``channels`` the samples of all channels stay, one after the other for each frame.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        files = files.option("pathGlobFilter", pattern)
    files = files.load(path).withColumn("_ending", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))).where(F.col("_ending").isin(*AUDIO))
    large = files.where(F.col("length") > limit).select("path", F.concat(F.lit("over the limit of bytes: "), "length").alias("error"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = {"path": row["path"]}
                try:
                    if row["_ending"] == "pcm":
                        sr, x = pcm(row["content"], pcm_sr, pcm_dtype)
                        out |= {"sr": sr, "channels": 1, "frames": len(x), "width": 2 if pcm_dtype == "int16" else 4}
                    elif row["_ending"] == "wav":
                        sr, many, frames, width, _, _ = header(row["content"])
                        out |= {"sr": sr, "channels": many, "frames": frames, "width": width}
                        x = None if header_only else samples(row["content"])[1]
                    else:
                        raise ValueError(f"no decoder for .{row['_ending']}")
                    if not header_only:
                        out["samples"] = x.reshape(-1) if channels else x.mean(axis=1)
                except Exception as e:  # a bad file is a row of the result
                    out["error"] = f"{type(e).__name__}: {e}"
                names = ["path", "sr", "channels", "frames", "width", "samples", "error"]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float32()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([out.get(k)], t) for k, t in zip(names, kinds, strict=True)], names)

    got = files.where(F.col("length") <= limit).select("path", "content", "_ending").mapInArrow(decode, SCHEMA)
    return got.unionByName(large, allowMissingColumns=True)


def wav16(sr: int, x: np.ndarray) -> bytes:
    """A 16-bit WAV: clipped to [-1, 1], scaled by 32767, cut toward zero."""
    out = io.BytesIO()
    x = np.asarray(x)
    with wave.open(out, "wb") as w:
        w.setnchannels(1 if x.ndim == 1 else x.shape[1])
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes((np.clip(x, -1.0, 1.0) * 32767.0).astype("<i2").tobytes())
    return out.getvalue()
