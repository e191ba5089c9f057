"""A Spark data source that reads parts of audio files: headers alone, or blocks of samples with some of their neighbours'.

    spark.dataSource.register(WavSource)
    spark.read.format("quern_wav").load(folder)                                 # headers
    spark.read.format("quern_wav").option("block", 65536).load(folder)          # samples, block by block

A header costs the first bytes of a file and eight for each of its sections, whatever its size. Blocks are found by their
place in the file, so that a long file is read by many tasks and none holds more than a block of it. Files are opened by
Arrow's file systems; stores that only Spark reads go through ``audio.read``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quern.sources.audio import AUDIO

HEADER = "path string, size long, sr int, channels int, frames long, width int, error string"
BLOCKS = "path string, sr int, block long, first long, frames long, samples array<float>, error string"
#: Bytes of files that a task takes, headers of a task, and the most sections that a header is looked for in.
SPLIT, HEADERS, SECTIONS = 64 << 20, 500, 256
CODES = {(1, 1): ("u1", 128, 128), (1, 2): ("<i2", 0, 32768), (1, 4): ("<i4", 0, 2147483648), (3, 4): ("<f4", 0, 1), (3, 8): ("<f8", 0, 1)}


@dataclass(frozen=True)
class Sound:
    """Where the samples of a file are and what they are."""

    sr: int
    channels: int
    width: int
    code: int
    start: int
    frames: int


def wav_header(f: pa.NativeFile, size: int) -> Sound:
    """The header of an open WAV of ``size`` bytes, by reading the beginnings of its sections only."""
    begin = f.read(12)
    if len(begin) < 12 or begin[:4] != b"RIFF" or begin[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    for _ in range(SECTIONS):
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            break
        name, length = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            body = f.read(min(length, 40))
            if len(body) < 16:
                break
            code, channels, sr, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            code = struct.unpack("<H", body[24:26])[0] if code == 0xFFFE and len(body) >= 26 else code
            form = sr, channels, bits // 8, code
        elif name == b"data":
            if form is None or not form[1] or not form[2]:
                break
            sr, channels, width, code = form
            return Sound(sr, channels, width, code, at + 8, min(length, size - at - 8) // (channels * width))
        at += 8 + length + length % 2
    raise ValueError("a WAV file without format or samples")


def decoded(raw: bytes, sound: Sound) -> np.ndarray:
    """Frames as the mean of their channels, integers scaled to [-1, 1]."""
    if (sound.code, sound.width) == (1, 3):
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / 2147483648).astype(np.float32)
    elif (sound.code, sound.width) in CODES:
        kind, zero, scale = CODES[sound.code, sound.width]
        x = ((np.frombuffer(raw, kind).astype(np.float64) - zero) / scale).astype(np.float32)
    else:
        raise ValueError(f"WAV format {sound.code} of {sound.width} bytes is not supported")
    return x.reshape(-1, sound.channels).mean(axis=1)


@dataclass(frozen=True)
class Files(InputPartition):
    """Files with their sizes, and the bytes of each that the task answers for."""

    files: list[tuple[str, int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.schema = options, schema
        self.block = int(options.get("block", 0))
        self.before, self.after, self.after_ms = int(options.get("before", 0)), int(options.get("after", 0)), float(options.get("after_ms", 0))
        self.pcm_sr, self.pcm_dtype = int(options.get("pcm_sr", 0)), options.get("pcm_dtype", "int16")

    def partitions(self) -> list[Files]:
        """Lists the files, by name, and deals them out: so many headers, or so many bytes, to a task."""
        store, root = fs.FileSystem.from_uri(self.options["path"])
        at = store.get_file_info(root)
        found = [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        some = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.extension.lower() in AUDIO)
        if not self.block:
            return [Files([(p, n, 0, n) for p, n in some[i : i + HEADERS]]) for i in range(0, len(some), HEADERS)] or [Files([])]
        out, held, size = [], [], 0
        for path, n in some:
            for lo in range(0, max(n, 1), SPLIT):
                part = min(SPLIT, n - lo)
                if held and size + part > SPLIT:
                    out.append(Files(held))
                    held, size = [], 0
                held.append((path, n, lo, lo + part))
                size += part
        return [*out, Files(held)]

    def _sound(self, f: pa.NativeFile, path: str, size: int) -> Sound:
        ending = path.rsplit(".", 1)[-1].lower()
        if ending == "wav":
            return wav_header(f, size)
        if ending != "pcm":
            raise ValueError(f"no decoder for .{ending}")
        if not self.pcm_sr:
            raise ValueError("headerless PCM needs a rate")
        if self.pcm_dtype not in ("int16", "int32"):
            raise ValueError(f"PCM of {self.pcm_dtype} is not supported")
        width = 2 if self.pcm_dtype == "int16" else 4
        return Sound(self.pcm_sr, 1, width, 1, 0, size // width)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        names = self.schema.fieldNames()
        for path, size, lo, hi in partition.files:
            for row in self._rows(store, path, size, lo, hi):
                row["path"] = path if "://" in self.options["path"] else f"file:{path}"  # as Spark names them
                yield pa.RecordBatch.from_pylist([{k: row.get(k) for k in names}], self._types(names))

    def _types(self, names: list[str]) -> pa.Schema:
        kinds = {"path": pa.string(), "size": pa.int64(), "sr": pa.int32(), "channels": pa.int32(), "frames": pa.int64(), "width": pa.int32(), "error": pa.string(), "block": pa.int64(), "first": pa.int64(), "samples": pa.list_(pa.float32())}
        return pa.schema([(n, kinds[n]) for n in names])

    def _rows(self, store: fs.FileSystem, path: str, size: int, lo: int, hi: int) -> Iterator[dict]:
        try:
            with store.open_input_file(path) as f:
                s = self._sound(f, path, size)
                if not self.block:
                    yield {"size": size, "sr": s.sr, "channels": s.channels, "frames": s.frames, "width": s.width}
                    return
                wide = s.channels * s.width
                after = max(self.after, int(s.sr * self.after_ms / 1000) + 1 if self.after_ms else 0)
                first = -(-max(lo - s.start, 0) // (wide * self.block))  # the task has the blocks that begin among its bytes
                for block in range(first, -(-s.frames // self.block)):
                    begin = block * self.block
                    if s.start + begin * wide >= hi:
                        break
                    a, b = max(0, begin - self.before), min(s.frames, begin + self.block + after)
                    f.seek(s.start + a * wide)
                    yield {"sr": s.sr, "block": block, "first": a, "frames": s.frames, "samples": decoded(f.read((b - a) * wide), s)}
        except Exception as e:  # a bad file is a row of the result
            if lo == 0:
                yield {"size": size, "error": f"{type(e).__name__}: {e}"}


class WavSource(DataSource):
    """``quern_wav``; options: path, block, before, after, after_ms (of a second, if that is more), pcm_sr, pcm_dtype."""

    @classmethod
    def name(cls) -> str:
        return "quern_wav"

    def schema(self) -> str:
        return BLOCKS if int(self.options.get("block", 0)) else HEADER

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(dict(self.options), schema)


def _load(spark: SparkSession, path: str, **options: float | str | None) -> DataFrame:
    spark.dataSource.register(WavSource)
    reader = spark.read.format("quern_wav")
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load(path)


def readable(path: str) -> bool:
    """Whether Arrow's file systems can open a path."""
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def headers(spark: SparkSession, path: str, pcm_sr: int | None = None, pcm_dtype: str = "int16") -> DataFrame:
    """``path, size, sr, channels, frames, width, error`` of the audio files below a path, without reading their samples."""
    return _load(spark, path, pcm_sr=pcm_sr, pcm_dtype=pcm_dtype)


def sample_blocks(spark: SparkSession, path: str, block: int, before: int = 0, after: int = 0, after_ms: float = 0, pcm_sr: int | None = None, pcm_dtype: str = "int16") -> DataFrame:
    """``path, sr, block, first, frames, samples, error``: blocks of files of any length, each with its neighbours' samples that are asked for."""
    return _load(spark, path, block=block, before=before, after=after, after_ms=after_ms, pcm_sr=pcm_sr, pcm_dtype=pcm_dtype)
