"""The data source that reads parts of audio files, and the sink that shows whole jobs or nothing."""

from __future__ import annotations

import json
import struct
import wave
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.functions import kernels
from quern.operators import long_signals, signals
from quern.sources import audio, file_sink, shared, wav_source


@pytest.fixture
def folder(tmp_path: Path) -> Path:
    rng = np.random.default_rng(3)
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.wav").write_bytes(audio.wav16(8000, 0.5 * np.sin(np.arange(50_000) / 7)))
    (root / "sub" / "two.wav").write_bytes(audio.wav16(16000, rng.uniform(-1, 1, (20_011, 2))))
    (root / "none.wav").write_bytes(audio.wav16(8000, np.zeros(0)))
    with wave.open(str(root / "three.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(3)
        w.setframerate(8000)
        w.writeframes(rng.integers(0, 256, 3 * 5001, np.uint8).tobytes())
    floats = rng.normal(0, 0.1, 6000).astype("<f4").tobytes()
    junk = b"LIST" + struct.pack("<I", 3_000_000) + bytes(3_000_000)  # a large section before the samples
    (root / "far.wav").write_bytes(b"RIFF" + struct.pack("<I", 36 + len(junk) + len(floats)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 8000, 32000, 4, 32) + junk + b"data" + struct.pack("<I", len(floats)) + floats)
    (root / "raw.pcm").write_bytes(rng.integers(-9999, 9999, 4001).astype("<i2").tobytes())
    (root / "bad.wav").write_bytes(b"RIFF")
    (root / "song.mp3").write_bytes(b"ID3")
    (root / "notes.txt").write_text("x")
    return root


def named(path: str) -> str:
    return path.rsplit("/", 1)[1]


def test_headers_are_those_of_whole_files(spark: SparkSession, folder: Path) -> None:
    columns = ("sr", "channels", "frames", "width")
    whole = {r.path: r for r in audio.read(spark, str(folder), pcm_sr=4000).collect()}
    got = {r.path: r for r in wav_source.headers(spark, str(folder), pcm_sr=4000).collect()}
    assert got.keys() == whole.keys()
    for path, r in whole.items():
        assert (r.error is None) == (got[path].error is None), path
        assert r.error is not None or [r[c] for c in columns] == [got[path][c] for c in columns], path
    assert got[next(p for p in got if p.endswith("far.wav"))]["size"] == (folder / "far.wav").stat().st_size
    one = wav_source.headers(spark, str(folder / "a.wav")).collect()
    assert [(named(r.path), r.frames) for r in one] == [("a.wav", 50_000)]


def test_headers_read_few_bytes(folder: Path) -> None:
    """Of a file with megabytes before and in its samples, less than two hundred bytes."""
    store, read = fs.LocalFileSystem(), []

    class Counted:
        def __init__(self, f: pa.NativeFile) -> None:
            self.f = f

        def read(self, n: int) -> bytes:
            read.append(n)
            return self.f.read(n)

        def seek(self, at: int) -> None:
            self.f.seek(at)

    for name in ("far.wav", "a.wav", "sub/two.wav"):
        read.clear()
        with store.open_input_file(str(folder / name)) as f:
            sound = wav_source.wav_header(Counted(f), (folder / name).stat().st_size)
        assert sound.frames > 0 and sum(read) < 200, name


@pytest.mark.parametrize(("block", "before", "after", "split"), [(1000, 0, 0, 64 << 20), (777, 10, 300, 5000), (60_000, 5, 5, 1000), (1, 0, 0, 20_000)])
def test_blocks_of_files(spark: SparkSession, folder: Path, monkeypatch, block: int, before: int, after: int, split: int) -> None:
    """Every sample in its block once, with its neighbours' around it, however the bytes are dealt out."""
    monkeypatch.setattr(wav_source, "SPLIT", split)
    if block == 1:
        for name in ("a.wav", "far.wav", "sub/two.wav", "three.wav"):
            (folder / name).unlink()
    whole = {r.path: r.samples for r in audio.read(spark, str(folder), pcm_sr=4000).collect() if r.error is None}
    reader = wav_source.WavReader({"path": str(folder), "block": str(block), "before": str(before), "after": str(after), "pcm_sr": "4000"}, wav_source.WavSource({"path": "", "block": "1"}) and spark.createDataFrame([], wav_source.BLOCKS).schema)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    seen = {}
    for r in rows:
        if r["error"] is None:
            x = whole[r["path"]]
            assert (r["path"], r["block"]) not in seen and r["frames"] == len(x)
            a, b = max(0, r["block"] * block - before), min(len(x), (r["block"] + 1) * block + after)
            assert r["first"] == a and np.allclose(r["samples"], x[a:b], atol=1e-6)
            seen[r["path"], r["block"]] = 1
    assert len(seen) == sum(-(-len(x) // block) for x in whole.values())
    assert {named(r["path"]) for r in rows if r["error"]} == {"bad.wav", "song.mp3"}


def test_features_of_files_in_blocks(spark: SparkSession, folder: Path) -> None:
    got = {r.path: r.asDict() for r in long_signals.features_of_blocks(wav_source.sample_blocks(spark, str(folder), 2048, after=1025, after_ms=40), signals.FEATURES, 2048).collect()}
    want = {r.path: r.asDict() for r in signals.features(audio.read(spark, str(folder)).where("error IS NULL AND size(samples) > 0"), signals.FEATURES).collect()}
    assert got.keys() == want.keys() and len(want) == 4
    for path, row in want.items():
        for name, value in row.items():
            assert name == "path" or got[path][name] == pytest.approx(value, abs=0.11 if name.endswith("hz") else 0.0101), (path, name)


def test_files_come_whole_or_not_at_all(spark: SparkSession, tmp_path: Path) -> None:
    root = tmp_path / "out"
    rows = spark.range(0, 200, 1, 4).select(F.concat(F.lit("d/f"), "id").alias("file"), F.col("id").cast("string").cast("binary").alias("content"))
    bad = rows.withColumn("content", F.when(F.col("file") != "d/f150", F.col("content")).otherwise(F.raise_error(F.lit("no")).cast("binary")))
    with pytest.raises(Exception, match="no"):
        file_sink.write(bad, str(root))
    assert not list(root.rglob("*")) if root.exists() else True
    file_sink.write(rows, str(root), manifest="all.json")
    assert {p.name: p.read_text() for p in (root / "d").iterdir()} == {f"f{i}": str(i) for i in range(200)}
    listed = [json.loads(x) for x in (root / "all.json").read_text().splitlines()]
    assert len(listed) == 200 and listed[0] == {"file": "d/f0", "size": 1, "sha256": "5feceb66ffc86f38d952786c6d696c79c2dbc239dd4e91b46729d73a27fb57e9"}
    file_sink.write(rows.limit(20), str(root))  # the same content may come again
    other = rows.limit(20).withColumn("content", F.lit(b"other"))
    new = rows.limit(1).withColumn("file", F.lit("new"))
    with pytest.raises(Exception, match="other content"):
        file_sink.write(other.unionByName(new), str(root))
    assert not (root / "new").exists() and (root / "d" / "f0").read_text() == "0"
    file_sink.write(other, str(root), replace=True)
    assert sum(p.read_text() == "other" for p in (root / "d").iterdir()) == 20
    with pytest.raises(Exception, match="two rows name one file"):
        file_sink.write(new.unionByName(new), str(root))
    for name in ("../x", "/x", "a//b", ""):
        with pytest.raises(Exception, match="not a name"):
            file_sink.write(new.withColumn("file", F.lit(name)), str(root))
    assert not [p for p in root.iterdir() if p.name.startswith("_writing")] and not (tmp_path / "x").exists()


def test_files_in_parts(spark: SparkSession, tmp_path: Path) -> None:
    """A converted signal is written block by block, as the whole one would be."""
    x = np.random.default_rng(5).uniform(-1, 1, 30_000).astype(np.float32)
    samples = long_signals.cut(spark.createDataFrame([("a", 16000, x.tolist()), ("b", 16000, x[:100].tolist())], "path string, sr int, samples array<float>"))
    parts = long_signals.wav_parts(long_signals.converted(samples, 8000, size=1000))
    file_sink.write(parts.select(F.concat("path", F.lit(".wav")).alias("file"), "part", "content"), str(tmp_path))
    for name, y in (("a", x), ("b", x[:100])):
        assert (tmp_path / f"{name}.wav").read_bytes() == audio.wav16(8000, kernels.resampled(y.astype(np.float64), 16000, 8000))


def test_kept_tables_go(spark: SparkSession) -> None:
    rows = shared.kept(spark.range(5))
    (path,) = {f.rsplit("/", 1)[0].removeprefix("file:").replace("//", "/") for f in rows.inputFiles()}
    assert rows.count() == 5 and Path(path).is_dir()
    shared.tidy()
    assert not Path(path).exists()
