"""PNG images made by hand, figures without blanks and copies, and records that arrive one by one."""

from __future__ import annotations

import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.functions import png
from quern.operators import layout, tracker
from quern.sources import records
from quern.streaming import records as arriving


def filtered(rows: np.ndarray, step: int, kind: int) -> bytes:
    """Rows of bytes under one of the five filters, by definition."""
    out, up = [], np.zeros(rows.shape[1], int)
    for row in rows.astype(int):
        left, corner = np.r_[np.zeros(step, int), row[:-step]], np.r_[np.zeros(step, int), up[:-step]]
        p = left + up - corner
        nearest = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * row, left, up, (left + up) // 2, nearest][kind]
        out.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        up = row
    return b"".join(out)


def image(pixels: np.ndarray, colour: int, kind: int = 0, depth: int = 8, palette: bytes = b"") -> bytes:
    height, width = pixels.shape[:2]
    rows = pixels.reshape(height, -1)
    if depth < 8:
        bits = (rows[:, :, None] >> np.arange(depth)[::-1] & 1).reshape(height, -1)
        rows = np.packbits(bits.astype(np.uint8), axis=1)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    data = zlib.compress(filtered(rows, max(1, png.SAMPLES[colour] * depth // 8), kind))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return png.SIGNATURE + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", data[:20]) + chunk(b"IDAT", data[20:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_levels(kind: int) -> None:
    rng = np.random.default_rng(kind)
    mixed = lambda x: (x[..., 0] * 19595 + x[..., 1] * 38470 + x[..., 2] * 7471 + 32768) >> 16
    for colour in png.SAMPLES:
        x = rng.integers(0, 256, (13, 17, png.SAMPLES[colour]))
        if colour == 3:
            palette = rng.integers(0, 256, (256, 3))
            assert np.array_equal(png.grey(image(x, 3, kind, palette=palette.astype(np.uint8).tobytes())), mixed(palette[x[..., 0]]))
        else:
            want = x[..., 0] if colour in (0, 4) else mixed(x)
            assert np.array_equal(png.grey(image(x, colour, kind)), want), colour
    for depth in (1, 2, 4):
        x = rng.integers(0, 1 << depth, (9, 21, 1))
        assert np.array_equal(png.grey(image(x, 0, kind, depth)), x[..., 0] * (255 // ((1 << depth) - 1)))


def test_blank_images() -> None:
    flat = np.full((50, 200, 1), 250)
    assert png.level_count(image(flat, 0)) == 1
    framed = np.array(flat)
    framed[:, 100:] = 0
    assert png.level_count(image(framed, 0)) > 2  # the edge is blurred
    halves = np.repeat(np.repeat(np.arange(64)[None, :, None] % 2 * 255, 64, axis=0), 1, axis=1)
    assert png.level_count(image(halves, 0)) == 2  # of the same size nothing is blurred
    assert png.level_count(b"no image") is None and png.level_count(None) is None and png.level_count(image(flat, 0)[:60]) is None
    assert np.array_equal(png.resized(np.full((7, 300), 9, np.uint8)), np.full((64, 64), 9))


def test_figures_without_blanks_and_copies(spark: SparkSession) -> None:
    rng = np.random.default_rng(1)
    a, b = (image(rng.integers(0, 256, (30, 30, 1)), 0) for _ in range(2))
    blank = image(np.full((30, 30, 1), 255), 0)
    rows = [(1, 0, 10.0, a), (1, 0, 20.0, blank), (1, 0, 30.0, a), (1, 1, 5.0, blank), (1, 1, 9.0, b), (1, 2, 1.0, None), (1, 2, 2.0, b"broken"), (2, 0, 1.0, a)]
    found = spark.createDataFrame([(d, p, 0.0, y, 50.0, y + 50, 0.9, None, "", c) for d, p, y, c in rows], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, cover double, label string, caption string, content binary")
    got = sorted((r.doc_id, r.place, r.file, r.rect_pt[1], None if r.content is None else bytes(r.content)) for r in layout.manifest(found).collect())
    assert got == [(1, 1, "figures/fig_001_p1.png", 10.0, a), (1, 2, "figures/fig_002_p2.png", 9.0, b), (1, 3, "figures/fig_003_p3.png", 1.0, None), (1, 4, "figures/fig_004_p3.png", 2.0, b"broken"), (2, 1, "figures/fig_001_p1.png", 1.0, a)]
    assert [r.place for r in layout.manifest(found.drop("content")).where("doc_id = 1").orderBy("place").collect()] == [1, 2, 3, 4, 5, 6, 7]


def test_conflicts_as_they_arrive(spark: SparkSession, tmp_path: Path) -> None:
    """A stream over a folder, stopped and taken up again, finds the groups that a batch finds."""
    folder = tmp_path / "in"
    folder.mkdir()

    def put(k: int, name: str, split: str | None, eer: float) -> None:
        row = {"schema_version": 1, "name": name, "timestamp": "2026-01-01T00:00:00", "metrics": {"eer": eer}, "config": {}, "notes": "", "split_fingerprint": split and {"file": "f", "sha256": split}}
        (folder / f"r{k:03d}.json").write_text(json.dumps(row))

    def run() -> None:
        query = arriving.conflicts(arriving.arriving(spark, str(folder), 2)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k, row in enumerate([("a", "s", 0.1), ("a", "s", 0.1), ("b", None, 0.2), ("a", "t", 0.3)]):
            put(k, *row)
        (folder / "SUMMARY_x.json").write_text('{"metrics": {"a": 1}}')
        (folder / "bad.json").write_text("{")
        run()
        for k, row in enumerate([("b", None, 0.2), ("a", "s", 0.4), ("b", None, 0.5), ("a", "s", 0.4), ("a", "s", 0.6)], 4):
            put(k, *row)
        run()
        got = spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r.name, r.split, r.file) for r in got) == [("a", "s", "r005.json"), ("a", "s", "r008.json"), ("b", None, "r006.json")]
    batch = records.records(spark, str(folder)).withColumn("split", F.col("split_fingerprint.sha256"))
    want = {(r["name"], r["split"], r.results) for r in tracker.duplicate_runs(batch).collect()}
    assert {(r.name, r.split, max(x.results for x in got if (x.name, x.split) == (r.name, r.split))) for r in got} == want
