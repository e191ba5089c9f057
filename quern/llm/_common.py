"""What the operators of this subpackage share: words, bounded Arrow pieces and the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables that ``cut`` has written in this process.
_cuts: list[str] = []
#: Lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z; every byte that is not part of an alphanumeric word becomes a space.
ALNUM = bytes(LOWER[b] if b >= 0x80 or chr(LOWER[b]).isalnum() else 32 for b in range(256))


def space_words(data: bytes, lower: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text."""
    return (data.translate(LOWER) if lower else data).split()


def alnum_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of A-Z-lower-cased UTF-8 text."""
    return data.translate(ALNUM).split()


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a piece take at most ``limit`` bytes; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < len(total):
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints, which all executors share.

    Where none is set a session on one machine gets a folder of its own (tests); on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back when it ends, rather than when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of ours, if the session is still there."""
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # noqa: BLE001  the session has ended, or the interpreter is about to
        return


def cut(df: DataFrame) -> DataFrame:
    """The rows written as a table to the shared folder and read back: lost executors cost no recomputation of them.

    The table is deleted when the session's Python process ends, or before that by ``scope``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quern/{uuid.uuid4().hex}"
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    _cuts.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were cut inside; results that read them must have been written by then."""
    before = len(_cuts)
    try:
        yield
    finally:
        for path in _cuts[before:]:
            _remove(spark, path)
        del _cuts[before:]


class Kept(dict):
    """Values by key, made when missing and kept for a while: the last ``keep`` to ``2 * keep`` keys that were asked for."""

    def __init__(self, make: Callable, keep: int) -> None:
        super().__init__()
        self.make, self.keep, self.before = make, keep, {}

    def __missing__(self, key):
        if (value := self.before.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.keep:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """``doc_id long, text``; a plain selection where ids are long already, so that equal scans stay equal to the planner."""
    if dict(docs.dtypes)["doc_id"] == "bigint":
        return docs.select("doc_id", "text")
    return docs.select(F.col("doc_id").cast("long"), "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
