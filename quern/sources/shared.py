"""Tables in the folder that a cluster's executors share: what several branches of a plan read is worked out once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The tables that ``kept`` has written in this process, with the session that wrote them.
_ours: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. A session on one machine without it gets a folder of its own; a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The rows, written as a table and read back. Lost executors cost no recomputation of them; see ``tidy``."""
    spark = df.sparkSession
    path = f"{folder(spark)}/quern/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _ours.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Deletes the tables that ``kept`` has written so far; frames that read them end with that."""
    while _ours:
        spark, name = _ours.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit() -> None:
    try:
        tidy()
    except Exception:  # noqa: BLE001  the session has ended, or the interpreter is about to
        return


atexit.register(_at_exit)
