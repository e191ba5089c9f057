"""Experiment records as they arrive: each is held against the runs of its name and split that came before it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.sources.records import RECORD

CONFLICTS = "name string, split string, file string, runs long, results long"


def arriving(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """Records of a folder as a stream of files, by the rules of ``sources.records.records``."""
    schema = f"{RECORD}, _corrupt_record string"
    rows = spark.readStream.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", per_batch).json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    return rows.where("metrics IS NOT NULL AND NOT startswith(file, 'SUMMARY') AND NOT startswith(file, 'metrics_result')").drop("_corrupt_record")


class Runs(StatefulProcessor):
    """For each name and split: how many runs there were, and their different results by hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "runs long")
        self.results = handle.getMapState("results", "hash string", "file string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        runs = self.count.get()[0] if self.count.exists() else 0
        known = {k[0] for k in self.results.keys()} if runs else set()
        out = []
        for frame in rows:
            for file, result in sorted(zip(frame["file"], frame["result"], strict=True)):
                runs += 1
                if result not in known:
                    self.results.updateValue((result,), (file,))
                    known.add(result)
                    if len(known) > 1:  # a run at odds with an earlier one
                        out.append((frame["name"].iloc[0], frame["split"].iloc[0], file, runs, len(known)))
        self.count.update((runs,))
        yield pd.DataFrame(out, columns=["name", "split", "file", "runs", "results"])

    def close(self) -> None:
        pass


def conflicts(records: DataFrame) -> DataFrame:
    """``name, split, file, runs, results``: each record whose metrics no earlier run of its name and split had, if there was one.

    No split is a split too. State is kept by key: a count, and one entry for each different result.
    """
    canonical = F.to_json(F.sort_array(F.transform(F.map_entries("metrics"), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("value")))))
    keyed = records.select("name", F.col("split_fingerprint.sha256").alias("split"), "file", F.sha2(canonical, 256).alias("result"))
    keyed = keyed.select("*", F.to_json(F.struct("name", "split")).alias("key"))
    return keyed.groupBy("key").transformWithStateInPandas(statefulProcessor=Runs(), outputStructType=CONFLICTS, outputMode="Append", timeMode="None")
