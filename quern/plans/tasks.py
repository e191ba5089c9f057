"""Metrics from a task's JSON: one document that names its ``task`` and holds the inputs as arrays, one result row.

The document is read by Spark, its arrays become rows by position, and the operators do the rest. Inputs too large for one
document go to the operators as tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import classification, detection, openset, transcripts, verification
from quern.sources.records import safe_path, write_files

#: Fixed fields of a task's document.
SPEC = "task string, labels array<string>, y_true array<string>, y_pred array<string>, scores array<double>, pos_scores array<double>, neg_scores array<double>, threshold double, unknown_label string, refs array<string>, hyps array<string>, y_true_multihot array<array<int>>, y_score array<array<double>>, classes array<string>"


def spec(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a task's JSON file."""
    return spark.read.schema(SPEC).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def zipped(task: DataFrame, *fields: str) -> DataFrame:
    """Rows ``pos, <fields>`` of arrays that must be there and be equally long."""
    size = F.array(*[F.coalesce(F.size(f), F.lit(-1)) for f in fields])
    same = (F.array_min(size) == F.array_max(size)) & (F.array_min(size) >= 0)
    rows = F.when(same, F.arrays_zip(*fields)).otherwise(F.raise_error(F.lit(f"{', '.join(fields)} must be arrays of one length")))
    return task.select(F.posexplode(rows).alias("pos", "r")).select("pos", *[F.col("r")[f].alias(f) for f in fields])


def _one(**parts: DataFrame) -> DataFrame:
    """One row of structs from frames of one row each, or lists from longer ones ordered by their columns."""
    out = None
    for name, df in parts.items():
        row = F.struct(*df.columns)
        df = df.agg(F.sort_array(F.collect_list(row)).alias(name) if name in LISTS else F.first(row).alias(name)).withColumn("_", F.lit(1))
        out = df if out is None else out.join(df, "_")
    return out.drop("_")


#: Parts of a result that are lists, a bounded number of rows each (classes, their pairs, points of a grid).
LISTS = ("per_class", "confusion", "det_points", "oscr_curve")


def _classification(task: DataFrame, labels: list[str] | None, threshold: float | None) -> DataFrame:
    return classification.report(zipped(task, "y_true", "y_pred"), labels)


def _verification(task: DataFrame, labels: list[str] | None, threshold: float | None) -> DataFrame:
    side = lambda c, pos: task.select(F.explode(c).alias("score")).select(F.lit(pos).alias("is_pos"), "score")
    pairs = side("pos_scores", True).unionByName(side("neg_scores", False))
    found = _one(eer=verification.eer(pairs), auroc=verification.auroc(pairs), det_points=verification.det_points(pairs), **({"at_threshold": verification.far_frr(pairs, threshold)} if threshold is not None else {}))
    rest = [F.col("at_threshold")] if threshold is not None else []
    return found.select(F.col("eer.eer").alias("eer"), F.col("eer.threshold").alias("eer_threshold"), F.col("auroc.auroc").alias("auroc"), "det_points", *rest)


def _openset(task: DataFrame, labels: list[str] | None, threshold: float | None) -> DataFrame:
    unknown = task.select(F.coalesce("unknown_label", F.lit("unknown"))).first()[0]
    samples = zipped(task, "y_true", "y_pred", "scores").withColumnRenamed("scores", "score")
    return _one(oscr_summary=openset.oscr(samples, unknown), oscr_curve=openset.oscr_curve(samples, unknown))


def _asr(task: DataFrame, labels: list[str] | None, threshold: float | None) -> DataFrame:
    pairs = zipped(task, "refs", "hyps").select(F.col("refs").alias("ref"), F.col("hyps").alias("hyp"))
    found = _one(wer=transcripts.error_rate(pairs, "wer"), cer=transcripts.error_rate(pairs, "cer"))
    return found.select(F.col("wer.rate").alias("WER"), F.col("wer.errors").alias("errors"), F.col("wer.total_tokens").alias("total_tokens"), F.col("cer.rate").alias("cer"))


def _sed(task: DataFrame, labels: list[str] | None, threshold: float | None) -> DataFrame:
    names = task.select("classes").first()[0]
    wide = zipped(task, "y_true_multihot", "y_score").select("pos", F.col("y_true_multihot").alias("y"), F.col("y_score").alias("score"))
    cells, at = detection.long_form(wide, names), 0.5 if threshold is None else threshold
    return _one(map=detection.mean_ap(cells, at), per_class=detection.per_class(cells, at)).select(F.col("map.map").alias("map"), "per_class")


TASKS: dict[str, Callable[[DataFrame, list[str] | None, float | None], DataFrame]] = {"classification": _classification, "verification": _verification, "openset": _openset, "asr": _asr, "sed": _sed}


def evaluate(spark: SparkSession, path: str) -> DataFrame:
    """``status, task, metrics`` (a struct whose fields follow the task) of a task's JSON file; an unknown task is an error."""
    task = spec(spark, path)
    named = task.select("task", "labels", "threshold").first()  # the task's settings
    if named is None or named.task not in TASKS:
        raise ValueError(f"unknown task: {named and named.task!r} (there are {', '.join(TASKS)})")
    found = TASKS[named.task](task, named.labels, named.threshold)
    metrics: Column = F.struct(*found.columns)
    return found.select(F.lit("ok").alias("status"), F.lit(named.task).alias("task"), metrics.alias("metrics"))


def write_result(result: DataFrame, path: str) -> None:
    """The result as a JSON file; its name must be ``metrics_result.json``."""
    folder, _, name = path.rpartition("/")
    if name != "metrics_result.json":
        raise ValueError(f"a result's file is metrics_result.json, not {name!r}")
    text = F.to_json(F.struct("status", "task", "metrics"), {"ignoreNullFields": "false"})
    rows = result.select(F.lit(name).alias("file"), F.encode(text, "UTF-8").alias("content"))
    write_files(rows, safe_path(folder or ".", "."), replace=True)
