"""Classification metrics over rows ``y_true, y_pred`` (any types; compared as text, rows with null skipped)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import ratio, rounded
from quern.sources.shared import kept


def _pairs(samples: DataFrame) -> DataFrame:
    text = samples.select(F.col("y_true").cast("string").alias("y_true"), F.col("y_pred").cast("string").alias("y_pred"))
    return text.where("y_true IS NOT NULL AND y_pred IS NOT NULL")


def accuracy(samples: DataFrame) -> DataFrame:
    """``accuracy``: the share of rows whose labels agree; null without rows."""
    return _pairs(samples).agg(rounded(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).alias("accuracy"))


def confusion(samples: DataFrame, labels: list[str] | None = None, dense: bool = True) -> DataFrame:
    """``y_true, y_pred, n`` for every pair of labels, zeros too; a label outside ``labels`` is an error.

    With many classes the zeros are most of the rows; without ``dense`` only pairs that occur are given.
    """
    counts = _pairs(samples).groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    if labels is None:
        names = counts.select(F.col("y_true").alias("label")).union(counts.select("y_pred")).distinct()
    else:
        names = samples.sparkSession.createDataFrame([(str(x),) for x in labels], "label string").distinct()
        known = F.array(*[F.lit(str(x)) for x in labels])
        bad = F.raise_error(F.concat(F.lit("label not listed: "), F.when(F.array_contains(known, F.col("y_true")), F.col("y_pred")).otherwise(F.col("y_true"))))
        counts = counts.withColumn("n", F.when(F.array_contains(known, F.col("y_true")) & F.array_contains(known, F.col("y_pred")), F.col("n")).otherwise(bad.cast("long")))
        counts = counts.where("n > 0")
    if not dense:
        return counts
    return _dense(counts, names)


def _dense(counts: DataFrame, names: DataFrame) -> DataFrame:
    """All pairs of labels with their counts, zeros too."""
    zero = F.lit(0).cast("long").alias("n")
    # every label meets every other: the square of the number of classes, which is the result's own size
    grid = names.select(F.col("label").alias("y_true"), F.lit(1).alias("_")).join(names.select(F.col("label").alias("y_pred"), F.lit(1).alias("_")), "_").select("y_true", "y_pred", zero)
    return counts.unionByName(grid).groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))


def _counted(samples: DataFrame, labels: list[str] | None) -> DataFrame:
    return confusion(samples, labels) if labels else _pairs(samples).groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def _of_cells(cells: DataFrame) -> DataFrame:
    """Each label's scores from the cells ``y_true, y_pred, n``."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    rows = cells.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), hit.alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed")))).alias("r")).select("r.*")
    s = rows.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"))
    p, r = ratio("tp", "guessed"), ratio("tp", "actual")
    f1 = ratio(2 * p * r, p + r)
    return s.select("label", rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(f1).alias("f1"), F.col("actual").alias("support"))


def per_class(samples: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``label, precision, recall, f1, support``; 0 where a denominator is 0."""
    return _of_cells(_counted(samples, labels))


def macro_f1(samples: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``macro_f1``: the mean of the rounded F1 of all labels, those without support included."""
    return per_class(samples, labels).agg(rounded(F.avg("f1")).alias("macro_f1"))


def report(samples: DataFrame, labels: list[str] | None = None, dense: bool = True) -> DataFrame:
    """One row with accuracy, macro F1, the classes and the confusion counts, the lists ordered by label.

    All of it comes from one table of the cells that occur. With many classes the zeros are most of the counts; without
    ``dense`` only pairs that occur are listed.
    """
    cells = kept(confusion(samples, labels, dense=False))
    if labels:
        names = samples.sparkSession.createDataFrame([(str(x),) for x in labels], "label string").distinct()
    else:
        names = cells.select(F.col("y_true").alias("label")).union(cells.select("y_pred")).distinct()
    none = names.select(F.col("label").alias("y_true"), F.col("label").alias("y_pred"), F.lit(0).cast("long").alias("n"))
    classes = _of_cells(cells.unionByName(none)).agg(F.sort_array(F.collect_list(F.struct("label", "precision", "recall", "f1", "support"))).alias("per_class"), rounded(F.avg("f1")).alias("macro_f1"))
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    whole = cells.agg(rounded(F.try_divide(right.cast("double"), F.sum("n").cast("double"))).alias("accuracy"))
    listed = (_dense(cells, names) if dense else cells).agg(F.sort_array(F.collect_list(F.struct("y_true", "y_pred", "n"))).alias("confusion"))
    return whole.join(F.broadcast(classes)).join(F.broadcast(listed)).select("accuracy", "macro_f1", "per_class", "confusion")  # one row each
