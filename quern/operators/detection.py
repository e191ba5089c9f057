"""Detection metrics over rows ``class, pos, y, score``: one row for each sample and class, ``pos`` giving the input order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import ratio, rounded
from quern.operators.ordered import running


def long_form(wide: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Rows from ``pos, y array<int>, score array<double>``; arrays of different length are an error."""
    same = F.when(F.size("y") == F.size("score"), F.arrays_zip("y", "score")).otherwise(F.raise_error(F.lit("y and score differ in shape")))
    rows = wide.select("pos", F.posexplode(same).alias("i", "cell"))
    name = F.element_at(F.array(*map(F.lit, classes)), F.col("i") + 1) if classes else F.concat(F.lit("class_"), F.col("i"))
    return rows.select(name.alias("class"), "pos", F.col("cell.y").alias("y"), F.col("cell.score").alias("score"))


def per_class(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``class, ap, f1``: average precision over descending scores (ties in input order; null without positives), F1 at the threshold."""
    s = cells.select("class", "pos", F.col("y").cast("long").alias("y"), F.col("score").cast("double").alias("score"))
    key = s.select("class", F.struct((-F.col("score")).alias("s"), "pos").alias("k"), "y", F.lit(1).cast("long").alias("one"))
    rows = running(key, "k", {"hits": "y", "seen": "one"}, by=["class"])
    precision = F.when(F.col("y") == 1, (F.col("hits") + 1) / (F.col("seen") + 1))
    ap = rows.groupBy("class").agg(F.sum(precision).alias("total"), F.sum("y").alias("positives"))
    ap = ap.select("class", rounded(F.try_divide("total", "positives")).alias("ap"))
    up = F.col("score") >= threshold
    n = s.groupBy("class").agg(F.count_if((F.col("y") == 1) & up).alias("tp"), F.count_if((F.col("y") == 0) & up).alias("fp"), F.count_if((F.col("y") == 1) & ~up).alias("fn"))
    f1 = rounded(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return n.select("class", f1.alias("f1")).join(ap, "class").select("class", "ap", "f1")


def mean_ap(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``map``: the mean of the classes' rounded average precisions, null if no class has positives."""
    return per_class(cells, threshold).agg(rounded(F.avg("ap")).alias("map"))
