"""Open-set metrics over rows ``y_true, y_pred, score``; one label stands for the unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import ratio, rounded, spaced


def oscr_curve(samples: DataFrame, unknown: str = "unknown", n: int = 100) -> DataFrame:
    """``threshold, tpi_rate, fpi_rate, oscr`` at ``n`` even thresholds from the least score to just above the greatest.

    Accepted known samples with the right label are true identifications; accepted wrong and unknown ones are false.
    Without known samples it is an error.
    """
    s = samples.select(F.col("y_true").cast("string").alias("y_true"), F.col("y_pred").cast("string").alias("y_pred"), F.col("score").cast("double").alias("score")).where("y_true IS NOT NULL AND score IS NOT NULL")
    known = F.col("y_true") != unknown
    right = known & F.coalesce(F.col("y_true") == F.col("y_pred"), F.lit(False))
    by = s.groupBy("score").agg(F.count_if(right).alias("good"), F.count_if(~right).alias("bad"), F.count_if(known).alias("known"), F.count("*").alias("all"))
    t = by.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("known").alias("n_known"), F.sum("all").alias("n_all"))
    t = t.withColumn("n_known", F.when(F.col("n_known") > 0, F.col("n_known")).otherwise(F.raise_error(F.lit("known samples are needed")).cast("long")))
    t = t.withColumn("grid", spaced(F.col("low"), F.col("high") + 1e-9, n))
    # a score is accepted by the thresholds up to it: count scores by the last such threshold, then sum from above
    last = F.size(F.filter("grid", lambda g: g <= F.col("score")))
    bins = by.join(F.broadcast(t)).groupBy(last.alias("bin")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    marks = t.select(F.posexplode("grid").alias("i", "threshold"), "n_known", "n_all").select((F.col("i") + 1).alias("i"), "threshold", "n_known", "n_all")
    up = lambda c: F.coalesce(F.sum(F.when(F.col("bin") >= F.col("i"), F.col(c))), F.lit(0))
    rows = marks.join(F.broadcast(bins)).groupBy("i", "threshold", "n_known", "n_all").agg(up("good").alias("tpi"), up("bad").alias("fpi"))  # n x n rows
    return rows.select("threshold", rounded(ratio("tpi", "n_known")).alias("tpi_rate"), rounded(ratio("fpi", "n_all")).alias("fpi_rate"), ratio("tpi", F.col("tpi") + F.col("fpi")).alias("oscr"), "n_known", (F.col("n_all") - F.col("n_known")).alias("n_unknown"))


def oscr(samples: DataFrame, unknown: str = "unknown", n: int = 100) -> DataFrame:
    """``oscr, threshold, n_known, n_unknown``: the best point of the curve, the first of equals."""
    best = oscr_curve(samples, unknown, n).agg(F.min_by(F.struct("oscr", "threshold", "n_known", "n_unknown"), F.struct(-F.col("oscr"), "threshold")).alias("b"))
    return best.select(rounded("b.oscr").alias("oscr"), rounded("b.threshold").alias("threshold"), "b.n_known", "b.n_unknown")
