"""Verification metrics over rows ``is_pos boolean, score double``; a score at or above a threshold is accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import rounded, spaced
from quern.operators.ordered import order_statistics, running
from quern.sources.shared import kept


def _scores(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("is_pos").cast("boolean").alias("is_pos"), F.col("score").cast("double").alias("score")).where("is_pos IS NOT NULL AND score IS NOT NULL")


def _by_score(pairs: DataFrame) -> DataFrame:
    """``v, np, nn``: distinct scores with how many positives and negatives have them."""
    return _scores(pairs).groupBy(F.col("score").alias("v")).agg(F.count_if("is_pos").alias("np"), F.count_if(~F.col("is_pos")).alias("nn"))


def _totals(scores: DataFrame) -> DataFrame:
    return scores.agg(F.coalesce(F.sum("np"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("nn"), F.lit(0)).alias("n_neg"), F.min("v").alias("low"), F.max("v").alias("high"))


def _both(totals: DataFrame) -> DataFrame:
    empty = F.raise_error(F.lit("both positive and negative scores are needed")).cast("long")
    return totals.withColumn("n_pos", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("n_pos")).otherwise(empty))


def rates_at(scores: DataFrame, thresholds: DataFrame, totals: DataFrame) -> DataFrame:
    """``t, fpr, fnr`` for each threshold ``t``: scores and thresholds in one order, summed from below."""
    marks = thresholds.select(F.col("t").alias("v"), F.lit(0).cast("long").alias("np"), F.lit(0).cast("long").alias("nn"), F.lit(1).alias("mark"))
    rows = scores.select("v", "np", "nn", F.lit(0).alias("mark")).unionByName(marks).groupBy("v").agg(F.sum("np").alias("np"), F.sum("nn").alias("nn"), F.max("mark").alias("mark"))
    rows = running(rows, "v", {"pos_below": "np", "neg_below": "nn"}).where("mark = 1")
    fnr = F.col("pos_below") / F.greatest("n_pos", F.lit(1))
    fpr = F.lit(1.0) - F.col("neg_below") / F.greatest("n_neg", F.lit(1))
    return rows.join(F.broadcast(totals)).select(F.col("v").alias("t"), fpr.alias("fpr"), fnr.alias("fnr"))  # totals: one row


def auroc(pairs: DataFrame) -> DataFrame:
    """``auroc``: the chance that a positive scores above a negative, ties counting half; both sides are needed."""
    scores = kept(_by_score(pairs))
    rows = running(scores, "v", {"neg_below": "nn"})
    won = F.sum(F.col("np") * (F.col("neg_below") + F.col("nn") / 2))
    n = _both(rows.agg(won.alias("won"), F.coalesce(F.sum("np"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("nn"), F.lit(0)).alias("n_neg")))
    return n.select(rounded(F.col("won") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auroc"))


def far_frr(pairs: DataFrame, threshold: float) -> DataFrame:
    """``far, frr, threshold`` at one threshold; 0 positives give frr 0, 0 negatives far 1."""
    s = _scores(pairs).withColumn("low", F.col("score") < threshold)
    share = lambda side: F.count_if(side & F.col("low")) / F.greatest(F.count_if(side), F.lit(1))
    return s.agg(rounded(F.lit(1.0) - share(~F.col("is_pos"))).alias("far"), rounded(share(F.col("is_pos"))).alias("frr")).withColumn("threshold", F.lit(float(threshold)))


def eer(pairs: DataFrame, grid: int = 2001) -> DataFrame:
    """``eer, threshold``: where the error rates meet.

    Thresholds are all scores and an even grid from one below the least to one above the greatest. The first with the
    least difference of the rates counts; if the difference changes its sign to its left, the crossing is interpolated
    and the rates are read off there again. A difference of exactly 0 keeps its threshold.
    """
    scores = kept(_by_score(pairs))
    totals = _both(_totals(scores))
    ts = totals.select(F.explode(spaced(F.col("low") - 1.0, F.col("high") + 1.0, grid)).alias("t")).union(scores.select("v")).distinct()
    rates = kept(rates_at(scores, ts, totals)).withColumn("diff", F.col("fpr") - F.col("fnr"))
    best = rates.agg(F.min_by(F.struct("t", "fpr", "fnr", "diff"), F.struct(F.abs("diff"), "t")).alias("b"), F.min("t").alias("first"), F.max("t").alias("last"))
    left = rates.join(F.broadcast(best)).where("t < b.t").agg(F.max_by(F.struct("t", "diff"), "t").alias("a"))
    cross = (F.col("a.diff") * F.col("b.diff") <= 0) & (F.col("b.t") < F.col("last"))
    at = F.col("a.t") - F.col("a.diff") * (F.col("b.t") - F.col("a.t")) / F.nullif(F.col("b.diff") - F.col("a.diff"), F.lit(0.0))
    chosen = best.join(F.broadcast(left)).select(F.when(F.coalesce(cross, F.lit(False)) & (F.col("b.diff") != 0), F.coalesce(at, F.col("a.t"))).otherwise(F.col("b.t")).alias("t"))
    below: Column = F.col("v") < F.col("t")
    read = scores.join(F.broadcast(chosen)).groupBy("t").agg((F.sum(F.when(below, F.col("np")).otherwise(0)) / F.sum("np")).alias("fnr"), (F.lit(1.0) - F.sum(F.when(below, F.col("nn")).otherwise(0)) / F.sum("nn")).alias("fpr"))
    return read.select(rounded((F.col("fpr") + F.col("fnr")) / 2).alias("eer"), rounded("t").alias("threshold"))


def det_points(pairs: DataFrame, n: int = 40) -> DataFrame:
    """``point, fpr, fnr``: the rates at ``n`` quantiles of all scores, each pair of rates once, in order of threshold."""
    scores = kept(_by_score(pairs))
    qs = [0.001 + i * (0.998 / (n - 1)) if i < n - 1 else 0.999 for i in range(n)]
    found = order_statistics(scores.select("v", (F.col("np") + F.col("nn")).alias("n")), [], "v", "n", qs)
    ts = kept(found.select(F.col("value").alias("t")).distinct())
    rates = rates_at(scores, ts, _totals(scores)).select("t", rounded("fpr").alias("fpr"), rounded("fnr").alias("fnr"))
    once = rates.groupBy("fpr", "fnr").agg(F.min("t").alias("t"))  # n rows at most
    from pyspark.sql import Window

    return once.select(F.row_number().over(Window.orderBy("t")).alias("point"), "fpr", "fnr")


def rank_accuracy(ranks: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """``rank1, rank5, ...``: the share of rows whose 1-based ``rank`` is at most k."""
    return ranks.where("rank IS NOT NULL").agg(*[rounded(F.avg((F.col("rank") <= k).cast("double"))).alias(f"rank{k}") for k in ks])
