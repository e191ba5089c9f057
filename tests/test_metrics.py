"""Evaluation metrics on small inputs whose results were worked out by hand."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.numbers import rounded
from quern.operators import classification, detection, openset, signals, transcripts, verification


def one(df: DataFrame) -> tuple:
    (row,) = df.collect()
    return tuple(row)


def labels(spark: SparkSession, true: Iterable, pred: Iterable) -> DataFrame:
    return spark.createDataFrame(list(zip(true, pred, strict=True)), "y_true string, y_pred string")


def pairs(spark: SparkSession, pos: list[float], neg: list[float]) -> DataFrame:
    return spark.createDataFrame([(True, s) for s in pos] + [(False, s) for s in neg], "is_pos boolean, score double")


def test_classification(spark: SparkSession) -> None:
    s = labels(spark, "AB", "AA")
    assert one(classification.accuracy(s)) == (0.5,)
    assert sorted(map(tuple, classification.per_class(s).collect())) == [("A", 0.5, 1.0, 0.666667, 1), ("B", 0.0, 0.0, 0.0, 1)]
    assert sorted(map(tuple, classification.confusion(s).collect())) == [("A", "A", 1), ("A", "B", 0), ("B", "A", 1), ("B", "B", 0)]
    assert sorted(map(tuple, classification.confusion(s, dense=False).collect())) == [("A", "A", 1), ("B", "A", 1)]
    assert one(classification.macro_f1(s)) == (0.333334,)  # bround half even of 0.3333335
    with pytest.raises(Exception, match="label not listed"):
        classification.confusion(s, ["A"]).collect()
    assert one(classification.accuracy(s.where("false"))) == (None,)


@pytest.mark.parametrize(
    ("pos", "neg", "eer", "auroc"),
    [
        ([0.8, 0.9], [0.2, 0.3], (0.0, 0.30025), 1.0),
        ([0.9, 0.8, 0.6, 0.4], [0.7, 0.5, 0.4, 0.1], (0.25, 0.5014), 0.78125),
        ([0.5, 0.5], [0.5, 0.5], (0.5, -0.5), 0.5),
        ([0.9, 0.6, 0.55], [0.7, 0.2], (0.583333, 0.60065), 0.666667),
    ],
)
def test_verification(spark: SparkSession, pos: list, neg: list, eer: tuple, auroc: float) -> None:
    s = pairs(spark, pos, neg)
    assert one(verification.eer(s)) == eer
    assert one(verification.auroc(s)) == (auroc,)
    points = verification.det_points(s).collect()
    assert len({(r.fpr, r.fnr) for r in points}) == len(points) <= 40


def test_rates_at_a_threshold(spark: SparkSession) -> None:
    assert one(verification.far_frr(pairs(spark, [0.9, 0.8, 0.6, 0.4], [0.7, 0.5, 0.4, 0.1]), 0.5)) == (0.5, 0.25, 0.5)


def test_one_side_missing(spark: SparkSession) -> None:
    for run in (verification.auroc, verification.eer):
        with pytest.raises(Exception, match="both positive and negative"):
            run(pairs(spark, [0.5], [])).collect()


def test_ranks(spark: SparkSession) -> None:
    assert one(verification.rank_accuracy(spark.createDataFrame([(1,), (2,), (6,)], "rank int"))) == (0.333333, 0.666667)


@pytest.mark.parametrize(
    ("true", "pred", "scores", "want"),
    [("AU", "AA", [0.9, 0.7], (1.0, 0.70202, 1, 1)), ("ABUA", "AAUA", [0.9, 0.8, 0.7, 0.6], (1.0, 0.8, 3, 1))],
)
def test_open_set(spark: SparkSession, true: str, pred: str, scores: list, want: tuple) -> None:
    s = spark.createDataFrame(list(zip(true, pred, scores, strict=True)), "y_true string, y_pred string, score double")
    r = openset.oscr(s, "U").collect()[0]
    assert (round(r.oscr, 6), round(r.threshold, 6), r.n_known, r.n_unknown) == want
    assert openset.oscr_curve(s, "U").count() == 100


@pytest.mark.parametrize(
    ("ref", "hyp", "level", "want"),
    [
        ("the cat sat on mat", "the cat sit mat now", "wer", (0.6, 3, 5)),
        ("四个汉字", "四个汉", "cer", (0.25, 1, 4)),
        ("四个汉字", "四个汉", "wer", (1.0, 1, 1)),
        ("", "two words", "wer", (0.0, 2, 0)),
        (None, None, "cer", (0.0, 0, 0)),
        ("　a b ", "a b", "wer", (0.0, 0, 2)),
    ],
)
def test_error_rates(spark: SparkSession, ref: str, hyp: str, level: str, want: tuple) -> None:
    assert one(transcripts.error_rate(spark.createDataFrame([(ref, hyp)], "ref string, hyp string"), level)) == want


def test_words_of_long_pairs(spark: SparkSession) -> None:
    """More distinct words than there are letters, and every short pair."""
    from itertools import product

    def plain(a: list, b: list) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    words = [list(x) for n in range(5) for x in product("ab", repeat=n)]
    assert all(transcripts.sequence_distance(a, b) == plain(a, b) for a in words for b in words)
    many = [str(i) for i in range(30_000)]
    assert one(transcripts.error_rate(spark.createDataFrame([(" ".join(many), " ".join(many[1:] + ["x"]))], "ref string, hyp string"))) == (0.000067, 2, 30_000)


def test_unknown_level(spark: SparkSession) -> None:
    with pytest.raises(ValueError):
        transcripts.error_rate(spark.createDataFrame([("a", "b")], "ref string, hyp string"), "per")


@pytest.mark.parametrize(("y", "scores", "ap"), [([1, 0, 1], [0.5] * 3, 0.833333), ([0, 1, 1], [0.5] * 3, 0.583333), ([1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1], 0.833333), ([0, 0], [0.1, 0.2], None)])
def test_average_precision(spark: SparkSession, y: list, scores: list, ap: float | None) -> None:
    cells = spark.createDataFrame([("c", i, a, s) for i, (a, s) in enumerate(zip(y, scores, strict=True))], "class string, pos int, y int, score double")
    assert detection.per_class(cells).first().ap == ap


def test_detection(spark: SparkSession) -> None:
    wide = spark.createDataFrame([(0, [1, 0], [0.9, 0.2])], "pos int, y array<int>, score array<double>")
    cells = detection.long_form(wide)
    assert sorted(map(tuple, detection.per_class(cells).collect())) == [("class_0", 1.0, 1.0), ("class_1", None, 0.0)]
    assert one(detection.mean_ap(cells)) == (1.0,)
    with pytest.raises(Exception, match="differ in shape"):
        detection.long_form(spark.createDataFrame([(0, [1], [0.9, 0.2])], wide.schema)).collect()


def test_numbers(spark: SparkSession) -> None:
    assert one(spark.range(1).select(rounded(F.lit(1 / 128)).alias("x"))) == (0.007812,)
    values = spark.createDataFrame([(float(i),) for i in (3, 1, 4, 2)], "d double")
    assert {r.share: r.value for r in signals.lower_quantiles(values, "d").collect()} == {0.0: 1.0, 0.25: 2.0, 0.5: 3.0, 0.75: 4.0, 1.0: 4.0}


def test_auroc_against_all_pairs(spark: SparkSession) -> None:
    pos, neg = [(i * 7 % 13) / 10 for i in range(60)], [(i * 5 % 11) / 10 for i in range(80)]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(one(verification.auroc(pairs(spark, pos, neg)))[0], want, abs_tol=1e-6)


@pytest.mark.parametrize("parts", [8, 200])
def test_order_of_a_million_scores(spark: SparkSession, parts: int) -> None:
    """Running sums agree with numpy whatever the number of ranges, and from run to run."""
    import numpy as np

    n = 1_000_000
    s = spark.range(n, numPartitions=8).select((F.xxhash64("id") % 3 == 0).alias("is_pos"), (F.xxhash64("id", F.lit(1)) / 2.0**63).alias("score"))
    rows = s.toPandas()
    score, pos = rows.score.to_numpy(), rows.is_pos.to_numpy()
    below = np.argsort(np.argsort(score))
    p, m = int(pos.sum()), int((~pos).sum())
    want = ((below[pos] + 1).sum() - p * (p + 1) / 2) / (p * m)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {one(verification.auroc(s)) for _ in range(2 if parts == 8 else 1)}
        if parts > 8:
            assert got == {(round(want, 6),)}
            return
        (point,) = [tuple(r) for r in verification.det_points(s).where("point = 20").collect()]
        rate = one(verification.eer(s))
        shares = {r.share: r.value for r in signals.lower_quantiles(s, "score").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {(round(want, 6),)}
    t = np.quantile(score, 0.001 + 19 * 0.998 / 39)
    assert point[1:] == (round(float((score[~pos] >= t).mean()), 6), round(float((score[pos] < t).mean()), 6))
    ordered = np.sort(score)
    assert shares == {q: ordered[min(int(n * q), n - 1)] for q in (0.0, 0.25, 0.5, 0.75, 1.0)}
    assert math.isclose(rate[0], (float((score[~pos] >= rate[1]).mean()) + float((score[pos] < rate[1]).mean())) / 2, abs_tol=3e-6)
