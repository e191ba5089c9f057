"""Operators that learn or approximate: recall, held-out accuracy, normalisation, and their defined results."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann_tree, lm_logbilinear, quality_classifier, queries
from quern.llm._common import space_words


def nearest(vectors: list[tuple[int, list[float]]], every: int = 20, k: int = 20) -> dict[int, list[tuple[int, float]]]:
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], np.float64)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            score = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall(got: DataFrame, want: dict) -> float:
    found: dict[int, dict[int, float]] = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = sum(i in found.get(q, {}) for q, best in want.items() for i, _ in best)
    for q, best in want.items():
        assert all(math.isclose(found[q][i], s, rel_tol=1e-12) for i, s in best if i in found[q])
    return hits / sum(map(len, want.values()))


def test_nearest_recall(spark: SparkSession, sf: str) -> None:
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.QUERIES["op1_ann_tree"](spark, sf)
    assert recall(got, nearest(vectors)) >= 0.9
    ranks = got.groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("rank")).alias("ranks")).collect()
    assert all(r.ranks == list(range(1, 21)) for r in ranks)
    last = {}
    for r in sorted(got.collect()):
        assert r.query_id != r.vec_id and (r.rank == 1 or (-last[r.query_id][0], last[r.query_id][1]) < (-r.score, r.vec_id))
        last[r.query_id] = (r.score, r.vec_id)


def test_nearest_in_a_tree_of_many_leaves(spark: SparkSession) -> None:
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), sample=1000, cell=50, block=50)
    assert recall(got, nearest([(i, v) for i, v in enumerate(x.astype(np.float64))])) >= 0.9


def test_nearest_defined_results(spark: SparkSession) -> None:
    bad = [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [1.0]), (None, [5.0, 5.0]), (140, [])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0])]
    rows = [(i, v, "leaf", 1) for i, v in bad + good]
    got = ann_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string, rank int"))
    assert [tuple(r) for r in sorted(got.collect())] == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 3, 1.0), (0, 4, 4, -1.0), (0, 5, 4, -1.0)]
    assert ann_tree.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert ann_tree.search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_language_model_beats_counts(spark: SparkSession, sf: str) -> None:
    got = queries.QUERIES["op5_lm_logbilinear"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count() and all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_in_any_partitions(spark: SparkSession, sf: str, odd: DataFrame, monkeypatch) -> None:
    """The same rows, and some that repeat, give the same scores however they are dealt; folds are many here."""
    monkeypatch.setattr(lm_logbilinear.train, "__defaults__", (256, 2000, 3000))
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 7 = 0").select("doc_id", "text").unionByName(odd.where("doc_id < 4").select("doc_id", "text"))
    docs = docs.unionByName(odd.where("doc_id = 1").select("doc_id", "text")).unionByName(odd.where("doc_id = 2").select((F.col("doc_id") * None).alias("doc_id"), "text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in lm_logbilinear.report(docs.repartition(int(n))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r[:3] for r in found[0]] == [r[:3] for r in found[1]] and len(found[0]) == docs.count()
    assert np.allclose([r[3] for r in found[0]], [r[3] for r in found[1]], rtol=1e-9)


def test_equal_texts_get_equal_scores(spark: SparkSession, sf: str, monkeypatch) -> None:
    """Every text under two ids that are held out alike, far apart and beside other rows: the same to the last bit."""
    monkeypatch.setattr(lm_logbilinear.train, "__defaults__", (256, 2000, 30000))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    twice = docs.unionByName(docs.select((F.col("doc_id") + 1_000_003).alias("doc_id"), "text").repartition(5))
    found: dict[int, list] = {}
    for r in lm_logbilinear.report(twice).collect():
        found.setdefault(r.doc_id % 1_000_003, []).append((r.n_tokens, r.n_known, r.base_score, r.score))
    assert len(found) == docs.count() and all(len(x) == 2 and x[0] == x[1] for x in found.values())


def test_exact_scores_in_any_company(spark: SparkSession) -> None:
    """A context's normaliser and its scores do not depend on which others are worked out with it, nor on the order."""
    rng = np.random.default_rng(6)
    noise = rng.random(700)
    model = lm_logbilinear.Model.start(noise / noise.sum(), 16, 3)
    model["r"] *= 30
    exact = lm_logbilinear.Exact.of(model)
    c1, c2, w = rng.integers(0, 700, (3, 5000))
    want = lm_logbilinear.Scorer(exact, 700).classes(c1, c2, w)
    for size in (1, 7, 333):
        scorer, order = lm_logbilinear.Scorer(exact, 700), rng.permutation(400)
        got = np.concatenate([scorer.classes(c1[at], c2[at], w[at]) for at in np.array_split(order, -(-400 // size))])
        assert np.array_equal(got, want[order])


def test_language_model_is_normalised(spark: SparkSession) -> None:
    """Over all words of the vocabulary and one unseen, classes and words within them sum to one."""
    texts = ["the mill turns the wheel", "the wheel turns grain to flour", "flour and water make bread", "bread of the mill"] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = lm_logbilinear.word_counts(docs).cache()
    c = lm_logbilinear.classes_of(counts, own=4, buckets=3, known=1000)
    model = lm_logbilinear.train(docs, c, dim=4, tokens=120, fold=30)
    scorer, size = lm_logbilinear.Scorer(lm_logbilinear.Exact.of(model), c.size), c.size
    for c1, c2 in ((0, 0), (1, 2), (size - 1, 3)):
        p = np.exp(scorer.classes(np.full(size, c1), np.full(size, c2), np.arange(size)))
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-5)
    within = c.within()
    for bucket in range(len(c.own), size):
        inside = [r.n for r in counts.collect() if c.of(bytes(r.word)) == bucket]
        assert math.isclose(sum(n + 0.5 for n in inside) + 0.5, 10 ** within[bucket])  # the last half is for unseen words
    assert {bytes(r.word): r.n for r in counts.collect()}[b" "] == len(texts)
    assert sum(r.n for r in counts.collect()) == sum(len(space_words(t.encode())) + 1 for t in texts)


@pytest.mark.parametrize("name", ["lm", "quality"])
def test_models_on_odd_rows(name: str, odd: DataFrame, odd_rows: list, empty: DataFrame, spark: SparkSession) -> None:
    labels = spark.createDataFrame([(0, 1, 0), (9, 1, 0), (12, 0, 1), (11, 0, None), (13, None, 1), (21, 5, 0), (None, 1, 0), (777, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    run = lm_logbilinear.report if name == "lm" else lambda d: quality_classifier.report(d, labels)
    got = {r.doc_id: r for r in run(odd).collect()}
    assert got.keys() == {d for d, _ in odd_rows} and all(math.isfinite(r.score) for r in got.values())
    assert got[0].score == got[1].score and got[3].score == got[4].score == got[5].score
    assert run(empty).collect() == []


def test_quality_without_labels(odd: DataFrame, spark: SparkSession) -> None:
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality_classifier.report(odd, none).collect()} == {(0.5, 0)}


def test_quality_on_held_out_labels(spark: SparkSession, sf: str) -> None:
    """Labels of the held-out fold, which taught nothing, are ranked far better than by chance."""
    path = sf.replace("sf0.001", "sf0.01")
    got = queries.QUERIES["op6_quality_classifier"](spark, path)
    rows = got.where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert good and bad
    won = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert won > 0.9 and right > 0.85, (won, right)


def test_language_model_scores_by_definition(spark: SparkSession, odd: DataFrame, odd_rows: list) -> None:
    """Each text's score, token by token, from the model's parameters and all counts."""
    docs = odd.select("doc_id", "text").where("char_length(text) < 3000 OR text IS NULL")
    training = docs.where(~lm_logbilinear._held())
    counts = {bytes(r.word): r.n for r in lm_logbilinear.word_counts(training).collect()}
    own, buckets = lm_logbilinear.sizes_of(len(counts))
    table = lm_logbilinear.word_counts(training).cache()
    c = lm_logbilinear.classes_of(table, own, buckets, known=30)
    m = lm_logbilinear.train(training, c, 16, sum(counts.values()))
    got = {r.doc_id: r for r in lm_logbilinear.report(docs, known=30).collect()}
    weight: dict[int, list[int]] = {}
    for w, n in counts.items():
        weight.setdefault(c.of(w), []).append(n)
    for doc, text in odd_rows:
        if doc not in got:
            continue
        tokens = [*space_words((text or "").encode()), b" "]
        total, before = 0.0, (0, 0)
        for w in tokens:
            k = c.of(w)
            q = m["r"][before[1]] @ m["a1"] + m["r"][before[0]] @ m["a2"]
            s = (m["t"] @ q + m["b"]).astype(np.float64)
            total += (s[k] - np.log(np.exp(s - s.max()).sum()) - s.max()) / math.log(10)
            if k >= len(c.own):
                inside = weight.get(k, [])
                total += math.log10((counts.get(w, 0) + 0.5) / (sum(inside) + 0.5 * (len(inside) + 1)))
            before = (before[1], k)
        assert math.isclose(got[doc].score, total, rel_tol=1e-4), doc


def test_quality_scores_by_definition(spark: SparkSession, odd: DataFrame, odd_rows: list) -> None:
    """Each text's score from the weights, feature by feature; labels may have ids of any width, and repeat."""
    from collections import Counter
    from zlib import crc32

    labels = spark.createDataFrame([(0, 1), (9, 1), (12, 0), (11, 0), (18, 1), (21, 0), (21, 1), (20, 1), (20, 1)], "doc_id int, quality int")
    narrow = odd.where("doc_id < 100").withColumn("doc_id", F.col("doc_id").cast("int"))
    model = quality_classifier.fit(narrow, labels.where(quality_classifier.remainder(F.col("doc_id"), 4) != 2))
    got = {r.doc_id: r for r in quality_classifier.report(narrow, labels).collect()}
    for doc, text in odd_rows:
        if doc >= 100:
            continue
        h = [crc32(w) for w in quality_classifier.TOKEN.findall((text or "").encode().translate(quality_classifier.LOWER))]
        h = [1 if i and h[i] == h[i - 1] else x for i, x in enumerate(h)]
        grams = h + [h[i - 1] * 0x100000001B3 & (1 << 64) - 1 ^ h[i] for i in range(1, len(h))]
        slots = Counter((g * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - model.bits for g in grams)
        norm = math.sqrt(sum(n * n for n in slots.values()))
        x = sum(model.weights[s] * n / norm for s, n in slots.items()) + model.weights[-1]
        assert math.isclose(got[doc].score, 1 / (1 + math.exp(-x)), rel_tol=1e-9) and got[doc].predicted == (got[doc].score >= 0.7), doc
