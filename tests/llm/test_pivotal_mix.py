"""Targets against a plain water level, what is taken against targets and odds, and reruns against each other."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import pivotal_mix as mix

from . import plain


def levelled(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Targets by sharing in rounds: whatever is over its limit is held there and the rest shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held: dict = {}
    while True:
        free = [s for s in order if s not in held]
        left = sum(sizes.values()) - sum(held.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return held | share
        held |= {s: 3 * sizes[s] for s in over}


def check(docs: list[tuple[int | None, str | None, str | None]], got: list) -> None:
    """docs: id, text, source. ``got``: rows of the report."""
    size = defaultdict(int)
    for _, text, source in docs:
        size[source] += len(plain.spaced(text))
    want = levelled(size) if size else {}
    assert sorted((d is None, d or 0, len(plain.spaced(t)), size[s]) for d, t, s in docs) == sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source_size) for r in got)
    by_target = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        copies = r.target / r.source_size if r.source_size else 0.0
        assert r.taken % r.size == 0 if r.size else r.taken == 0
        assert not r.size or int(copies - 1e-9) <= r.taken // r.size <= int(copies + 1 - 1e-9) <= 3
        one = by_target[(r.source_size, round(r.target, 6))]
        one[0] += r.taken
        one[2] = max(one[2], r.size)
    expected = defaultdict(float)
    number = defaultdict(int)
    for s in want:
        key = (size[s], round(want[s], 6))
        expected[key] += want[s]
        number[key] += 1
    assert set(expected) == set(by_target)
    for key, (taken, _, largest) in by_target.items():
        assert abs(taken - expected[key]) <= number[key] * max(largest, 1)


@pytest.fixture(scope="module")
def many() -> list[tuple]:
    """Sources of very different sizes, one held at its limit, one null, one without words; copies and rows without ids."""
    rows = [(k, "w " * (1 + k * k % 97), f"s{k % 7}" if k % 3 else "big") for k in range(1500)]
    rows += [(5, "five words are in here", "s1")] * 40 + [(None, "four words in here", "s1")] * 700
    return [*rows, (9001, "a few words", "Aa tiny"), (9002, None, None), (9003, "the null one", None), (9004, " ", "none"), (9005, None, "none")]


@pytest.mark.parametrize("fan", [2, 64])
def test_words_come_near_targets(spark: SparkSession, many: list, fan: int) -> None:
    docs = spark.createDataFrame(many, "doc_id long, text string, source string")
    got = mix.report(docs, fan=fan).collect()
    check(many, got)
    again = mix.report(docs.repartition(7).withColumn("size", F.lit("x")).withColumn("bucket", F.lit(1)), fan=fan).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_odds(spark: SparkSession) -> None:
    """Over many buckets of the same documents each is whole as often as its fraction says; a bucket's words stay."""
    size, part, n = [3, 8, 13, 40, 40, 28], [0.5, 0.25, 0.9, 0.1, 0.6, 0.35], 4000
    item = F.expr(f"struct(id AS doc_id, element_at(array({','.join(f'{x}L' for x in size)}), int(id) + 1) AS size, 1L AS many, 0L AS whole)")
    rows = spark.range(6).select(item.alias("i"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("bucket"))
    mass = F.element_at(F.array(*map(F.lit, part)), F.col("i.doc_id").cast("int") + 1) * F.col("i.size")
    draw = mix._drawn(1, F.col("bucket"), F.col("i.doc_id"))
    got = mix._rounded(rows.select(F.lit(0).alias("sid"), "bucket", F.struct("i.*", mass.alias("mass"), draw.alias("draw")).alias("item"))).collect()
    total, words = defaultdict(float), sum(a * b for a, b in zip(size, part, strict=True))
    for r in got:
        assert abs(sum(d.one * d.size for d in r.done) + r.open.mass - words) < 1e-9 and len(r.done) == 5
        for d in r.done:
            total[d.doc_id] += d.one / n
        total[r.open.doc_id] += r.open.mass / r.open.size / n
    assert len(got) == n and all(abs(total[k] - p) < 0.05 for k, p in enumerate(part))


def test_mixed_rows(spark: SparkSession, many: list) -> None:
    docs = spark.createDataFrame([(*r, "own") for r in many], "doc_id long, text string, source string, copies string")
    want = defaultdict(int)
    for r in mix.report(docs).collect():
        want[(r.doc_id, r.size)] += r.taken
    got = defaultdict(int)
    for r in mix.mixed(docs).collect():
        n = len(plain.spaced(r.text))
        got[(r.doc_id, n)] += n
    assert mix.mixed(docs).columns == docs.columns and {k: v for k, v in want.items() if v} == dict(got)


def test_odd_tables(spark: SparkSession, odd_rows: list, supplied: list, sf: str) -> None:
    rows = [(d, t, None if d == 3 else "x" if (d or 0) % 2 else "é") for d, t in odd_rows]
    check(rows, mix.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mix.report(none).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mix.report(none.limit(0)).collect() == []
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    check([tuple(r) for r in docs.collect()], mix.report(docs).collect())
