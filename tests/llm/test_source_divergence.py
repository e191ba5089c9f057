"""Both ways of summing against all pairs by definition."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession

from quern.llm import source_divergence as audit

from . import plain


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    """Languages of many, few and one source; sources and a language without kept terms; nulls; rows that repeat."""
    draw = random.Random(3)
    words = [f"{a}{b}" for a in "Korn mehl Öl wasser 水 stein".split() for b in "abcdefghij"]
    out = []
    for k in range(260):
        source = draw.choices(range(13), [30, 9, 8, 7, 6, 5, 4, 3, 2, 2, 2, 1, 1])[0]
        own = words[: 20 + 3 * source]
        out.append((k % 9, " ".join(draw.choices(own, k=draw.randint(0, 40))) + draw.choice(["", " 1x_y", "!Z[w", "\x00q"]), f"s{source}", draw.choices(["a", "b", None], [6, 2, 1])[0]))
    out += [(1, "once only here", "lone", "c"), (1, None, "other", "c"), (None, "korn", None, None), (None, "", "s1", ""), (7, None, None, "d")]
    return out + [(5, "hot same words", "s0", "a")] * 150


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    wide = [(d, t, s, x, "own", 1) for d, t, s, x in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, source string, lang string, term string, n int")


@pytest.mark.parametrize("options", [{}, {"heavy": 10**9}, {"heavy": 1}, {"side": 4, "tile": 7}, {"side": 3, "heavy": 2, "least": 2, "top": 3}])
def test_against_definition(spark: SparkSession, rows: list, options: dict) -> None:
    got = sorted(tuple(r) for r in audit.report(table(spark, rows), **options).collect())
    want = plain.divergence([(t, x, s) for _, t, s, x in rows], options.get("least", 3), options.get("top", 200))
    assert got == sorted(want)


def test_no_rows(spark: SparkSession, rows: list) -> None:
    assert audit.report(table(spark, rows).limit(0)).collect() == []


def test_shares_are_whole(spark: SparkSession) -> None:
    """The share in steps is the quotient of whole numbers, far past 64 bits; the expression gives the same."""
    draw = random.Random(4)
    cases = [(draw.randrange(10**e), draw.randrange(1, 10 ** max(e, 3)), draw.randrange(1, 10**5)) for e in range(1, 15) for _ in range(50)]
    cases = [(n, max(n, size), v) for n, size, v in cases]
    want = [1 + 10**9 * (n + 1) // (size + v) for n, size, v in cases]
    got = audit.share(*(np.array(c, np.int64) for c in zip(*cases, strict=True)))
    assert got.tolist() == want
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, n long, size long, v long")
    assert [r.p for r in df.select("k", audit._share("n", "size", "v").alias("p")).orderBy("k").collect()] == want


def test_counts_in_parts(spark: SparkSession, rows: list) -> None:
    """Tasks that hand on what they counted before they are done count the same."""
    docs = table(spark, rows).selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "text")
    total = lambda df: sorted(map(tuple, df.groupBy("lang", "source", "term").agg({"n": "sum", "docs": "sum"}).collect()))
    assert total(audit.counted(docs, full=3)) == total(audit.counted(docs))
