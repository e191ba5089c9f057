"""All queries over the supplied tables: against DuckDB where there is SQL, else that they give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from quern.plans import catalog
from quern.plans import tables as t

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(value: object) -> str:
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(name: str, spark, sf: str, duck) -> None:
    df = catalog.QUERIES[name](spark, sf)
    got = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(df.columns) == sorted(columns)
    assert got == sorted(tuple(shown(r[i]) for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql(name: str, spark, sf: str) -> None:
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert rows


def test_conversations_word_by_word(spark, sf: str) -> None:
    """Turns against the next ones, by the plain table of distances."""
    turns = {(r.conv_id, r.turn): (r.text or "").split() for r in t.table(spark, sf, "conversations").collect()}
    errors = words = 0
    for (conv, turn), ref in turns.items():
        if (hyp := turns.get((conv, turn + 1))) is not None:
            row = list(range(len(hyp) + 1))
            for i, x in enumerate(ref):
                last, row = row, [i + 1]
                for j, y in enumerate(hyp):
                    row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
            errors, words = errors + row[-1], words + len(ref)
    assert [tuple(r) for r in catalog.QUERIES["wer_conversations"](spark, sf).collect()] == [(round(errors / words, 6), errors, words)]


def test_figures_do_not_change(spark, sf: str) -> None:
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in (before, "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(repr, catalog.QUERIES["figures_lines"](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and found[0]


def test_entry(spark, sf: str) -> None:
    """The flagship query and the registry; the optional part may be absent."""
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalog.QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert [tuple(r) for r in queries["auroc_events"](spark, sf).collect()] == [(0.484819,)]
