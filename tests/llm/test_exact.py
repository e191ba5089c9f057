"""Operators with one right result, against the plain versions."""

from __future__ import annotations

import math
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from quern.llm import _repeats, bpe_segments, decontamination, fill_in_middle, jaccard_groups, lm_logbilinear, phrase_automata, queries, secret_scan, suffix_dedup, token_counts

from . import plain
from .conftest import prose


def rows(df: DataFrame, n: int) -> list[tuple]:
    return sorted(tuple(r)[:n] for r in df.collect())


BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def counted(docs: list) -> list[tuple]:
    t = Tokenizer.from_file(BYTE)
    n = [len(e.ids) for e in t.encode_batch([x or "" for _, x in docs], add_special_tokens=False)]
    return [(d, len((x or "").encode()), k, k > 1024) for (d, x), k in zip(docs, n, strict=True)]


def encoded(docs: list) -> list[tuple]:
    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    ids = [e.ids for e in t.encode_batch([x or "" for _, x in docs], add_special_tokens=False)]
    return [(d, len(i), plain.sha(" ".join(map(str, i))), plain.sha(t.decode(i, skip_special_tokens=False))) for (d, _), i in zip(docs, ids, strict=True)]


ITEMS = [(1, "corn meal stone mill water wheel grain flour sack miller river bread oven loaf crust"), (2, "Two words"), (3, None), (4, ""), (30, "two words"), (5, "é" * 120)]
CASES = {
    "fill_in_middle": (fill_in_middle.report, plain.fill_in_middle, 7),
    "fill_in_middle, all cut": (lambda d: fill_in_middle.report(d, rate=100, spm=30, seed=7), lambda d: plain.fill_in_middle(d, 7, 100, 30), 7),
    "token_counts": (lambda d: token_counts.report(d, BYTE), counted, 4),
    "secret_scan": (secret_scan.report, plain.base_secrets, 5),
    "suffix_dedup": (suffix_dedup.report, plain.byte_repeats, 5),
    "phrase_automata": (phrase_automata.report, plain.word_repeats, 4),
    "bpe_segments": (lambda d: bpe_segments.report(d, WORD), encoded, 4),
    "jaccard_groups": (jaccard_groups.report, plain.jaccard, 3),
    "decontamination": (lambda d: decontamination.report(d, d.sparkSession.createDataFrame(ITEMS, "item_id long, text string")), lambda d: plain.contamination(d, ITEMS), 6),
    "decontamination by join": (lambda d: decontamination.report(d, d.sparkSession.createDataFrame(ITEMS, "item_id long, text string"), max_windows=0), lambda d: plain.contamination(d, ITEMS), 6),
    "suffix_dedup, hot anchors": (lambda d: suffix_dedup.report(d, hot=1), plain.byte_repeats, 5),
    "suffix_dedup, heavy anchors": (lambda d: suffix_dedup.report(d, heavy=1), plain.byte_repeats, 5),
    "phrase_automata, parted shards": (lambda d: phrase_automata.report(d, phrases=3), plain.word_repeats, 4),
    "phrase_automata, copied shards": (lambda d: phrase_automata.report(d, phrases=40, stream=10), plain.word_repeats, 4),
    "suffix_dedup, small shards": (lambda d: suffix_dedup.report(d, limit=100), plain.byte_repeats, 5),
    "jaccard_groups, small groups": (lambda d: jaccard_groups.report(d, group=2, rounds=1), plain.jaccard, 3),
}


@pytest.mark.parametrize("case", CASES)
def test_odd_rows(case: str, odd: DataFrame, odd_rows: list) -> None:
    run, want, n = CASES[case]
    assert rows(run(odd), n) == sorted(want(odd_rows))


@pytest.mark.parametrize("case", [c for c in CASES if "," not in c and " " not in c])
def test_no_rows(case: str, empty: DataFrame) -> None:
    assert CASES[case][0](empty).collect() == []


@pytest.mark.parametrize("case", [c for c in CASES if "," not in c])
def test_null_ids_and_repeated_rows(case: str, odd: DataFrame) -> None:
    """Each row keeps one result; equal rows have equal ones; rows without an id change nothing."""
    run, _, n = CASES[case]
    lost = odd.where("doc_id IN (0, 9)").withColumn("doc_id", odd.doc_id * None)
    got = [tuple(r)[:n] for r in run(odd.unionByName(odd.where("doc_id IN (1, 10)")).unionByName(lost)).collect()]
    want = rows(run(odd), n)
    assert sorted(r for r in got if r[0] is not None) == sorted(want + [r for r in want if r[0] in (1, 10)])
    assert sum(r[0] is None for r in got) == 2


QUERIES = {
    "op2_decontamination": 6,
    "op3_token_counts": 4,
    "op4_secret_scan": 5,
    "op7_suffix_dedup": 5,
    "op8_phrase_automata": 4,
    "op9_bpe_segments": 4,
    "op10_jaccard_groups": 3,
}


@pytest.mark.parametrize("name", QUERIES)
def test_queries(name: str, spark, sf: str, supplied: list) -> None:
    case = name.split("_", 1)[1]
    if case == "decontamination":
        items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        want = plain.contamination(supplied, items)
    else:
        want = CASES[case][1](supplied)
    assert rows(queries.QUERIES[name](spark, sf), QUERIES[name]) == sorted(want)


def test_unigram_columns(odd: DataFrame, odd_rows: list) -> None:
    got = rows(lm_logbilinear.report(odd), 7)
    want = sorted(plain.unigram(odd_rows))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_prefix_table(odd: DataFrame) -> None:
    """The count at every prefix is what encoding that prefix anew gives; budgets follow."""
    t = Tokenizer.from_file(BYTE)
    some = odd.where("char_length(text) < 400")
    for row in token_counts.prefix_table(some, BYTE).join(some.select("doc_id", "text"), "doc_id").collect():
        assert row.counts == [len(e.ids) for e in t.encode_batch([row.text[:i] for i in range(len(row.text) + 1)], add_special_tokens=False)]
    asked = token_counts.prefix_table(odd.where("doc_id = 0"), BYTE).select(token_counts.tokens_at(__import__("pyspark").sql.functions.lit(10)).alias("n"), token_counts.chars_within(__import__("pyspark").sql.functions.lit(5)).alias("most"), "counts").first()
    assert asked.n == asked.counts[10] and asked.counts[asked.most] <= 5 and asked.counts[asked.most + 1] > 5


def test_encode_then_decode(odd: DataFrame) -> None:
    t = Tokenizer.from_file(WORD)
    ids = bpe_segments.encode(odd, WORD)
    for row in bpe_segments.decode(ids, WORD).join(ids, "doc_id").collect():
        assert row.text == t.decode(row.ids, skip_special_tokens=False)


def test_texts_without_repeats(odd: DataFrame) -> None:
    for run in (suffix_dedup.report, phrase_automata.report):
        for row in run(odd, texts=True).collect():
            assert plain.sha(bytes(row.kept) if not isinstance(row.kept, str) else row.kept) == row.kept_sha256


def test_texts_are_read_for_passages_once(odd: DataFrame, odd_rows: list) -> None:
    """Hot anchors or not, the plan reads the passages from a table and doesn't cut them out of the texts for each branch."""
    for some in ({}, {"hot": 1}):
        got = suffix_dedup.report(odd, **some)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow digest(" in plan and "MapInArrow passages(" not in plan
        assert rows(got, 5) == sorted(plain.byte_repeats(odd_rows))


def test_what_spans_leave() -> None:
    """Of many texts together: overlapping spans, none, null, beyond the end, in a slice."""
    spans = [[(9, 9)], None, [(0, 2), (1, 3), (1, 3)], [], [(2, 90)], [(0, 4), (4, 5)], [(1, 1)]]
    sizes = [9, 3, 4, 0, 5, 5, 1]
    column = pa.array([s and [{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    for first in (0, 2):
        for size, some, got in zip(sizes[first:], spans[first:], _repeats.kept(sizes[first:], column.slice(first)), strict=True):
            assert (got is None) == (not some)
            assert not some or got.tolist() == [not any(a <= i < b for a, b in some) for i in range(size)]


def test_links_between_classes(odd: DataFrame, odd_rows: list, supplied: list, spark) -> None:
    """All links between different sets, and who has which set."""
    for docs, given in ((odd, odd_rows), (spark.createDataFrame(supplied, "doc_id long, text string"), supplied)):
        sets = {}
        for d, text in given:
            w = plain.spaced((text or "").translate(plain.UPPER))
            if w:
                sets[d] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3)))
        least = {s: min(d for d in sets if sets[d] == s) for s in set(sets.values())}
        got = {tuple(r) for r in jaccard_groups.classes(docs).select("doc_id", "class_id").collect()}
        assert got == {(d, least[s]) for d, s in sets.items()}
        ids = sorted(least.values())
        want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
        found = [tuple(r) for r in jaccard_groups.links(docs).collect()]
        assert set(found) == want and len(found) == len(want) and want


def test_rows_that_repeat_leave_one(odd: DataFrame) -> None:
    """Copies of a row leave one, those without an id none beside it; without ids alone one stays too."""
    twice = odd.unionByName(odd.where("doc_id IN (3, 9)"))
    lost = odd.where("doc_id = 0").withColumn("doc_id", odd.doc_id * None)
    once = sorted(r.doc_id for r in jaccard_groups.first_of_each(odd).collect())
    assert sorted(r.doc_id for r in jaccard_groups.first_of_each(twice.unionByName(lost)).collect()) == once
    nameless = jaccard_groups.first_of_each(odd.withColumn("doc_id", odd.doc_id * None)).collect()
    assert len({r.text for r in nameless}) == len(nameless) == len({odd_text for odd_text in (r.text for r in jaccard_groups.first_of_each(odd).collect())})


def test_rows_that_share_an_id_are_judged_by_their_texts(odd_rows: list, spark) -> None:
    a, b, c = prose(31, 80), prose(32, 80), prose(33, 80)
    near = b.split()
    near[79] = "changed"
    given = [(1, a), (2, a), (2, b), (3, " ".join(near)), (3, c), (3, None), (None, b), (None, prose(34, 50)), (None, prose(34, 50))]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    named = [(d, t) for d, t in given if d is not None]
    only = spark.createDataFrame(named, "doc_id long, text string").repartition(3)
    assert rows(suffix_dedup.report(only), 5) == sorted(plain.byte_repeats(named))
    assert rows(phrase_automata.report(only), 4) == sorted(plain.word_repeats(named))
    assert rows(suffix_dedup.report(only.unionByName(only)), 5) == sorted(plain.byte_repeats(named + named))
    assert rows(phrase_automata.report(only.unionByName(only)), 4) == sorted(plain.word_repeats(named + named))
    for some in ({"hot": 1}, {"heavy": 1}, {"limit": 100}):
        assert rows(suffix_dedup.report(only, **some), 5) == sorted(plain.byte_repeats(named))
    for some in ({"phrases": 3}, {"phrases": 40, "stream": 10}):
        assert rows(phrase_automata.report(only, **some), 4) == sorted(plain.word_repeats(named))
    # sets by row: the components are {a, a}, {b, near, b} and one for each other text
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard_groups.report(docs).collect())
    want = [((False, 1), 77, 1), ((False, 2), 77, 1), ((False, 2), 77, 2), ((False, 3), 0, 3), ((False, 3), 77, 2), ((False, 3), 77, 3), ((True, 0), 47, None), ((True, 0), 47, None), ((True, 0), 77, 2)]
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)
    assert sorted(tuple(r) for r in jaccard_groups.links(docs).collect()) == [(2, 3)]
    kept = Counter((r.doc_id, r.text) for r in jaccard_groups.first_of_each(docs).collect())
    assert kept == Counter([(1, a), (2, b), (3, c), (3, None), (None, prose(34, 50))])


def test_large_benchmarks_edit_alike(odd: DataFrame, spark) -> None:
    """Both ways keep and cut the same rows, those without ids and with other texts under one id too."""
    rows = [(1, ITEMS[0][1] + " and more"), (1, "clean text of its own"), (None, ITEMS[0][1]), (None, "clean"), (None, None), (2, "two WORDS, and: two words")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for edit in (decontamination.drop_documents, decontamination.drop_spans):
        a, b = (sorted(map(repr, edit(docs, items, max_windows=most).collect())) for most in (10**6, 0))
        assert a == b
    kept = [tuple(r) for r in decontamination.drop_documents(docs, items, max_windows=0).where("doc_id IS NULL OR doc_id = 1 AND text LIKE 'c%'").collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [(1, "clean text of its own"), (None, "clean"), (None, None)]))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same_rows(name: str, spark, sf: str) -> None:
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    assert got.columns == [c[0] for c in found.description]
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())
