"""The automaton against patterns, and what is cut against what is put together again."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession

from quern.llm import fill_in_middle as fim

from . import plain


def odd_texts(n: int) -> list[str]:
    draw = random.Random(5)
    parts = ["<", "<P", "<P>", "S>", "<<M>", "P", "M", ">", " ", "\t", "\n", "\x0b", "\r", "é", "中", "🙂", "\u0085", "\x00", "word", "<S"]
    return ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 256])
def test_scan_counts(block: int) -> None:
    texts = odd_texts(400)
    counted = fim.scan(b"".join(b"\xff" + t.encode() for t in texts), block)
    at = 0
    for t in texts:
        own = counted[at + 1 : at + 1 + len(t.encode())]
        at += 1 + len(own)
        count = lambda bit: int(np.count_nonzero(own & bit))  # noqa: B023, E731
        starts = [len(t[: m.start()].encode()) for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)]
        assert count(fim.POINT) == len(t)
        assert np.flatnonzero(own & fim.UNIT).tolist() == starts
        assert count(fim.SENTINEL) == len(re.findall("<[PSM]>", t))


def test_sentinels_stay_plain_and_texts_come_back(spark: SparkSession) -> None:
    rows = [(k, t, "own", "own") for k, t in enumerate(odd_texts(300))] + [(None, "no id at all", "own", "own"), (7, None, "own", "own")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, fim_form string, form string")
    got = fim.transformed(docs, rate=100, spm=50).collect()
    assert docs.columns[:2] + ["form", "fim_text", "fim_form"] == fim.transformed(docs).columns and len(got) == len(rows)
    forms = {r.fim_form for r in got}
    assert forms == {"plain", "psm", "spm"}
    for r in got:
        if r.text is None:
            assert r.fim_text is None and r.fim_form == "plain"
            continue
        assert fim.restored(r.fim_text.encode(), r.fim_form).decode() == r.text
        assert (r.fim_form == "plain") == (not r.text or bool(re.search("<[PSM]>", r.text)))


def test_long_texts_and_empty_table(spark: SparkSession, empty: DataFrame) -> None:
    rows = [(1, "corn meal " * 600_000), (2, "é" * 3_000_000), (3, " " * 5_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in fim.report(docs, rate=100).collect()) == plain.fill_in_middle(rows, rate=100)
    assert fim.report(empty).collect() == [] and fim.transformed(empty).collect() == []
