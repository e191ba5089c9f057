"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import base64
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import SparkSession

from quern.llm import ann_tree, jaccard_groups, secret_scan

from . import plain
from .conftest import prose


def test_stage_links_five_words_at_080(spark: SparkSession, sf: str) -> None:
    """One changed word of 49 or 51: 0.80 and 0.81 of five-word shingles, under 0.85 of four-word ones; of 47, 0.79."""
    docs = []
    for k, n in enumerate((47, 49, 51)):
        words = prose(20 + k, n).split()
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:24], "changed", *words[25:]]))]
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf).collect()}
    assert got == {0, 1, 2, 4} == {d for d, _, c in plain.jaccard(docs, n=5, percent=80) if d == c}
    assert all(d == c for d, _, c in plain.jaccard(docs))


def test_secrets_before_stops_in_wrapped_and_escaped_text() -> None:
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    for header in (b'{"alg":"HS256"}', b'{\n "alg": "HS256"}', b'{\r\n "alg": "HS256"\r\n}', b'\n{"alg": "none"}'):
        token = f"{part(header)}.{part(b'{"sub": "me"}')}.{'s' * 43}"
        for before, after in (("", ""), ("It is ", ". Next"), ("www.", "."), ("(", ".)"), ("", ".Next line")):
            text = before + token + after
            assert secret_scan.confirmed_spans(text) == [(len(before), 3, len(before + token))], text
    assert secret_scan.confirmed_spans("some.dotted-words.in-a.sentence of_words.and_so.on.") == []

    numbers = b"".join(bytes([2, 40]) + bytes([k + 1] * 40) for k in range(8))
    text_of = lambda x: len(x).to_bytes(4, "big") + x
    ssh = secret_scan.SSH_MAGIC + text_of(b"none") * 2 + text_of(b"") + (1).to_bytes(4, "big") + text_of(b"public" * 9) + text_of(b"private" * 30)
    for tail in (b"", b"\x02\x01\x05", b"\x02\x02\x05\x06"):  # all lengths of the last base64 letters
        body = bytes([2, 1, 0]) + numbers + tail
        der = bytes([0x30, 0x82]) + len(body).to_bytes(2, "big") + body
        for data, kind in ((der, 5), (ssh, 6)):
            for run, kinds in ((base64.b64encode(data).decode(), kind), (base64.urlsafe_b64encode(data).decode(), kind), (data.hex(), 5 if kind == 5 else None)):
                for width in (64, 76, 10**6):
                    for newline in ("\n", "\r\n", "\\n", "\\r\\n", "\\\\n", " \n\t"):
                        key = newline.join(run[i : i + width] for i in range(0, len(run), width))
                        for before, after in (("", ""), ("my key" + newline, newline + "thanks"), ("k='", "'"), ("line" + newline + "M" + newline, newline)):
                            want = [(len(before), kinds, len(before + key))] if kinds else []
                            assert secret_scan.confirmed_spans(before + key + after) == want, (before, key, after)
                        assert secret_scan.confirmed_spans(key[:-6]) == secret_scan.confirmed_spans("ab" + key) == []

        for newline in ("\n", "\\n", "\\r\\n", "\\\\n"):
            run = base64.b64encode(der).decode().replace("/", "\\/" if newline == "\\n" else "/")
            pem = newline.join(["-----BEGIN RSA PRIVATE KEY-----", run, "-----END RSA PRIVATE KEY-----"])
            assert secret_scan.confirmed_spans(f'{{"key": "{pem}{newline}"}}') == [(9, 4, 9 + len(pem))]
            assert secret_scan.confirmed_spans(pem.replace("MII", "MIJ")) == []


def test_queries_in_small_leaves_find_k(spark: SparkSession) -> None:
    """One big cluster of copies, which keeps the calibrated visits low, and many tiny ones; ids that stand twice."""
    rng = np.random.default_rng(3)
    hot = np.ones((4000, 8))
    tiny = np.repeat(rng.normal(0, 5, (15, 8)), 4, axis=0) + rng.normal(0, 1e-3, (60, 8))
    x = np.concatenate([hot, tiny])
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    rows += [rows[4000], (4020, rows[4001][1]), (8000, rows[7][1])]
    found = ann_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell=100, recall=0.5).collect()
    assert Counter(r.query_id for r in found) == {i: 20 for i in [*range(0, len(x), 20), 8000]}
    for query in (4000, 4020):
        assert max(Counter(r.vec_id for r in found if r.query_id == query and r.vec_id not in (4000, 4040)).values()) == 1
    assert all(r.query_id != r.vec_id for r in found)


def test_jaccard_joins_send_nothing_to_the_driver(spark: SparkSession) -> None:
    """Joins of few rows are merges too: each broadcast would take memory of the driver, whatever the table's size."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words), " ".join([*words, "x"]), " ".join([*words[1:], "x"]), "alone and short text here", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    def plans() -> dict[int, str]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {run.executionId(): run.physicalPlanDescription() for run in (runs.apply(i) for i in range(runs.size()))}

    before = max(plans(), default=-1)
    found = {r.doc_id: r.component_id for r in jaccard_groups.report(rows).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5}
    own = [p for k, p in plans().items() if k > before]
    assert any("SortMergeJoin" in p for p in own) and not any("BroadcastExchange" in p for p in own)
