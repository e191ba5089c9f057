"""Texts, markup, metadata, experiment records and page layout on small inputs."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import documents, layout, tracker
from quern.sources import records
from quern.streaming import levels


def value(spark: SparkSession, column, **named: object) -> object:
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in named.items()]) if named else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_dois_and_names(spark: SparkSession) -> None:
    for given in ("10.1038/abc", " https://doi.org/10.1038/abc ", "doi: 10.1038/abc", "DX.doi.org/10.1038/abc"):
        assert value(spark, text.normal_doi("x"), x=given) == "10.1038/abc"
    assert value(spark, text.normal_doi("x"), x="11.1/abc") is None
    with pytest.raises(Exception, match="not a DOI"):
        value(spark, text.strict_doi("x"), x="nothing")
    assert value(spark, text.arxiv_url("x"), x="10.48550/arXiv.2001.00001") == "https://arxiv.org/pdf/2001.00001"
    assert value(spark, text.arxiv_unversioned("x"), x="2001.00001v3") == "2001.00001"
    assert value(spark, text.publisher_urls("x"), x="10.7717/peerj-cs.12") == ["https://peerj.com/articles/cs-12.pdf"]
    assert value(spark, text.publisher_urls("x"), x="10.7717/peerj.123") == ["https://peerj.com/articles/123.pdf"]
    assert value(spark, text.publisher_urls("x", F.array(F.lit("10.1/x"), F.lit("S0012345678"))), x="10.1016/j.a")[0].startswith("https://www.sciencedirect.com/science/article/pii/S0012345678/")
    assert value(spark, text.directory_name(F.array(F.lit("Ann Lee")), F.lit(2021), "x"), x="The Art of Deep Nets for Speech") == "Lee2021_art-deep-nets"
    assert value(spark, text.directory_name(F.lit(None).cast("array<string>"), F.lit(None), "x"), x="") == "paper"
    assert value(spark, text.safe_name("x"), x="a b/c?.json") == "a_b_c_.json" and value(spark, text.safe_name("x"), x="..") == "result"


def test_addresses(spark: SparkSession) -> None:
    assert value(spark, text.fetchable("x"), x="https://example.org/a.pdf")
    assert value(spark, text.fetchable("x"), x="http://[2606:4700::1111]/a")
    for bad in ("ftp://example.org/a", "http://127.0.0.1/", "http://192.168.1.4/x", "https://10.0.0.1/", "nothing", "http://[::1]/", "http://[fc00::1]/", "http://[fe80::1]/", "http://[::ffff:10.0.0.1]/", "http://[2001:db8::1]/", "http://[ff02::1]/"):
        assert not value(spark, text.fetchable("x"), x=bad)
    assert value(spark, text.whole_pdf("x"), x=bytearray(b"%PDF-1.4" + bytes(30_000)))
    assert not value(spark, text.whole_pdf("x"), x=bytearray(b"%PDF-1.4"))
    assert value(spark, text.url_forms("x"), x="https://hal.science/hal-1") == ["https://hal.science/hal-1", "https://hal.science/hal-1/document"]


def test_markup(spark: SparkSession) -> None:
    xml = '<sec><title>Results</title><p>See <xref rid="f1">Fig 1</xref>.</p><fig id="f1"><label>Fig 1</label><caption><p>A <b>bold</b> plot</p></caption><graphic xlink:href="f1.jpg"/></fig><table-wrap><label>Table 2</label><caption>Counts</caption></table-wrap>\n\n\n\n<p>End</p></sec>'
    got = value(spark, text.article_text("x"), x=xml)
    assert "## Results" in got and "See Fig 1." in got and "[图 Fig 1] A" in got and "[表 Table 2] Counts" in got and "\n\n\n" not in got and "<" not in got
    assert value(spark, text.figure_links("x"), x=xml) == ["f1.jpg"]
    assert value(spark, text.without_tags("x"), x="<p> a <i>b</i>\n c</p>") == "a b c" and value(spark, text.without_tags("x"), x="<br/>") is None
    labels = {"Table 3. Counts": "Table 3", "Fig. 2 shows": "Fig 2", "12 Figure 4": "Figure 4", "Extended Data Fig. 3": "Extended Data Fig 3", "Figures of speech": None}
    for given, want in labels.items():
        assert value(spark, text.caption_label("x"), x=given) == want
    assert [value(spark, text.shown_number("x"), x=v) for v in ("0.5", "2", "1e-3", "text")] == ["0.5000", "2", "0.0010", "text"]


EXPLAINED = "# t\n## 一、a\n讲解状态说明\n**Mel（梅尔）** filter and codec words, `inline` https://a.b/c\n![i](img/a.png) ![w](http://x/y.png)\n## 二、b\n## 三、c\n| 英文术语 | x |\n|---|---|\n| Mel/codec | y |\n## 四、d\n"


def test_document_audit(spark: SparkSession) -> None:
    docs = spark.createDataFrame([("a", EXPLAINED), ("b", "only words here 概览级")], "path string, text string")
    files = spark.createDataFrame([("z", "img/a.png")], "path string, file string")
    got = {r.path: r for r in documents.audit(docs, files).collect()}
    assert got["a"].hard == ["missing image img/a.png"] and not got["a"]["pass"]
    assert (got["a"].n_images, got["a"].n_terms) == (2, 2) and got["a"].uncovered == ["filter", "words"]
    assert got["a"].unexplained == ["codec"]
    assert len(got["b"].hard) == 4 and got["b"].uncovered == ["only", "words", "here"]
    assert documents.audit(docs, spark.createDataFrame([("a", "img/a.png")], files.schema)).where("path = 'a'").first()["pass"]


def test_metadata(spark: SparkSession) -> None:
    crossref = {"message": {"title": ["T"], "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[2020]]}, "abstract": "<p>x</p>"}}
    datacite = {"data": {"attributes": {"titles": [{"title": "D"}], "creators": [{"name": "C"}], "publicationYear": 2019, "publisher": "P"}}}
    unpaywall = {"is_oa": True, "best_oa_location": {"url_for_pdf": "u1"}, "oa_locations": [{"url_for_pdf": "u1", "url": "u2"}]}
    rows = [("d1", "crossref", crossref), ("d1", "datacite", datacite), ("d1", "unpaywall", unpaywall), ("d2", "datacite", datacite), ("d3", "crossref", "broken")]
    responses = spark.createDataFrame([(d, s, json.dumps(b)) for d, s, b in rows], "doi string, source string, body string")
    meta = documents.metadata(responses)
    got = {r.doi: r for r in meta.collect()}
    assert (got["d1"].title, got["d1"].authors, got["d1"].year, got["d1"].abstract) == ("T", ["A B"], 2020, "x")
    assert (got["d2"].title, got["d2"].authors, got["d2"].journal, got["d2"].year) == ("D", ["C"], "P", 2019)
    assert got["d3"].title is None
    urls = [(r.source, r.url) for r in documents.candidates(meta).where("doi = 'd1'").orderBy("place").collect()]
    assert urls == [("unpaywall", "u1"), ("unpaywall", "u2")]
    # the first registry's title keeps the second out; what the access services call the work stays apart
    assert (got["d1"].journal, got["d1"].publisher, got["d2"].publisher) == (None, None, "P")
    one = {"crossref": {"message": {"publisher": "C"}}, "datacite": datacite, "unpaywall": {"title": "U", "journal_name": "J", "best_oa_location": {"url": "u"}}, "openalex": {"open_access": {"oa_url": "o"}, "best_oa_location": {"pdf_url": "https://hal.science/x"}}, "europepmc": {"resultList": {"result": [{"pmcid": "PMC1"}]}}}
    whole = documents.metadata(spark.createDataFrame([("10.48550/arXiv.1", k, json.dumps(v)) for k, v in one.items()], responses.schema))
    w = whole.first()
    assert (w.title, w.publisher, w.unpaywall_title, w.unpaywall_journal, w.openalex_oa_url, w.pmcid) == ("D", "C", "U", "J", "o", "PMC1")
    feeds = spark.createDataFrame([("10.48550/arXiv.1", 0, "<feed/>"), ("10.48550/arXiv.1", 1, "<id>http://arxiv.org/abs/2001.1v2</id><id>https://arxiv.org/abs/2001.1</id>")], "doi string, variant int, body string")
    found = [(r.source, r.url) for r in documents.candidates(whole, documents.title_candidates(feeds)).orderBy("place").collect()]
    assert found == [("arxiv", "https://arxiv.org/pdf/1"), ("unpaywall", "u"), ("openalex", "https://hal.science/x"), ("openalex", "https://hal.science/x/document"), ("openalex", "o"), ("europepmc", "https://www.ebi.ac.uk/europepmc/webservices/rest/PMC/PMC1/fullTextPDF"), ("preprint", "https://arxiv.org/pdf/2001.1")]
    titled = spark.createDataFrame([("a", " one two  three four five six seven eight nine ten eleven"), ("b", "short")], "doi string, title string")
    assert [tuple(r) for r in documents.title_queries(titled).orderBy("variant").collect()] == [("a", 0, "one two three four five six seven eight nine ten eleven"), ("a", 1, "one two three four five six seven eight nine ten")]
    tried = spark.createDataFrame([("d1", 0, "a", "x", False), ("d1", 1, "b", "y", True), ("d1", 2, "c", "z", True)], "doi string, place int, source string, url string, ok boolean")
    assert tuple(documents.first_success(tried).first()) == ("d1", "b", "y")


def test_records(spark: SparkSession, tmp_path: Path) -> None:
    def record(name: str, split: str | None, value: float, dirty: bool = False, data: bool = True) -> str:
        return json.dumps({"schema_version": 1, "name": name, "timestamp": "2026-01-0" + str(len(name)), "metrics": {"eer": value, "n": 2}, "config": {"lr": 0.1}, "git": {"commit": "c", "dirty": dirty}, "notes": "", "split_fingerprint": split and {"file": "f", "sha256": split}, "data_fingerprint": {"sha256": "d", "n_files": 1, "mode": "stat"} if data else None})

    for k, content in enumerate([record("run", "s", 0.5), record("run", "s", 0.25), record("other", None, 1.0, dirty=True, data=False)]):
        (tmp_path / f"r{k}.json").write_text(content)
    (tmp_path / "broken.json").write_text("{no json")
    (tmp_path / "SUMMARY_x.json").write_text(record("s", "s", 1.0))
    (tmp_path / "no.json").write_text('{"name": "x"}')
    rows = records.records(spark, str(tmp_path))
    assert sorted(r.file for r in rows.collect()) == ["r0.json", "r1.json", "r2.json"]
    assert [tuple(r) for r in tracker.metric_keys(rows).collect()] == [("eer", 3), ("n", 3)]
    issues = sorted((r.issue, r.file) for r in tracker.provenance(rows).collect())
    assert issues == [("changed-tree", "r2.json"), ("conflicting-runs", "r0.json"), ("conflicting-runs", "r1.json"), ("no-data-hash", "r2.json"), ("no-split-hash", "r2.json")]
    lines = [r.line for r in tracker.report(rows, check=True).orderBy("line_no").collect()]
    assert lines[:5] == ["# 实验结果汇总（3 条，核心指标：eer, n）", "", "| 实验 | 时间 | eer | n | 配置摘要 |", "|---|---|---|---|---|", "| run | 2026-01-03 | 0.5000 | 2 | lr=0.1 |"]
    assert lines[7:10] == ["", "## 可追溯性审计", ""] and lines[10].startswith("- ℹ️ `run` 同名同切分有 2 次") and len(lines) == 14
    clean = rows.where("file = 'r0.json'")
    assert [r.line for r in tracker.report(clean, check=True).orderBy("line_no").collect()][-1] == "- ✅ 未发现可追溯性问题"


def test_runs_without_a_split(spark: SparkSession) -> None:
    """No split is a split too: two such runs that differ are at odds."""
    rows = spark.createDataFrame([("a", None, {"m": "1"}), ("a", None, {"m": "2"}), ("b", None, {"m": "1"}), ("b", "s", {"m": "2"})], "name string, split string, metrics map<string,string>")
    assert [tuple(r) for r in tracker.duplicate_runs(rows).collect()] == [("a", None, 2, 2)]


def test_lines_within_a_minute(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("b", "2026-01-01T10:00:59", "x"), ("a", "2026-01-01T10:00:30", "z"), ("c", "2026-01-01T10:00:30", "y")], "name string, timestamp string, file string")
    rows = rows.withColumn("metrics", F.create_map(F.lit("m"), F.lit("1"))).withColumn("config", F.lit(None).cast("map<string,string>"))
    table = tracker.summary_table(rows, ["m"])
    got = [r.line for r in tracker.markdown(table, ["timestamp", "file"], {"name": "n", "time": "t"}).orderBy("line_no").collect()]
    assert got == ["| n | t |", "|---|---|", "| c | 2026-01-01T10:00 |", "| a | 2026-01-01T10:00 |", "| b | 2026-01-01T10:00 |"]


def test_registered_records(spark: SparkSession, tmp_path: Path) -> None:
    runs = spark.createDataFrame([("a b/c", '{"eer": 0.25, "n": 2}', '{"lr": 0.1}', "2026-01-02 03:04:05.678")], "name string, metrics string, config string, timestamp string")
    runs = runs.withColumn("timestamp", F.to_timestamp("timestamp"))
    records.append(records.registered(runs, ("abc", True)), str(tmp_path))
    (file,) = tmp_path.iterdir()
    assert file.name == "a_b_c_2026-01-02T030405678.json"
    got = json.loads(file.read_text())
    assert (got["metrics"], got["config"], got["git"], got["timestamp"], got["schema_version"]) == ({"eer": 0.25, "n": 2}, {"lr": 0.1}, {"commit": "abc", "dirty": True}, "2026-01-02T03:04:05", 1)
    assert records.records(spark, str(tmp_path)).first().metrics == {"eer": "0.25", "n": "2"}
    records.append(records.registered(runs, ("abc", True)), str(tmp_path))  # the same again does no harm
    with pytest.raises(Exception, match="other content"):
        records.append(records.registered(runs, ("other", True)), str(tmp_path))
    for bad in ("{}", "[1]", "no", None):
        with pytest.raises(Exception, match="metrics must be"):
            records.registered(runs.withColumn("metrics", F.lit(bad).cast("string"))).collect()


def test_one_call_registers(spark: SparkSession, tmp_path: Path) -> None:
    """Git state, split and data folder go into the record; the summary is written under its one name."""
    data, results = tmp_path / "data", tmp_path / "results"
    (data / "sub").mkdir(parents=True)
    results.mkdir()
    (data / "a.txt").write_text("one")
    (data / "sub" / "b.txt").write_text("three")
    (tmp_path / "split.csv").write_text("train,a")
    at = datetime(2026, 1, 2, 3, 4, 5, 678_900)
    path = records.register(spark, str(results), "my run", '{"eer": 0.5}', '{"lr": 1}', "note", str(tmp_path / "split.csv"), str(data), str(tmp_path), at)
    assert path == str(results / "my_run_2026-01-02T030405678.json")
    got = json.loads(Path(path).read_text())
    lines = sorted(f"{p.relative_to(data)}|{p.stat().st_size}|{int(p.stat().st_mtime)}" for p in data.rglob("*") if p.is_file())
    assert got["data_fingerprint"] == {"sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], "n_files": 2, "mode": "stat-fingerprint"}
    assert got["split_fingerprint"] == {"file": str(tmp_path / "split.csv"), "sha256": hashlib.sha256(b"train,a").hexdigest()}
    assert (got["notes"], got["config"], got["git"]["commit"]) == ("note", {"lr": 1}, None)
    with pytest.raises(Exception, match="metrics must be"):
        records.register(spark, str(results), "x", "{}")
    with pytest.raises(ValueError, match="may not hold"):
        records.register(spark, f"{results}/../x", "x", '{"a": 1}')
    rows = records.records(spark, str(results)).withColumn("split", F.col("split_fingerprint.sha256"))
    tracker.write_report(rows, str(tmp_path / "SUMMARY.md"), check=True)
    assert (tmp_path / "SUMMARY.md").read_text() == "".join(r.line + "\n" for r in tracker.report(rows, check=True).orderBy("line_no").collect())
    for bad in ("other.md", "../SUMMARY.md"):
        with pytest.raises(ValueError, match="SUMMARY.md|may not hold"):
            tracker.write_report(rows, str(tmp_path / bad))


def test_changed_files_touch_one_range(spark: SparkSession) -> None:
    files = spark.range(0, 5000, 1, 3).select(F.concat(F.lit("d/"), "id").alias("path"), F.col("id").alias("size"), F.lit(7).alias("modified"))
    one = files.withColumn("size", F.when(F.col("path") == "d/77", 1).otherwise(F.col("size")))
    fewer = files.where("path <> 'd/78'")
    tree = records.fingerprint_levels(files)
    for other, path in ((one, "d/77"), (fewer, "d/78")):
        differ = sorted(tuple(r) for r in records.changed_ranges(tree, records.fingerprint_levels(other)).collect())
        first = int(hashlib.sha256(path.encode()).hexdigest()[:4], 16)
        assert differ == [(k, first >> 4 * k) for k in range(5)]
        again = records.updated_levels(tree, other, spark.createDataFrame([(path,)], "path string"))
        assert records.changed_ranges(again, records.fingerprint_levels(other)).collect() == []
    assert records.tree_fingerprint(files).first().n_files == 5000 and records.tree_fingerprint(files.limit(0)).first().n_files == 0


def test_fingerprints_and_paths(spark: SparkSession, tmp_path: Path) -> None:
    files = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "path string, size long, modified long")
    first = tuple(records.fingerprint(files).first())
    assert first == (hashlib.sha256(b"a|1|10\nb|2|20").hexdigest()[:16], 2, "stat-fingerprint")
    assert first == tuple(records.fingerprint(files.orderBy(F.desc("path"))).first())
    assert tuple(records.fingerprint(files.where("false")).first())[:2] == (hashlib.sha256(b"").hexdigest()[:16], 0)
    tree = tuple(records.tree_fingerprint(files).first())
    assert tree == tuple(records.tree_fingerprint(files.orderBy(F.desc("path"))).first()) and tree[1] == 2 and len(tree[0]) == 16
    assert first != tuple(records.fingerprint(files.withColumn("size", F.col("size") + 1)).first())
    (tmp_path / "x.txt").write_text("abc")
    assert records.content_hashes(spark, str(tmp_path)).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert records.texts(spark, str(tmp_path)).first().text == "abc"
    assert records.safe_path(str(tmp_path), "x.txt").endswith("x.txt")
    for bad in ("../x", "a/../../x", "/etc/passwd"):
        with pytest.raises(ValueError):
            records.safe_path(str(tmp_path), bad)


def boxes(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame([(1, 0, *r) for r in rows], "doc_id long, page int, kind string, x0 double, y0 double, x1 double, y1 double")


def blocks(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame([(1, 0, k, *r) for k, r in enumerate(rows)], "doc_id long, page int, block int, x0 double, y0 double, x1 double, y1 double, text string, max_size double, all_bold boolean")


def test_layout(spark: SparkSession) -> None:
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id long, page int, width double, height double")
    b = boxes(spark, ("image", 50.0, 100.0, 250.0, 250.0), ("image", 60.0, 110.0, 240.0, 240.0), ("drawing", 300.0, 100.0, 350.0, 200.0), ("drawing", 360.0, 100.0, 420.0, 200.0), ("image", 400.0, 600.0, 500.0, 700.0), ("image", 0.0, 0.0, 20.0, 20.0))
    t = blocks(spark, (50.0, 255.0, 250.0, 270.0, "Figure 1. Left", 9.0, False), (300.0, 205.0, 420.0, 220.0, "Fig. 2 Right", 9.0, False), (50.0, 30.0, 300.0, 60.0, "Title", 20.0, False), (50.0, 300.0, 300.0, 320.0, "body of text that goes on", 9.0, False), (50.0, 330.0, 200.0, 340.0, "Bold heading", 9.0, True))
    got = {r.label: r for r in layout.figures(pages, b, t).collect()}
    assert set(got) == {"Figure 1", "Fig 2", None}
    assert (got["Figure 1"].x0, got["Figure 1"].y1) == (50.0, 250.0) and (got["Fig 2"].x0, got["Fig 2"].x1) == (300.0, 420.0)
    assert (got[None].x0, got[None].cover) == (400.0, 1.0)
    assert [r.text for r in layout.outline(t).orderBy("item").collect()] == ["[Page 1 | 20.0pt] Title", "[Page 1 | 9.0pt bold] Bold heading"]
    apart = [(0.0, 0.0, 100.0, 20.0), (0.0, 40.0, 100.0, 60.0)]
    assert len(layout.gathered(apart, [])) == 1 and len(layout.gathered(apart, [(0.0, 22.0, 100.0, 38.0)])) == 2
    assert layout.not_nested([(0, 0, 10, 10), (1, 1, 9, 9), (5, 5, 20, 20)]) == [(5, 5, 20, 20), (0, 0, 10, 10)]


def test_stream_of_levels(spark: SparkSession, tmp_path: Path) -> None:
    """A stream gives the windows that a batch gives, but for the last ones, which stay open."""
    rows = spark.range(600).select((F.col("id") % 2).cast("string").alias("key"), (F.col("id") * 60).cast("timestamp").alias("ts"), (F.col("id") % 7).cast("double").alias("value"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = levels.windowed_rms(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed, batch = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}, {tuple(r) for r in levels.windowed_rms(rows).collect()}
    assert len(batch) == 20 and streamed < batch and len(streamed) >= 14


def test_image_paths(spark: SparkSession) -> None:
    docs = spark.createDataFrame([("d", "![a](./img/a.png) ![b](img/../img/b.png) ![c](../c.png) ![e](img//e.png)")], "path string, text string")
    files = spark.createDataFrame([("d", "img/a.png"), ("d", "img/b.png"), ("d", "./img/e.png")], "path string, file string")
    assert [r.ref for r in documents.missing_images(docs, files).collect()] == ["../c.png"]


def test_covered_words(spark: SparkSession) -> None:
    """By every pair of word and term, each way."""
    words = ["mel", "melody", "caramel", "codec", "code", "deco", "filter", "the", "abc", "bca", "spectrogram", "gram", "a-b'c"]
    terms = ["Mel", "codec", "ra", "ilt", "the spectrogram of it", "x", "abca"]
    tokens = spark.createDataFrame([(p, w) for p in "pq" for w in words], "path string, token string")
    got = {tuple(r) for r in documents.uncovered(tokens, spark.createDataFrame([("p", t) for t in terms], "path string, term string")).collect()}
    low = [t.lower() for t in terms]
    want = {("p", w) for w in words if w not in text.PLAIN_WORDS and not any(t in w or w in t for t in low)}
    assert got == want | {("q", w) for w in words if w not in text.PLAIN_WORDS}


def test_articles(spark: SparkSession) -> None:
    body = {"title": "<i>T</i> x", "authorString": "A B, C D,", "journalInfo": {"journal": {"title": "J"}, "yearOfPublication": 2020}, "pmid": "7"}
    got = documents.article_metadata(spark.createDataFrame([("PMC1", None, json.dumps(body))], "pmcid string, doi string, body string")).first()
    assert (got.title, got.authors, got.journal, got.year, got.pmid, got.download_source) == ("T x", ["A B", "C D"], "J", "2020", "7", "EuropePMC fullTextXML + PMC CDN images (PMC1)")
    texts = spark.createDataFrame([("PMC1", "short"), ("PMC2", "x" * 5000)], "pmcid string, text string")
    images = spark.createDataFrame([("PMC1", f"a/{i}.jpg", None) for i in range(6)] + [("PMC2", "b.jpg", "u")], "pmcid string, href string, url string")
    got = {r.pmcid: r.warnings for r in documents.article_warnings(texts, images).collect()}
    assert got == {"PMC1": ["6 images missing: 0.jpg, 1.jpg, 2.jpg, 3.jpg, 4.jpg, ...", "short text"], "PMC2": []}
    pictures = spark.createDataFrame([(1, 0, bytearray(b"a")), (1, 1, bytearray(b"a")), (1, 2, bytearray(b"b")), (2, 0, bytearray(b"a"))], "doc_id int, place int, content binary")
    assert sorted((r.doc_id, r.place) for r in documents.distinct_images(pictures).collect()) == [(1, 0), (1, 2), (2, 0)]
