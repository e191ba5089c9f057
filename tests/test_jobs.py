"""Jobs from files to files: tasks in JSON, and folders of audio."""

from __future__ import annotations

import csv
import json
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quern.operators import documents
from quern.plans import audio_jobs, paper_jobs, tasks
from quern.sources.audio import wav16

TASKS = {
    "classification": ({"y_true": ["A", 1], "y_pred": ["A", "A"]}, {"accuracy": 0.5, "macro_f1": 0.333334}),
    "verification": ({"pos_scores": [0.8, 0.9], "neg_scores": [0.2, 0.3], "threshold": 0.5}, {"eer": 0.0, "eer_threshold": 0.30025, "auroc": 1.0, "at_threshold": {"far": 0.0, "frr": 0.0, "threshold": 0.5}}),
    "openset": ({"y_true": ["A", "U"], "y_pred": ["A", "A"], "scores": [0.9, 0.7], "unknown_label": "U"}, {"oscr_summary": {"oscr": 1.0, "threshold": 0.70202, "n_known": 1, "n_unknown": 1}}),
    "asr": ({"refs": ["the cat sat on mat"], "hyps": ["the cat sit mat now"]}, {"WER": 0.6, "errors": 3, "total_tokens": 5}),
    "sed": ({"y_true_multihot": [[1, 0], [0, 1]], "y_score": [[0.9, 0.2], [0.1, 0.8]], "classes": ["x", "y"]}, {"map": 1.0}),
}


@pytest.mark.parametrize("task", TASKS)
def test_tasks(task: str, spark: SparkSession, tmp_path: Path) -> None:
    given, want = TASKS[task]
    (tmp_path / "task.json").write_text(json.dumps({"task": task, **given}))
    tasks.write_result(tasks.evaluate(spark, str(tmp_path / "task.json")), str(tmp_path / "metrics_result.json"))
    got = json.loads((tmp_path / "metrics_result.json").read_text())
    assert (got["status"], got["task"]) == ("ok", task) and want.items() <= got["metrics"].items()


def test_bad_tasks(spark: SparkSession, tmp_path: Path) -> None:
    path = tmp_path / "task.json"
    path.write_text(json.dumps({"task": "other"}))
    with pytest.raises(ValueError, match="unknown task"):
        tasks.evaluate(spark, str(path))
    path.write_text(json.dumps({"task": "asr", "refs": ["a"], "hyps": []}))
    with pytest.raises(Exception, match="one length"):
        tasks.evaluate(spark, str(path)).collect()
    with pytest.raises(ValueError, match="metrics_result"):
        tasks.write_result(spark.range(1), str(tmp_path / "x.json"))


@pytest.fixture
def folder(tmp_path: Path) -> Path:
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    t = np.arange(8000) / 8000
    (root / "a.wav").write_bytes(wav16(8000, 0.5 * np.sin(2 * np.pi * 440 * t)))
    (root / "sub" / "two.wav").write_bytes(wav16(8000, np.stack([0.25 * np.ones(800), -0.25 * np.ones(800)], axis=1)))
    (root / "loud.wav").write_bytes(wav16(8000, np.ones(400)))
    (root / "bad.wav").write_bytes(b"RIFF")
    (root / "x.xyz").write_bytes(b"?")
    return root


def rows_of(path: Path) -> list[dict]:
    return [r for f in path.glob("part-*.csv") for r in csv.DictReader(f.open())]


@pytest.mark.parametrize("light", [False, True])
def test_audit(light: bool, spark: SparkSession, folder: Path, tmp_path: Path) -> None:
    out = tmp_path / "out"
    r = audio_jobs.audit(spark, str(folder), str(out), light=light).first()
    assert (r.n_audio, r.n_errors, r.n_unsupported, r.mode) == (4, 1, 1, "light" if light else "full")
    assert r.unsupported_examples[0].endswith("x.xyz") and r.errors[0].path.endswith("bad.wav") and r.sr_distribution["8000"] == 3
    flags = {f.path.rsplit("/", 1)[1]: f.flags for f in r.flagged}
    assert flags == ({"loud.wav": ["too-short"], "two.wav": ["too-short"]} if light else {"loud.wav": ["clipping", "too-short"], "two.wav": ["high-silence", "too-short", "all-zero"]})
    table = {Path(x["path"]).name: x for x in rows_of(out / "audio_audit.csv")}
    assert len(table) == 4 and table["a.wav"]["duration"] == "1.0" and table["two.wav"]["channels"] == "2" and table["bad.wav"]["error"]
    assert {x.share: x.value for x in r.duration_stats}[1.0] == 1.0


@pytest.mark.parametrize("mono", [False, True])
def test_convert(mono: bool, spark: SparkSession, folder: Path, tmp_path: Path) -> None:
    out = tmp_path / "out"
    done = audio_jobs.convert(spark, str(folder), str(out), sr=4000, mono=mono, trim="0-0.5", normalize=True).collect()
    end = "_4000hz_mono.wav" if mono else "_4000hz.wav"
    assert {r.file for r in done if r.error is None} == {f"a{end}", f"loud{end}", f"sub/two{end}"} and [r.file for r in done if r.error] == ["bad.wav"]
    said = spark.read.json(str(out / "audio_convert.json")).first()
    assert (said.status, said.converted, said.failed, said.target_sr, said.warnings) == ("ok", 3, 1, 4000, [audio_jobs.UNSUPPORTED]) and said.failures[0].file == "bad.wav"
    with wave.open(str(out / "sub" / f"two{end}")) as w:
        assert (w.getframerate(), w.getnchannels(), w.getnframes(), w.getsampwidth()) == (4000, 1 if mono else 2, 400, 2)
        x = np.frombuffer(w.readframes(400), "<i2").reshape(400, -1)
    if not mono:
        assert np.all(x[50:350, 0] > 20000) and np.all(x[50:350, 1] == -x[50:350, 0])
    with wave.open(str(out / f"a{end}")) as w:
        assert w.getnframes() == 2000
    for bad in (str(folder), f"{folder}/../in", ""):
        with pytest.raises(ValueError):
            audio_jobs.convert(spark, str(folder), bad)


def test_features_to_files(spark: SparkSession, folder: Path, tmp_path: Path) -> None:
    out = tmp_path / "out"
    r = audio_jobs.features(spark, str(folder), str(out), ("duration", "peak_freq", "zcr")).first()
    assert (r.status, r.n_files, r.n_errors, r.features) == ("ok", 3, 1, ["duration", "peak_freq", "zcr"]) and r.errors[0].file == "bad.wav"
    table = {x["file"]: x for x in rows_of(out / "acoustic_features.csv")}
    assert table["a.wav"]["duration_s"] == "1.0" and abs(float(table["a.wav"]["peak_freq_hz"]) - 440) < 8 and set(table["a.wav"]) == {"file", "duration_s", "rms_db", "peak_freq_hz", "zcr"}
    with pytest.raises(ValueError, match="unknown features"):
        audio_jobs.features(spark, str(folder), str(out), ("nothing",))


def test_papers_to_files(spark: SparkSession, tmp_path: Path) -> None:
    pages = spark.createDataFrame([(7, 0, 600.0, 800.0), (8, 0, 600.0, 800.0)], "doc_id long, page int, width double, height double")
    boxes = spark.createDataFrame([(7, 0, "image", 300.0, 600.2, 500.0, 750.0), (7, 0, "image", 50.0, 100.4, 250.0, 250.0)], "doc_id long, page int, kind string, x0 double, y0 double, x1 double, y1 double")
    blocks = spark.createDataFrame([(7, 0, 0, 50.0, 20.0, 250.0, 60.0, "Title of it", 20.0, False), (7, 0, 1, 50.0, 255.0, 250.0, 270.0, "Figure 1. Left", 9.0, False), (7, 0, 2, 50.0, 300.0, 250.0, 320.0, "body", 9.0, False), (8, 0, 0, 1.0, 1.0, 9.0, 9.0, "thin", 9.0, False)], "doc_id long, page int, block int, x0 double, y0 double, x1 double, y1 double, text string, max_size double, all_bold boolean")
    paper_jobs.write(pages, boxes, blocks, str(tmp_path))
    got = json.loads((tmp_path / "7" / "figures_manifest.json").read_text())
    assert [(f["file"], f["label"], f["source"], f["page"]) for f in got] == [("figures/fig_001_p1.png", "Figure 1", "raster", 1), ("figures/fig_002_p1.png", "未识别编号", "raster", 1)]
    assert got[0]["rect_pt"] == [50.0, 100.4, 250.0, 250.0] and json.loads((tmp_path / "8" / "figures_manifest.json").read_text()) == []
    assert (tmp_path / "7" / "paper_outline.txt").read_text() == "[Page 1 | 20.0pt] Title of it\n" and not (tmp_path / "8" / "paper_outline.txt").exists()
    assert (tmp_path / "7" / "paper_text.txt").read_text() == "\n\n===== Page 1 =====\n\nTitle of it\nFigure 1. Left\nbody\n\n===== 检测到的图表题注 =====\n[Page 1] Figure 1: Figure 1. Left\n"
    found = {r.doc_id: r for r in paper_jobs.summary(pages, boxes, blocks).collect()}
    assert (found[7].figure_count, found[7].captions_found, found[7].warnings) == (2, 1, ["little-text"])
    assert (found[8].figure_count, found[8].text_chars, found[8].warnings) == (0, 4, ["little-text", "no-figures"])


def test_articles_to_files(spark: SparkSession, tmp_path: Path) -> None:
    xml = '<article><fig><label>1</label><caption>C</caption><graphic xlink:href="x/f1.jpg"/></fig><fig><graphic xlink:href="f2.png"/></fig><fig><graphic xlink:href="f3.tif"/></fig><fig><graphic xlink:href="f4.gif"/></fig>' + "word " * 1200 + "</article>"
    blob = "https://cdn.ncbi.nlm.nih.gov/pmc/blobs/a/"
    html = f'<img src="{blob}f1.jpg"><img src="{blob}other/f1.jpg"><img src="{blob}f4.gif">'
    body = json.dumps({"title": "T", "authorString": "A B", "pubYear": "2020"})
    articles = spark.createDataFrame([("PMC1", "10.1/x", body, xml, html), ("PMC2", None, body, None, None)], "pmcid string, doi string, body string, xml string, html string")
    stored = spark.createDataFrame([(f"{blob}f1.jpg", b"i" * 2000), (f"{blob}other/f1.jpg", b"o" * 2000), (f"{blob}f4.gif", b"small")], "url string, content binary")
    got = {r.pmcid: r for r in paper_jobs.rescued(articles, stored, str(tmp_path)).collect()}
    assert got["PMC1"].figures == ["figures/f1.jpg"] and got["PMC1"].warnings == ["2 images missing: f2.png, f4.gif"] and got["PMC2"].warnings == ["short text"]
    assert (tmp_path / "PMC1" / "figures" / "f1.jpg").read_bytes() == b"i" * 2000
    meta = json.loads((tmp_path / "PMC1" / "metadata.json").read_text())
    assert (meta["doi"], meta["title"], meta["figures"], meta["volume"]) == ("10.1/x", "T", ["figures/f1.jpg"], None)
    assert len((tmp_path / "PMC1" / "paper_text.txt").read_text()) == got["PMC1"].text_chars and (tmp_path / "PMC2" / "paper_text.txt").read_text() == ""


def test_attempts_end_with_the_first_success(spark: SparkSession) -> None:
    rows = [("a", 0, "arxiv", "u0", False, "404"), ("a", 2, "publisher", "u2", True, "10 bytes"), ("a", 1, "unpaywall", "u1", None, "refused"), ("a", 3, "preprint", "u3", True, "9 bytes"), ("b", 0, "preprint", "v0", True, "5 bytes"), ("c", 0, "arxiv", "w0", False, "403")]
    got = {r.doi: r for r in documents.acquired(spark.createDataFrame(rows, "doi string, place int, source string, url string, ok boolean, note string")).collect()}
    assert (got["a"].ok, got["a"].source, got["a"].url, got["a"].is_preprint) == (True, "publisher", "u2", False)
    assert [tuple(x) for x in got["a"].attempts] == [("arxiv", "u0", False, "404"), ("unpaywall", "u1", False, "refused"), ("publisher", "u2", True, "10 bytes")]
    assert got["b"].is_preprint and (got["c"].ok, got["c"].url, len(got["c"].attempts)) == (False, None, 1)
