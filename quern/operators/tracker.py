"""Summaries and provenance checks of experiment records (see ``sources.records``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import shown_number
from quern.operators.ordered import numbered
from quern.sources import file_sink

#: Fixed texts of the report.
TITLE, KEYS, AUDIT, CLEAN = "# 实验结果汇总（{n} 条，{keys}）", "核心指标：", "## 可追溯性审计", "- ✅ 未发现可追溯性问题"
COLUMNS = ("实验", "时间", "配置摘要")
NO_SPLIT, NO_DATA, CHANGED = "）缺少切分指纹，数字无法追溯到具体切分", "）缺少数据指纹", "` 登记时 git 工作区不干净，复现性存疑"
CONFLICT, CONFLICT_END = "` 同名同切分有 ", " 次结果且指标不同——确认是否为多种子/多折（应把折号写进 config 或 notes）"


def metric_keys(rows: DataFrame, top: int = 8, by: str = "file") -> DataFrame:
    """``key, n``: the ``top`` most frequent metric names; ties by first appearance in order of ``by``."""
    keys = rows.select(F.col(by).alias("_by"), F.posexplode(F.map_keys("metrics")).alias("_at", "key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("_by", "_at")).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(top).select("key", "n")


def duplicate_runs(rows: DataFrame) -> DataFrame:
    """``name, split, runs, results``: runs of one name and split (none is a split too) that differ in their metrics. Rows: ``name, split, metrics`` (map)."""
    canonical = F.to_json(F.sort_array(F.transform(F.map_entries("metrics"), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("value")))))
    known = rows.select("name", "split", canonical.alias("result"))
    return known.groupBy("name", "split").agg(F.count("*").alias("runs"), F.count_distinct("result").alias("results")).where("runs > 1 AND results > 1")


def provenance(rows: DataFrame) -> DataFrame:
    """``issue, file, name``: records without a split's or the data's hash, from a changed tree, or at odds with another run."""
    issue = lambda test, name: rows.where(test).select(F.lit(name).alias("issue"), "file", "name")
    r = rows.withColumn("split", F.col("split_fingerprint.sha256")).alias("r")
    d = duplicate_runs(r).select("name", "split").alias("d")
    twice = r.join(d, F.col("r.name").eqNullSafe(F.col("d.name")) & F.col("r.split").eqNullSafe(F.col("d.split"))).select(F.lit("conflicting-runs").alias("issue"), "r.file", "r.name")
    return issue("split_fingerprint.sha256 IS NULL", "no-split-hash").unionByName(issue("data_fingerprint.sha256 IS NULL", "no-data-hash")).unionByName(issue("git.dirty", "changed-tree")).unionByName(twice)


def summary_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``name, time, <keys>, config, timestamp, file``: one line of a report for each record; the last two give its order."""
    config = F.array_join(F.transform(F.slice(F.map_entries("config"), 1, 4), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ", ")
    shown = [shown_number(F.try_element_at("metrics", F.lit(k))).alias(k) for k in keys]
    return rows.select(F.coalesce("name", F.lit("?")).alias("name"), F.substring(F.coalesce("timestamp", F.lit("?")), 1, 16).alias("time"), *shown, F.coalesce(config, F.lit("")).alias("config"), F.coalesce("timestamp", F.lit("")).alias("timestamp"), "file")


def markdown(table: DataFrame, order: list[str], columns: dict[str, str] | None = None) -> DataFrame:
    """``line_no, line``: a table as Markdown, its rows in an ``order`` that no two share; ``columns`` names those to show."""
    columns = columns or {c: c for c in table.columns}
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = table.sparkSession.createDataFrame([(0, f"| {' | '.join(columns.values())} |"), (1, f"|{'---|' * len(columns)}")], "line_no long, line string")
    body = numbered(table, order, "_at").select((F.col("_at") + 2).alias("line_no"), cells.alias("line"))
    return head.unionByName(body)


def audit_lines(rows: DataFrame) -> DataFrame:
    """``place, line``: the report's lines on provenance, conflicts first, then each record's issues; one line if there are none."""
    r = rows.withColumn("split", F.col("split_fingerprint.sha256"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    name = F.coalesce("name", F.lit("?"))
    first = r.groupBy("name", "split").agg(F.min("file").alias("file")).alias("f")
    d = duplicate_runs(r).alias("d")
    conflicts = d.join(first, F.col("d.name").eqNullSafe(F.col("f.name")) & F.col("d.split").eqNullSafe(F.col("f.split"))).select("d.name", "runs", "file")
    conflicts = conflicts.select(F.struct(F.lit(0).alias("part"), "file", F.lit(0).alias("k")).alias("place"), text("- ℹ️ `", name, CONFLICT, F.col("runs").cast("string"), CONFLICT_END).alias("line"))
    issues = F.array(
        F.when(F.col("split").isNull(), text("- ⚠️ `", name, "`（", F.col("file"), NO_SPLIT)),
        F.when(F.col("data_fingerprint.sha256").isNull(), text("- ⚠️ `", name, "`（", F.col("file"), NO_DATA)),
        F.when(F.col("git.dirty"), text("- ⚠️ `", name, CHANGED)),
    )
    found = r.select("file", F.posexplode(F.array_compact(issues)).alias("k", "line")).select(F.struct(F.lit(1).alias("part"), "file", "k").alias("place"), "line")
    none = found.agg(F.count("*").alias("n")).where("n = 0").select(F.struct(F.lit(1).alias("part"), F.lit("").alias("file"), F.lit(0).alias("k")).alias("place"), F.lit(CLEAN).alias("line"))
    return conflicts.unionByName(found).unionByName(none)


def report(rows: DataFrame, check: bool = False) -> DataFrame:
    """``line_no, line``: the whole Markdown summary of records (at least one), with the provenance audit if ``check``."""
    spark = rows.sparkSession
    keys = [r.key for r in metric_keys(rows).collect()]  # eight names at most
    shown = {"name": COLUMNS[0], "time": COLUMNS[1], **{k: k for k in keys}, "config": COLUMNS[2]}
    title = TITLE.format(n=rows.count(), keys=KEYS + ", ".join(keys) if keys else "[]")
    parts = [spark.createDataFrame([(0, 0, title), (0, 1, "")], "part int, line_no long, line string")]
    parts.append(markdown(summary_table(rows, keys), ["timestamp", "file"], shown).select(F.lit(1).alias("part"), "line_no", "line"))
    if check:
        parts.append(spark.createDataFrame([(2, 0, ""), (2, 1, AUDIT), (2, 2, "")], "part int, line_no long, line string"))
        parts.append(numbered(audit_lines(rows), ["place"], "line_no").select(F.lit(3).alias("part"), "line_no", "line"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return numbered(out.withColumnRenamed("line_no", "at"), ["part", "at"], "line_no").select("line_no", "line")


def write_report(rows: DataFrame, path: str, check: bool = False) -> None:
    """Writes the Markdown summary to a file, whose name must be ``SUMMARY.md``; ``..`` in the path is an error."""
    folder, _, name = path.rpartition("/")
    if ".." in path.split("/"):
        raise ValueError(f"a path may not hold '..': {path!r}")
    if name != "SUMMARY.md":
        raise ValueError(f"a summary's file is SUMMARY.md, not {name!r}")
    lines = report(rows, check).select(F.lit(name).alias("file"), F.col("line_no").alias("part"), F.encode(F.concat("line", F.lit("\n")), "UTF-8").alias("content"))
    file_sink.write(lines, folder or ".", replace=True)
