"""Experiment records as JSON files, texts as whole rows, and checked output paths."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import safe_name
from quern.sources import file_sink
from quern.sources.shared import kept

#: The fields of a record; metrics and settings keep their literal text.
RECORD = "schema_version int, name string, timestamp string, metrics map<string,string>, config map<string,string>, git struct<commit:string,dirty:boolean>, notes string, split_fingerprint struct<file:string,sha256:string>, data_fingerprint struct<sha256:string,n_files:int,mode:string>"


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records below a folder with their ``file``; files that are no JSON objects with metrics, and summaries, are skipped."""
    schema = f"{RECORD}, _corrupt_record string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    return rows.where("metrics IS NOT NULL AND NOT startswith(file, 'SUMMARY') AND NOT startswith(file, 'metrics_result')").drop("_corrupt_record")


#: What a record is written as; metrics and settings are JSON text here and JSON values in the file.
VERSION = 1


def registered(runs: DataFrame, git: tuple[str | None, bool | None] = (None, None)) -> DataFrame:
    """``file, json`` of rows ``name, metrics, config, timestamp`` (and, if there, ``notes, split_fingerprint, data_fingerprint``).

    metrics and config are JSON texts, timestamp is one of Spark's. Metrics that are no JSON object, or an empty one, are
    an error, as are settings that don't parse. The file is named by the safe name and the time to a thousandth of a
    second; rows that would share a name are an error when they are written.
    """
    kind = "map<string,variant>"
    checked = lambda c, test, why: F.when(F.coalesce(test, F.lit(False)), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(why), F.coalesce(F.col(c), F.lit("null")))).cast("string"))
    parsed = lambda c: F.from_json(F.col(c), kind)
    metrics = checked("metrics", F.size(F.map_keys(parsed("metrics"))) > 0, "metrics must be a JSON object that is not empty: ")
    config = checked("config", F.try_parse_json("config").isNotNull(), "settings must be JSON: ")
    rows = runs.withColumn("config", F.coalesce("config", F.lit("{}"))).select("*", safe_name("name").alias("_name"), metrics.alias("_metrics"), config.alias("_config"))
    optional = [F.col(c).alias(c) for c in ("split_fingerprint", "data_fingerprint") if c in runs.columns]
    notes = F.coalesce("notes", F.lit("")) if "notes" in runs.columns else F.lit("")
    state = F.struct(F.lit(git[0]).cast("string").alias("commit"), F.lit(git[1]).cast("boolean").alias("dirty"))
    record = F.struct(F.lit(VERSION).alias("schema_version"), F.col("_name").alias("name"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.parse_json("_metrics").alias("metrics"), F.parse_json("_config").alias("config"), state.alias("git"), notes.alias("notes"), *optional)
    file = F.concat("_name", F.lit("_"), F.date_format("timestamp", "yyyy-MM-dd'T'HHmmssSSS"), F.lit(".json"))
    return rows.select(file.alias("file"), F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def folder_listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` (below the folder)``, size, modified`` (whole seconds) of a folder's files, as Spark lists them: without hidden ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.split(":", 1)[-1].rstrip("/") if ":" in folder.split("/")[0] else os.path.realpath(folder)
    bare = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    inside = F.expr(f"substring(bare, {len('/' + root.strip('/')) + 2})")
    return files.select(bare.alias("bare"), "length", "modificationTime").select(inside.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified"))


def register(spark: SparkSession, results_dir: str, name: str, metrics: str, config: str = "{}", notes: str = "", split_file: str | None = None, data_dir: str | None = None, workdir: str = ".", timestamp: datetime | None = None) -> str:
    """Adds one result to a folder and returns its file's path: git state, the split file's hash and the data folder's fingerprint go with it.

    metrics and config are JSON texts; ``..`` in the folder is an error. timestamp: now, if not given.
    """
    if ".." in results_dir.split("/"):
        raise ValueError(f"a path may not hold '..': {results_dir!r}")
    at = timestamp or datetime.now()
    runs = spark.createDataFrame([(name, metrics, config, notes, at.isoformat(sep=" ", timespec="milliseconds"))], "name string, metrics string, config string, notes string, timestamp string")
    runs = runs.withColumn("timestamp", F.to_timestamp("timestamp"))
    if split_file is not None:
        whole = content_hashes(spark, split_file).select(F.struct(F.lit(os.path.abspath(split_file)).alias("file"), "sha256").alias("split_fingerprint"))
        runs = runs.join(F.broadcast(whole))  # one file
    if data_dir is not None:
        found = fingerprint(folder_listing(spark, data_dir)).select(F.struct("sha256", F.col("n_files").cast("int").alias("n_files"), "mode").alias("data_fingerprint"))
        runs = runs.join(F.broadcast(found))  # one row
    rows = kept(registered(runs, git_state(workdir)))
    append(rows, results_dir)
    return f"{results_dir.rstrip('/')}/{rows.first().file}"


def append(rows: DataFrame, folder: str) -> None:
    """Adds ``file, json`` rows to a folder that all executors share, a file each; files of other content that are there already are an error."""
    write_files(rows.select("file", F.encode("json", "UTF-8").alias("content")), folder)


def write_files(rows: DataFrame, folder: str, replace: bool = False) -> None:
    """Writes ``file, content`` (binary) rows below a folder that all executors share: all of them, or none if the job fails.

    Without ``replace`` a file of other content that is there already is an error.
    """
    file_sink.write(rows.select("file", "content"), folder if "://" in folder else safe_path(folder, "."), replace)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: each file as a row."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def _lines(files: DataFrame, *others: str) -> DataFrame:
    return files.select(*others, F.concat_ws("|", "path", F.col("size").cast("string"), F.col("modified").cast("string")).alias("line"))


def fingerprint(files: DataFrame) -> DataFrame:
    """``sha256`` (16 digits)``, n_files, mode`` of rows ``path, size, modified`` (whole seconds): SHA-256 over all their lines, sorted.

    The value needs one hash over one stream: lines are sorted by ranges, and one task reads the ranges in turn and
    holds a batch of them at a time. ``tree_fingerprint`` is for more files than one task should read.
    """
    lines = _lines(files).sort("line")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, n = hashlib.sha256(), 0
        for batch in batches:
            for line in batch.column("line").to_pylist():
                whole.update(("\n" if n else "").encode() + line.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([whole.hexdigest()[:16]]), pa.array([n], pa.int64())], ["sha256", "n_files"])

    found = lines.coalesce(1).mapInArrow(digest, "sha256 string, n_files long")
    none = files.sparkSession.createDataFrame([(hashlib.sha256(b"").hexdigest()[:16], 0)], "sha256 string, n_files long")  # where not even a task runs
    return found.unionByName(none).agg(F.max_by("sha256", "n_files").alias("sha256"), F.max("n_files").alias("n_files")).withColumn("mode", F.lit("stat-fingerprint"))


def fingerprint_levels(files: DataFrame, bits: int = 16, step: int = 4) -> DataFrame:
    """``level, range, hash, n``: a hash tree over rows ``path, size, modified``. Level 0 has the ranges of files, the last one the whole.

    A file's range is the first ``bits`` of its path's hash; a range's hash is over its lines' hashes in order. ``2**step``
    ranges that follow each other have one parent, over their hashes. No task holds more than a range's hashes, and a
    changed file changes one range in each level, so that two trees differ where their files do (``changed_ranges``).
    """
    part = F.conv(F.substring(F.sha2("path", 256), 1, 8), 16, 10).cast("long")
    rows = _lines(files.select("path", "size", "modified", F.shiftright(part, 32 - bits).alias("range")), "range").select("range", F.sha2("line", 256).alias("h"))
    return _with_parents(kept(rows.groupBy("range").agg(_joined(F.sort_array(F.collect_list("h"))), F.count("*").alias("n"))), bits, step)


def _joined(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, "\n"), 256).alias("hash")


def _with_parents(level: DataFrame, bits: int, step: int) -> DataFrame:
    """A tree from its level 0 (``range, hash, n``)."""
    out, at = level.select(F.lit(0).alias("level"), "range", "hash", "n"), 0
    while at * step < bits:
        at += 1
        own = F.transform(F.sort_array(F.collect_list(F.struct("range", "hash"))), lambda x: x["hash"])
        level = level.groupBy(F.shiftright("range", step).alias("parent")).agg(_joined(own), F.sum("n").alias("n")).withColumnRenamed("parent", "range")
        out = out.unionByName(level.select(F.lit(at).alias("level"), "range", "hash", "n"))
    return out


def tree_fingerprint(files: DataFrame, bits: int = 16) -> DataFrame:
    """``sha256`` (16 digits)``, n_files`` like ``fingerprint``, but of hashes of hashes: another value, for any number of files."""
    top = F.struct("level", F.substring("hash", 1, 16).alias("sha256"), "n")
    whole = fingerprint_levels(files, bits).agg(F.max(top).alias("top"), F.substring(F.sha2(F.lit(""), 256), 1, 16).alias("none"))
    return whole.select(F.coalesce("top.sha256", "none").alias("sha256"), F.coalesce("top.n", F.lit(0)).alias("n_files"))


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """``level, range`` of two trees (``fingerprint_levels``) whose hashes differ, or that only one has."""
    both = before.alias("a").join(after.alias("b"), ["level", "range"], "full")
    return both.where("NOT a.hash <=> b.hash").select("level", "range")


def updated_levels(tree: DataFrame, files: DataFrame, changed: DataFrame, bits: int = 16, step: int = 4) -> DataFrame:
    """The tree of ``files`` from an older ``tree`` and the paths (``changed``) that were added, altered or removed: only their ranges are hashed again."""
    part = lambda c: F.shiftright(F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long"), 32 - bits)
    touched = kept(changed.select(part("path").alias("range")).distinct())
    again = fingerprint_levels(files.where(F.col("path").isNotNull()).withColumn("_range", part("path")).join(touched.withColumnRenamed("range", "_range"), "_range", "left_semi"), bits, step).where("level = 0")
    same = tree.where("level = 0").join(touched, "range", "left_anti").select("range", "hash", "n")
    return _with_parents(kept(same.unionByName(again.select("range", "hash", "n"))), bits, step)


def safe_path(root: str, name: str) -> str:
    """``name`` below ``root``; ValueError if it leaves it."""
    if ".." in name.split("/"):
        raise ValueError(f"a path may not hold '..': {name!r}")
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, name))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{name!r} leaves {root!r}")
    return full


def git_state(folder: str = ".") -> tuple[str | None, bool | None]:
    """Commit (short) and whether files changed, on the driver; nulls if git can't tell."""
    try:
        run = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        return run("rev-parse", "--short", "HEAD"), bool(run("status", "--porcelain"))
    except (OSError, subprocess.SubprocessError):
        return None, None
