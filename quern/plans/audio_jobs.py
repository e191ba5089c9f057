"""Jobs from a folder of audio files to files: audit, conversion, features.

Reports are written by Spark: tables as CSV folders, summaries as one line of JSON; converted files by the tasks that made
them. ``outdir`` must be a folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import long_signals, signals
from quern.sources import audio, file_sink, wav_source
from quern.sources.records import safe_path
from quern.sources.shared import kept

#: Fixed columns of the audit's table.
AUDIT = ("path", "sr", "channels", "duration", "peak", "clip_ratio", "silence_ratio", "mean_rms", "size_mb", "flags", "error")

#: Fixed text: what a conversion says of files that it does not know.
UNSUPPORTED = "存在未支持格式的文件"


def prepared(outdir: str, source: str | None = None) -> str:
    """The folder to write to; ``..`` in it or in the source, and the source itself, are errors."""
    for path in (outdir, source or ""):
        if ".." in path.split("/"):
            raise ValueError(f"a path may not hold '..': {path!r}")
    root = safe_path(outdir or ".", ".")
    if not outdir or source is not None and root == safe_path(source, "."):
        raise ValueError("the output folder must be named and differ from the input")
    return root


def _csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(folder)


def _json(row: DataFrame, folder: str) -> None:
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(folder)  # one row


def _heads(spark: SparkSession, path: str, pcm_sr: int | None, pcm_dtype: str) -> DataFrame:
    """``path, size, sr, channels, frames, error`` of the audio files, without their samples where Arrow can open them."""
    if wav_source.readable(path):
        return wav_source.headers(spark, path, pcm_sr, pcm_dtype)
    heads = audio.read(spark, path, pcm_sr, pcm_dtype, header_only=True, limit=1 << 40)
    return heads.join(audio.listing(spark, path).select("path", "size"), "path")


def audited(spark: SparkSession, path: str, light: bool = False, max_read_mb: int = 300, pcm_sr: int | None = None, pcm_dtype: str = "int16", **limits: float) -> DataFrame:
    """One row for each audio file with the columns of ``AUDIT``.

    With ``light``, and for files over ``max_read_mb``, only headers are read and quality stays null; of the flags those
    of the duration remain. Files that fail have their ``error``. Other files are read and decoded once.
    """
    heads = _heads(spark, path, pcm_sr, pcm_dtype).withColumn("size_mb", F.bround(F.col("size") / 1e6, 2)).withColumn("seconds", F.bround(F.col("frames") / F.col("sr"), 3))
    low, high = limits.get("min_sec", 0.2), limits.get("max_sec", 120.0)
    flags = F.array_compact(F.array(F.when(F.col("seconds") < low, "too-short"), F.when(F.col("seconds") > high, "too-long")))
    out = heads.withColumn("flags_light", F.when(F.size(flags) > 0, flags))
    if light:
        none = F.lit(None).cast("double")
        return out.select("path", "sr", "channels", F.col("seconds").alias("duration"), none.alias("peak"), none.alias("clip_ratio"), none.alias("silence_ratio"), none.alias("mean_rms"), "size_mb", F.col("flags_light").alias("flags"), "error")
    read = audio.read(spark, path, pcm_sr, pcm_dtype, limit=max_read_mb << 20)
    q = kept(signals.file_quality(read, **limits))
    out = out.withColumnRenamed("error", "head_error").join(q, "path", "left")
    # a file over the limit has its header, which is no error
    large = F.col("size") > max_read_mb << 20
    error = F.when(~large, F.coalesce("head_error", "error")).otherwise(F.col("head_error"))
    return out.select("path", "sr", "channels", F.coalesce("duration", "seconds").alias("duration"), "peak", "clip_ratio", "silence_ratio", "mean_rms", "size_mb", F.coalesce("flags", F.when(F.col("duration").isNull(), F.col("flags_light"))).alias("flags"), error.alias("error"))


def audit(spark: SparkSession, path: str, outdir: str, light: bool = False, **options: float) -> DataFrame:
    """Audits a folder: writes ``audio_audit.csv`` and ``audio_audit.json`` below ``outdir`` and returns the summary's row."""
    root = prepared(outdir, None)
    prepared(path)
    _csv(audited(spark, path, light, **options).withColumn("flags", F.array_join("flags", ";")).select(*AUDIT), f"{root}/audio_audit.csv")
    schema = "path string, sr int, channels int, duration double, peak double, clip_ratio double, silence_ratio double, mean_rms double, size_mb double, flags string, error string"
    rows = spark.read.option("header", "true").schema(schema).csv(f"{root}/audio_audit.csv")
    rows = rows.withColumn("flags", F.when(F.col("flags") != "", F.split("flags", ";")))
    others = audio.listing(spark, path).where("kind = 'unsupported'")
    summary = signals.audit_summary(rows).withColumn("input", F.lit(path)).withColumn("mode", F.lit("light" if light else "full")).withColumn("_", F.lit(1))
    rates = signals.rate_histogram(rows.where("error IS NULL")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("sr").cast("string"), "n")))).alias("sr_distribution"), F.lit(1).alias("_"))
    quantiles = signals.lower_quantiles(rows, "duration").agg(F.sort_array(F.collect_list(F.struct("share", F.bround("value", 3).alias("value")))).alias("duration_stats"), F.lit(1).alias("_"))
    some = others.orderBy("path").limit(5).agg(F.sort_array(F.collect_list("path")).alias("unsupported_examples"), F.lit(1).alias("_"))
    count = others.agg(F.count("*").alias("n_unsupported"), F.lit(1).alias("_"))
    for part in (count, some, rates, quantiles):  # one row each
        summary = summary.join(part, "_")
    _json(summary.drop("_"), f"{root}/audio_audit.json")
    return spark.read.json(f"{root}/audio_audit.json")


def convert(spark: SparkSession, path: str, outdir: str, sr: int = 16000, mono: bool = False, trim: str | None = None, normalize: bool = False, pattern: str | None = None, pcm_sr: int | None = None, pcm_dtype: str = "int16") -> DataFrame:
    """Converts a folder to 16-bit WAV files ``<stem>_<sr>hz[_mono].wav`` below ``outdir``; returns ``file, size, error``.

    The summary goes to ``audio_convert.json``. Every file's channels are kept unless ``mono``. Inputs of one stem and folder would share a name; the folder below
    ``path`` is kept, so that inputs of different folders don't.
    """
    root = prepared(outdir, path)
    read = audio.read(spark, path, pcm_sr, pcm_dtype, pattern=pattern, channels=not mono)
    whole = read.where("error IS NULL")
    done = signals.converted(whole.drop("channels") if mono else whole, sr, trim, normalize)
    name = relative(F.col("path"), path)
    stem = F.regexp_replace(name, r"\.[^./]+$", "")
    rows = done.select(F.concat(stem, F.lit(f"_{sr}hz{'_mono' if mono else ''}.wav")).alias("file"), F.col("wav").alias("content"))
    file_sink.write(rows, root, replace=True, manifest="audio_convert_files.json")
    written = spark.read.schema("file string, size long").json(f"{root}/audio_convert_files.json").withColumn("error", F.lit(None).cast("string"))
    failed = read.where("error IS NOT NULL").select(name.alias("file"), F.lit(None).cast("long").alias("size"), "error")
    written.unionByName(failed).write.mode("overwrite").parquet(f"{root}/_converted")
    done = spark.read.parquet(f"{root}/_converted")
    _json(converted_summary(done, audio.listing(spark, path).where("kind = 'unsupported'"), root, sr), f"{root}/audio_convert.json")
    return done


def converted_summary(rows: DataFrame, unsupported: DataFrame, outdir: str, sr: int) -> DataFrame:
    """One row ``status, outdir, converted, failed, failures`` (the first 10 by name)``, target_sr, warnings`` of rows ``file, size, error``."""
    bad = rows.where("error IS NOT NULL")
    some = bad.select("file", "error").orderBy("file").limit(10).agg(F.sort_array(F.collect_list(F.struct("file", "error"))).alias("failures"))
    other = unsupported.limit(1).agg(F.when(F.count("*") > 0, F.array(F.lit(UNSUPPORTED))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    counts = rows.agg(F.count_if(F.col("error").isNull()).alias("converted"), F.count("error").alias("failed"))
    whole = counts.join(F.broadcast(some)).join(F.broadcast(other))  # one row each
    return whole.select(F.lit("ok").alias("status"), F.lit(outdir).alias("outdir"), "converted", "failed", "failures", F.lit(sr).alias("target_sr"), "warnings")


def relative(path: Column, root: str) -> Column:
    """The part of a file's path after a folder's, whatever scheme either is written with; of a single file its name."""
    bare = F.regexp_replace(path, "^[a-z0-9]+:/*", "/")
    inside = root.split(":", 1)[-1].strip("/") if ":" in root.split("/")[0] else safe_path(root, ".").strip("/")
    after = F.regexp_replace(bare, "^/+" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in inside) + "/+", "")
    return F.when(after.startswith("/"), F.element_at(F.split(bare, "/"), -1)).otherwise(after)


def features(spark: SparkSession, path: str, outdir: str, wanted: tuple[str, ...] = ("duration", "peak_freq", "bandwidth", "spectral", "f0"), pcm_sr: int | None = None, pcm_dtype: str = "int16") -> DataFrame:
    """Features of a folder's files: writes ``acoustic_features.csv`` and ``acoustic_features_summary.json``; returns the summary's row."""
    root = prepared(outdir, None)
    prepared(path)
    name = F.element_at(F.split("path", "/"), -1)
    if wav_source.readable(path):  # files of any length, a block at a time
        size = long_signals.BLOCK
        read = wav_source.sample_blocks(spark, path, size, after=long_signals.N_FFT + 1, after_ms=long_signals.PITCH_MS, pcm_sr=pcm_sr, pcm_dtype=pcm_dtype)
        found = long_signals.features_of_blocks(read, wanted, size)
        read = _heads(spark, path, pcm_sr, pcm_dtype)
        # files without a sample have a row too
        found = read.where("error IS NULL").select("path").join(found, "path", "left")
    else:
        read = audio.read(spark, path, pcm_sr, pcm_dtype)
        found = signals.features(read.where("error IS NULL"), wanted)
    rows = found.withColumn("file", name).drop("path")
    _csv(rows.select("file", *[c for c in rows.columns if c != "file"]), f"{root}/acoustic_features.csv")
    done = spark.read.option("header", "true").csv(f"{root}/acoustic_features.csv").agg(F.count("*").alias("n_files"), F.lit(1).alias("_"))
    failed = read.where("error IS NOT NULL").select(name.alias("file"), "error")
    some = failed.orderBy("file").limit(10).agg(F.sort_array(F.collect_list(F.struct("file", "error"))).alias("errors"), F.lit(1).alias("_"))
    count = failed.agg(F.count("*").alias("n_errors"), F.lit(1).alias("_"))
    summary = done.join(count, "_").join(some, "_").select(F.lit("ok").alias("status"), "n_files", "n_errors", F.array(*map(F.lit, wanted)).alias("features"), "errors")
    _json(summary, f"{root}/acoustic_features_summary.json")
    return spark.read.json(f"{root}/acoustic_features_summary.json")
