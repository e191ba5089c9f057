"""The supplied tables as inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ordered import running
from quern.sources.shared import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification scores: the values of events, errors being the positives."""
    return table(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("is_pos"), F.col("value").alias("score"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification samples: quality against a guess from the length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").alias("y_true"), F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("y_pred"))


def open_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-set samples: event types, sign-ups being unknown."""
    guess = F.element_at(F.array(*map(F.lit, ("view", "click", "purchase", "error"))), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("y_true"), guess.alias("y_pred"), F.col("value").alias("score"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection cells: two classes of labels, scored by the document's length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    score = F.col("n_chars") % 1000 / 1000
    cells = F.array(F.struct(F.lit("quality").alias("class"), F.col("quality").alias("y"), score.alias("score")), F.struct(F.lit("toxic").alias("class"), F.col("toxic").alias("y"), (1 - score).alias("score")))
    return rows.select(F.col("doc_id").alias("pos"), F.explode(cells).alias("c")).select("c.class", "pos", "c.y", "c.score")


def user_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals as rows ``path, sr, pos, value``: each user's values over time, 100 to the second, however many one user has."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), "event_id", (F.col("value") / 500).cast("float").alias("value"), F.lit(1).cast("long").alias("one"))
    return kept(running(e, "event_id", {"pos": "one"}, by=["path"]).select("path", F.lit(100).alias("sr"), "pos", "value"))


def vector_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(64).alias("sr"), F.col("embedding").alias("samples"))


def user_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment records: events, their properties being metrics and the day the split."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("file"), F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("split"), F.from_json("props", "map<string,string>").alias("metrics"))


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", "l_quantity")


def layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, boxes and text blocks laid out from order lines: odd lines are images, even ones captions below or beside."""
    rows = _boxed(spark, sf_dir)
    x, y = F.col("l_partkey") % 300, F.col("l_suppkey") * 7 % 500
    d = lambda c: c.cast("double")
    page = F.lit(0).alias("page")
    pages = rows.select("doc_id", page, F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).distinct()
    boxes = rows.where("n % 2 = 1").select("doc_id", page, F.lit("image").alias("kind"), d(x).alias("x0"), d(y).alias("y0"), d(x + 60 + F.col("l_quantity") * 2).alias("x1"), d(y + 80 + F.col("l_quantity")).alias("y1"))
    text = F.concat(F.when(F.col("n") % 4 == 0, "Table ").otherwise("Fig. "), F.col("n"), F.lit(" of a line"))
    blocks = rows.where("n % 2 = 0").select("doc_id", page, F.col("n").alias("block"), d(x).alias("x0"), d(y + 100).alias("y0"), d(x + 200).alias("x1"), d(y + 120).alias("y1"), d(8 + F.col("n")).alias("max_size"), (F.col("n") == 2).alias("all_bold"), text.alias("text"))
    return pages, boxes, blocks
