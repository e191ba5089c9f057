"""The queries of this subpackage, each over its whole table; ``ORACLES`` has the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import ann_tree, bpe_segments, decontamination, fill_in_middle, jaccard_groups, lm_logbilinear, phrase_automata, pivotal_mix, quality_classifier, secret_scan, source_divergence, suffix_dedup, token_counts
from quern.llm._common import table
from quern.llm.oracles import ORACLES  # noqa: F401


def op1_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(table(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op5_lm_logbilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_logbilinear.report(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op8_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.report(table(spark, sf_dir, "documents"))


def op9_bpe_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_segments.report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.report(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.report(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.report(table(spark, sf_dir, "documents"))


def op13_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ann_tree, op2_decontamination, op3_token_counts, op4_secret_scan, op5_lm_logbilinear, op6_quality_classifier, op7_suffix_dedup, op8_phrase_automata, op9_bpe_segments, op10_jaccard_groups, op11_source_divergence, op12_fill_in_middle, op13_pivotal_mix)}
