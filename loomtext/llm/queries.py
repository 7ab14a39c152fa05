"""Queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, langid, licenses, mixing, ngram_join, pst, quality, suffix_dedup, toxicity
from .common import table

#: Near to even, since the tables' sources are near to even themselves: a lower entropy would leave them as they are.
MIX_ENTROPY, MIX_REPEATS = 0.9999, 2.0
ORACLES: dict[str, str] = {"op2_mix_sources": mixing.oracle(entropy=MIX_ENTROPY, repeats=MIX_REPEATS), "op3_license_scan": licenses.ORACLE, "op5_fingerprints": fingerprints.ORACLE, "op4_ngram_jaccard_join": ngram_join.ORACLE, "op9_suffix_array_dedup": suffix_dedup.ORACLE}


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"), entropy=MIX_ENTROPY, repeats=MIX_REPEATS)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_pst_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op7_language_id, op4_ngram_jaccard_join, op9_suffix_array_dedup, op6_decontaminate, op2_mix_sources, op3_license_scan, op5_fingerprints, op8_pst_score, op10_quality, op1_toxicity)}
