"""Registered queries of this package: ``opN_<name>`` and their DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_automaton import bpe_query
from .common import table
from .licenses import license_query
from .line_crf import line_quality_query
from .near_dups import near_duplicates_query
from .packing import packing_query
from .passages import passages_query
from .quality import quality_query, quality_sql
from .simhash import simhash_query
from .spelling import spelling_query
from .token_files import token_files_query
from .toxicity import toxicity_query
from .url_filter import url_query, url_sql
from .whitening import whitening_query


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(spark, table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_query(spark, table(spark, sf_dir, "documents"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_query(spark, table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_query(spark, table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_query(spark, table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_query(spark, table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_query(spark, table(spark, sf_dir, "documents"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages_query(spark, table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(spark, sf_dir)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates_query(spark, table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every valid row of ``embeddings``."""
    return whitening_query(spark, table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of ``documents``."""
    return spelling_query(spark, table(spark, sf_dir, "documents"))


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every row of ``documents``."""
    return line_quality_query(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_token_files, op3_bpe_automaton, op4_license_scan,
                                   op5_url_filter, op6_packing, op7_simhash, op8_passages, op9_toxicity,
                                   op10_near_duplicates, op11_whitening, op12_spelling, op13_line_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_sql(), "op5_url_filter": url_sql()}
