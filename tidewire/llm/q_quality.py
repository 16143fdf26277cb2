"""Queries of text quality (p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import text_quality


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are for the most part lists, tables or junk."""
    kinds = text_quality.text_kinds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    return kinds.filter("kind <> 'prose'").select("doc_id", "kind")


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document."""
    return text_quality.text_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")).drop("features")


QUERIES = {"p10_found": p10_found, "p10_stats": p10_stats}
