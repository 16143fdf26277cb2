"""Queries of main-body extraction (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import main_body


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each article outside its main body."""
    return main_body.furniture_lines(table(spark, sf_dir, "news_articles"))


def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of each article."""
    return main_body.main_bodies(table(spark, sf_dir, "news_articles"))


QUERIES = {"p4_found": p4_found, "p4_bodies": p4_bodies}
