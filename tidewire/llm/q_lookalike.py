"""Queries of look-alike normalisation (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import lookalike


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "news_articles").select("article_id", F.explode(F.expr("array(struct('title' as field, title as text), struct('summary' as field, summary as text))")).alias("x")).select("article_id", "x.field", "x.text").filter("text is not null")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of titles, and of summaries, that look the same but are different strings."""
    pairs = lookalike.same_look_pairs(_texts(spark, sf_dir), "article_id", "field", "text")
    return pairs.select(F.col("id_a").alias("article_id_a"), F.col("id_b").alias("article_id_b"), "field").distinct()


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and summary in its canonical form."""
    return lookalike.canonical_texts(_texts(spark, sf_dir), "text").select("article_id", "field", "canonical")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and summary with the class of its look and the number of links to other strings."""
    return lookalike.same_look_classes(_texts(spark, sf_dir), "article_id", "field", "text")


QUERIES = {"p2_found": p2_found, "p2_canonical": p2_canonical, "p2_classes": p2_classes}
