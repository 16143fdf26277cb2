"""Queries of best representatives (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import cut, table
from . import survivor


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the tier, time and heat of each story's surviving record come from.

    These three are fixed by stated orders, which a latent quality model does
    not know (README has figures); the orders are applied alone, and the model
    judges the multi-valued fields of ``p3_survivors``.
    """
    found = survivor.best_rows(table(spark, sf_dir, "news_articles"), table(spark, sf_dir, "source_clocks"))
    return found.select("canonical_url", "tier_id", "published_id", "heat_id")


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each story of two or more rows."""
    return survivor.best_representatives(table(spark, sf_dir, "news_articles"), table(spark, sf_dir, "source_clocks"))


def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity and specificity inferred for each source."""
    articles = table(spark, sf_dir, "news_articles")
    best = cut(survivor.best_rows(articles, table(spark, sf_dir, "source_clocks")))
    model = survivor.fit_quality(cut(survivor.claim_facts(articles, best, ["tags", "region_tags"])))
    rows = [(s, float(model["sensitivity"][i]), float(1 - model["false_rate"][i])) for s, i in model["index"].items()]
    return spark.createDataFrame(rows, "source_code string, sensitivity double, specificity double")


QUERIES = {"p3_found": p3_found, "p3_survivors": p3_survivors, "p3_sources": p3_sources}
