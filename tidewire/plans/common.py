"""Shared views of the news tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: The moment queries are asked at; results never depend on the clock.
NOW = "2026-03-01 00:00:00"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct event-article links."""
    return table(spark, sf_dir, "event_articles").select("event_id", "article_id").distinct()


def article_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, pos, place fields) of every place of an article."""
    each = table(spark, sf_dir, "news_articles").select("article_id", F.posexplode("geo_entities").alias("pos", "e"))
    return each.select(
        "article_id", "pos", "e.geo_key", F.col("e.country_code").alias("country_code"), F.col("e.country_name").alias("country_name"), F.col("e.admin1_code").alias("admin1_code"),
        F.col("e.admin1_name").alias("admin1_name"), F.col("e.city_name").alias("city_name"), F.col("e.precision_level").alias("precision_level"), F.col("e.lat").alias("lat"), F.col("e.lng").alias("lng"), F.col("e.confidence").alias("confidence"),
    )


def event_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the articles of each event."""
    return links(spark, sf_dir).join(article_places(spark, sf_dir), "article_id")


# The same views for DuckDB.
LINKS_SQL = "SELECT DISTINCT event_id, article_id FROM event_articles"
PLACES_SQL = (
    "SELECT article_id, i - 1 AS pos, e.geo_key AS geo_key, e.country_code AS country_code, e.country_name AS country_name, e.admin1_code AS admin1_code, e.admin1_name AS admin1_name,"
    " e.city_name AS city_name, e.precision_level AS precision_level, e.lat AS lat, e.lng AS lng, e.confidence AS confidence"
    " FROM (SELECT article_id, unnest(geo_entities) AS e, generate_subscripts(geo_entities, 1) AS i FROM news_articles)"
)
WITH_PLACES = f"WITH links AS ({LINKS_SQL}), places AS ({PLACES_SQL}), event_places AS (SELECT l.event_id, p.* FROM links l JOIN places p USING (article_id)) "
