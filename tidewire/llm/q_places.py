"""Queries of place-name mapping (p1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import place_match


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of geo_entities that name a first-level region without its key."""
    each = table(spark, sf_dir, "news_articles").select("article_id", F.posexplode("geo_entities").alias("entity_pos", "e"))
    return each.filter("e.precision_level = 'ADMIN1' and e.geojson_key is null").select("article_id", "entity_pos", "e.name", "e.country_code")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region that each free-typed entry means, or UNMATCHED."""
    found = place_match.map_entries(_entries(spark, sf_dir), table(spark, sf_dir, "admin1_regions"))
    return found.select("article_id", "entity_pos", "geojson_key")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that mean no region of the list, with the number of entries."""
    found = place_match.map_entries(_entries(spark, sf_dir), table(spark, sf_dir, "admin1_regions"))
    return found.filter(F.col("geojson_key") == place_match.UNMATCHED).groupBy("name", "country_code").agg(F.count("*").alias("n_entries"))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched}
