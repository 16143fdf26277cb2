"""Read queries: hot lists, heat roll-ups by place, event details and region news.

Each query is a DataFrame plan; filters and columns reach the scan, roll-ups
aggregate before they move, and top lists end in a bounded sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table
from .common import NOW, WITH_PLACES, article_places, event_places, links

#: Countries of the narrower scope; the others are the wider one.
HOME = ["QM", "QN"]
CATEGORY = "disaster"


def _since(column: str, hours: int) -> Column:
    return F.col(column) >= F.expr(f"timestamp'{NOW}' - interval {hours} hours")


def country_heat(places: DataFrame, events: DataFrame) -> DataFrame:
    """Heat and number of events by country; an event counts once per country and spelling of its name."""
    pairs = places.select("event_id", "country_code", "country_name").filter("country_code is not null").distinct()
    joined = pairs.join(events.select("event_id", "heat_score"), "event_id")
    return joined.groupBy("country_code").agg(F.max("country_name").alias("country_name"), F.sum(F.coalesce("heat_score", F.lit(0))).alias("heat_total"), F.count("*").alias("event_count"))


def country_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat by country, hottest first."""
    heat = country_heat(event_places(spark, sf_dir), table(spark, sf_dir, "news_events"))
    return heat.orderBy(F.desc("heat_total"), "country_code").limit(80)


def country_hotspots_recent(spark: SparkSession, sf_dir: str, hours: int = 24 * 90, min_heat: int = 50) -> DataFrame:
    """Heat by country of recently seen events, countries of little heat left out."""
    events = table(spark, sf_dir, "news_events").filter(_since("last_seen_at", hours))
    return country_heat(event_places(spark, sf_dir), events).filter(F.col("heat_total") >= min_heat)


def admin1_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat by first-level region with the region's centre."""
    places = event_places(spark, sf_dir).filter("admin1_code is not null").select("event_id", "country_code", "admin1_code", "admin1_name").distinct()
    heat = places.join(table(spark, sf_dir, "news_events").select("event_id", "heat_score"), "event_id").groupBy("country_code", "admin1_code").agg(
        F.max("admin1_name").alias("admin1_name"), F.sum(F.coalesce("heat_score", F.lit(0))).alias("heat_total"), F.count_distinct("event_id").alias("event_count")
    )
    centre = table(spark, sf_dir, "admin1_regions").groupBy("country_code", "admin1_code").agg(F.min(F.struct("geojson_key", "lat", "lng")).alias("c"))
    return heat.join(centre, ["country_code", "admin1_code"], "left").select("country_code", "admin1_code", "admin1_name", "heat_total", "event_count", F.col("c.lat").alias("lat"), F.col("c.lng").alias("lng"))


def city_hotspots(spark: SparkSession, sf_dir: str, min_heat: int = 10) -> DataFrame:
    """Heat by city."""
    places = event_places(spark, sf_dir).filter("precision_level = 'CITY' and geo_key is not null")
    heat = places.join(table(spark, sf_dir, "news_events").select("event_id", "heat_score"), "event_id").groupBy("geo_key").agg(
        F.max("city_name").alias("city_name"), F.max("country_code").alias("country_code"), F.max("lat").alias("lat"), F.max("lng").alias("lng"), F.sum(F.coalesce("heat_score", F.lit(0))).alias("heat_total"), F.count("*").alias("mention_count")
    )
    return heat.filter(F.col("heat_total") >= min_heat)


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "news_events")
    return events.filter(~F.col("main_country").isin(HOME)).filter(F.col("category") == CATEGORY).filter("heat_score >= 10").filter(_since("last_seen_at", 24 * 360))


def hot_list(spark: SparkSession, sf_dir: str, page: int = 1, size: int = 50) -> DataFrame:
    """One page of the filtered hot list."""
    cols = ["event_id", "title", "main_country", "category", "heat_score", "article_count"]
    return _hot(spark, sf_dir).select(*cols).orderBy(F.desc("heat_score"), "event_id").offset((page - 1) * size).limit(size)


def hot_list_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of events that the hot list's filters leave, by country."""
    return _hot(spark, sf_dir).groupBy("main_country").agg(F.count("*").alias("n_events"), F.max("heat_score").alias("max_heat"))


def _tagged(spark: SparkSession, sf_dir: str, condition: Column) -> DataFrame:
    return table(spark, sf_dir, "news_articles").filter(condition).select("article_id", F.size("tags").alias("n_tags"))


def tag_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with one tag."""
    return _tagged(spark, sf_dir, F.array_contains("tags", "health"))


def tags_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with any of the tags."""
    return _tagged(spark, sf_dir, F.arrays_overlap("tags", F.array(F.lit("ai"), F.lit("health"))))


def tags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with all of the tags."""
    return _tagged(spark, sf_dir, F.col("tags").isNotNull() & (F.size(F.array_except(F.array(F.lit("ai"), F.lit("health")), "tags")) == 0))


def globe_hotspots(spark: SparkSession, sf_dir: str, top: int = 200) -> DataFrame:
    """Places of the hottest events; an event without a place falls back to its country."""
    best = table(spark, sf_dir, "news_events").filter("heat_score is not null").orderBy(F.desc("heat_score"), "event_id").limit(top).select("event_id", "main_country", "heat_score")
    # Only the links of the hottest events meet the places.
    kept = links(spark, sf_dir).join(F.broadcast(best.select("event_id")), "event_id", "left_semi")
    places = kept.join(article_places(spark, sf_dir), "article_id").filter("geo_key is not null").groupBy("event_id", "geo_key").agg(F.max("confidence").alias("confidence"))
    joined = best.join(places, "event_id", "left")
    return joined.select("event_id", "heat_score", F.coalesce("geo_key", "main_country").alias("geo_key"), F.when(F.col("geo_key").isNull(), 0.45).otherwise(F.col("confidence")).alias("confidence"))


def region_news(spark: SparkSession, sf_dir: str, country: str = "QX") -> DataFrame:
    """Events mapped to a country, hottest first."""
    wanted = event_places(spark, sf_dir).filter(F.col("country_code") == country).select("event_id")
    events = table(spark, sf_dir, "news_events").select("event_id", "title", "heat_score", "last_seen_at")
    return events.join(wanted, "event_id", "left_semi").orderBy(F.desc_nulls_last("heat_score"), "event_id").limit(100)


def event_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best article of each source of each event: hottest, then latest crawled."""
    articles = table(spark, sf_dir, "news_articles").select("article_id", F.lower("source_code").alias("source_code"), "heat_score", "crawled_at")
    best = F.max_by("article_id", F.struct(F.coalesce("heat_score", F.lit(-1)), "crawled_at", -F.col("article_id")))
    return links(spark, sf_dir).join(articles, "article_id").filter("source_code is not null").groupBy("event_id", "source_code").agg(best.alias("article_id"), F.count("*").alias("n_articles"))


def event_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its primary article, if it has one."""
    primary = table(spark, sf_dir, "event_articles").filter("is_primary").groupBy("event_id").agg(F.min("article_id").alias("article_id"))
    return table(spark, sf_dir, "news_events").select("event_id").join(primary, "event_id", "left")


def hottest_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hottest article of each event."""
    a = table(spark, sf_dir, "news_articles").select("article_id", "heat_score").filter("heat_score is not null")
    best = F.max(F.struct("heat_score", (-F.col("article_id")).alias("n"))).alias("b")
    return links(spark, sf_dir).join(a, "article_id").groupBy("event_id").agg(best).select("event_id", F.col("b.heat_score").alias("heat_score"), (-F.col("b.n")).alias("article_id"))


def intensity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries in seven bands of a log-scaled mix of heat and number of events."""
    heat = country_heat(event_places(spark, sf_dir), table(spark, sf_dir, "news_events"))
    one = W.partitionBy(F.lit(1))  # one row a country
    heat = heat.withColumns({"h": F.max("heat_total").over(one), "c": F.max("event_count").over(one)})
    part = lambda x, m: F.when(F.col(m) > 0, F.log1p(x) / F.log1p(m)).otherwise(0.0)
    score = heat.withColumn("score", F.round(0.68 * part("heat_total", "h") + 0.32 * part("event_count", "c"), 9))
    return score.select("country_code", F.least(F.lit(6), F.floor(F.col("score") * 7)).cast("int").alias("band"))


def region_cells(spark: SparkSession, sf_dir: str, degrees: float = 5.0) -> DataFrame:
    """Weight of mentions per grid cell of latitude and longitude."""
    p = event_places(spark, sf_dir).filter("lat is not null and lng is not null")
    cell = lambda c: F.floor(F.col(c) / degrees).cast("int")
    return p.groupBy(cell("lat").alias("cell_lat"), cell("lng").alias("cell_lng")).agg(F.count("*").alias("n_mentions"), F.count_distinct("event_id").alias("n_events"))


def country_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by country and category with all subtotals."""
    e = table(spark, sf_dir, "news_events")
    return e.cube("main_country", "category").agg(F.count("*").alias("n_events"), F.sum("heat_score").alias("heat_total"), F.grouping_id().cast("int").alias("level"))


def latest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest articles of each source."""
    w = W.partitionBy("source").orderBy(F.desc("crawled_at"), "article_id")
    a = table(spark, sf_dir, "news_articles").select("article_id", F.lower("source_code").alias("source"), "crawled_at").filter("source is not null and crawled_at is not null")
    return a.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("source", "rank", "article_id")


QUERIES = {f.__name__: f for f in [
    country_hotspots, country_hotspots_recent, admin1_hotspots, city_hotspots, hot_list, hot_list_total, tag_one, tags_any, tags_all, globe_hotspots, region_news,
    event_sources, event_primary, hottest_per_event, intensity_bands, region_cells, country_cube, latest_per_source,
]}

_HEAT = "heat AS (SELECT country_code, max(country_name) AS country_name, CAST(sum(coalesce(heat_score, 0)) AS BIGINT) AS heat_total, count(*) AS event_count FROM (SELECT DISTINCT event_id, country_code, country_name FROM event_places WHERE country_code IS NOT NULL) JOIN {events} e USING (event_id) GROUP BY country_code)"
_RECENT = f"(SELECT * FROM news_events WHERE last_seen_at >= TIMESTAMP '{NOW}' - INTERVAL {24 * 90} HOUR)"
_HOT = f"FROM news_events WHERE main_country NOT IN ('QM', 'QN') AND category = '{CATEGORY}' AND heat_score >= 10 AND last_seen_at >= TIMESTAMP '{NOW}' - INTERVAL {24 * 360} HOUR"
_P = WITH_PLACES.rstrip()
SQL = {
    "country_hotspots": f"{_P}, {_HEAT.format(events='news_events')} SELECT * FROM heat ORDER BY heat_total DESC, country_code LIMIT 80",
    "country_hotspots_recent": f"{_P}, {_HEAT.format(events=_RECENT)} SELECT * FROM heat WHERE heat_total >= 50",
    "admin1_hotspots": f"{_P}, heat AS (SELECT country_code, admin1_code, max(admin1_name) AS admin1_name, CAST(sum(coalesce(heat_score, 0)) AS BIGINT) AS heat_total, count(DISTINCT event_id) AS event_count FROM (SELECT DISTINCT event_id, country_code, admin1_code, admin1_name FROM event_places WHERE admin1_code IS NOT NULL) JOIN news_events USING (event_id) GROUP BY ALL), centre AS (SELECT country_code, admin1_code, arg_min(lat, geojson_key) AS lat, arg_min(lng, geojson_key) AS lng FROM admin1_regions GROUP BY ALL) SELECT heat.*, lat, lng FROM heat LEFT JOIN centre USING (country_code, admin1_code)",
    "city_hotspots": f"{_P} SELECT geo_key, max(city_name) AS city_name, max(country_code) AS country_code, max(lat) AS lat, max(lng) AS lng, CAST(sum(coalesce(heat_score, 0)) AS BIGINT) AS heat_total, count(*) AS mention_count FROM event_places JOIN news_events USING (event_id) WHERE precision_level = 'CITY' AND geo_key IS NOT NULL GROUP BY geo_key HAVING sum(coalesce(heat_score, 0)) >= 10",
    "hot_list": f"SELECT event_id, title, main_country, category, heat_score, article_count {_HOT} ORDER BY heat_score DESC, event_id LIMIT 50",
    "hot_list_total": f"SELECT main_country, count(*) AS n_events, max(heat_score) AS max_heat {_HOT} GROUP BY main_country",
    "tag_one": "SELECT article_id, CAST(len(tags) AS INT) AS n_tags FROM news_articles WHERE list_contains(tags, 'health')",
    "tags_any": "SELECT article_id, CAST(len(tags) AS INT) AS n_tags FROM news_articles WHERE list_has_any(tags, ['ai', 'health'])",
    "tags_all": "SELECT article_id, CAST(len(tags) AS INT) AS n_tags FROM news_articles WHERE list_has_all(tags, ['ai', 'health'])",
    "globe_hotspots": f"{_P}, best AS (SELECT event_id, main_country, heat_score FROM news_events WHERE heat_score IS NOT NULL ORDER BY heat_score DESC, event_id LIMIT 200), p AS (SELECT event_id, geo_key, max(confidence) AS confidence FROM event_places WHERE geo_key IS NOT NULL GROUP BY ALL) SELECT event_id, heat_score, coalesce(geo_key, main_country) AS geo_key, CASE WHEN geo_key IS NULL THEN 0.45::DOUBLE ELSE confidence END AS confidence FROM best LEFT JOIN p USING (event_id)",
    "region_news": f"{_P} SELECT event_id, title, heat_score, last_seen_at FROM news_events WHERE event_id IN (SELECT event_id FROM event_places WHERE country_code = 'QX') ORDER BY heat_score DESC NULLS LAST, event_id LIMIT 100",
    "event_sources": f"{_P} SELECT event_id, lower(source_code) AS source_code, arg_max(article_id, (coalesce(heat_score, -1), crawled_at, -article_id)) AS article_id, count(*) AS n_articles FROM links JOIN news_articles USING (article_id) WHERE source_code IS NOT NULL GROUP BY event_id, lower(source_code)",
    "event_primary": "SELECT event_id, article_id FROM news_events LEFT JOIN (SELECT event_id, min(article_id) AS article_id FROM event_articles WHERE is_primary GROUP BY event_id) USING (event_id)",
    "hottest_per_event": f"{_P} SELECT event_id, max(heat_score) AS heat_score, arg_max(article_id, (heat_score, -article_id)) AS article_id FROM links JOIN news_articles USING (article_id) WHERE heat_score IS NOT NULL GROUP BY event_id",
    "intensity_bands": f"{_P}, {_HEAT.format(events='news_events')}, top AS (SELECT max(heat_total) AS h, max(event_count) AS c FROM heat) SELECT country_code, CAST(least(6, floor(7 * round(0.68::DOUBLE * CASE WHEN h > 0 THEN ln(1 + heat_total) / ln(1 + h) ELSE 0 END + 0.32::DOUBLE * CASE WHEN c > 0 THEN ln(1 + event_count) / ln(1 + c) ELSE 0 END, 9))) AS INT) AS band FROM heat, top",
    "region_cells": f"{_P} SELECT CAST(floor(lat / 5) AS INT) AS cell_lat, CAST(floor(lng / 5) AS INT) AS cell_lng, count(*) AS n_mentions, count(DISTINCT event_id) AS n_events FROM event_places WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY 1, 2",
    "country_cube": "SELECT main_country, category, count(*) AS n_events, CAST(sum(heat_score) AS BIGINT) AS heat_total, CAST(grouping(main_country, category) AS INT) AS level FROM news_events GROUP BY CUBE (main_country, category)",
    "latest_per_source": "SELECT source, CAST(rank AS INT) AS rank, article_id FROM (SELECT lower(source_code) AS source, article_id, row_number() OVER (PARTITION BY lower(source_code) ORDER BY crawled_at DESC, article_id) AS rank FROM news_articles WHERE source_code IS NOT NULL AND crawled_at IS NOT NULL) WHERE rank <= 3",
}
