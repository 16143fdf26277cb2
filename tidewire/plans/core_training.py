"""Queries of the general data-preparation operators: timestamps (p5) and proximity (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import proximity, timestamps
from ..session import cut, table

TIME_FIELDS = ["published_at", "event_time", "source_updated_at"]
NEAR_KM = 2.0


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each readable time text of an article as epoch milliseconds in UTC."""
    out = timestamps.normalise_instants(table(spark, sf_dir, "news_articles"), table(spark, sf_dir, "source_clocks"), TIME_FIELDS)
    return out.select("article_id", "field", "utc_ms")


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How local times resolved, by field: stated, unique, ambiguous or skipped."""
    out = timestamps.normalise_instants(table(spark, sf_dir, "news_articles"), table(spark, sf_dir, "source_clocks"), TIME_FIELDS)
    return out.groupBy("field", "local_time_kind").agg(F.count("*").alias("n_values"), F.min("utc_ms").alias("first_ms"), F.max("utc_ms").alias("last_ms"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles at most 2 km apart, and the first-level region around each article."""
    located = cut(proximity.article_locations(table(spark, sf_dir, "news_articles")).distinct())  # read once
    points = located.select("lat", "lng").distinct()
    pairs = proximity.expand_pairs(located, proximity.near_pairs(points, NEAR_KM))
    regions = proximity.containing_regions(points, table(spark, sf_dir, "admin1_shapes"))
    near = pairs.select(F.lit("near").alias("kind"), F.col("id_a").alias("article_id"), F.col("id_b").cast("string").alias("match_key"))
    inside = located.join(regions, ["lat", "lng"]).select(F.lit("inside").alias("kind"), "article_id", F.col("key").alias("match_key"))
    return near.unionByName(inside)


QUERIES = {"p5_found": p5_found, "p5_kinds": p5_kinds, "p7_found": p7_found}

_XY = (
    "coalesce(CASE WHEN g ->> '$.type' = 'Point' THEN TRY_CAST(g ->> '$.coordinates[{i}]' AS DOUBLE) WHEN g ->> '$.type' = 'Feature' AND g ->> '$.geometry.type' = 'Point' THEN TRY_CAST(g ->> '$.geometry.coordinates[{i}]' AS DOUBLE) END,"
    " TRY_CAST(g ->> '$.{name}' AS DOUBLE))"
)
_B = "TRY_CAST(b ->> '$[{i}]' AS DOUBLE)"
_RANGE = "{y} BETWEEN -90 AND 90 AND {x} BETWEEN -180 AND 180"
SQL = {
    "p7_found": "WITH a AS (SELECT article_id, CASE WHEN json_valid(display_geo) THEN display_geo::JSON END AS g, CASE WHEN json_valid(bbox) THEN bbox::JSON END AS b, list_filter(geo_entities, lambda e: e.precision_level = 'POINT')[1] AS e FROM news_articles), "
    f"c AS (SELECT article_id, {_XY.format(i=0, name='lng')} AS gx, {_XY.format(i=1, name='lat')} AS gy, {_B.format(i=0)} AS w, {_B.format(i=1)} AS s, {_B.format(i=2)} AS o, {_B.format(i=3)} AS n, e.lng AS ex, e.lat AS ey FROM a), "
    "d AS (SELECT article_id, gx, gy, CASE WHEN w BETWEEN -180 AND 180 AND o BETWEEN -180 AND 180 AND s BETWEEN -90 AND 90 AND n BETWEEN -90 AND 90 THEN w + CASE WHEN w > o THEN o + 360 - w ELSE o - w END / 2 END AS bx0, (s + n) / 2 AS byy, ex, ey FROM c), "
    "f AS (SELECT *, CASE WHEN bx0 > 180 THEN bx0 - 360 ELSE bx0 END AS bx FROM d), "
    f"l AS (SELECT DISTINCT article_id, CASE k WHEN 1 THEN gy WHEN 2 THEN byy ELSE ey END + 0.0 AS lat, CASE k WHEN 1 THEN gx WHEN 2 THEN bx ELSE ex END + 0.0 AS lng FROM (SELECT *, CASE WHEN {_RANGE.format(x='gx', y='gy')} AND NOT (gx = 0 AND gy = 0) THEN 1 WHEN {_RANGE.format(x='bx', y='byy')} THEN 2 WHEN {_RANGE.format(x='ex', y='ey')} AND NOT (ex = 0 AND ey = 0) THEN 3 END AS k FROM f) WHERE k IS NOT NULL), "
    "r AS (SELECT geojson_key, unnest(CAST(geometry::JSON -> '$.coordinates' AS DOUBLE[][][])) AS ring FROM admin1_shapes WHERE geometry ->> '$.type' = 'Polygon' UNION ALL SELECT geojson_key, unnest(flatten(CAST(geometry::JSON -> '$.coordinates' AS DOUBLE[][][][]))) FROM admin1_shapes WHERE geometry ->> '$.type' = 'MultiPolygon'), "
    "g AS (SELECT geojson_key, ring[i][1] AS x1, ring[i][2] AS y1, ring[i + 1][1] AS x2, ring[i + 1][2] AS y2 FROM (SELECT geojson_key, ring, unnest(range(1, len(ring))) AS i FROM r)) "
    "SELECT 'near' AS kind, p.article_id, CAST(q.article_id AS VARCHAR) AS match_key FROM l p JOIN l q ON p.article_id < q.article_id AND abs(p.lat - q.lat) < 0.02 WHERE 2 * 6371.0::DOUBLE * asin(least(1, sqrt(pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lng - p.lng) / 2), 2)))) <= 2 "
    "UNION ALL SELECT 'inside', article_id, geojson_key FROM l JOIN g ON (y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY article_id, geojson_key HAVING count(*) % 2 = 1",
}
