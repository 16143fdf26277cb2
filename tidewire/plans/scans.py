"""Every reader on documents of its format, written from whole tables and read again.

The documents are written to the shared folder by Spark, one an article, event
or country, so nothing passes through the driver; what is read must be the
table's own values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, table
from ..sources import feeds


def _written(df: DataFrame, body: Column) -> str:
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/documents-{uuid.uuid4()}"
    df.select(body.alias("value")).write.text(path)
    return path


def _xml(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return F.coalesce(F.regexp_replace(c, r"[\r\n]", " "), F.lit(""))


def _e(name: str, c: str | Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), _xml(c), F.lit(f"</{name}>"))


def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "news_articles").filter("title is not null and url is not null")


def scan_rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as RSS 2.0, with the guid in place of a missing link."""
    body = F.concat(F.lit("<rss><channel><item>"), _e("title", "title"), F.when(F.col("article_id") % 3 == 0, _e("guid", "url")).otherwise(_e("link", "url")), _e("description", "summary"), _e("pubDate", "published_at"), _e("category", "category"), F.lit("</item></channel></rss>"))
    return feeds.rss_items(spark.read.text(_written(_a(spark, sf_dir), body))).select("title", "url", "summary", "category")


def scan_rdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as RSS 1.0 with name spaces."""
    body = F.concat(F.lit('<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><item>'), _e("title", "title"), _e("link", "url"), _e("dc:date", "published_at"), F.lit("</item></rdf:RDF>"))
    return feeds.rss_items(spark.read.text(_written(_a(spark, sf_dir), body))).select("title", "url", "heat")


def scan_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as Atom entries, the address an attribute."""
    body = F.concat(F.lit('<feed><entry>'), _e("title", "title"), F.lit('<link rel="self" href="https://x.example/"/><link rel="alternate" href="'), _xml("url"), F.lit('"/>'), _e("summary", "summary"), _e("updated", "published_at"), F.lit("</entry></feed>"))
    return feeds.atom_items(spark.read.text(_written(_a(spark, sf_dir), body))).select("title", "url", "summary")


def _documents(spark: SparkSession, df: DataFrame, wrap: str, before: str = "", after: str = "") -> str:
    """One document a line: the row as the only entry of the list that ``wrap`` holds."""
    return _written(df, F.concat(F.lit(before + wrap.split("@")[0]), F.to_json(F.struct(*df.columns)), F.lit(wrap.split("@")[1] + after)))


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    return feeds.json_items(spark.read.text(path).select(F.col("value").alias("doc")))


def scan_article_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as items of JSON lists in three places of a document, some within a function call."""
    a = _a(spark, sf_dir).select("title", "url", F.col("source_code").alias("domain"), F.date_format("crawled_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), (F.col("article_id") % 3).alias("k"))
    shapes = [('{"articles": [@]}', "", ""), ('{"result": {"list": [@]}}', "", ""), ('{"idlist": [{"newslist": [@]}]}', "callback(", ");")]
    parts = [_read_lines(spark, _documents(spark, a.filter(F.col("k") == k).drop("k"), *shape)) for k, shape in enumerate(shapes)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("url").agg(F.min("title").alias("title"), F.min("published").alias("published"))


def scan_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as an aggregator links them, with the paper's name behind the title; each address once."""
    a = _a(spark, sf_dir).filter("source_name is not null")
    wrapped = a.select("title", F.concat(F.lit("https://news.example/rss/articles/"), F.regexp_replace("url", "^https://", "")).alias("url"), F.concat("title", F.lit(" - The Paper")).alias("named"))
    items = feeds.aggregated(wrapped.select(F.col("named").alias("title"), "url"), ["The Paper", "Reuters"])
    return items.groupBy("url").agg(F.count("*").alias("n"))


def scan_hot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as entries of a hot list; identity is title and site."""
    a = table(spark, sf_dir, "news_articles").select(F.when(F.col("article_id") % 2 == 0, F.col("title")).alias("word"), F.col("title").alias("note"), F.col("heat_score").cast("long").alias("num"))
    hot = feeds.read_hot_list(spark, _documents(spark, a, '{"data": {"realtime": [@]}}'), "hot")
    return hot.groupBy("item_hash").agg(F.count("*").alias("n"), F.max("heat").alias("heat"))


def scan_video_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the stream as videos with nested counts."""
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("Video "), "event_id").alias("title"), F.col("event_type").alias("tname"), F.lit("").alias("desc"), F.struct(F.concat(F.lit("u"), "user_id").alias("name")).alias("owner"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("pubdate"), F.struct((F.col("user_id") * 10).alias("view"), F.col("user_id").alias("like"), F.lit(1).cast("long").alias("reply"), F.lit(2).cast("long").alias("share")).alias("stat"),
    )
    v = feeds.read_video_list(spark, _documents(spark, e, '{"data": {"list": [@]}}'))
    return v.groupBy("topic", "owner").agg(F.count("*").alias("n"), F.sum("views").alias("views"), F.sum("heat").alias("heat"), F.max("published_at").cast("timestamp_ntz").alias("last_at"))


def scan_quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the stream as earthquake features."""
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).alias("ms"), F.col("user_id").cast("double").alias("lng"))
    body = F.concat(
        F.lit('{"type": "FeatureCollection", "features": [{"id": "q'), "event_id", F.lit('", "properties": {"title": "M", "place": "near", "mag": '), F.col("value").cast("string"), F.lit(', "time": '), F.col("ms").cast("string"), F.lit('}, "geometry": {"type": "Point", "coordinates": ['),
        F.col("lng").cast("string"), F.lit(", 1.5, 10]}}]}"),
    )
    q = feeds.quakes(feeds.geojson_features(spark.read.text(_written(e, body))))
    return q.select("external_id", "magnitude", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "lat", "lng")


def scan_open_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as open events with two geometries; the later one counts."""
    e = table(spark, sf_dir, "news_events").filter("title is not null").select("event_id", "title", "category")
    g = lambda day, x: F.struct(F.lit(day).alias("date"), F.lit("Point").alias("type"), F.array(F.lit(x), F.lit(2.0)).alias("coordinates"))
    doc = e.select(F.concat(F.lit("E"), "event_id").alias("id"), "title", F.array(F.struct(F.lit("c").alias("id"), F.coalesce("category", F.lit("none")).alias("title"))).alias("categories"), F.array(g("2026-02-02", 9.0), g("2026-02-01", 1.0)).alias("geometry"))
    return feeds.open_events(spark.read.text(_documents(spark, doc, '{"events": [@]}'))).select("external_id", "title", "category", "lng", "at")


def scan_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as the lines of a gazetteer's cities and of its region codes, joined again."""
    r = table(spark, sf_dir, "admin1_regions").filter("admin1_code is not null and admin1_name is not null and lat is not null")
    tab = lambda *c: F.concat_ws("\t", *[F.coalesce(x.cast("string"), F.lit("")) for x in c])
    none = F.lit("")
    city = tab(F.col("source_id"), F.col("admin1_name"), F.col("admin1_name_ascii"), none, F.col("lat"), F.col("lng"), F.lit("P"), F.lit("PPLA"), F.col("country_code"), none, F.col("admin1_code"), none, none, none, F.lit(1000), none, none, none, none)
    code = tab(F.concat_ws(".", "country_code", "admin1_code"), F.col("admin1_name"), F.col("admin1_name_ascii"), F.col("source_id"))
    cities, codes = feeds.read_cities(spark, _written(r, city)), feeds.read_admin1_codes(spark, _written(r, code))
    return codes.join(feeds.region_centres(cities), ["country_code", "admin1_code"]).select("country_code", "admin1_code", "name", "geonameid", "lat", "lng")


def scan_region_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions written as dictionary documents of a country each and read again."""
    path = f"{ensure_checkpoint_dir(spark)}/dictionary-{uuid.uuid4()}"
    feeds.write_region_dictionary(table(spark, sf_dir, "admin1_regions"), path)
    d = feeds.region_dictionary(spark.read.text(path))
    return d.select("country_name", "country_code", "code", "admin1_name", "admin1_name_zh", "geojson_key", "lat", "lng")


def scan_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as links of a page: long enough texts, https, one host's pattern."""
    a = _a(spark, sf_dir).select(F.concat(F.lit("<p><a class='x' href=\""), "url", F.lit("\"><b>"), _xml("title"), F.lit("</b></a> <a href='/local'>A local page</a><a href=\"https://other.example/a\">Read</a></p>")).alias("html"))
    return feeds.page_links(a, least_text=8, pattern="/(health|disaster|science)/").select("url")


def scan_fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the stream as fetches: errors by user, with the last."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("feed_code"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", 500 + F.col("user_id") % 5).otherwise(200).cast("int").alias("status"), F.lit(None).cast("string").alias("error"))
    return feeds.fetch_log(e).select("feed_code", "n_fetches", "n_failed", "last_error", "last_failed_at")


QUERIES = {f.__name__: f for f in [
    scan_rss, scan_rdf, scan_atom, scan_article_json, scan_aggregator, scan_hot_list, scan_video_list, scan_quakes, scan_open_events, scan_gazetteer, scan_region_dictionary, scan_page_links, scan_fetch_log,
]}

_T = "nullif(trim(regexp_replace({}, '[\\r\\n]', ' ', 'g')), '')"
_OK = f"title IS NOT NULL AND url IS NOT NULL AND {_T.format('title')} IS NOT NULL AND {_T.format('url')} IS NOT NULL"
SQL = {
    "scan_rss": f"SELECT {_T.format('title')} AS title, {_T.format('url')} AS url, {_T.format('summary')} AS summary, {_T.format('category')} AS category FROM news_articles WHERE {_OK}",
    "scan_rdf": f"SELECT {_T.format('title')} AS title, {_T.format('url')} AS url, 50 AS heat FROM news_articles WHERE {_OK}",
    "scan_atom": f"SELECT {_T.format('title')} AS title, {_T.format('url')} AS url, {_T.format('summary')} AS summary FROM news_articles WHERE {_OK}",
    "scan_article_json": "SELECT min(trim(title)) AS title, trim(url) AS url, min(strftime(crawled_at, '%Y-%m-%dT%H:%M:%SZ')) AS published FROM news_articles WHERE nullif(trim(title), '') IS NOT NULL AND nullif(trim(url), '') IS NOT NULL GROUP BY trim(url)",
    "scan_aggregator": "SELECT url, 1::BIGINT AS n FROM (SELECT DISTINCT CASE WHEN url LIKE 'https://%' THEN url ELSE 'https://' || url END AS url FROM news_articles WHERE title IS NOT NULL AND url IS NOT NULL AND source_name IS NOT NULL)",
    "scan_hot_list": "SELECT sha256(trim(title) || '|hot') AS item_hash, count(*) AS n, max(coalesce(heat_score, 0))::BIGINT AS heat FROM news_articles WHERE nullif(trim(title), '') IS NOT NULL GROUP BY 1",
    "scan_video_list": "SELECT event_type AS topic, 'u' || user_id AS owner, count(*) AS n, CAST(sum(user_id * 10) AS BIGINT) AS views, CAST(sum(user_id + 2 + 6) AS BIGINT) AS heat, date_trunc('second', max(ts)) AS last_at FROM events GROUP BY 1, 2",
    "scan_quakes": "SELECT 'q' || event_id AS external_id, value AS magnitude, date_trunc('second', ts) AS event_time, 1.5::DOUBLE AS lat, CAST(user_id AS DOUBLE) AS lng FROM events",
    "scan_open_events": "SELECT 'E' || event_id AS external_id, title, coalesce(category, 'none') AS category, 9.0::DOUBLE AS lng, '2026-02-02' AS at FROM news_events WHERE title IS NOT NULL",
    "scan_gazetteer": "SELECT country_code, admin1_code, admin1_name AS name, CAST(source_id AS BIGINT) AS geonameid, lat, lng FROM admin1_regions WHERE admin1_code IS NOT NULL AND admin1_name IS NOT NULL AND lat IS NOT NULL",
    "scan_region_dictionary": "SELECT max(country_name) OVER (PARTITION BY country_code) AS country_name, country_code, admin1_code AS code, admin1_name, admin1_name_zh, geojson_key, lat, lng FROM admin1_regions WHERE admin1_code IS NOT NULL AND country_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY country_code, admin1_code ORDER BY geojson_key) = 1",
    "scan_page_links": "SELECT DISTINCT url FROM news_articles WHERE title IS NOT NULL AND url LIKE 'https://%' AND length(trim(title)) >= 8 AND regexp_matches(url, '/(health|disaster|science)/')",
    "scan_fetch_log": "SELECT user_id AS feed_code, count(*) AS n_fetches, count(*) FILTER (event_type = 'error') AS n_failed, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'HTTP ' || (500 + user_id % 5) END AS last_error, max(ts) FILTER (event_type = 'error') AS last_failed_at FROM events GROUP BY user_id",
}
