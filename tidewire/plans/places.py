"""Queries of place extraction and resolution, places of events, and their maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import places as P
from ..session import cut, table
from .cleaning import _stem_sql
from .common import LINKS_SQL, WITH_PLACES, article_places, event_places, links


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(P.name_table(table(spark, sf_dir, "admin1_regions"), P.cities_of(article_places(spark, sf_dir))))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "news_articles").select("article_id", F.posexplode("geo_entities").alias("pos", "e")).select("article_id", "pos", "e.*")


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of the dictionary by kind, with the places each may mean."""
    t = P.name_table(table(spark, sf_dir, "admin1_regions"), P.cities_of(article_places(spark, sf_dir)))
    return t.groupBy("name", "kind").agg(F.count("*").alias("n_places"), F.min("key").alias("first_key"))


def place_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entry of every place an article names, looked up with its country."""
    e = _entities(spark, sf_dir).select("article_id", "pos", "name", P.stated_kind(F.col("type")).alias("wanted"), F.coalesce(F.upper(F.trim("country_code")), P.hint_of_key(F.col("geo_key"))).alias("hint"))
    return P.resolve(e, _names(spark, sf_dir), ["article_id", "pos"]).select("article_id", "pos", "kind", "key", "score")


def place_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct place name as a country, else a region, else a city; names without one are tried without their ending."""
    names = cut(_entities(spark, sf_dir).filter("name is not null").select("name").distinct().withColumn("n", F.lower(F.trim("name"))))
    t = _names(spark, sf_dir).groupBy("name").agg(*[F.min(F.when(F.col("kind") == k, F.col("key"))).alias(k) for k in ("country", "admin1", "city")])
    keyed = names.select("name", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("try"), F.col("n").alias("n")), F.struct(F.lit(1).alias("try"), F.lower(T.region_stem(F.trim("name"))).alias("n"))))).alias("x")).select("name", "x.*")
    hit = keyed.join(t.withColumnRenamed("name", "n"), "n")
    kind = F.when(F.col("country").isNotNull(), "country").when(F.col("admin1").isNotNull(), "admin1").otherwise("city")
    best = hit.groupBy("name").agg(F.min(F.struct("try", kind.alias("kind"), F.coalesce("country", "admin1", "city").alias("key"))).alias("b"))
    return names.select("name").join(best, "name", "left").select("name", "b.kind", "b.key", F.col("b.try").alias("without_ending"))


def _mentions(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(article_id, key, name, start, confidence): first place in title and summary at which a name of the kind stands; of one start the longest."""
    t = P.name_table(table(spark, sf_dir, "admin1_regions")).filter(F.col("kind") == kind).select("name", "key")
    texts = table(spark, sf_dir, "news_articles").select("article_id", F.concat_ws(" ", "title", "summary").alias("text"))
    found = P.text_candidates(texts, "article_id", "text", []).select("article_id", F.lower("name").alias("name")).distinct()
    hits = found.join(F.broadcast(t) if kind == "country" else t, "name").join(texts, "article_id")
    start = F.when(F.col("name").rlike(P.CJK_RUN), F.instr("text", F.col("name"))).otherwise(F.regexp_instr(F.lower("text"), F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), "name", F.lit(r"\E(?![\p{L}\p{N}_])"))))
    at = hits.withColumn("start", start).filter("start > 0").withColumn("confidence", F.lit(1.0) if kind == "country" else F.when(F.col("name").rlike(P.CJK_RUN), 0.9).otherwise(0.85))
    best = at.groupBy("article_id", "start").agg(F.max(F.struct("confidence", F.length("name").alias("n"), "name", "key")).alias("b"))
    return best.select("article_id", F.col("b.key").alias("key"), F.col("b.name").alias("name"), F.col("start").cast("int").alias("start"), F.col("b.confidence").alias("confidence"))


def country_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries that titles and summaries name."""
    return _mentions(spark, sf_dir, "country")


def province_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-level regions that titles and summaries name."""
    return _mentions(spark, sf_dir, "admin1")


def all_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries and regions of each article in one order: surest first, then by place in the text."""
    both = _mentions(spark, sf_dir, "country").withColumn("kind", F.lit("country")).unionByName(_mentions(spark, sf_dir, "admin1").withColumn("kind", F.lit("province")))
    w = W.partitionBy("article_id").orderBy(F.desc("confidence"), "start", "kind", "key")
    return both.select("article_id", "kind", "key", "start", F.row_number().over(w).alias("rank"))


def text_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be a place in each article's title and summary, in the order it is tried."""
    texts = table(spark, sf_dir, "news_articles").select("article_id", F.concat_ws(" ", "title", "summary").alias("text"))
    return P.text_candidates(texts, "article_id", "text")


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "news_articles").select("article_id", "title", "summary", "content")
    texts = P.with_geo_text(a).select("article_id", "geo_text")
    found = P.places_in_texts(texts, _names(spark, sf_dir), text_col="geo_text").join(a, "article_id")
    kind = F.when(F.col("kind") == "admin1", "province").otherwise(F.col("kind"))
    noted = found.withColumn("position", P.position_of(F.col("name"), F.col("title"), F.col("summary"), F.col("content"))).withColumn("relevance", V.relevance(F.col("position"), F.col("kind"), F.col("confidence")))
    return noted.select("article_id", "rank", "name", kind.alias("kind"), "key", "country_code", "admin1_code", "label", "lat", "lng", "confidence", "position", "relevance")


def geo_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each article from its text: found, resolved with a running country, placed in the text, ordered, each once, the first primary."""
    found = cut(_extracted(spark, sf_dir))
    key = P.entity_order(F.col("relevance"), F.col("kind"), F.col("position"), F.col("confidence"))
    named = found.withColumn("place_label", F.when(F.col("kind") == "country", F.col("country_code")).otherwise(F.lower("label")))
    once = named.groupBy("article_id", "kind", "country_code", "place_label").agg(F.max_by(F.struct("key", "name", "position", "relevance", "confidence", "rank"), F.struct(key.alias("o"), (-F.col("rank")).alias("r"))).alias("e"), F.max(F.struct(key.alias("o"), (-F.col("rank")).alias("r"))).alias("o"))
    w = W.partitionBy("article_id").orderBy(F.desc("o"))
    return once.select("article_id", F.row_number().over(w).alias("place_no"), "kind", "e.key", "e.name", "e.position", "e.relevance", "e.confidence").withColumn("is_primary", F.col("place_no") == 1)


def event_source_places(spark: SparkSession, sf_dir: str, most: int = 4) -> DataFrame:
    """Places of located event reports: the point itself first, then at most four places of the text."""
    from ..operators.proximity import article_locations

    a = table(spark, sf_dir, "news_articles").filter("source_class = 'event' or category = 'disaster'")
    points = article_locations(a).groupBy("article_id").agg(F.min(F.struct("lat", "lng")).alias("p"))
    point = points.select("article_id", F.lit(0).alias("place_no"), F.concat(F.lit("PT:"), F.round("p.lat", 3), F.lit(","), F.round("p.lng", 3)).alias("key"), F.lit("POINT").alias("precision_level"), F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))
    texts = a.join(points, "article_id", "left_semi").select("article_id", F.concat_ws(" ", "title", "summary").alias("text"))
    text = P.places_in_texts(texts, _names(spark, sf_dir), most=most).select("article_id", (F.col("rank") + 1).alias("place_no"), "key", F.when(F.col("kind") == "city", "CITY").when(F.col("kind") == "admin1", "ADMIN1").otherwise("COUNTRY").alias("precision_level"), "lat", "lng")
    return point.unionByName(text)


def entity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each article in order of importance, the first primary."""
    e = _entities(spark, sf_dir)
    w = W.partitionBy("article_id").orderBy(F.desc("o"), "pos")
    rank = e.withColumn("o", P.entity_order(F.col("relevance_score"), F.col("type"), F.col("source_text_position"), F.col("confidence"))).withColumn("rank", F.row_number().over(w))
    return rank.select("article_id", "pos", "rank", (F.col("rank") == 1).alias("is_primary"))


def distinct_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of the places of an article that share kind, country and label; places without a label all stay."""
    e = _entities(spark, sf_dir).withColumn("label", P.entity_label(F.col("type"), F.col("country_code"), F.col("country_name"), F.col("admin1_name"), F.col("city_name"), F.col("name")))
    e = e.select("article_id", "pos", F.coalesce(F.lower("type"), F.lit("")).alias("kind"), F.coalesce(F.upper(F.trim("country_code")), F.lit("")).alias("cc"), F.coalesce("label", F.lit("")).alias("label"))
    first = e.filter("label <> ''").groupBy("article_id", "kind", "cc", "label").agg(F.min("pos").alias("pos"))
    return first.select("article_id", "pos", "label").unionByName(e.filter("label = ''").select("article_id", "pos", "label"))


def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of an event merged by key: the surest mention's fields, blanks filled from later mentions.

    The surest is the first of the highest confidence in order of article and
    position; mentions before it are overlaid by it.
    """
    cols = ["country_name", "admin1_name", "city_name", "precision_level"]
    m = links(spark, sf_dir).join(_entities(spark, sf_dir).filter("trim(geo_key) <> ''"), "article_id").select("event_id", F.trim("geo_key").alias("geo_key"), F.struct("article_id", "pos").alias("o"), F.coalesce("confidence", F.lit(0.0)).alias("c"), *cols)
    top = m.groupBy("event_id", "geo_key").agg(F.max("c").alias("confidence"), F.min(F.struct((-F.col("c")).alias("c"), "o")).alias("t")).select("event_id", "geo_key", "confidence", F.col("t.o").alias("from"))
    later = m.join(top, ["event_id", "geo_key"]).filter(F.col("o") >= F.col("from"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return later.groupBy("event_id", "geo_key").agg(F.max("confidence").alias("confidence"), *[F.min(F.when(blank(c).isNotNull(), F.struct("o", F.col(c).alias("v")))).getField("v").alias(c) for c in cols])


def place_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table of places by key: every field from the first mention that has it."""
    cols = ["name", "country_code", "country_name", "admin1_code", "city_name", "lat", "lng"]
    e = _entities(spark, sf_dir).filter("geo_key is not null")
    return e.groupBy("geo_key").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("article_id", "pos"))).alias(c) for c in cols], F.count("*").alias("n_mentions"))


def place_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events mapped to places: first mention counts full, later ones 0.8; how it was found and where."""
    e = links(spark, sf_dir).join(_entities(spark, sf_dir).filter("geo_key is not null"), "article_id")
    first = e.groupBy("event_id", "geo_key").agg(F.min(F.struct("article_id", "pos", "matched_text", "source_text_position")).alias("m"))
    w = W.partitionBy("event_id").orderBy("m.article_id", "m.pos", "geo_key")
    r = first.withColumn("n", F.row_number().over(w))
    return r.select(
        "event_id", "geo_key", (F.col("n") == 1).alias("is_primary"), F.when(F.col("n") == 1, 1.0).otherwise(0.8).alias("relevance"), F.when(F.col("m.matched_text").isNotNull(), "dictionary_match+text_scan").otherwise("dictionary_match").alias("method"),
        F.coalesce("m.source_text_position", F.when(F.col("n") == 1, "title")).alias("position"),
    )


def precision_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and display of places that have none, from their key: the country's own key is the country, anything else a city."""
    e = _entities(spark, sf_dir)
    country = (F.length("country_code") == 2) & (F.upper("geo_key") == F.upper("country_code"))
    guessed = F.when(country, "COUNTRY").otherwise("CITY")
    none = F.col("precision_level").isNull()
    return e.select("article_id", "pos", F.coalesce("precision_level", guessed).alias("precision_level"), F.when(none, F.when(country, "POLYGON").otherwise("POINT")).otherwise(F.col("display_mode")).alias("display_mode"), none.alias("filled"))


def event_geo_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country and level of each event from the places of its best article: hottest, then latest."""
    a = table(spark, sf_dir, "news_articles").select("article_id", F.coalesce("heat_score", F.lit(0)).alias("h"), "crawled_at", "geo_entities")
    best = links(spark, sf_dir).join(a.filter("size(geo_entities) > 0"), "article_id").groupBy("event_id").agg(F.max_by(F.get("geo_entities", F.lit(0)), F.struct("h", "crawled_at", "article_id")).alias("e"))
    level = F.when(F.col("e.precision_level") == "CITY", "city").when(F.col("e.precision_level") == "ADMIN1", "admin1").otherwise("country")
    old = table(spark, sf_dir, "news_events").select("event_id", "main_country", "event_level")
    return old.join(best, "event_id").select("event_id", F.coalesce("e.country_code", "main_country").alias("main_country"), level.alias("event_level"), F.coalesce(level != F.col("event_level"), F.lit(True)).alias("changed"))


def suspicious_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose places look wrong, with the reasons."""
    e = links(spark, sf_dir).join(_entities(spark, sf_dir), "article_id")
    first = e.groupBy("event_id").agg(F.min(F.struct("article_id", "pos", F.coalesce("geo_key", F.lit("")).alias("geo_key"), F.coalesce("matched_text", F.lit("")).alias("matched_text"))).alias("p"))
    j = table(spark, sf_dir, "news_events").select("event_id", "event_level").join(first, "event_id", "left")
    key, text = F.coalesce("p.geo_key", F.lit("")), F.trim(F.coalesce("p.matched_text", F.lit("")))
    reasons = F.array(
        F.when(key == "", "missing_primary_geo"), F.when((text != "") & (F.length(text) <= 3), "short_matched_text"), F.when(text.rlike("^[a-z]+$"), "lowercase_ascii_matched_text"),
        F.when((F.col("event_level") == "city") & (key == ""), "city_event_without_primary_geo"),
    )
    return j.select("event_id", F.array_join(F.filter(reasons, lambda r: r.isNotNull()), "|").alias("reasons")).filter("reasons <> ''")


def hotspot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the globe: each place of an event with its centre, the country's where it has none; an event without places falls back to its country."""
    centre = table(spark, sf_dir, "admin1_regions").groupBy("country_code").agg((F.round(F.avg("lat"), 5) + 0.0).alias("clat"), (F.round(F.avg("lng"), 5) + 0.0).alias("clng"))
    events = table(spark, sf_dir, "news_events").select("event_id", "main_country", "heat_score")
    p = event_places(spark, sf_dir).filter("geo_key is not null").groupBy("event_id", "geo_key").agg(F.max("country_code").alias("country_code"), F.max(F.struct("lat", "lng")).alias("at"), F.max("confidence").alias("confidence"))
    mapped = p.join(events.select("event_id", "heat_score"), "event_id")
    bare = events.join(p.select("event_id"), "event_id", "left_anti").filter("main_country is not null").select("event_id", F.col("main_country").alias("geo_key"), F.col("main_country").alias("country_code"), F.lit(None).cast("struct<lat:double,lng:double>").alias("at"), F.lit(0.45).alias("confidence"), "heat_score")
    rows = mapped.unionByName(bare).join(F.broadcast(centre), "country_code", "left")  # one row a country
    own = F.col("at.lat").isNotNull() & F.col("at.lng").isNotNull()
    return rows.select("event_id", "geo_key", "heat_score", "confidence", F.when(own, F.col("at.lat")).otherwise(F.col("clat")).alias("lat"), F.when(own, F.col("at.lng")).otherwise(F.col("clng")).alias("lng")).filter("lat is not null")


def region_keys(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("QX", "QM", "A1:QX:09", "A1:QM:2", "QX.09", "qn")) -> DataFrame:
    """Events of each region key: a country's two letters, 'A1:country:code', or a place's own key."""
    asked = spark.createDataFrame([(k,) for k in keys], "region_key string")
    k = F.col("region_key")
    parts = F.split(k, ":", 3)
    asked = asked.select(k, F.when(k.rlike("^[A-Za-z]{2}$"), F.upper(k)).when(k.startswith("A1:") & (F.size(parts) == 3), F.upper(F.get(parts, F.lit(1)))).alias("cc"), F.when(k.startswith("A1:") & (F.size(parts) == 3), F.get(parts, F.lit(2))).alias("a1"))
    p = event_places(spark, sf_dir).select("event_id", "geo_key", "country_code", "admin1_code").distinct()
    by_country = F.broadcast(asked.filter("cc is not null and a1 is null").select("region_key", F.col("cc").alias("country_code")))
    by_region = F.broadcast(asked.filter("a1 is not null").select("region_key", F.col("cc").alias("country_code"), F.col("a1").alias("admin1_code")))
    by_key = F.broadcast(asked.filter("cc is null").select("region_key", k.alias("geo_key")))
    hits = p.join(by_country, "country_code").select("region_key", "event_id").unionByName(p.join(by_region, ["country_code", "admin1_code"]).select("region_key", "event_id")).unionByName(p.join(by_key, "geo_key").select("region_key", "event_id"))
    return hits.distinct()


def region_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of each region with heat: by code, else by name."""
    e = table(spark, sf_dir, "news_events").select("event_id", F.coalesce("heat_score", F.lit(0)).alias("h"))
    p = event_places(spark, sf_dir).filter("admin1_name is not null or admin1_code is not null").select("event_id", "country_code", "admin1_code", "admin1_name").distinct()
    heat = p.join(e, "event_id").groupBy("country_code", "admin1_code", "admin1_name").agg(F.sum("h").alias("heat_total"))
    r = table(spark, sf_dir, "admin1_regions")
    by_code = r.filter("admin1_code is not null").groupBy("country_code", "admin1_code").agg(F.min("geojson_key").alias("k1"))
    by_name = r.filter("admin1_name is not null").groupBy("country_code", F.lower("admin1_name").alias("ln")).agg(F.min("geojson_key").alias("k2"))
    j = heat.join(by_code, ["country_code", "admin1_code"], "left").withColumn("ln", F.lower("admin1_name")).join(by_name, ["country_code", "ln"], "left")
    return j.select("country_code", "admin1_code", "admin1_name", "heat_total", F.coalesce("k1", "k2").alias("geojson_key"), F.when(F.col("k1").isNotNull(), "code").when(F.col("k2").isNotNull(), "name").alias("met_by"))


QUERIES = {f.__name__: f for f in [
    place_names, place_lookups, place_normaliser, country_mentions, province_mentions, all_mentions, text_candidates, geo_pipeline, event_source_places, entity_order, distinct_entities, merged_entities,
    place_entities, place_mappings, precision_backfill, event_geo_backfill, suspicious_places, hotspot_rows, region_keys, region_polygons,
]}

_E = "e AS (SELECT article_id, CAST(i - 1 AS INT) AS pos, x.* FROM (SELECT article_id, unnest(geo_entities) AS x, generate_subscripts(geo_entities, 1) AS i FROM news_articles))"
_VARIANTS = rf"[trim(n), regexp_replace(trim(n), '[\s\pZ]+', ' ', 'g'), trim({_stem_sql('trim(n)')})]"
_DICT = f"""{_E}, city AS (SELECT geo_key AS key, min(city_name) AS n, min(country_code) AS country_code FROM e WHERE precision_level = 'CITY' AND geo_key IS NOT NULL AND city_name IS NOT NULL GROUP BY 1),
raw AS (SELECT unnest([admin1_name, admin1_name_ascii, admin1_name_zh] || coalesce(aliases, [])) AS n, 'admin1' AS kind, geojson_key AS key, country_code FROM admin1_regions WHERE geojson_key IS NOT NULL
 UNION ALL SELECT max(country_name), 'country', country_code, country_code FROM admin1_regions WHERE country_code IS NOT NULL GROUP BY country_code UNION ALL SELECT n, 'city', key, country_code FROM city),
dict AS (SELECT name, kind, key, min(country_code) AS country_code FROM (SELECT lower(unnest({_VARIANTS})) AS name, kind, key, country_code FROM raw WHERE n IS NOT NULL) WHERE name IS NOT NULL AND name <> '' GROUP BY ALL)"""
_ORDER = """CAST(round(coalesce(relevance_score, 0) + CASE lower(type) WHEN 'province' THEN 0.06::DOUBLE WHEN 'admin1' THEN 0.06 WHEN 'city' THEN 0.04 ELSE 0 END, 6) AS DOUBLE) DESC,
 CASE lower(type) WHEN 'province' THEN 1.0 WHEN 'admin1' THEN 1.0 WHEN 'city' THEN 0.92 WHEN 'country' THEN 0.86 ELSE 0.8 END DESC, CASE lower(source_text_position) WHEN 'title' THEN 1.0 WHEN 'summary' THEN 0.8 WHEN 'content' THEN 0.6 ELSE 0.5 END DESC, coalesce(confidence, 0) DESC, pos"""
SQL = {
    "place_names": f"WITH {_DICT} SELECT name, kind, count(*) AS n_places, min(key) AS first_key FROM dict GROUP BY ALL",
    "place_lookups": f"""WITH {_DICT}, q AS (SELECT article_id, pos, lower(trim(name)) AS raw_name, lower(trim(regexp_replace(name, '[（(].*?[)）]$', ''))) AS bare, name AS spelled,
        CASE WHEN lower(trim(type)) IN ('province', 'state', 'region', 'admin1') THEN 'admin1' WHEN lower(trim(type)) IN ('city', 'district', 'point') THEN 'city' ELSE 'country' END AS wanted,
        coalesce(upper(trim(country_code)), substr(coalesce(nullif(regexp_extract(upper(trim(geo_key)), '^([^.]*)\\.', 1), ''), nullif(regexp_extract(upper(trim(geo_key)), '^([^_]*)_', 1), ''), nullif(regexp_extract(upper(trim(geo_key)), '^([^:]*):', 1), ''),
        CASE WHEN regexp_matches(upper(trim(geo_key)), '^[A-Z]{{2,3}}$') THEN upper(trim(geo_key)) END), 1, 10)) AS hint FROM e WHERE name IS NOT NULL),
        tries AS (SELECT article_id, pos, spelled, wanted, hint, raw_name AS n, 0 AS try FROM q UNION ALL SELECT article_id, pos, spelled, wanted, hint, bare, 1 FROM q WHERE bare <> raw_name),
        h AS (SELECT t.*, kind, key, coalesce(d.country_code = hint, FALSE) AS near FROM tries t JOIN dict d ON d.name = t.n),
        s AS (SELECT *, round(CASE kind WHEN 'city' THEN 0.62::DOUBLE WHEN 'admin1' THEN 0.58 ELSE 0.54 END + CASE WHEN kind = wanted THEN 0.22::DOUBLE WHEN wanted = 'admin1' AND kind = 'city' THEN -0.08 WHEN wanted = 'city' AND kind = 'admin1' THEN -0.05 ELSE 0 END + CASE WHEN near THEN 0.18::DOUBLE ELSE 0 END, 6) AS score,
          max(CASE WHEN kind = 'city' AND (near OR hint IS NULL) THEN 1 ELSE 0 END) OVER g AS has_city, max(CASE WHEN kind = 'admin1' AND (near OR hint IS NULL) THEN 1 ELSE 0 END) OVER g AS has_region FROM h WINDOW g AS (PARTITION BY article_id, pos, try)),
        ok AS (SELECT * FROM s WHERE kind = 'country' OR (kind = 'city' AND (CASE WHEN has_city = 1 THEN near OR hint IS NULL ELSE regexp_matches(spelled, '[一-鿿]|[ ''-]') END)) OR (kind = 'admin1' AND (has_region = 0 OR near OR hint IS NULL)))
        SELECT article_id, pos, kind, key, score FROM ok QUALIFY row_number() OVER (PARTITION BY article_id, pos ORDER BY try, score DESC, key) = 1""",
    "place_normaliser": f"""WITH {_DICT}, n AS (SELECT DISTINCT name FROM e WHERE name IS NOT NULL), t AS (SELECT name, 0 AS try, lower(trim(name)) AS n FROM n UNION ALL SELECT name, 1, lower({_stem_sql('trim(name)')}) FROM n),
        b AS (SELECT t.name, try, kind, key, row_number() OVER (PARTITION BY t.name ORDER BY try, CASE kind WHEN 'country' THEN 0 WHEN 'admin1' THEN 1 ELSE 2 END, key) AS r FROM t JOIN dict d ON d.name = t.n)
        SELECT n.name, kind, key, try AS without_ending FROM n LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON b.name = n.name""",
    "entity_order": f"WITH {_E} SELECT article_id, pos, CAST(row_number() OVER w AS INT) AS rank, row_number() OVER w = 1 AS is_primary FROM e WINDOW w AS (PARTITION BY article_id ORDER BY {_ORDER})",
    "distinct_entities": f"""WITH {_E}, l AS (SELECT article_id, pos, coalesce(lower(type), '') AS kind, coalesce(upper(trim(country_code)), '') AS cc, coalesce(CASE lower(type) WHEN 'city' THEN lower(trim(coalesce(nullif(city_name, ''), name))) WHEN 'province' THEN lower(trim(coalesce(nullif(admin1_name, ''), name)))
        WHEN 'admin1' THEN lower(trim(coalesce(nullif(admin1_name, ''), name))) WHEN 'country' THEN coalesce(nullif(upper(trim(country_code)), ''), lower(trim(coalesce(nullif(country_name, ''), name)))) ELSE lower(trim(name)) END, '') AS label FROM e)
        SELECT article_id, pos, label FROM l WHERE label = '' OR pos = (SELECT min(pos) FROM l m WHERE m.article_id = l.article_id AND m.kind = l.kind AND m.cc = l.cc AND m.label = l.label)""",
    "merged_entities": f"""WITH {_E}, m AS (SELECT event_id, trim(geo_key) AS geo_key, article_id, pos, coalesce(confidence, 0) AS c, nullif(country_name, '') AS country_name, nullif(admin1_name, '') AS admin1_name, nullif(city_name, '') AS city_name, nullif(precision_level, '') AS precision_level FROM ({LINKS_SQL}) JOIN e USING (article_id) WHERE trim(geo_key) <> ''),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_id, geo_key ORDER BY article_id, pos) AS i, max(c) OVER (PARTITION BY event_id, geo_key) AS top FROM m), f AS (SELECT *, min(CASE WHEN c = top THEN i END) OVER (PARTITION BY event_id, geo_key) AS start FROM r)
        SELECT event_id, geo_key, max(top) AS confidence, arg_min(country_name, i) FILTER (country_name IS NOT NULL) AS country_name, arg_min(admin1_name, i) FILTER (admin1_name IS NOT NULL) AS admin1_name, arg_min(city_name, i) FILTER (city_name IS NOT NULL) AS city_name, arg_min(precision_level, i) FILTER (precision_level IS NOT NULL) AS precision_level FROM f WHERE i >= start GROUP BY ALL""",
    "place_entities": f"WITH {_E} SELECT geo_key, " + ", ".join(f"arg_min({c}, (article_id, pos)) FILTER ({c} IS NOT NULL) AS {c}" for c in ["name", "country_code", "country_name", "admin1_code", "city_name", "lat", "lng"]) + ", count(*) AS n_mentions FROM e WHERE geo_key IS NOT NULL GROUP BY geo_key",
    "place_mappings": f"""WITH {_E}, f AS (SELECT event_id, geo_key, article_id, pos, matched_text, source_text_position FROM ({LINKS_SQL}) JOIN e USING (article_id) WHERE geo_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id, geo_key ORDER BY article_id, pos) = 1),
        n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY article_id, pos, geo_key) AS n FROM f) SELECT event_id, geo_key, n = 1 AS is_primary, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.8 END AS relevance, CASE WHEN matched_text IS NOT NULL THEN 'dictionary_match+text_scan' ELSE 'dictionary_match' END AS method, coalesce(source_text_position, CASE WHEN n = 1 THEN 'title' END) AS position FROM n""",
    "precision_backfill": f"""WITH {_E} SELECT article_id, pos, coalesce(precision_level, CASE WHEN length(country_code) = 2 AND upper(geo_key) = upper(country_code) THEN 'COUNTRY' ELSE 'CITY' END) AS precision_level,
        CASE WHEN precision_level IS NULL THEN CASE WHEN length(country_code) = 2 AND upper(geo_key) = upper(country_code) THEN 'POLYGON' ELSE 'POINT' END ELSE display_mode END AS display_mode, precision_level IS NULL AS filled FROM e""",
    "event_geo_backfill": f"""WITH b AS (SELECT event_id, geo_entities[1] AS e FROM ({LINKS_SQL}) JOIN news_articles USING (article_id) WHERE len(geo_entities) > 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY coalesce(heat_score, 0) DESC, crawled_at DESC NULLS LAST, article_id DESC) = 1),
        l AS (SELECT event_id, main_country, event_level, e.country_code AS cc, CASE e.precision_level WHEN 'CITY' THEN 'city' WHEN 'ADMIN1' THEN 'admin1' ELSE 'country' END AS level FROM news_events JOIN b USING (event_id)) SELECT event_id, coalesce(cc, main_country) AS main_country, level AS event_level, coalesce(level <> event_level, TRUE) AS changed FROM l""",
    "suspicious_places": f"""WITH {_E}, f AS (SELECT event_id, coalesce(geo_key, '') AS k, trim(coalesce(matched_text, '')) AS t FROM ({LINKS_SQL}) JOIN e USING (article_id) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY article_id, pos) = 1),
        j AS (SELECT event_id, event_level, coalesce(k, '') AS k, coalesce(t, '') AS t FROM news_events LEFT JOIN f USING (event_id)) SELECT * FROM (SELECT event_id, concat_ws('|', CASE WHEN k = '' THEN 'missing_primary_geo' END, CASE WHEN t <> '' AND length(t) <= 3 THEN 'short_matched_text' END,
        CASE WHEN regexp_matches(t, '^[a-z]+$') THEN 'lowercase_ascii_matched_text' END, CASE WHEN event_level = 'city' AND k = '' THEN 'city_event_without_primary_geo' END) AS reasons FROM j) WHERE reasons <> ''""",
    "hotspot_rows": f"""{WITH_PLACES.rstrip()}, c AS (SELECT country_code, round(avg(lat), 5) + 0.0 AS clat, round(avg(lng), 5) + 0.0 AS clng FROM admin1_regions GROUP BY 1), p AS (SELECT event_id, geo_key, max(country_code) AS country_code, max({{'lat': lat, 'lng': lng}}) AS at_, max(confidence) AS confidence FROM event_places WHERE geo_key IS NOT NULL GROUP BY ALL),
        r AS (SELECT event_id, geo_key, country_code, at_.lat AS lat, at_.lng AS lng, confidence, heat_score FROM p JOIN news_events USING (event_id) UNION ALL SELECT event_id, main_country, main_country, NULL, NULL, 0.45::DOUBLE, heat_score FROM news_events WHERE main_country IS NOT NULL AND event_id NOT IN (SELECT event_id FROM p))
        SELECT * FROM (SELECT event_id, geo_key, heat_score, confidence, CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN lat ELSE clat END AS lat, CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN lng ELSE clng END AS lng FROM r LEFT JOIN c USING (country_code)) WHERE lat IS NOT NULL""",
    "region_keys": f"""{WITH_PLACES} SELECT DISTINCT k AS region_key, event_id FROM (SELECT unnest(['QX', 'QM', 'A1:QX:09', 'A1:QM:2', 'QX.09', 'qn']) AS k) JOIN event_places p ON CASE WHEN regexp_matches(k, '^[A-Za-z]{{2}}$') THEN p.country_code = upper(k) WHEN k LIKE 'A1:%:%' THEN p.country_code = upper(split_part(k, ':', 2)) AND p.admin1_code = split_part(k, ':', 3) ELSE p.geo_key = k END""",
    "region_polygons": f"""{WITH_PLACES.rstrip()}, h AS (SELECT country_code, admin1_code, admin1_name, CAST(sum(coalesce(heat_score, 0)) AS BIGINT) AS heat_total FROM (SELECT DISTINCT event_id, country_code, admin1_code, admin1_name FROM event_places WHERE admin1_name IS NOT NULL OR admin1_code IS NOT NULL) JOIN news_events USING (event_id) GROUP BY ALL),
        a AS (SELECT country_code, admin1_code, min(geojson_key) AS k1 FROM admin1_regions GROUP BY ALL), b AS (SELECT country_code, lower(admin1_name) AS ln, min(geojson_key) AS k2 FROM admin1_regions GROUP BY ALL)
        SELECT h.country_code, h.admin1_code, admin1_name, heat_total, coalesce(k1, k2) AS geojson_key, CASE WHEN k1 IS NOT NULL THEN 'code' WHEN k2 IS NOT NULL THEN 'name' END AS met_by FROM h LEFT JOIN a ON a.country_code = h.country_code AND a.admin1_code = h.admin1_code LEFT JOIN b ON b.country_code = h.country_code AND b.ln = lower(h.admin1_name)""",
}
