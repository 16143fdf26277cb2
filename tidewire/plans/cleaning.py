"""Queries of the cleaning and conversion functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import places as P
from ..session import staged, table



def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "news_articles")


def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without tags, a site's name or a number at the end; each article's title with its source's name and position behind it is cleaned, too."""
    a = _a(spark, sf_dir).select("article_id", "title", F.concat("title", F.lit(" - Reuters")).alias("named"), F.concat("title", F.lit("_"), F.col("article_id").cast("string")).alias("numbered"))
    return a.select("article_id", T.clean_title(F.col("title")).alias("title"), T.clean_title(F.col("named")).alias("from_named"), T.clean_title(F.col("numbered")).alias("from_numbered"))


def content_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginning of each content without markup, at most 200 characters."""
    return _a(spark, sf_dir).select("article_id", T.summary_of(F.col("content")).alias("summary"))


def normal_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and hash of each content with blanks and empty lines in order."""
    text = T.normal_content(F.col("content"))
    return _a(spark, sf_dir).select("article_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_hash"))


def script_free_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents between a script, a style and a comment, with these taken out again."""
    page = F.concat(F.lit("<script a='1'>\nvar x = '<p>';</script>"), F.coalesce("content", F.lit("")), F.lit("<STYLE>p {}</STYLE>\n<!-- note\n -->"))
    return _a(spark, sf_dir).select("article_id", F.md5(T.without_scripts(page)).alias("page_hash"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three identities of each article: of title and beginning, of title, source and address, and of the filled fields."""
    return _a(spark, sf_dir).select(
        "article_id", T.content_hash(F.col("title"), F.col("content")).alias("content_hash"), T.dedup_hash(F.col("title"), F.col("source_name"), F.col("url")).alias("dedup_hash"),
        T.joined_hash(F.col("url"), F.col("title"), F.col("category")).alias("field_hash"),
    )


def listed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags written as one text and read again."""
    written = F.array_join("tags", " , ")
    return _a(spark, sf_dir).select("article_id", F.array_join(T.listed(written), "|").alias("tags"), F.size(T.listed(written)).alias("n_tags"))


def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source names in their usual spelling and countries by known code."""
    known = sorted(r[0] for r in table(spark, sf_dir, "admin1_regions").select("country_code").dropna().distinct().collect())  # one row a country
    a = _a(spark, sf_dir).select(T.normal_source(F.col("source_name")).alias("source_name"), T.normal_country(F.col("country"), known).alias("country"))
    return a.groupBy("source_name", "country").agg(F.count("*").alias("n_articles"))


def region_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of regions, with the words of their kind behind them, cut to their stem."""
    r = table(spark, sf_dir, "admin1_regions").select("geojson_key", F.concat_ws(" ", "admin1_name_ascii", F.lower("admin1_type")).alias("en"), F.concat("admin1_name_zh", F.lit("自治区")).alias("zh"), F.concat("admin1_name_zh", F.lit("省")).alias("zh2"))
    return r.select("geojson_key", *[T.region_stem(F.col(c)).alias(c) for c in ("en", "zh", "zh2")])


def region_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings that each region may be met under."""
    r = table(spark, sf_dir, "admin1_regions")
    names = F.concat(F.array("admin1_name", "admin1_name_ascii", "admin1_name_zh", F.concat("admin1_name_zh", F.lit("地区"))), F.coalesce("aliases", F.array().cast("array<string>")))
    each = r.select("geojson_key", F.explode(names).alias("name")).filter("name is not null")
    return each.select("geojson_key", F.explode(T.name_variants(F.col("name"))).alias("variant")).distinct()


def page_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles written into the head of a page and read from its meta elements."""
    clean = F.regexp_replace(F.coalesce("title", F.lit("-")), "[\"'<>&]", "")
    page = F.concat(F.lit("<html><head><meta charset=\"utf-8\"><META property=\"og:title\" content=\""), clean, F.lit("\"><meta name='section' content='"), F.coalesce("category", F.lit("none")), F.lit("'></head></html>"))
    return _a(spark, sf_dir).select("article_id", T.meta_content(page, "og:title").alias("title"), T.meta_content(page, "section").alias("section"), T.meta_content(page, "absent").alias("absent"))


def web_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in the shapes pages hold them, made absolute against the source's page."""
    path = F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://[^/]+/", ""))
    a = _a(spark, sf_dir).select("article_id", "url", "source_url", path.alias("path"), F.concat(F.lit("//"), F.regexp_replace("url", "^[a-z]+://", "")).alias("bare"), F.concat("url", F.lit("#part")).alias("part"))
    base = F.col("source_url")
    return a.select(
        "article_id", *[V.web_address(F.col(c), base).alias(f"web_{c}") for c in ("url", "path", "bare", "part")], *[V.article_address(F.col(c), base).alias(f"article_{c}") for c in ("path", "part")],
        V.web_address(F.concat(F.lit("mailto:"), "article_id"), base).alias("web_mail"),
    )


def geo_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each article that is searched for places."""
    return P.with_geo_text(_a(spark, sf_dir).select("article_id", "title", "summary", "content")).select("article_id", "geo_text")


def sentence_ranks(spark: SparkSession, sf_dir: str, most: int = 8) -> DataFrame:
    """The eight sentences of each content most likely to name a place."""
    a = staged(_a(spark, sf_dir).select("article_id", "content"), parts=T.sentences(F.substring(T.plain_html(F.col("content")), 1, 4500)))
    top = F.slice(F.array_sort(F.filter(T.sentence_scores(F.col("parts")), lambda x: F.length(x["text"]) >= 20)), 1, most)
    return a.select("article_id", F.posexplode(top).alias("rank", "s")).select("article_id", "rank", F.col("s.at").alias("sentence_no"), (-F.col("s.rank")).alias("tenths"))


def latest_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest of the times known of each event and its newest article."""
    newest = table(spark, sf_dir, "event_articles").join(_a(spark, sf_dir).select("article_id", "crawled_at"), "article_id").groupBy("event_id").agg(F.max("crawled_at").alias("at"))
    e = table(spark, sf_dir, "news_events").join(newest, "event_id", "left")
    return e.select("event_id", F.greatest("first_seen_at", "last_seen_at", "at").alias("latest_at"))


def day_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by day number and hour begun at UTC+8."""
    at = F.col("crawled_at").cast("timestamp")
    a = _a(spark, sf_dir).filter("crawled_at is not null").select(V.day_index(at).alias("day_no"), V.hours_of_day(at).alias("hour_no"))
    return a.groupBy("day_no", "hour_no").agg(F.count("*").alias("n_articles"))


def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity by the three rules, of alerts made from the event stream."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 10).alias("mag"), (F.col("event_id") % 7).alias("k"))
    alert = F.when(F.col("k") == 0, "Red ").when(F.col("k") == 1, "orange").when(F.col("k") == 2, "green").when(F.col("k") == 3, "yellow")
    sig = F.when(F.col("k") == 4, F.col("mag") * 40)
    kind = F.when(F.col("k") == 0, "volcanoes").when(F.col("k") == 1, "severeStorms").when(F.col("k") == 2, "wildfires").otherwise("floods")
    return e.select(
        "event_id", V.quake_severity(alert, sig, F.when(F.col("k") == 5, F.col("mag"))).alias("quake"), V.alert_severity(alert, F.when(F.col("k") > 1, F.col("mag") / 5)).alias("alert"),
        V.open_event_severity(kind, F.when(F.col("k") > 3, F.col("mag"))).alias("open_event"),
    )


def place_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of every place of an article by position, kind and confidence."""
    e = _a(spark, sf_dir).select("article_id", F.posexplode("geo_entities").alias("pos", "e"))
    return e.select("article_id", "pos", V.relevance(F.col("e.source_text_position"), F.col("e.type"), F.col("e.confidence")).alias("relevance"))


def geometry_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent, middle and viewing altitude of every article's geometry and every region's shape."""
    a = _a(spark, sf_dir).filter("raw_geometry is not null").select(F.col("article_id").cast("string").alias("key"), F.col("raw_geometry").alias("g"))
    s = table(spark, sf_dir, "admin1_shapes").select(F.col("geojson_key").alias("key"), F.col("geometry").alias("g"))
    box = a.union(s).select("key", V.extent(F.col("g")).alias("box")).filter("box is not null").select("key", "box", V.extent_centre(F.col("box")).alias("c"))
    return box.select("key", *[F.get("box", F.lit(i)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))], "c.lng", "c.lat", "c.altitude")


def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of an event from its articles: later values overlay earlier ones key by key, and all sources are listed.

    One row an event and key. Which value is later is settled by crawl time and
    article id before anything is gathered.
    """
    a = _a(spark, sf_dir).filter("source_metadata is not null").select("article_id", "crawled_at", F.explode(F.from_json("source_metadata", "map<string,string>")).alias("name", "value"))
    pairs = table(spark, sf_dir, "event_articles").select("event_id", "article_id").distinct().join(a, "article_id")
    return pairs.groupBy("event_id", "name").agg(F.max_by("value", F.struct("crawled_at", "article_id")).alias("value"), F.count_distinct("value").alias("n_values"))


def built_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written from an article's filled fields; empty ones are left out."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    j = F.to_json(F.struct(blank(F.col("geom_type")).alias("geom_type"), blank(F.col("external_id")).alias("external_id"), F.col("severity"), blank(F.col("event_status")).alias("event_status")))
    return _a(spark, sf_dir).select("article_id", F.get_json_object(j, "$.geom_type").alias("geom_type"), F.get_json_object(j, "$.severity").alias("severity"), F.size(F.json_object_keys(j)).alias("n_fields"))


def tags_asked(spark: SparkSession, sf_dir: str, asked: str = " AI, health,,ai ,space") -> DataFrame:
    """Articles with any of the tags of a query parameter."""
    wanted = V.query_tags(asked)
    tags = V.normal_tags(F.col("tags"), 10_000)
    return _a(spark, sf_dir).filter(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted]))).select("article_id")


def entity_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries of each article's places in order, each once, as its region tags."""
    codes = F.array_distinct(F.filter(F.transform("geo_entities", lambda e: F.upper(F.trim(e["country_code"]))), lambda c: c.isNotNull() & (c != "")))
    return _a(spark, sf_dir).filter("geo_entities is not null").select("article_id", F.array_join(codes, "|").alias("region_tags"))


QUERIES = {f.__name__: f for f in [
    clean_titles, content_summaries, normal_contents, script_free_pages, content_hashes, listed_tags, normal_names, region_stems, region_variants, page_metas, web_addresses, geo_texts, sentence_ranks,
    latest_times, day_indexes, severities, place_relevance, geometry_extents, merged_metadata, built_metadata, tags_asked, entity_countries,
]}

_B = r"[\s\pZ]+"
_PLAIN = f"nullif(trim(regexp_replace(regexp_replace({{}}, '<[^>]+>', ' ', 'g'), '{_B}', ' ', 'g')), '')"
_SITES = T.SITE_SUFFIX


def _clean_sql(column: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace({_PLAIN.format(column)}, '{_SITES}', ''), '[-_—|]\\s*\\d+$', '')), '')"


def _stem_sql(c: str) -> str:
    zh = " ".join(f"WHEN suffix({c}, '{e}') AND length({c}) > {len(e)} THEN substr({c}, 1, length({c}) - {len(e)})" for e in T.REGION_ENDINGS_ZH)
    en = " ".join(f"WHEN suffix(lower({c}), '{e}') AND length({c}) > {len(e)} THEN substr({c}, 1, length({c}) - {len(e)})" for e in T.REGION_ENDINGS_EN)
    return f"CASE {zh} {en} ELSE {c} END"


_NUM = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
SQL = {
    "clean_titles": f"SELECT article_id, {_clean_sql('title')} AS title, {_clean_sql(chr(40) + 'title || ' + chr(39) + ' - Reuters' + chr(39) + chr(41))} AS from_named, {_clean_sql(chr(40) + 'title || ' + chr(39) + '_' + chr(39) + ' || article_id' + chr(41))} AS from_numbered FROM news_articles",
    "content_summaries": f"SELECT article_id, coalesce(CASE WHEN length(t) > 200 THEN rtrim(substr(t, 1, 197)) || '...' ELSE t END, '') AS summary FROM (SELECT article_id, {_PLAIN.format('content')} AS t FROM news_articles)",
    "normal_contents": rf"""SELECT article_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS text_hash FROM (SELECT article_id, regexp_replace(array_to_string(list_transform(
        string_split(regexp_replace(regexp_replace(coalesce(content, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^{_B}|{_B}$', '', 'g')), chr(10)), '^{_B}|{_B}$', '', 'g') AS t FROM news_articles)""",
    "script_free_pages": "SELECT article_id, md5(nullif(trim(coalesce(content, '') || chr(10)), '')) AS page_hash FROM news_articles",
    "content_hashes": """SELECT article_id, sha256(coalesce(title, '') || '|' || substr(coalesce(content, ''), 1, 500)) AS content_hash,
        sha256(trim(lower(coalesce(title, ''))) || '|' || trim(lower(coalesce(source_name, ''))) || '|' || trim(lower(coalesce(url, '')))) AS dedup_hash, sha256(concat_ws('|', nullif(url, ''), nullif(title, ''), nullif(category, ''))) AS field_hash FROM news_articles""",
    "listed_tags": "SELECT article_id, array_to_string(l, '|') AS tags, CAST(len(l) AS INT) AS n_tags FROM (SELECT article_id, list_filter(list_transform(coalesce(tags, []), lambda t: trim(t)), lambda t: t <> '') AS l FROM news_articles)",
    "normal_names": """SELECT coalesce(CASE trim(source_name) WHEN '新浪' THEN '新浪新闻' WHEN '新浪网' THEN '新浪新闻' WHEN 'reuters' THEN 'Reuters' ELSE nullif(trim(source_name), '') END, 'Unknown') AS source_name,
        CASE WHEN upper(trim(country)) IN (SELECT country_code FROM admin1_regions) THEN upper(trim(country)) END AS country, count(*) AS n_articles FROM news_articles GROUP BY 1, 2""",
    "region_stems": f"SELECT geojson_key, {_stem_sql('en')} AS en, {_stem_sql('zh')} AS zh, {_stem_sql('zh2')} AS zh2 FROM (SELECT geojson_key, concat_ws(' ', admin1_name_ascii, lower(admin1_type)) AS en, admin1_name_zh || '自治区' AS zh, admin1_name_zh || '省' AS zh2 FROM admin1_regions)",
    "region_variants": f"""WITH n AS (SELECT geojson_key, trim(unnest([admin1_name, admin1_name_ascii, admin1_name_zh, admin1_name_zh || '地区'] || coalesce(aliases, []))) AS name FROM admin1_regions),
        v AS (SELECT geojson_key, unnest([name, regexp_replace(name, '{_B}', ' ', 'g'), trim({_stem_sql('name')})]) AS variant FROM n WHERE name IS NOT NULL) SELECT DISTINCT geojson_key, variant FROM v WHERE variant IS NOT NULL AND variant <> ''""",
    "page_metas": "SELECT article_id, trim(regexp_replace(coalesce(title, '-'), '[\"''<>&]', '', 'g')) AS title, coalesce(category, 'none') AS section, NULL::VARCHAR AS absent FROM news_articles",
    "web_addresses": """SELECT article_id, CASE WHEN regexp_matches(url, '^https?://') THEN split_part(url, '#', 1) ELSE '' END AS web_url, coalesce(root || path, '') AS web_path, 'https:' || bare AS web_bare,
        CASE WHEN regexp_matches(url, '^https?://') THEN split_part(url, '#', 1) ELSE '' END AS web_part, coalesce(root || path, '') AS article_path, CASE WHEN regexp_matches(url, '^https?://') THEN url || '#part' ELSE '' END AS article_part, '' AS web_mail
        FROM (SELECT article_id, trim(url) AS url, nullif(regexp_extract(coalesce(source_url, ''), '^(https?://[^/?#]+)', 1), '') AS root, '/' || regexp_replace(url, '^[a-z]+://[^/]+/', '') AS path, '//' || regexp_replace(url, '^[a-z]+://', '') AS bare FROM news_articles)""",
    "latest_times": "SELECT event_id, greatest(first_seen_at, last_seen_at, newest) AS latest_at FROM news_events LEFT JOIN (SELECT event_id, max(crawled_at) AS newest FROM event_articles JOIN news_articles USING (article_id) GROUP BY event_id) USING (event_id)",
    "day_indexes": "SELECT CAST(floor(s / 86400) AS INT) AS day_no, CAST(greatest(1, ceil((s % 86400) / 3600.0)) AS INT) AS hour_no, count(*) AS n_articles FROM (SELECT CAST(floor(epoch(crawled_at)) AS BIGINT) + 28800 AS s FROM news_articles WHERE crawled_at IS NOT NULL) GROUP BY 1, 2",
    "severities": """SELECT event_id, CAST(CASE k WHEN 0 THEN 95 WHEN 1 THEN 85 WHEN 2 THEN 58 WHEN 3 THEN 72 WHEN 4 THEN greatest(35, least(92, round_even(mag * 4, 0))) WHEN 5 THEN greatest(30, least(90, round_even(mag * 12, 0))) ELSE 40 END AS INT) AS quake,
        CAST(CASE WHEN k <= 1 THEN base ELSE greatest(base, CASE WHEN s >= 2 THEN 96 WHEN s >= 1 THEN 84 ELSE least(72, round_even(55 + s * 10, 0)) END) END AS INT) AS alert,
        CAST(greatest(40, least(95, CASE k WHEN 0 THEN 84 WHEN 1 THEN 76 WHEN 2 THEN 72 ELSE 65 END + CASE WHEN k > 3 THEN least(12, round_even(mag, 0)) ELSE 0 END)) AS INT) AS open_event
        FROM (SELECT event_id, value / 10 AS mag, value / 10 / 5 AS s, event_id % 7 AS k, CASE event_id % 7 WHEN 0 THEN 96 WHEN 1 THEN 84 WHEN 2 THEN 60 ELSE 55 END AS base FROM events)""",
    "place_relevance": """SELECT article_id, CAST(i - 1 AS INT) AS pos, round_even(0.6::DOUBLE * CASE lower(e.source_text_position) WHEN 'title' THEN 1 WHEN 'summary' THEN 0.8 WHEN 'content' THEN 0.6 ELSE 0.5 END::DOUBLE
        + 0.3::DOUBLE * CASE lower(e.type) WHEN 'admin1' THEN 1 WHEN 'city' THEN 0.9 WHEN 'country' THEN 0.85 ELSE 0.8 END::DOUBLE + 0.1::DOUBLE * greatest(0, least(1, coalesce(nullif(e.confidence, 0), 1))), 2) AS relevance
        FROM (SELECT article_id, unnest(geo_entities) AS e, generate_subscripts(geo_entities, 1) AS i FROM news_articles)""",
    "geometry_extents": rf"""WITH g AS (SELECT CAST(article_id AS VARCHAR) AS key, raw_geometry AS g FROM news_articles WHERE raw_geometry IS NOT NULL UNION ALL SELECT geojson_key, geometry FROM admin1_shapes),
        p AS (SELECT key, unnest(regexp_extract_all(g, '\[\s*({_NUM}\s*,\s*{_NUM})', 1)) AS p FROM g), b AS (SELECT key, min(CAST(trim(split_part(p, ',', 1)) AS DOUBLE)) AS west, min(CAST(trim(split_part(p, ',', 2)) AS DOUBLE)) AS south,
        max(CAST(trim(split_part(p, ',', 1)) AS DOUBLE)) AS east, max(CAST(trim(split_part(p, ',', 2)) AS DOUBLE)) AS north FROM p GROUP BY key),
        m AS (SELECT *, CASE WHEN east - west > 180 THEN (west + east + 360) / 2 ELSE (west + east) / 2 END AS x, CASE WHEN east - west > 180 THEN 360 - (east - west) ELSE east - west END AS span FROM b)
        SELECT key, west, south, east, north, round(CASE WHEN x > 180 THEN x - 360 ELSE x END, 6) AS lng, round((south + north) / 2, 6) AS lat, round(least(2.4::DOUBLE, greatest(0.3::DOUBLE, greatest(span, north - south) / 58)), 4) AS altitude FROM m""",
    "merged_metadata": """WITH a AS (SELECT article_id, crawled_at, unnest(json_keys(source_metadata)) AS name, source_metadata FROM news_articles WHERE source_metadata IS NOT NULL), v AS (SELECT article_id, crawled_at, name, source_metadata ->> ('$.' || name) AS value FROM a)
        SELECT event_id, name, arg_max(value, (crawled_at, article_id)) AS value, count(DISTINCT value) AS n_values FROM (SELECT DISTINCT event_id, article_id FROM event_articles) JOIN v USING (article_id) GROUP BY event_id, name""",
    "built_metadata": """SELECT article_id, nullif(trim(geom_type), '') AS geom_type, CAST(severity AS VARCHAR) AS severity, CAST((nullif(trim(geom_type), '') IS NOT NULL)::INT + (nullif(trim(external_id), '') IS NOT NULL)::INT + (severity IS NOT NULL)::INT + (nullif(trim(event_status), '') IS NOT NULL)::INT AS INT) AS n_fields FROM news_articles""",
    "tags_asked": "SELECT article_id FROM news_articles WHERE list_has_any(list_transform(tags, lambda t: lower(trim(t))), ['ai', 'health', 'space'])",
    "entity_countries": """SELECT article_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS region_tags FROM (SELECT article_id, list_filter(list_transform(geo_entities, lambda e: upper(trim(e.country_code))), lambda c: c IS NOT NULL AND c <> '') AS l FROM news_articles WHERE geo_entities IS NOT NULL)""",
}
