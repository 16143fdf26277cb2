"""Readers of feeds and dictionaries: RSS, RDF, Atom, article JSON, GeoJSON, TSV and dictionary JSON.

Every reader takes a path (a file, a folder or a glob) and gives one row per
item with the same columns where the format has them. Schemas are stated, so
nothing is inferred by reading the data twice; unreadable items are dropped,
missing elements are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_XML = "title string, link string, guid string, description string, summary string, content string, pubDate string, date string, published string, updated string, category string"


#: Places of a document in which the list of items may be, in the order they are tried.
LIST_PATHS = ("$.articles", "$.result.data", "$.result.list", "$.idlist[0].newslist", "$.data.list", "$.data")


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def read_rss(spark: SparkSession, path: str, row_tag: str = "item", top: int = 50) -> DataFrame:
    """(title, url, summary, published, category, heat) of RSS 2.0 and RDF items; heat falls with the position.

    Items without title or address are left out; a guid that is an address
    stands in for a missing link.
    """
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(_XML).load(path)
    guid = F.when(F.col("guid").startswith("http"), F.col("guid"))
    items = raw.select(
        _blank(F.col("title")).alias("title"), F.coalesce(_blank(F.col("link")), guid).alias("url"), F.coalesce(_blank(F.col("description")), _blank(F.col("summary")), _blank(F.col("content"))).alias("summary"),
        F.coalesce("pubDate", "date", "published", "updated").alias("published"), _blank(F.col("category")).alias("category"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("order"),
    )
    kept = items.filter("title is not null and url is not null")
    position = F.row_number().over(W.partitionBy("file").orderBy("order"))  # one feed file is one document
    return kept.withColumn("heat", F.greatest(F.lit(1), F.lit(top + 1) - position).cast("int")).drop("file", "order")


_ITEM = "struct<" + _XML.replace(" string", ": string") + ", media: struct<_url: string>, thumbnail: struct<_url: string>>"
_ENTRY = "struct<title: string, id: string, link: array<struct<_href: string, _rel: string>>, summary: string, content: string, published: string, updated: string, thumbnail: struct<_url: string>>"


def rss_items(docs: DataFrame, top: int = 50) -> DataFrame:
    """(title, url, summary, published, category, image, heat) of RSS 2.0 and RDF documents in a column ``value``, any name space.

    Items without title or address are left out; a guid that is an address
    stands in for a missing link; heat falls with the place in the document.
    """
    feed = F.from_xml("value", f"channel struct<item: array<{_ITEM}>>, item array<{_ITEM}>", {"ignoreNamespace": "true"})
    each = docs.select(feed.alias("f")).select(F.posexplode(F.coalesce("f.channel.item", "f.item")).alias("at", "x"))
    guid = F.when(F.col("x.guid").startswith("http"), F.trim("x.guid"))
    out = each.select(
        _blank(F.col("x.title")).alias("title"), F.coalesce(_blank(F.col("x.link")), guid).alias("url"), F.coalesce(*[_blank(F.col(f"x.{c}")) for c in ("description", "summary", "content")]).alias("summary"),
        F.coalesce(*[_blank(F.col(f"x.{c}")) for c in ("pubDate", "date", "published", "updated")]).alias("published"), _blank(F.col("x.category")).alias("category"), F.coalesce("x.media._url", "x.thumbnail._url").alias("image"),
        F.greatest(F.lit(1), F.lit(top) - F.col("at")).alias("heat"),
    )
    return out.filter("title is not null and url is not null")


def atom_items(docs: DataFrame) -> DataFrame:
    """(title, url, summary, published, image) of Atom documents in a column ``value``; the alternate link counts, its address an attribute."""
    feed = F.from_xml("value", f"entry array<{_ENTRY}>", {"ignoreNamespace": "true"})
    each = docs.select(feed.alias("f")).select(F.explode("f.entry").alias("x"))
    alternate = F.get(F.filter("x.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    out = each.select(
        _blank(F.col("x.title")).alias("title"), F.coalesce(_blank(alternate), F.when(F.col("x.id").startswith("http"), F.col("x.id"))).alias("url"), F.coalesce(_blank(F.col("x.summary")), _blank(F.col("x.content"))).alias("summary"),
        F.coalesce(_blank(F.col("x.published")), _blank(F.col("x.updated"))).alias("published"), F.col("x.thumbnail._url").alias("image"),
    )
    return out.filter("title is not null and url is not null")


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, summary, published) of Atom entries."""
    schema = "title string, id string, link array<struct<_href: string, _rel: string>>, summary string, content string, published string, updated string"
    raw = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema(schema).load(path)
    alternate = F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    out = raw.select(_blank(F.col("title")).alias("title"), F.coalesce(alternate, F.when(F.col("id").startswith("http"), F.col("id"))).alias("url"), F.coalesce(_blank(F.col("summary")), _blank(F.col("content"))).alias("summary"), F.coalesce("published", "updated").alias("published"))
    return out.filter("title is not null and url is not null")


def read_json_items(spark: SparkSession, path: str, list_paths: tuple[str, ...] = LIST_PATHS) -> DataFrame:
    """(title, url, domain, published) of items of a JSON document, the first list found; a function call around it is taken off. Each address once a document."""
    return json_items(spark.read.option("wholetext", "true").text(path).select(F.col("value").alias("doc")), list_paths)


def json_items(docs: DataFrame, list_paths: tuple[str, ...] = LIST_PATHS) -> DataFrame:
    """The same of documents in a column ``doc``."""
    text = docs.select(F.regexp_replace("doc", r"(?s)^\s*[\w$.]+\s*\((.*)\)\s*;?\s*$", "$1").alias("doc"))
    text = text.withColumn("_doc", F.xxhash64("doc"))
    lists = F.coalesce(*[F.when(F.get_json_object("doc", p).startswith("["), F.get_json_object("doc", p)) for p in list_paths])
    item = "array<struct<title: string, url: string, link: string, domain: string, sourcecountry: string, seendate: string, ctime: string>>"
    each = text.select("_doc", F.explode(F.from_json(lists, item)).alias("x"))
    out = each.select("_doc", _blank(F.col("x.title")).alias("title"), F.coalesce(_blank(F.col("x.url")), _blank(F.col("x.link"))).alias("url"), F.concat_ws(" | ", "x.domain", "x.sourcecountry").alias("summary"), F.coalesce(_compact_time(F.col("x.seendate")), F.col("x.seendate"), F.col("x.ctime")).alias("published"))
    return out.filter("title is not null and url is not null").dropDuplicates(["_doc", "url"]).drop("_doc")


def _compact_time(text: Column) -> Column:
    """'20260301T120000Z' as ISO text; null for other forms."""
    p = F.regexp_extract_all(text, F.lit(r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$"), F.lit(0))
    return F.when(F.size(p) > 0, F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$", "$1-$2-$3T$4:$5:$6Z"))


def unwrapped(url: Column) -> Column:
    """Address behind an aggregator's redirect: what follows the first '/articles/' is host and path; other addresses stay."""
    return F.when(F.contains(url, F.lit("/articles/")), F.concat(F.lit("https://"), F.regexp_extract(url, r"^.*?/articles/(.*)$", 1))).otherwise(url)


def aggregated(items: DataFrame, publishers: list[str] | None = None, group: str | None = None) -> DataFrame:
    """Items of an aggregator or search feed: addresses unwrapped, a publisher's name off the end of titles, each address once a response (``group``)."""
    names = "|".join(rf"\Q{p}\E" for p in publishers or [])
    title = F.trim(F.regexp_replace("title", rf"\s+-\s+(?:{names})$", "")) if names else F.col("title")
    out = items.withColumn("url", unwrapped(F.col("url"))).withColumn("title", title)
    return out.dropDuplicates([*([group] if group else []), "url"])


def read_hot_list(spark: SparkSession, path: str, site: str) -> DataFrame:
    """(title, rank, heat, item_hash) of a hot-list document's entries; the title is the word, else the note, and identity is title and site alone."""
    entry = "array<struct<word: string, note: string, num: long>>"
    docs = spark.read.text(path).select(F.from_json(F.get_json_object("value", "$.data.realtime"), entry).alias("d"))
    e = docs.select(F.posexplode("d").alias("rank", "x")).select(F.coalesce(_blank(F.col("x.word")), _blank(F.col("x.note"))).alias("title"), (F.col("rank") + 1).alias("rank"), F.coalesce("x.num", F.lit(0).cast("long")).alias("heat"))
    return e.filter("title is not null").withColumn("item_hash", F.sha2(F.concat_ws("|", "title", F.lit(site)), 256))


def read_video_list(spark: SparkSession, path: str) -> DataFrame:
    """(title, topic, summary, owner, published_at, views, likes, heat) of a video hot list with nested counts."""
    entry = "array<struct<title: string, tname: string, desc: string, owner: struct<name: string>, pubdate: long, stat: struct<view: long, like: long, reply: long, share: long>>>"
    docs = spark.read.text(path).select(F.from_json(F.get_json_object("value", "$.data.list"), entry).alias("d"))
    n = lambda c: F.coalesce(F.col(f"x.stat.{c}"), F.lit(0).cast("long"))
    e = docs.select(F.explode("d").alias("x")).select(
        _blank(F.col("x.title")).alias("title"), F.col("x.tname").alias("topic"), _blank(F.col("x.desc")).alias("summary"), F.col("x.owner.name").alias("owner"), F.timestamp_seconds("x.pubdate").alias("published_at"), n("view").alias("views"), n("like").alias("likes"),
        (n("like") + 2 * n("reply") + 3 * n("share")).alias("heat"),
    )
    return e.filter("title is not null")


def read_admin1_codes(spark: SparkSession, path: str) -> DataFrame:
    """(country_code, admin1_code, name, ascii_name, geonameid) of a tab-separated list whose code is 'country.region'."""
    df = spark.read.csv(path, sep="\t", schema="code string, name string, ascii_name string, geonameid long", quote="", comment="#")
    return df.select(F.substring_index("code", ".", 1).alias("country_code"), F.regexp_extract("code", r"\.(.*)$", 1).alias("admin1_code"), "name", "ascii_name", "geonameid")


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """(iso2, iso3, name, capital, population) of a tab-separated list of countries."""
    schema = "iso2 string, iso3 string, iso_number string, fips string, name string, capital string, area string, population long, continent string"
    return spark.read.csv(path, sep="\t", schema=schema, quote="", comment="#").select("iso2", "iso3", "name", "capital", "population")


def read_alternate_names(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """(geonameid, language, name) of a tab-separated list of other names, of some languages."""
    df = spark.read.csv(path, sep="\t", schema="id long, geonameid long, language string, name string, preferred string", quote="", comment="#")
    return (df.filter(F.col("language").isin(languages)) if languages else df).filter("name is not null").select("geonameid", "language", "name")


def write_region_dictionary(regions: DataFrame, path: str) -> None:
    """Dictionary files, one line a country: its regions as a map of code to region. A country has a bounded number of regions."""
    region = F.struct(*[F.col(c) for c in ("country_code", "admin1_code", "admin1_name", "admin1_name_zh", "aliases", "geojson_key", "lat", "lng")])
    one = regions.filter("admin1_code is not null and country_code is not null").groupBy("country_code", "admin1_code").agg(F.max("country_name").alias("country_name"), F.min(F.struct("geojson_key", region.alias("r"))).alias("m"))
    docs = one.groupBy("country_code").agg(F.max("country_name").alias("country_name"), F.count("*").alias("total_count"), F.map_from_entries(F.collect_list(F.struct("admin1_code", "m.r"))).alias("admin1_regions"))
    docs.select(F.to_json(F.struct("country_code", "country_name", "total_count", "admin1_regions")).alias("value")).write.mode("overwrite").text(path)


def fetch_log(responses: DataFrame) -> DataFrame:
    """(feed_code, n_fetches, n_failed, last_error, last_failed_at) from (feed_code, at, status, error): what went wrong by feed."""
    failed = F.col("error").isNotNull() | (F.coalesce("status", F.lit(0)) >= 400)
    return responses.groupBy("feed_code").agg(
        F.count("*").alias("n_fetches"), F.count_if(failed).alias("n_failed"), F.max_by(F.coalesce("error", F.concat(F.lit("HTTP "), "status")), F.when(failed, F.struct("at", "status"))).alias("last_error"), F.max(F.when(failed, F.col("at"))).alias("last_failed_at"),
    )


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, properties, lng, lat, bbox) of the features of GeoJSON collections; properties stay JSON text."""
    return geojson_features(spark.read.option("wholetext", "true").text(path))


def geojson_features(docs: DataFrame) -> DataFrame:
    """The same of documents in a column ``value``."""
    schema = "type string, features array<struct<id: string, bbox: array<double>, geometry: struct<type: string, coordinates: string>, properties: string>>"
    docs = docs.select(F.from_json("value", schema).alias("d"))
    each = docs.select(F.explode("d.features").alias("f"))
    point = F.when(F.col("f.geometry.type") == "Point", F.from_json("f.geometry.coordinates", "array<double>"))
    return each.select("f.id", "f.properties", F.get(point, F.lit(0)).alias("lng"), F.get(point, F.lit(1)).alias("lat"), F.col("f.geometry.type").alias("geom_type"), "f.bbox")


def read_quakes(spark: SparkSession, path: str) -> DataFrame:
    """(external_id, title, place, magnitude, event_time, updated_at, url, lat, lng) of earthquake features."""
    return quakes(read_geojson(spark, path))


def quakes(features: DataFrame) -> DataFrame:
    """The same of features that are read already."""
    p = lambda k: F.get_json_object("properties", f"$.{k}")
    ms = lambda k: F.timestamp_millis(p(k).try_cast("long"))
    return features.select(F.col("id").alias("external_id"), p("title").alias("title"), p("place").alias("place"), p("mag").try_cast("double").alias("magnitude"), ms("time").alias("event_time"), ms("updated").alias("updated_at"), p("url").alias("url"), "lat", "lng")


def read_open_events(spark: SparkSession, path: str) -> DataFrame:
    """(external_id, title, category, closed, lat, lng, at) of open events; the latest geometry counts."""
    return open_events(spark.read.option("wholetext", "true").text(path))


def open_events(docs: DataFrame) -> DataFrame:
    """The same of documents in a column ``value``."""
    geometry = "array<struct<date: string, type: string, coordinates: string>>"
    schema = f"events array<struct<id: string, title: string, closed: string, categories: array<struct<id: string, title: string>>, geometry: {geometry}>>"
    each = docs.select(F.explode(F.from_json("value", schema).getField("events")).alias("e"))
    last = each.select("e", F.array_max(F.transform("e.geometry", lambda g: F.struct(g.date.alias("date"), g.type.alias("type"), g.coordinates.alias("coordinates")))).alias("g"))
    point = F.when(F.col("g.type") == "Point", F.from_json("g.coordinates", "array<double>"))
    return last.select(F.col("e.id").alias("external_id"), F.col("e.title").alias("title"), F.get(F.col("e.categories"), F.lit(0)).title.alias("category"), F.col("e.closed").alias("closed"), F.get(point, F.lit(1)).alias("lat"), F.get(point, F.lit(0)).alias("lng"), F.col("g.date").alias("at"))


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """(geonameid, name, ascii_name, lat, lng, feature_code, country_code, admin1_code, population) of a tab-separated gazetteer."""
    schema = (
        "geonameid long, name string, ascii_name string, alternate_names string, lat double, lng double, feature_class string, feature_code string, country_code string, cc2 string,"
        " admin1_code string, admin2_code string, admin3_code string, admin4_code string, population long, elevation string, dem string, timezone string, modified string"
    )
    df = spark.read.csv(path, sep="\t", schema=schema, quote="", comment="#")
    return df.select("geonameid", "name", "ascii_name", "lat", "lng", "feature_code", "country_code", "admin1_code", "population")


def region_centres(cities: DataFrame) -> DataFrame:
    """Coordinates of the most populous city of each first-level region."""
    best = F.max(F.struct(F.coalesce("population", F.lit(0)).alias("population"), (-F.col("geonameid")).alias("n"), "lat", "lng")).alias("b")
    return cities.filter("admin1_code is not null").groupBy("country_code", "admin1_code").agg(best).select("country_code", "admin1_code", F.col("b.lat").alias("lat"), F.col("b.lng").alias("lng"))


def read_region_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Rows of dictionary files whose ``admin1_regions`` is a map of code to region."""
    return region_dictionary(spark.read.option("wholetext", "true").text(path))


def region_dictionary(docs: DataFrame) -> DataFrame:
    """The same of documents in a column ``value``."""
    region = "struct<country_code: string, admin1_code: string, admin1_name: string, admin1_name_zh: string, aliases: array<string>, geojson_key: string, lat: double, lng: double>"
    docs = docs.select(F.from_json("value", f"country_code string, country_name string, admin1_regions map<string, {region}>").alias("d"))
    return docs.select("d.country_name", F.explode("d.admin1_regions").alias("code", "r")).select("country_name", "code", "r.*")


def page_links(pages: DataFrame, html_col: str = "html", least_text: int = 8, hosts: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """(url, text) of the absolute https links of pages whose text is long enough, of some hosts and of a pattern where given, each once."""
    tags = pages.select(F.explode(F.regexp_extract_all(html_col, F.lit(r"(?is)(<a\s[^>]*href=[\"'][^\"']+[\"'][^>]*>.*?</a>)"), F.lit(1))).alias("a"))
    out = tags.select(F.regexp_extract("a", r"(?is)href=[\"']([^\"']+)[\"']", 1).alias("url"), F.trim(F.regexp_replace(F.regexp_replace("a", r"<[^>]+>", ""), r"\s+", " ")).alias("text"))
    out = out.filter(F.col("url").startswith("https://") & (F.length("text") >= least_text))
    if hosts:
        out = out.filter(F.lower(F.regexp_extract("url", r"^https://([^/?#]+)", 1)).isin([h.lower() for h in hosts]))
    if pattern:
        out = out.filter(F.col("url").rlike(pattern))
    return out.groupBy("url").agg(F.min("text").alias("text"))


def split_features(spark: SparkSession, geojson_path: str, out_path: str, key: str) -> None:
    """Features written in folders by one of their properties, for partition pruning later."""
    df = read_geojson(spark, geojson_path).withColumn(key, F.coalesce(F.get_json_object("properties", f"$.{key}"), F.lit("unknown")))
    df.write.mode("overwrite").partitionBy(key).parquet(out_path)
