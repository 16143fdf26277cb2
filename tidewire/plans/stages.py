"""Queries of the intake stages, look-ups, joins, orders and reports around articles, events and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import matching as M
from ..operators.timestamps import normalise_instants
from ..session import table
from .articles import SQL as _ARTICLE_SQL
from .common import LINKS_SQL, NOW, WITH_PLACES, article_places, event_places, links

TIMES = ["published_at", "event_time", "source_updated_at"]


def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "news_articles")


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "news_events")


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an article: its three times as instants."""
    t = normalise_instants(_a(spark, sf_dir), table(spark, sf_dir, "source_clocks"), TIMES)
    return t.groupBy("article_id").agg(*[F.max(F.when(F.col("field") == f, F.timestamp_millis("utc_ms"))).alias(f"{f}_utc") for f in TIMES])


def valid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event reports with a time and an identity, their status, scales and hash in order; others with the reason they are refused."""
    a = _a(spark, sf_dir).filter("lower(trim(source_class)) = 'event'").select("article_id", "title", "url", "canonical_url", "external_id", "event_status", "confidence", "severity", "hash")
    j = a.join(_instants(spark, sf_dir), "article_id", "left")
    at = F.coalesce("event_time_utc", "published_at_utc")
    external, canonical = F.nullif(F.trim("external_id"), F.lit("")), F.nullif(F.trim(F.coalesce(F.nullif("canonical_url", F.lit("")), "url")), F.lit(""))
    reason = F.when(at.isNull(), "no time").when(external.isNull() & canonical.isNull(), "no identity")
    status = F.when(F.lower(F.trim("event_status")).isin("open", "active"), "open").otherwise("closed")
    basis = F.coalesce(external, F.concat_ws("|", canonical, at.cast("string"), F.coalesce("title", F.lit(""))))
    return j.select("article_id", reason.alias("refused"), at.alias("event_at"), status.alias("event_status"), V.percent_or(F.col("confidence"), 85).alias("confidence"), V.percent_or(F.col("severity"), 25).alias("severity"), F.coalesce(F.nullif("hash", F.lit("")), F.sha2(basis, 256)).alias("hash"))


def timely_items(spark: SparkSession, sf_dir: str, now: str = NOW) -> DataFrame:
    """Whether each item is in time: open events always, closed ones by their last change, news by its time; news without a time may pass."""
    a = _a(spark, sf_dir).select("article_id", F.coalesce(F.lower(F.trim("source_class")), F.lit("news")).alias("c"), F.coalesce("freshness_sla_hours", F.lit(24)).alias("h"), F.lower(F.trim(F.coalesce("event_status", F.lit("closed")))).alias("s"))
    j = a.join(_instants(spark, sf_dir), "article_id", "left")
    event = F.col("c") == "event"
    signal = F.when(event, F.coalesce("event_time_utc", "published_at_utc")).otherwise(F.col("published_at_utc"))
    last = F.when(event, F.coalesce("source_updated_at_utc", signal)).otherwise(signal)
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(last)
    fate = F.when(signal.isNull(), F.when(event, "no time").otherwise("kept without time")).when(event & (F.col("s") == "open"), "open").when(age > F.col("h") * 3600, "stale").otherwise("kept")
    return j.select("article_id", fate.alias("fate"))


def stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as they are stored: fields cut to their columns, codes in small letters, scales and status in order, defaults filled."""
    cut = lambda c, n: F.substring(F.col(c), 1, n).alias(c)
    return _a(spark, sf_dir).select(
        "article_id", cut("title", 500), F.substring(V.normal_url(F.col("url")), 1, 2000).alias("article_url"), cut("source_name", 100), F.substring(F.lower(F.trim("source_code")), 1, 50).alias("source_code"), F.substring("canonical_url", 1, 2000).alias("canonical_url"),
        F.coalesce("language", F.lit("zh")).alias("language"), F.coalesce("country", F.lit("CN")).alias("country"), F.coalesce("heat_score", F.lit(0)).alias("heat_score"), V.percent_scale(F.col("confidence")).alias("confidence"),
        V.event_status(F.col("event_status"), F.col("source_class")).alias("event_status"), F.size(V.normal_tags(F.col("tags"))).alias("n_tags"),
    )


def normal_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items normalised: name, title, summary, address, heat and tags."""
    return _a(spark, sf_dir).select(
        "article_id", T.normal_source(F.col("source_name")).alias("source_name"), T.clean_title(F.col("title")).alias("title"), T.plain_html(F.col("summary")).alias("summary"), V.web_address(F.col("url"), F.col("source_url")).alias("url"),
        F.greatest(F.lit(0), F.coalesce("heat_score", F.lit(0))).alias("heat"), F.array_join(T.listed(F.array_join("tags", ",")), "|").alias("tags"),
    )


def crawl_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl time of each article, the moment of the query where it has none, by usual source name."""
    a = _a(spark, sf_dir).select(T.normal_source(F.col("source_name")).alias("source_name"), F.coalesce("crawled_at", F.lit(NOW).cast("timestamp_ntz")).alias("at"))
    return a.groupBy("source_name").agg(F.count("*").alias("n_articles"), F.max("at").alias("last_at"))


def stored_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each article the first stored one with the same hash, address, normal address, canonical address or external id; an event's id holds within its source."""
    x = F.nullif("external_id", F.lit(""))
    external = F.when(F.lower("source_class") == "event", F.concat_ws("|", F.lit("event"), F.lower("source_code"), x)).otherwise(F.concat(F.lit("any|"), x))
    a = _a(spark, sf_dir).select(F.col("article_id").alias("id"), "hash", "url", V.normal_url(F.col("url")).alias("normal_url"), "canonical_url", F.when(x.isNotNull(), external).alias("external_id"))
    keys = ["hash", "url", "normal_url", "canonical_url", "external_id"]
    stored = None  # one stored row per key value: the first; a key held by a third of all rows stays one row
    for k in keys:
        first = a.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias("id")).select("id", *[F.col(c) if c == k else F.lit(None).cast("string").alias(c) for c in keys])
        stored = first if stored is None else stored.unionByName(first)
    found = M.any_key_matches(a, stored, {k: (F.col(k), F.col(k)) for k in keys})
    return found.filter("id < in_id").select(F.col("in_id").alias("article_id"), F.col("id").alias("first_id"), "kind")


def events_at_level(spark: SparkSession, sf_dir: str, level: str = "admin1", categories: tuple[str, ...] = ("disaster", "health")) -> DataFrame:
    """Events of a level and of some categories."""
    return _e(spark, sf_dir).filter((F.col("event_level") == level) & F.col("category").isin(*categories)).select("event_id", "category", "heat_score")


def seen_or_begun(spark: SparkSession, sf_dir: str, hours: int = 24 * 60) -> DataFrame:
    """Events that were first or last seen within some hours before the moment of the query."""
    since = F.expr(f"timestamp'{NOW}' - interval {hours} hours")
    return _e(spark, sf_dir).filter((F.col("first_seen_at") >= since) | (F.col("last_seen_at") >= since)).select("event_id", "last_seen_at")


def article_by_id(spark: SparkSession, sf_dir: str, article_id: int = 17) -> DataFrame:
    """One article by its key; no row where there is none."""
    return _a(spark, sf_dir).filter(F.col("article_id") == article_id).select("article_id", "title", "url", "source_code", "crawled_at")


def source_list(spark: SparkSession, sf_dir: str, tiers: tuple[str, ...] = ("official", "authoritative")) -> DataFrame:
    """Active sources of some tiers in their order: level of trust, hours of freshness, code."""
    w = W.partitionBy(F.lit(1)).orderBy("source_tier_level", "freshness_sla_hours", "code")  # the registry is small
    return table(spark, sf_dir, "news_sources").filter(F.col("is_active") & F.col("source_tier").isin(*tiers)).select("code", "source_tier", F.row_number().over(w).alias("rank"))


def topic_articles(spark: SparkSession, sf_dir: str, topic: str = "ai") -> DataFrame:
    """Articles that carry a topic among their tags, spelling aside."""
    return _a(spark, sf_dir).filter(F.exists("tags", lambda t: F.lower(F.trim(t)) == topic)).select("article_id")


def active_crawls(spark: SparkSession, sf_dir: str, now: str = "2024-01-30 12:00:00", minutes: int = 240) -> DataFrame:
    """Users of the event stream as crawls: active while their last row is a view, or within some minutes of it."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    active = (F.col("m.event_type") == "view") | (F.expr(f"timestampdiff(SECOND, m.ts, timestamp_ntz'{now}')") <= minutes * 60)
    return last.select("user_id", F.col("m.ts").alias("last_at"), active.alias("is_active"))


def job_page(spark: SparkSession, sf_dir: str, page: int = 3, size: int = 50) -> DataFrame:
    """One page of the run history, latest first."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).offset((page - 1) * size).limit(size)


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source and its language with what came in by both, zero where nothing did."""
    health = _a(spark, sf_dir).groupBy(F.lower("source_code").alias("code"), "language").agg(F.count("*").alias("n_articles"), F.count_if(F.col("content").isNull()).alias("n_empty"), F.max("crawled_at").alias("last_at"))
    return table(spark, sf_dir, "news_sources").select("code", "language", "name").join(health, ["code", "language"], "left").fillna(0, ["n_articles", "n_empty"])


def event_primary_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its primary article and that article's first place, as far as they exist."""
    primary = table(spark, sf_dir, "event_articles").filter("is_primary").groupBy("event_id").agg(F.min("article_id").alias("article_id"))
    first = article_places(spark, sf_dir).filter("pos = 0").select("article_id", "geo_key", "precision_level")
    return _e(spark, sf_dir).select("event_id", "event_level").join(primary, "event_id", "left").join(first, "article_id", "left").select("event_id", "event_level", "article_id", "geo_key", "precision_level")


def primary_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First article of each event in the order of its list: hottest, latest crawled, smallest id."""
    a = _a(spark, sf_dir).select("article_id", F.coalesce("heat_score", F.lit(-1)).alias("h"), "crawled_at")
    return links(spark, sf_dir).join(a, "article_id").groupBy("event_id").agg(F.max_by("article_id", F.struct("h", "crawled_at", -F.col("article_id"))).alias("article_id"))


def source_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with its latest article and the last one that arrived, which need not be the latest."""
    a = _a(spark, sf_dir).filter("source_code is not null").groupBy(F.lower("source_code").alias("code")).agg(F.max_by("article_id", F.struct("crawled_at", "article_id")).alias("latest_id"), F.max("article_id").alias("last_id"), F.max("crawled_at").alias("cursor_at"))
    return table(spark, sf_dir, "news_sources").select("code").join(a, "code", "left")


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.expr(f"timestampdiff(SECOND, crawled_at, timestamp_ntz'{NOW}')")
    stats = _a(spark, sf_dir).filter("source_code is not null").groupBy(F.lower("source_code").alias("code")).agg(
        F.count("*").alias("n_articles"), F.count_if((age >= 0) & (age <= 86400)).alias("n_24h"), F.count_if((age >= 0) & (age <= 259200)).alias("n_72h"), F.max("crawled_at").alias("last_at")
    )
    clocks = table(spark, sf_dir, "source_clocks").select(F.lower("source_code").alias("code"), "tz_name")
    s = table(spark, sf_dir, "news_sources").select("code", "name", "is_active")
    return clocks.join(s, "code", "left").join(stats, "code", "left").fillna(0, ["n_articles", "n_24h", "n_72h"])


def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configured source with its registration and what came in of late."""
    return _audit(spark, sf_dir).select("code", "tz_name", F.col("name").isNotNull().alias("is_registered"), "is_active", "n_articles", "n_24h", "n_72h", "last_at")


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the audit of all sources."""
    return _audit(spark, sf_dir).agg(F.count("*").alias("n_configured"), F.count_if(F.col("name").isNotNull()).alias("n_registered"), F.count_if("is_active").alias("n_active"), F.count_if(F.col("n_24h") > 0).alias("n_with_24h"), F.count_if(F.col("n_articles") > 0).alias("n_with_articles"))


def global_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest crawl of all and minutes since, negative for times to come."""
    last = _a(spark, sf_dir).agg(F.max("crawled_at").alias("last_at"), F.count("*").alias("n_articles"))
    return last.withColumn("age_minutes", F.floor(F.expr(f"timestampdiff(SECOND, last_at, timestamp_ntz'{NOW}')") / 60).cast("long"))


def place_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of places by precision, kind and position in the text, and of events by level."""
    e = _a(spark, sf_dir).select(F.explode("geo_entities").alias("e"))
    facets = e.select(F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.coalesce(c, F.lit("UNKNOWN")).alias("value")) for n, c in (("precision", F.col("e.precision_level")), ("kind", F.col("e.type")), ("position", F.col("e.source_text_position")))])).alias("x")).select("x.*")
    levels = _e(spark, sf_dir).select(F.lit("level").alias("facet"), F.coalesce("event_level", F.lit("UNKNOWN")).alias("value"))
    return facets.unionByName(levels).groupBy("facet", "value").agg(F.count("*").alias("n"))


def feed_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each feed with the shares of stale and of empty items."""
    late = F.expr(f"timestampdiff(SECOND, crawled_at, timestamp_ntz'{NOW}')") > 90 * 86400
    f = _a(spark, sf_dir).select(F.get_json_object("source_metadata", "$.feed_code").alias("feed_code"), late.alias("late"), F.col("content").isNull().alias("empty")).filter("feed_code is not null")
    g = f.groupBy("feed_code").agg(F.count("*").alias("n_items"), F.count_if("late").alias("n_stale"), F.count_if("empty").alias("n_empty"))
    return g.withColumns({"stale_ratio": V.ratio(F.col("n_stale"), F.col("n_items")), "empty_ratio": V.ratio(F.col("n_empty"), F.col("n_items"))})


def city_counts(spark: SparkSession, sf_dir: str, top: int = 10) -> DataFrame:
    """Ten countries of most cities named."""
    c = article_places(spark, sf_dir).filter("precision_level = 'CITY' and country_code is not null").groupBy("country_code").agg(F.count_distinct("geo_key").alias("n_cities"))
    return c.orderBy(F.desc("n_cities"), "country_code").limit(top)


def capital_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most named city of each country, in place of its capital, with its position where known; of equals the last key."""
    c = article_places(spark, sf_dir).filter("precision_level = 'CITY' and country_code is not null").groupBy("country_code", "geo_key").agg(F.count("*").alias("n"), F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    best = c.groupBy("country_code").agg(F.max(F.struct("n", "geo_key", "lat", "lng")).alias("b"))
    return best.select("country_code", "b.geo_key", "b.lat", "b.lng")


def region_heat_with(spark: SparkSession, sf_dir: str, country: str = "QX", joined: str = "QM", top: int = 12) -> DataFrame:
    """Regions of a country by heat, with another country as one more row among them, cut to the hottest."""
    places = event_places(spark, sf_dir).filter(F.col("country_code").isin(country, joined)).select("event_id", "country_code", "admin1_code", "admin1_name")
    heat = places.join(_e(spark, sf_dir).select("event_id", F.coalesce("heat_score", F.lit(0)).alias("h")), "event_id")
    own = heat.filter((F.col("country_code") == country) & F.col("admin1_code").isNotNull()).select("event_id", "admin1_code", "h").distinct().groupBy("admin1_code").agg(F.sum("h").alias("heat_total"), F.count("*").alias("n_events"))
    other = heat.filter(F.col("country_code") == joined).select("event_id", "h").distinct().agg(F.sum("h").alias("heat_total"), F.count("*").alias("n_events")).select(F.lit(joined).alias("admin1_code"), "heat_total", "n_events").filter("n_events > 0")
    return own.unionByName(other).orderBy(F.desc("heat_total"), "admin1_code").limit(top)


def analytics_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in the order of the report: most events, most articles, name."""
    a = _a(spark, sf_dir).select("article_id", F.lower("source_code").alias("code"))
    n = a.groupBy("code").agg(F.count("*").alias("n_articles"))
    ev = links(spark, sf_dir).join(a, "article_id").select("code", "event_id").distinct().groupBy("code").agg(F.count("*").alias("n_events"))
    s = table(spark, sf_dir, "news_sources").select("code", "name").join(n, "code", "left").join(ev, "code", "left").fillna(0, ["n_articles", "n_events"])
    w = W.partitionBy(F.lit(1)).orderBy(F.desc("n_events"), F.desc("n_articles"), F.lower("name"), "code")  # the registry is small
    return s.select("code", "n_events", "n_articles", F.row_number().over(w).alias("rank"))


def feed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds by source, best rank and name."""
    f = _a(spark, sf_dir).select(F.lower("source_code").alias("code"), F.get_json_object("source_metadata", "$.feed_code").alias("feed_code"), F.get_json_object("source_metadata", "$.rank").try_cast("int").alias("rank")).filter("feed_code is not null and code is not null")
    g = f.groupBy("code", "feed_code").agg(F.min(F.coalesce("rank", F.lit(100))).alias("priority"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("code").orderBy("priority", "feed_code")))


def registry_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync of the registry with the latest article of each source would do, field by field."""
    a = _a(spark, sf_dir).filter("source_code is not null").groupBy(F.lower("source_code").alias("code")).agg(F.max(F.struct("crawled_at", "article_id", F.col("source_name").alias("name"), "language", "source_class")).alias("x"))
    j = table(spark, sf_dir, "news_sources").select("code", "name", "language", "source_class").join(a, "code", "full")
    changed = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"x.{c}")), F.lit(c)) for c in ("name", "language", "source_class")]), lambda c: c.isNotNull())
    action = F.when(F.col("x").isNull(), "unseen").when(F.col("name").isNull(), "create").when(F.size(changed) > 0, "update").otherwise("unchanged")
    return j.select("code", action.alias("action"), F.when(action == "update", F.array_join(changed, "|")).alias("changed"))


def density_cells(spark: SparkSession, sf_dir: str, degrees: float = 5.0) -> DataFrame:
    """Density of mentions: each cell with its own weight and half of its neighbours', around the globe."""
    columns = int(360 / degrees)
    p = event_places(spark, sf_dir).filter("lat is not null and lng is not null").join(_e(spark, sf_dir).select("event_id", F.coalesce("heat_score", F.lit(0)).alias("h")), "event_id")
    cell = lambda c: F.floor(F.col(c) / degrees).cast("int")
    own = p.groupBy(cell("lat").alias("y"), cell("lng").alias("x")).agg(F.sum("h").cast("long").alias("heat"))
    spread = own.select("heat", "y", "x", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dy")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dx"))
    half = columns // 2
    at = spread.select((F.col("y") + F.col("dy")).alias("cell_lat"), (F.pmod(F.col("x") + F.col("dx") + half, F.lit(columns)) - half).alias("cell_lng"), (F.col("heat") * F.when((F.col("dx") == 0) & (F.col("dy") == 0), 2).otherwise(1)).alias("w"))
    return at.groupBy("cell_lat", "cell_lng").agg((F.sum("w") / 2).alias("density"))


def region_hotspots(spark: SparkSession, sf_dir: str, region: str = "QX") -> DataFrame:
    """Rows of one region's panel: each event once, defaults filled, and whether the key is a country's."""
    p = event_places(spark, sf_dir).filter(F.col("country_code") == region)
    one = p.groupBy("event_id").agg(F.min(F.struct(F.coalesce("geo_key", F.lit(region)).alias("geo_key"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))).alias("m"))
    return one.select("event_id", "m.geo_key", "m.confidence", F.when(F.lit(region).rlike("^[A-Z]{2}$"), "country").otherwise("region").alias("geo_type"))


QUERIES = {f.__name__: f for f in [
    valid_events, timely_items, stored_articles, normal_items, crawl_defaults, stored_copies, events_at_level, seen_or_begun, article_by_id, source_list, topic_articles, active_crawls, job_page, source_health,
    event_primary_places, primary_articles, source_checkpoints, source_audit, audit_summary, global_freshness, place_distributions, feed_ratios, city_counts, capital_places, region_heat_with, analytics_order, feed_order,
    registry_sync, density_cells, region_hotspots,
]}

_B = r"[\s\pZ]+"
_PLAIN = f"nullif(trim(regexp_replace(regexp_replace({{}}, '<[^>]+>', ' ', 'g'), '{_B}', ' ', 'g')), '')"
_NAME = "coalesce(CASE trim(source_name) WHEN '新浪' THEN '新浪新闻' WHEN '新浪网' THEN '新浪新闻' WHEN 'reuters' THEN 'Reuters' ELSE nullif(trim(source_name), '') END, 'Unknown')"
_AUDIT = f"""a AS (SELECT lower(source_code) AS code, crawled_at, floor(epoch(TIMESTAMP '{NOW}') - epoch(crawled_at)) AS age FROM news_articles WHERE source_code IS NOT NULL),
s AS (SELECT code, count(*) AS n_articles, count(*) FILTER (age BETWEEN 0 AND 86400) AS n_24h, count(*) FILTER (age BETWEEN 0 AND 259200) AS n_72h, max(crawled_at) AS last_at FROM a GROUP BY code),
audit AS (SELECT lower(c.source_code) AS code, tz_name, name, is_active, coalesce(n_articles, 0) AS n_articles, coalesce(n_24h, 0) AS n_24h, coalesce(n_72h, 0) AS n_72h, last_at FROM source_clocks c LEFT JOIN news_sources n ON n.code = lower(c.source_code) LEFT JOIN s ON s.code = lower(c.source_code))"""
_P = WITH_PLACES.rstrip()
SQL = {
    "stored_articles": f"""WITH u AS ({_ARTICLE_SQL['normal_urls']}) SELECT a.article_id, substr(title, 1, 500) AS title, substr(u.url, 1, 2000) AS article_url, substr(source_name, 1, 100) AS source_name, substr(lower(trim(source_code)), 1, 50) AS source_code, substr(canonical_url, 1, 2000) AS canonical_url,
        coalesce(language, 'zh') AS language, coalesce(country, 'CN') AS country, coalesce(heat_score, 0) AS heat_score, CASE WHEN confidence IS NOT NULL THEN greatest(0, least(100, CAST(round_even(CASE WHEN confidence <= 1 THEN confidence * 100 ELSE confidence END, 0) AS INT))) END AS confidence,
        CASE WHEN lower(trim(source_class)) = 'event' AND lower(trim(event_status)) IN ('open', 'active', 'ongoing') THEN 'open' ELSE 'closed' END AS event_status, CASE WHEN tags IS NULL THEN NULL ELSE CAST(least(20, len(list_distinct(list_filter(list_transform(tags, lambda t: lower(trim(t))), lambda t: t <> '')))) AS INT) END AS n_tags
        FROM news_articles a JOIN u ON u.article_id = a.article_id""",
    "normal_items": f"""SELECT article_id, {_NAME} AS source_name, nullif(trim(regexp_replace(regexp_replace({_PLAIN.format('title')}, '{T.SITE_SUFFIX}', ''), '[-_—|]\\s*\\d+$', '')), '') AS title, {_PLAIN.format('summary')} AS summary,
        CASE WHEN regexp_matches(trim(url), '^https?://') THEN split_part(trim(url), '#', 1) ELSE '' END AS url, greatest(0, coalesce(heat_score, 0)) AS heat, array_to_string(list_filter(list_transform(string_split(coalesce(array_to_string(tags, ','), ''), ','), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags FROM news_articles""",
    "crawl_defaults": f"SELECT {_NAME} AS source_name, count(*) AS n_articles, max(coalesce(crawled_at, TIMESTAMP '{NOW}')) AS last_at FROM news_articles GROUP BY 1",
    "stored_copies": f"""WITH u AS ({_ARTICLE_SQL['normal_urls']}), a AS (SELECT n.article_id, nullif(hash, '') AS k1, nullif(n.url, '') AS k2, nullif(u.url, '') AS k3, nullif(canonical_url, '') AS k4, CASE WHEN external_id <> '' THEN CASE WHEN lower(source_class) = 'event' THEN concat_ws('|', 'event', lower(source_code), external_id) ELSE 'any|' || external_id END END AS k5 FROM news_articles n JOIN u ON u.article_id = n.article_id),
        m AS (SELECT article_id, """ + ", ".join(f"CASE WHEN k{i} IS NOT NULL THEN min(article_id) OVER (PARTITION BY k{i}) END AS m{i}" for i in range(1, 6)) + """ FROM a)
        SELECT article_id, coalesce(m1, m2, m3, m4, m5) AS first_id, CASE WHEN m1 IS NOT NULL THEN 'hash' WHEN m2 IS NOT NULL THEN 'url' WHEN m3 IS NOT NULL THEN 'normal_url' WHEN m4 IS NOT NULL THEN 'canonical_url' ELSE 'external_id' END AS kind FROM m WHERE coalesce(m1, m2, m3, m4, m5) < article_id""",
    "events_at_level": "SELECT event_id, category, heat_score FROM news_events WHERE event_level = 'admin1' AND category IN ('disaster', 'health')",
    "seen_or_begun": f"SELECT event_id, last_seen_at FROM news_events WHERE first_seen_at >= TIMESTAMP '{NOW}' - INTERVAL 1440 HOUR OR last_seen_at >= TIMESTAMP '{NOW}' - INTERVAL 1440 HOUR",
    "article_by_id": "SELECT article_id, title, url, source_code, crawled_at FROM news_articles WHERE article_id = 17",
    "source_list": "SELECT code, source_tier, CAST(row_number() OVER (ORDER BY source_tier_level, freshness_sla_hours, code) AS INT) AS rank FROM news_sources WHERE is_active AND source_tier IN ('official', 'authoritative')",
    "topic_articles": "SELECT article_id FROM news_articles WHERE list_contains(list_transform(tags, lambda t: lower(trim(t))), 'ai')",
    "active_crawls": "SELECT user_id, last_at, kind = 'view' OR epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(last_at) < 14401 AS is_active FROM (SELECT user_id, max(ts) AS last_at, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id)",
    "job_page": "SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100",
    "source_health": "SELECT s.code, s.language, name, coalesce(n_articles, 0) AS n_articles, coalesce(n_empty, 0) AS n_empty, last_at FROM news_sources s LEFT JOIN (SELECT lower(source_code) AS code, language, count(*) AS n_articles, count(*) FILTER (content IS NULL) AS n_empty, max(crawled_at) AS last_at FROM news_articles GROUP BY ALL) h ON h.code = s.code AND h.language = s.language",
    "event_primary_places": "SELECT event_id, event_level, p.article_id, geo_key, precision_level FROM news_events LEFT JOIN (SELECT event_id, min(article_id) AS article_id FROM event_articles WHERE is_primary GROUP BY event_id) p USING (event_id) LEFT JOIN (SELECT article_id, geo_entities[1].geo_key AS geo_key, geo_entities[1].precision_level AS precision_level FROM news_articles) g ON g.article_id = p.article_id",
    "primary_articles": f"SELECT event_id, article_id FROM ({LINKS_SQL}) JOIN news_articles USING (article_id) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY coalesce(heat_score, -1) DESC, crawled_at DESC NULLS LAST, article_id) = 1",
    "source_checkpoints": "SELECT s.code, latest_id, last_id, cursor_at FROM news_sources s LEFT JOIN (SELECT lower(source_code) AS code, arg_max(article_id, (coalesce(crawled_at, TIMESTAMP '1900-01-01'), article_id)) AS latest_id, max(article_id) AS last_id, max(crawled_at) AS cursor_at FROM news_articles WHERE source_code IS NOT NULL GROUP BY 1) a USING (code)",
    "source_audit": f"WITH {_AUDIT} SELECT code, tz_name, name IS NOT NULL AS is_registered, is_active, n_articles, n_24h, n_72h, last_at FROM audit",
    "audit_summary": f"WITH {_AUDIT} SELECT count(*) AS n_configured, count(name) AS n_registered, count(*) FILTER (is_active) AS n_active, count(*) FILTER (n_24h > 0) AS n_with_24h, count(*) FILTER (n_articles > 0) AS n_with_articles FROM audit",
    "global_freshness": f"SELECT max(crawled_at) AS last_at, count(*) AS n_articles, CAST(floor(trunc(epoch(TIMESTAMP '{NOW}') - epoch(max(crawled_at))) / 60) AS BIGINT) AS age_minutes FROM news_articles",
    "place_distributions": """WITH e AS (SELECT unnest(geo_entities) AS e FROM news_articles) SELECT facet, value, count(*) AS n FROM (SELECT 'precision' AS facet, coalesce(e.precision_level, 'UNKNOWN') AS value FROM e UNION ALL SELECT 'kind', coalesce(e.type, 'UNKNOWN') FROM e
        UNION ALL SELECT 'position', coalesce(e.source_text_position, 'UNKNOWN') FROM e UNION ALL SELECT 'level', coalesce(event_level, 'UNKNOWN') FROM news_events) GROUP BY ALL""",
    "feed_ratios": f"""SELECT *, round_even(n_stale / n_items, 4) AS stale_ratio, round_even(n_empty / n_items, 4) AS empty_ratio FROM (SELECT source_metadata ->> '$.feed_code' AS feed_code, count(*) AS n_items, count(*) FILTER (trunc(epoch(TIMESTAMP '{NOW}') - epoch(crawled_at)) > 7776000) AS n_stale, count(*) FILTER (content IS NULL) AS n_empty
        FROM news_articles WHERE source_metadata ->> '$.feed_code' IS NOT NULL GROUP BY 1)""",
    "city_counts": f"{_P} SELECT country_code, count(DISTINCT geo_key) AS n_cities FROM places WHERE precision_level = 'CITY' AND country_code IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "capital_places": f"{_P}, c AS (SELECT country_code, geo_key, count(*) AS n, min(lat) AS lat, min(lng) AS lng FROM places WHERE precision_level = 'CITY' AND country_code IS NOT NULL GROUP BY ALL) SELECT country_code, geo_key, lat, lng FROM c QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY n DESC, geo_key DESC NULLS LAST) = 1",
    "region_heat_with": f"""{_P}, h AS (SELECT p.event_id, country_code, admin1_code, coalesce(heat_score, 0) AS h FROM event_places p JOIN news_events USING (event_id) WHERE country_code IN ('QX', 'QM')) SELECT * FROM (SELECT admin1_code, CAST(sum(h) AS BIGINT) AS heat_total, count(*) AS n_events FROM (SELECT DISTINCT event_id, admin1_code, h FROM h WHERE country_code = 'QX' AND admin1_code IS NOT NULL) GROUP BY 1
        UNION ALL SELECT 'QM', CAST(sum(h) AS BIGINT), count(*) FROM (SELECT DISTINCT event_id, h FROM h WHERE country_code = 'QM') HAVING count(*) > 0) ORDER BY heat_total DESC, admin1_code LIMIT 12""",
    "analytics_order": f"""WITH a AS (SELECT article_id, lower(source_code) AS code FROM news_articles), s AS (SELECT s.code, name, coalesce(n_articles, 0) AS n_articles, coalesce(n_events, 0) AS n_events FROM news_sources s LEFT JOIN (SELECT code, count(*) AS n_articles FROM a GROUP BY 1) USING (code) LEFT JOIN (SELECT code, count(DISTINCT event_id) AS n_events FROM ({LINKS_SQL}) JOIN a USING (article_id) GROUP BY 1) USING (code))
        SELECT code, n_events, n_articles, CAST(row_number() OVER (ORDER BY n_events DESC, n_articles DESC, lower(name), code) AS INT) AS rank FROM s""",
    "feed_order": """WITH f AS (SELECT lower(source_code) AS code, source_metadata ->> '$.feed_code' AS feed_code, min(coalesce(TRY_CAST(source_metadata ->> '$.rank' AS INT), 100)) AS priority FROM news_articles WHERE source_code IS NOT NULL AND source_metadata ->> '$.feed_code' IS NOT NULL GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY priority, feed_code) AS INT) AS place FROM f""",
    "registry_sync": """WITH x AS (SELECT lower(source_code) AS code, source_name AS n, language AS l, source_class AS c FROM news_articles WHERE source_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(source_code) ORDER BY crawled_at DESC NULLS LAST, article_id DESC) = 1),
        j AS (SELECT coalesce(s.code, x.code) AS code, s.name, x.code AS seen, concat_ws('|', CASE WHEN s.name IS DISTINCT FROM n THEN 'name' END, CASE WHEN s.language IS DISTINCT FROM l THEN 'language' END, CASE WHEN s.source_class IS DISTINCT FROM c THEN 'source_class' END) AS ch FROM news_sources s FULL JOIN x ON s.code = x.code),
        k AS (SELECT code, CASE WHEN seen IS NULL THEN 'unseen' WHEN name IS NULL THEN 'create' WHEN ch <> '' THEN 'update' ELSE 'unchanged' END AS action, ch FROM j) SELECT code, action, CASE WHEN action = 'update' THEN ch END AS changed FROM k""",
    "density_cells": f"""{_P}, o AS (SELECT CAST(floor(lat / 5) AS INT) AS y, CAST(floor(lng / 5) AS INT) AS x, CAST(sum(coalesce(heat_score, 0)) AS BIGINT) AS heat FROM event_places JOIN news_events USING (event_id) WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY ALL)
        SELECT y + dy AS cell_lat, ((x + dx + 36) % 72 + 72) % 72 - 36 AS cell_lng, sum(heat * CASE WHEN dx = 0 AND dy = 0 THEN 2 ELSE 1 END) / 2.0::DOUBLE AS density FROM o, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) GROUP BY ALL""",
    "region_hotspots": f"{_P} SELECT event_id, m.k AS geo_key, m.c AS confidence, 'country' AS geo_type FROM (SELECT event_id, min({{'k': coalesce(geo_key, 'QX'), 'c': coalesce(confidence, 1.0)}}) AS m FROM event_places WHERE country_code = 'QX' GROUP BY event_id)",
}
