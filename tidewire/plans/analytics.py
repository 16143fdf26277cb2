"""Source, quality and maintenance queries: pre-aggregates joined to the sources, never a query per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..session import small_side, table
from .common import NOW, WITH_PLACES, event_places, links


def _per_source(spark: SparkSession, sf_dir: str, hours: int = 24 * 90) -> DataFrame:
    a = table(spark, sf_dir, "news_articles").select(F.lower("source_code").alias("code"), "article_id", "crawled_at", "tags", "region_tags", "category", "title", "published_at")
    recent = a.filter(F.col("crawled_at") >= F.expr(f"timestamp'{NOW}' - interval {hours} hours"))
    tags = F.coalesce(F.size(F.filter("tags", lambda t: F.trim(t) != "")), F.lit(0))
    articles = recent.groupBy("code").agg(
        F.count("*").alias("n_articles"), F.count("published_at").alias("n_timed"), F.count_if(tags > 0).alias("n_tagged"), F.count_if(F.coalesce(F.size("region_tags"), F.lit(0)) > 0).alias("n_placed"),
        F.count_if((F.length(F.trim(F.coalesce("title", F.lit("")))) < 12) & (tags <= 1)).alias("n_low_signal"), F.max("crawled_at").alias("last_crawled_at"),
    )
    events = table(spark, sf_dir, "news_events").select("event_id", "heat_score", "event_level", "last_seen_at").filter(F.col("last_seen_at") >= F.expr(f"timestamp'{NOW}' - interval {hours} hours"))
    pairs = links(spark, sf_dir).join(a.select("article_id", "code"), "article_id").select("code", "event_id").distinct()
    by_event = pairs.join(events, "event_id").groupBy("code").agg(
        F.count("*").alias("n_events"), F.sum(F.coalesce("heat_score", F.lit(0))).alias("heat_total"), F.count_if(F.col("event_level").isin("admin1", "city")).alias("n_fine")
    )
    sources = table(spark, sf_dir, "news_sources").select("code", "name", "source_tier", "is_active")
    counts = ["n_articles", "n_timed", "n_tagged", "n_placed", "n_low_signal", "n_events", "heat_total", "n_fine"]
    joined = sources.join(articles, "code", "left").join(by_event, "code", "left")  # both one row a source
    return joined.fillna(0, counts)


def _ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "time_coverage": V.ratio(F.col("n_timed"), F.col("n_articles")), "tag_coverage": V.ratio(F.col("n_tagged"), F.col("n_articles")), "place_coverage": V.ratio(F.col("n_placed"), F.col("n_articles")),
        "low_signal_ratio": V.ratio(F.col("n_low_signal"), F.col("n_articles")), "fine_ratio": V.ratio(F.col("n_fine"), F.col("n_events")), "avg_heat": V.ratio(F.col("heat_total"), F.col("n_events"), 2),
    })


def source_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and coverage of each active source."""
    df = _ratios(_per_source(spark, sf_dir).filter("is_active"))
    return df.select("code", "source_tier", "n_articles", "n_events", "time_coverage", "tag_coverage", "place_coverage", "low_signal_ratio", "fine_ratio", "avg_heat", "last_crawled_at")


def tier_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by tier: ratios of sums, not means of ratios."""
    sums = ["n_articles", "n_timed", "n_tagged", "n_placed", "n_low_signal", "n_events", "heat_total", "n_fine"]
    df = _per_source(spark, sf_dir).groupBy("source_tier").agg(F.count("*").alias("n_sources"), F.count_if("is_active").alias("n_active"), *[F.sum(c).alias(c) for c in sums])
    return _ratios(df).select("source_tier", "n_sources", "n_active", "n_articles", "n_events", "time_coverage", "tag_coverage", "place_coverage", "low_signal_ratio", "fine_ratio", "avg_heat")


def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of each source within 24 and 72 hours, and the latest."""
    age = F.expr(f"timestampdiff(SECOND, crawled_at, timestamp'{NOW}')")
    a = table(spark, sf_dir, "news_articles").filter("crawled_at is not null and source_code is not null").select(F.lower("source_code").alias("code"), "crawled_at", age.alias("age"))
    a = a.withColumn("age", F.greatest(F.lit(0), "age"))  # after the moment of the query: just seen
    return a.groupBy("code").agg(F.count_if(F.col("age") <= 86400).alias("n_24h"), F.count_if(F.col("age") <= 3 * 86400).alias("n_72h"), F.max("crawled_at").alias("last_crawled_at"))


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by user of the event stream: failed and completed ones, latest run and its outcome."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return e.groupBy("user_id").agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("event_type") == "error").alias("n_failed"), F.count_if(F.col("event_type") == "purchase").alias("n_completed"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_completed_at"),
    )


def place_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by precision: mentions, events, keys, share without a key."""
    p = event_places(spark, sf_dir)
    return p.groupBy(F.coalesce("precision_level", F.lit("UNKNOWN")).alias("precision_level")).agg(
        F.count("*").alias("n_mentions"), F.count_distinct("event_id").alias("n_events"), F.count_distinct("geo_key").alias("n_keys"), V.ratio(F.count_if(F.col("country_code").isNull()), F.count("*")).alias("no_country_ratio")
    )


def top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten countries of most events."""
    p = event_places(spark, sf_dir).filter("country_code is not null")
    return p.groupBy("country_code").agg(F.count_distinct("event_id").alias("n_events")).orderBy(F.desc("n_events"), "country_code").limit(10)


def column_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled values of the main columns of articles, a row each."""
    cols = ["title", "summary", "content", "category", "source_tier", "heat_score", "canonical_url", "published_at", "display_geo", "bbox"]
    a = table(spark, sf_dir, "news_articles")
    one = a.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in cols])
    return one.select("n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_filled")) for c in cols])).alias("x")).select("x.column_name", "x.n_filled", "n_rows")


def tag_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by tag."""
    t = table(spark, sf_dir, "news_articles").select(F.explode(V.normal_tags(F.col("tags"))).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n_articles"))


def tier_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by tier, spelling aside."""
    return table(spark, sf_dir, "news_articles").groupBy(F.coalesce(F.nullif(F.lower(F.trim("source_tier")), F.lit("")), F.lit("unknown")).alias("tier")).agg(F.count("*").alias("n_articles"))


def event_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat of each event from its articles."""
    a = table(spark, sf_dir, "news_articles").select("article_id", F.coalesce("heat_score", F.lit(0)).alias("h"), F.lower("source_code").alias("code"), "crawled_at", "tags")
    tiers = table(spark, sf_dir, "news_sources").select("code", V.tier_order(F.col("source_tier")).alias("tier"))
    signals = links(spark, sf_dir).join(a, "article_id").join(small_side(tiers), "code", "left")
    hot = lambda ws: F.max(F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(w) for w in ws])), F.lit(False)).cast("int"))
    per = signals.groupBy("event_id").agg(
        F.max("h").alias("top"), F.sum("h").alias("sum_h"), F.count("*").alias("n"), F.count_distinct("code").alias("sources"), F.max(F.coalesce("tier", F.lit(4))).alias("tier"), F.max("crawled_at").alias("at"),
        hot(V.HOT_TAGS).alias("hot"), hot(V.WARM_TAGS).alias("warm"),
    )
    e = table(spark, sf_dir, "news_events").select("event_id", "category", "event_level", "severity", "article_count")
    df = e.join(per, "event_id")
    by_category = F.when(F.col("category").isin("technology", "science", "conflict", "disaster"), 6).when(F.col("category").isin("policy", "business"), 4).otherwise(0)
    topic = F.least(F.lit(20), F.col("hot") * 12 + F.col("warm") * 8 + by_category)
    hours = F.expr(f"timestampdiff(SECOND, at, timestamp'{NOW}') / 3600")
    heat = V.event_heat(F.greatest("top", F.lit(1)), F.col("sum_h") / F.col("n"), F.greatest(F.coalesce("article_count", F.lit(0)), "n"), F.greatest(F.lit(1), "sources"), F.col("tier"), topic, F.col("event_level"), hours, F.col("severity"))
    return df.select("event_id", heat.alias("heat"))


def legacy_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older heat: articles and sources, decaying over 48 hours."""
    a = table(spark, sf_dir, "news_articles").select("article_id", F.lower("source_code").alias("code"), "crawled_at")
    per = links(spark, sf_dir).join(a, "article_id").groupBy("event_id").agg(F.count("*").alias("n"), F.count_distinct("code").alias("s"), F.max("crawled_at").alias("at"))
    # What lies after the moment of the query counts as just seen.
    fade = F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), F.expr(f"timestampdiff(SECOND, at, timestamp'{NOW}')")) / 3600 / 48)
    return per.select("event_id", ((F.col("n") * 100 + F.col("s") * 50) * fade).cast("int").alias("heat"))


def unlinked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of no event."""
    return table(spark, sf_dir, "news_articles").select("article_id").join(links(spark, sf_dir).select("article_id"), "article_id", "left_anti")


def kept_after_retention(spark: SparkSession, sf_dir: str, days: int = 90) -> DataFrame:
    """Articles left when events not seen for ``days`` go with their links, then articles without link crawled before."""
    cutoff = F.expr(f"timestamp'{NOW}' - interval {days} days")
    live = table(spark, sf_dir, "news_events").filter(F.col("last_seen_at") >= cutoff).select("event_id")
    kept = links(spark, sf_dir).join(live, "event_id", "left_semi").select("article_id")
    a = table(spark, sf_dir, "news_articles").select("article_id", "crawled_at")
    held = a.join(kept, "article_id", "left_semi").select("article_id")
    young = a.filter(F.col("crawled_at") >= cutoff).select("article_id")
    return held.union(young).distinct()


def source_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync of the registry with the sources seen in articles would do."""
    seen = table(spark, sf_dir, "news_articles").filter("source_code is not null").groupBy(F.lower("source_code").alias("code")).agg(F.max("source_name").alias("seen_name"))
    stored = table(spark, sf_dir, "news_sources").select("code", "name")
    j = stored.join(seen, "code", "full")
    action = F.when(F.col("name").isNull(), "create").when(F.col("seen_name").isNull(), "unseen").when(F.col("name") == F.col("seen_name"), "unchanged").otherwise("update")
    return j.select("code", action.alias("action"))


def budget_split(spark: SparkSession, sf_dir: str, total: int = 1000) -> DataFrame:
    """A budget spread over the active sources, the remainder to the first."""
    s = table(spark, sf_dir, "news_sources").filter("is_active").select("code")
    one = W.partitionBy(F.lit(1))  # the registry is small
    return s.select("code", (F.expr(f"{total}") / F.count("*").over(one)).cast("long").alias("base"), (F.lit(total) % F.count("*").over(one)).alias("rem"), F.row_number().over(one.orderBy("code")).alias("i")).select("code", (F.col("base") + F.when(F.col("i") <= F.col("rem"), 1).otherwise(0)).alias("items"))


QUERIES = {f.__name__: f for f in [
    source_analytics, tier_analytics, source_freshness, job_status, place_quality, top_countries, column_coverage, tag_facets, tier_facets, event_heat, legacy_heat, unlinked_articles,
    kept_after_retention, source_diff, budget_split,
]}

_CUT = f"TIMESTAMP '{NOW}' - INTERVAL {24 * 90} HOUR"
_SRC = (
    "WITH a AS (SELECT lower(source_code) AS code, *, CASE WHEN tags IS NULL THEN 0 ELSE len(list_filter(tags, lambda t: trim(t) <> '')) END AS nt FROM news_articles),"
    f" ar AS (SELECT code, count(*) AS n_articles, count(published_at) AS n_timed, count(*) FILTER (nt > 0) AS n_tagged, count(*) FILTER (coalesce(len(region_tags), 0) > 0) AS n_placed, count(*) FILTER (length(trim(coalesce(title, ''))) < 12 AND nt <= 1) AS n_low_signal, max(crawled_at) AS last_crawled_at FROM a WHERE crawled_at >= {_CUT} GROUP BY code),"
    f" ev AS (SELECT code, count(*) AS n_events, CAST(sum(coalesce(heat_score, 0)) AS BIGINT) AS heat_total, count(*) FILTER (event_level IN ('admin1', 'city')) AS n_fine FROM (SELECT DISTINCT code, event_id FROM event_articles JOIN a USING (article_id)) JOIN news_events USING (event_id) WHERE last_seen_at >= {_CUT} GROUP BY code),"
    " s AS (SELECT code, source_tier, is_active, coalesce(n_articles, 0) AS n_articles, coalesce(n_timed, 0) AS n_timed, coalesce(n_tagged, 0) AS n_tagged, coalesce(n_placed, 0) AS n_placed, coalesce(n_low_signal, 0) AS n_low_signal, coalesce(n_events, 0) AS n_events, coalesce(heat_total, 0) AS heat_total, coalesce(n_fine, 0) AS n_fine, last_crawled_at FROM news_sources LEFT JOIN ar USING (code) LEFT JOIN ev USING (code))"
)
_R = ", ".join(f"CASE WHEN {d} > 0 THEN round_even(CAST({n} AS DOUBLE) / {d}, {k}) ELSE 0 END AS {name}" for n, d, k, name in [
    ("n_timed", "n_articles", 4, "time_coverage"), ("n_tagged", "n_articles", 4, "tag_coverage"), ("n_placed", "n_articles", 4, "place_coverage"), ("n_low_signal", "n_articles", 4, "low_signal_ratio"),
    ("n_fine", "n_events", 4, "fine_ratio"), ("heat_total", "n_events", 2, "avg_heat")])
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ["n_articles", "n_timed", "n_tagged", "n_placed", "n_low_signal", "n_events", "heat_total", "n_fine"])
_TAGS = "list_filter(list_transform(tags, lambda t: lower(trim(t))), lambda t: t <> '')"
_ANY = lambda ws: "max(CASE WHEN list_has_any(coalesce(tags, []), [" + ", ".join(f"'{w}'" for w in ws) + "]) THEN 1 ELSE 0 END)"
SQL = {
    "source_analytics": f"{_SRC} SELECT code, source_tier, n_articles, n_events, {_R}, last_crawled_at FROM s WHERE is_active",
    "tier_analytics": f"{_SRC}, t AS (SELECT source_tier, count(*) AS n_sources, count(*) FILTER (is_active) AS n_active, {_SUMS} FROM s GROUP BY source_tier) SELECT source_tier, n_sources, n_active, n_articles, n_events, {_R} FROM t",
    "source_freshness": f"SELECT code, count(*) FILTER (age <= 86400) AS n_24h, count(*) FILTER (age <= 259200) AS n_72h, max(crawled_at) AS last_crawled_at FROM (SELECT lower(source_code) AS code, crawled_at, greatest(0, floor(epoch(TIMESTAMP '{NOW}') - epoch(crawled_at))) AS age FROM news_articles WHERE crawled_at IS NOT NULL AND source_code IS NOT NULL) GROUP BY code",
    "job_status": "SELECT user_id, count(*) AS n_runs, count(*) FILTER (event_type = 'error') AS n_failed, count(*) FILTER (event_type = 'purchase') AS n_completed, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) FILTER (event_type = 'purchase') AS last_completed_at FROM events GROUP BY user_id",
    "place_quality": f"{WITH_PLACES} SELECT coalesce(precision_level, 'UNKNOWN') AS precision_level, count(*) AS n_mentions, count(DISTINCT event_id) AS n_events, count(DISTINCT geo_key) AS n_keys, round_even(CAST(count(*) FILTER (country_code IS NULL) AS DOUBLE) / count(*), 4) AS no_country_ratio FROM event_places GROUP BY 1",
    "top_countries": f"{WITH_PLACES} SELECT country_code, count(DISTINCT event_id) AS n_events FROM event_places WHERE country_code IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "column_coverage": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_filled, count(*) AS n_rows FROM news_articles" for c in ["title", "summary", "content", "category", "source_tier", "heat_score", "canonical_url", "published_at", "display_geo", "bbox"]),
    "tag_facets": f"SELECT tag, count(*) AS n_articles FROM (SELECT DISTINCT article_id, unnest({_TAGS}) AS tag FROM news_articles) GROUP BY tag",
    "tier_facets": "SELECT coalesce(nullif(lower(trim(source_tier)), ''), 'unknown') AS tier, count(*) AS n_articles FROM news_articles GROUP BY 1",
    "event_heat": f"WITH s AS (SELECT event_id, coalesce(a.heat_score, 0) AS h, lower(a.source_code) AS code, crawled_at, tags, CASE n.source_tier WHEN 'official' THEN 5 WHEN 'authoritative' THEN 4 WHEN 'aggregator' THEN 3 WHEN 'community' THEN 2 ELSE 1 END AS tier, n.code AS known FROM (SELECT DISTINCT event_id, article_id FROM event_articles) JOIN news_articles a USING (article_id) LEFT JOIN news_sources n ON n.code = lower(a.source_code)), p AS (SELECT event_id, max(h) AS top, sum(h) AS sh, count(*) AS n, count(DISTINCT code) AS src, max(CASE WHEN known IS NULL THEN 4 ELSE tier END) AS tier, max(crawled_at) AS last_at, {_ANY(V.HOT_TAGS)} AS hot, {_ANY(V.WARM_TAGS)} AS warm FROM s GROUP BY event_id), q AS (SELECT event_id, greatest(top, 1) AS top, sh / n AS mean, greatest(coalesce(article_count, 0), n) AS n, greatest(1, src) AS src, tier, least(20, hot * 12 + warm * 8 + CASE WHEN category IN ('technology', 'science', 'conflict', 'disaster') THEN 6 WHEN category IN ('policy', 'business') THEN 4 ELSE 0 END) AS topic, event_level, floor(epoch(TIMESTAMP '{NOW}') - epoch(last_at)) / 3600 AS hrs, coalesce(severity, 0) AS sev FROM news_events JOIN p USING (event_id)) SELECT event_id, CAST(least(9999, greatest(1, trunc(top * 0.62::DOUBLE + round_even(mean, 0) * 0.38::DOUBLE) + least(42, n * 6) + least(36, src * 9) + CASE tier WHEN 5 THEN 18 WHEN 4 THEN 14 WHEN 3 THEN 8 WHEN 2 THEN 5 ELSE 3 END + topic + CASE event_level WHEN 'city' THEN 8 WHEN 'admin1' THEN 4 ELSE 0 END + CASE WHEN hrs <= 6 THEN 18 WHEN hrs <= 24 THEN 12 WHEN hrs <= 72 THEN 6 ELSE 0 END + least(24, round_even(sev * 0.24::DOUBLE, 0)))) AS INT) AS heat FROM q",
    "legacy_heat": f"SELECT event_id, CAST(trunc((n * 100 + s * 50) * greatest(0, 1 - greatest(0, trunc(epoch(TIMESTAMP '{NOW}') - epoch(last_at))) / 3600 / 48)) AS INT) AS heat FROM (SELECT event_id, count(*) AS n, count(DISTINCT lower(source_code)) AS s, max(crawled_at) AS last_at FROM (SELECT DISTINCT event_id, article_id FROM event_articles) JOIN news_articles USING (article_id) GROUP BY event_id)",
    "unlinked_articles": "SELECT article_id FROM news_articles WHERE article_id NOT IN (SELECT article_id FROM event_articles WHERE article_id IS NOT NULL)",
    "kept_after_retention": f"WITH k AS (SELECT article_id FROM event_articles WHERE event_id IN (SELECT event_id FROM news_events WHERE last_seen_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY)) SELECT article_id FROM news_articles WHERE article_id IN (SELECT article_id FROM k) OR crawled_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY",
    "source_diff": "SELECT coalesce(s.code, a.code) AS code, CASE WHEN name IS NULL THEN 'create' WHEN seen_name IS NULL THEN 'unseen' WHEN name = seen_name THEN 'unchanged' ELSE 'update' END AS action FROM news_sources s FULL JOIN (SELECT lower(source_code) AS code, max(source_name) AS seen_name FROM news_articles WHERE source_code IS NOT NULL GROUP BY 1) a ON s.code = a.code",
    "budget_split": "SELECT code, CAST(1000 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY code) <= 1000 % count(*) OVER () THEN 1 ELSE 0 END AS BIGINT) AS items FROM news_sources WHERE is_active",
}
