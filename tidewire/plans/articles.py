"""Article-level queries: cleaning, hashes, tokens, urls, tags, times and JSON fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..session import table
from .common import NOW


def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "news_articles")


def clean_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries without tags, web and mail addresses, at most 60 characters."""
    return _a(spark, sf_dir).select("article_id", T.truncate(T.strip_tags(T.remove_emails(T.remove_urls(F.col("summary")))), 60).alias("summary"))


def content_ledes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentence of each content."""
    return _a(spark, sf_dir).filter("content is not null").select("article_id", T.first_paragraph(F.col("content")).alias("lede"))


def unescaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with character references and tags resolved."""
    return _a(spark, sf_dir).select("article_id", T.clean_html(F.col("title")).alias("title"))


def item_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of each article by address and title."""
    return _a(spark, sf_dir).select("article_id", T.item_hash(F.col("url"), F.col("title")).alias("item_hash"))


def title_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that share a normal title, by its hash."""
    e = table(spark, sf_dir, "news_events").filter("title is not null").select(T.title_hash(F.col("title")).alias("h"), "event_id")
    return e.groupBy("h").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_id"))


def title_token_counts(spark: SparkSession, sf_dir: str, top: int = 50) -> DataFrame:
    """Most frequent telling tokens of titles, of every language."""
    words = _a(spark, sf_dir).select(F.explode(T.title_tokens(F.col("title"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(top)


def keywords_per_category(spark: SparkSession, sf_dir: str, top: int = 5) -> DataFrame:
    """Five most frequent Latin words of each category's titles, of every language."""
    words = _a(spark, sf_dir).filter("category is not null").select("category", F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    counts = words.groupBy("category", "word").agg(F.count("*").alias("n"))
    w = W.partitionBy("category").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("category", "rank", "word", "n")


def normal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses without tracking, fragment and slash at the end."""
    return _a(spark, sf_dir).select("article_id", V.normal_url(F.col("url")).alias("url"))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by host."""
    return _a(spark, sf_dir).groupBy(V.host(F.col("url")).alias("host")).agg(F.count("*").alias("n_articles"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First article of each content hash, with the number of repeats."""
    return _a(spark, sf_dir).filter("hash is not null").groupBy("hash").agg(F.min("article_id").alias("article_id"), F.count("*").alias("n_copies"))


def default_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat by length of content where none is given."""
    heat = F.when(F.coalesce("heat_score", F.lit(0)) == 0, F.least(F.lit(100), F.expr("coalesce(length(content), 0) div 100"))).otherwise(F.col("heat_score"))
    return _a(spark, sf_dir).select("article_id", heat.cast("int").alias("heat"))


def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and region tags of an article in one list."""
    return _a(spark, sf_dir).select("article_id", F.array_join(V.merged_tags(F.col("tags"), F.col("region_tags")), "|").alias("tags"))


def timeliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles crawled within their freshness limit before the moment of the query."""
    age = F.expr(f"timestampdiff(SECOND, crawled_at, timestamp'{NOW}')")
    a = _a(spark, sf_dir).filter("crawled_at is not null").select("article_id", age.alias("age_s"), F.coalesce("freshness_sla_hours", F.lit(24)).alias("limit_h"))
    return a.filter("age_s >= 0 and age_s <= limit_h * 3600").select("article_id", "age_s")


def day_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by day at UTC+8, the last seven days."""
    day = F.to_date(F.expr("crawled_at + interval 8 hours"))
    last = F.lit(NOW[:10]).cast("date")
    return _a(spark, sf_dir).select(day.alias("day")).filter((F.col("day") <= last) & (F.col("day") > F.date_sub(last, 7))).groupBy("day").agg(F.count("*").alias("n_articles"))


def metadata_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and best rank by feed, from the JSON metadata."""
    a = _a(spark, sf_dir).select(F.get_json_object("source_metadata", "$.feed_code").alias("feed_code"), F.get_json_object("source_metadata", "$.rank").try_cast("int").alias("rank"))
    return a.filter("feed_code is not null").groupBy("feed_code").agg(F.count("*").alias("n_articles"), F.min("rank").alias("best_rank"))


def percent_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of articles on one scale."""
    return _a(spark, sf_dir).filter("confidence is not null").groupBy(V.percent_scale(F.col("confidence")).alias("confidence")).agg(F.count("*").alias("n_articles"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of a JSON property of the event stream by type."""
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.count("k").alias("k_given"))


QUERIES = {f.__name__: f for f in [
    clean_summaries, content_ledes, unescaped_titles, item_hashes, title_hashes, title_token_counts, keywords_per_category, normal_urls, hosts, exact_duplicates, default_heat, tag_union,
    timeliness, day_ranges, metadata_feeds, percent_confidence, event_props,
]}

_STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOPWORDS)
_B = "[\\s\\pZ]+"
_SUFFIX = T.TITLE_SUFFIX.replace("'", "''")


def _normal(column: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace(regexp_replace(trim({column}), '{_SUFFIX}', ''), '[^\\pL\\pN_\\s\\pZ]', ' ', 'g'), '{_B}', ' ', 'g')))"


def tokens_sql(column: str) -> str:
    """DuckDB list of the telling tokens of a title."""
    return f"list_filter(regexp_extract_all({_normal(column)}, '[一-鿿]{{2,}}|[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains([{_STOP}], w))"


_TRACK = ", ".join(f"'{w}'" for w in V.TRACKING)
SQL = {
    "clean_summaries": "SELECT article_id, CASE WHEN length(s) > 60 THEN rtrim(substr(s, 1, 57)) || '...' ELSE s END AS summary FROM (SELECT article_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(summary, 'https?://\\S+', '', 'g'), '\\S+@\\S+\\.\\S+', '', 'g'), '<[^>]+>', '', 'g'), '[\\s\\pZ]+', ' ', 'g')), '') AS s FROM news_articles)",
    "item_hashes": "SELECT article_id, sha256(concat_ws('|', coalesce(url, ''), coalesce(title, ''))) AS item_hash FROM news_articles",
    "title_token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('title')}) AS token FROM news_articles WHERE title IS NOT NULL) GROUP BY token ORDER BY n DESC, token LIMIT 50",
    "title_hashes": f"SELECT md5({_normal('title')}) AS h, count(*) AS n_events, min(event_id) AS first_id FROM news_events WHERE title IS NOT NULL GROUP BY 1",
    "content_ledes": "SELECT article_id, coalesce(" + ", ".join(f"CASE WHEN contains(t, '{m}') AND length(trim(split_part(t, '{m}', 1))) > 15 THEN substr(trim(split_part(t, '{m}', 1)), 1, 600) END" for m in ["。", "！", "？", ". ", "! ", "? "]) + f", substr(t, 1, 600)) AS lede FROM (SELECT article_id, trim(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '{_B}', ' ', 'g')) AS t FROM news_articles WHERE content IS NOT NULL)",
    "tag_union": "SELECT article_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:20], '|') AS tags FROM (SELECT article_id, list_filter(list_transform(coalesce(tags, []) || coalesce(region_tags, []), lambda t: lower(trim(t))), lambda t: t <> '') AS l FROM news_articles)",
    "keywords_per_category": "SELECT category, CAST(rank AS INT) AS rank, word, n FROM (SELECT category, word, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, word) AS rank FROM (SELECT category, word, count(*) AS n FROM (SELECT category, unnest(regexp_extract_all(lower(title), '[a-z]{4,}')) AS word FROM news_articles WHERE category IS NOT NULL AND title IS NOT NULL) GROUP BY ALL)) WHERE rank <= 5",
    "normal_urls": f"SELECT article_id, CASE WHEN h = '' THEN url ELSE h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS url FROM (SELECT article_id, url, h, regexp_replace(split_part(rest, '?', 1), '/+$', '') AS path, coalesce(array_to_string(list_sort(list_filter(string_split(CASE WHEN contains(rest, '?') THEN regexp_replace(rest, '^[^?]*\\?', '') ELSE '' END, '&'), lambda p: regexp_matches(p, '^[^=]+=.+') AND NOT list_contains([{_TRACK}], lower(split_part(p, '=', 1))))), '&'), '') AS q FROM (SELECT article_id, url, h, substr(u, length(h) + 1) AS rest FROM (SELECT article_id, url, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS h FROM (SELECT article_id, url, regexp_replace(trim(url), '#.*$', '') AS u FROM news_articles))))",
    "hosts": "SELECT nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '') AS host, count(*) AS n_articles FROM news_articles GROUP BY 1",
    "exact_duplicates": "SELECT hash, min(article_id) AS article_id, count(*) AS n_copies FROM news_articles WHERE hash IS NOT NULL GROUP BY hash",
    "default_heat": "SELECT article_id, CAST(CASE WHEN coalesce(heat_score, 0) = 0 THEN least(100, coalesce(length(content), 0) // 100) ELSE heat_score END AS INT) AS heat FROM news_articles",
    "timeliness": f"SELECT article_id, age_s FROM (SELECT article_id, CAST(floor(epoch(TIMESTAMP '{NOW}') - epoch(crawled_at)) AS BIGINT) AS age_s, coalesce(freshness_sla_hours, 24) AS lim FROM news_articles WHERE crawled_at IS NOT NULL) WHERE age_s >= 0 AND age_s <= lim * 3600",
    "day_ranges": f"SELECT day, count(*) AS n_articles FROM (SELECT CAST(crawled_at + INTERVAL 8 HOUR AS DATE) AS day FROM news_articles) WHERE day <= DATE '{NOW[:10]}' AND day > DATE '{NOW[:10]}' - 7 GROUP BY day",
    "metadata_feeds": "SELECT feed_code, count(*) AS n_articles, min(rank) AS best_rank FROM (SELECT source_metadata ->> '$.feed_code' AS feed_code, TRY_CAST(source_metadata ->> '$.rank' AS INT) AS rank FROM news_articles) WHERE feed_code IS NOT NULL GROUP BY feed_code",
    "percent_confidence": "SELECT greatest(0, least(100, CAST(round_even(CASE WHEN confidence <= 1 THEN confidence * 100 ELSE confidence END, 0) AS INT))) AS confidence, count(*) AS n_articles FROM news_articles WHERE confidence IS NOT NULL GROUP BY 1",
    "event_props": "SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_sum, count(k) AS k_given FROM (SELECT event_type, TRY_CAST(props ->> '$.k' AS BIGINT) AS k FROM events) GROUP BY event_type",
}
