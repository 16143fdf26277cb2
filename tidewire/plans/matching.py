"""Queries of matching, de-duplication, merging and dictionary look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import alike_titles
from ..operators import matching as M
from ..operators.proximity import article_locations
from ..session import cut, small_side, table
from .articles import SQL as _ARTICLE_SQL
from .articles import tokens_sql
from .common import links


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "news_articles")


def earlier_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each article the first stored one that shares its hash, address or canonical address."""
    a = _articles(spark, sf_dir).select(F.col("article_id").alias("id"), "hash", V.normal_url(F.col("url")).alias("url"), "canonical_url")
    keys = {k: (F.col(k), F.col(k)) for k in ("hash", "url", "canonical_url")}
    first = {k: a.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias("id")) for k in keys}
    stored = None  # one stored row per key value: the first; a key held by a third of all rows stays one row
    for k, df in first.items():
        part = df.select("id", *[F.col(c) if c == k else F.lit(None).cast("string").alias(c) for c in keys])
        stored = part if stored is None else stored.unionByName(part)
    return M.any_key_matches(a, stored, keys).filter("id < in_id").select(F.col("in_id").alias("article_id"), F.col("id").alias("first_id"), "kind")


def _event_sides(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """``events`` with the tier of their source and the place keys and tags of their articles."""
    sources = table(spark, sf_dir, "news_sources").select(F.col("code").alias("source_code"), F.col("source_tier").alias("e_tier"))
    none = F.array().cast("array<string>")
    said = _articles(spark, sf_dir).select("article_id", F.transform("geo_entities", lambda x: x.geo_key).alias("k"), F.transform("tags", lambda t: F.lower(F.trim(t))).alias("t"))
    each = lambda c, i: F.transform(F.coalesce(c, none), lambda v: F.struct(F.lit(i).alias("i"), v.alias("v")))
    said = links(spark, sf_dir).join(said, "article_id").select("event_id", F.explode(F.concat(each("k", 0), each("t", 1))).alias("s"))
    of = lambda i: F.array_sort(F.collect_set(F.when(F.col("s.i") == i, F.col("s.v"))))
    sides = said.groupBy("event_id").agg(of(0).alias("e_keys"), of(1).alias("e_tags"))  # bounded vocabularies
    return events.join(small_side(sources), "source_code", "left").join(sides, "event_id", "left").drop("source_code")


def event_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best open event of each article, of all events of its country in the window."""
    a = _articles(spark, sf_dir).filter("country is not null and title is not null and crawled_at is not null")
    items = a.select(F.col("article_id").alias("item_id"), "country", F.col("crawled_at").alias("at"), "title", "category", "tags", F.col("source_tier").alias("tier"), F.transform(F.coalesce("geo_entities", F.array().cast(a.schema["geo_entities"].dataType)), lambda x: x.geo_key).alias("keys"))
    e = table(spark, sf_dir, "news_events").filter("main_country is not null and title is not null and last_seen_at is not null")
    e = e.select("event_id", F.col("main_country").alias("country"), F.col("last_seen_at").alias("seen_at"), F.col("title").alias("e_title"), F.col("category").alias("e_category"), "source_code")
    near = M.paired(M.match_forms(items, "title"), M.match_forms(_event_sides(spark, sf_dir, e), "e_title", "e_"))
    return M.match_events(M.likely(near))


def alert_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best event of another source for each disaster article within seven days: time, tags and distance.

    Where both have tags, one must be shared; where either has no point, its
    distance counts as unknown.
    """
    a = _articles(spark, sf_dir).filter("category = 'disaster' and country is not null and crawled_at is not null")
    points = article_locations(_articles(spark, sf_dir))
    items = a.select(F.col("article_id").alias("item_id"), "country", F.col("crawled_at").alias("at"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.lower("source_code").alias("src")).join(points.withColumnRenamed("article_id", "item_id"), "item_id", "left")
    first = links(spark, sf_dir).join(points, "article_id").groupBy("event_id").agg(F.min(F.struct("article_id", "lat", "lng")).alias("p"))
    tags = links(spark, sf_dir).join(_articles(spark, sf_dir).select("article_id", F.explode("tags").alias("t")), "article_id").groupBy("event_id").agg(F.collect_set("t").alias("e_tags"))  # a bounded vocabulary
    events = table(spark, sf_dir, "news_events").filter("main_country is not null and last_seen_at is not null").select("event_id", F.col("main_country").alias("country"), F.col("last_seen_at").alias("seen_at"), "category", F.lower("source_code").alias("e_src"))
    near = M.window_candidates(items, events.join(first, "event_id", "left").join(tags, "event_id", "left"), 24 * 7, 100)
    shared = F.coalesce(F.arrays_overlap("tags", "e_tags"), F.lit(False))
    near = near.filter(~F.coalesce(F.col("src") == F.col("e_src"), F.lit(False))).filter(shared | (F.size("tags") == 0) | F.col("e_tags").isNull())
    km = V.haversine_km(F.col("lat"), F.col("lng"), F.col("p.lat"), F.col("p.lng"))
    hours = F.abs(F.unix_timestamp("seen_at") - F.unix_timestamp("at")) / 3600
    score = F.round(M.enrichment_score(hours, shared, km, F.col("lat").isNotNull() & F.col("p.lat").isNotNull(), F.col("category") == "disaster"), 6)
    best = near.withColumn("score", score).filter("score >= 0.45").groupBy("item_id").agg(F.max(F.struct("score", "seen_at", (-F.col("event_id")).alias("n"))).alias("b"))
    return best.select(F.col("item_id").alias("article_id"), (-F.col("b.n")).alias("event_id"), F.col("b.score").alias("score"))


def title_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of alike titles within 24 hours, over all sources, in order of time."""
    a = _articles(spark, sf_dir).filter("title is not null and crawled_at is not null")
    return M.fold_clusters(M.alike_groups(a.select(F.col("article_id").alias("item_id"), F.col("crawled_at").alias("at"), "title")))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First kept article of alike titles, over all sources and days."""
    return alike_titles.near_duplicates(_articles(spark, sf_dir).filter("title is not null").select(F.col("article_id").alias("item_id"), "title"))


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry merged with what articles say about their source."""
    seen = _articles(spark, sf_dir).filter("source_code is not null").select(F.lower("source_code").alias("code"), F.col("source_name").alias("name"), "freshness_sla_hours", "source_tier_level")
    return M.merge_by_key(table(spark, sf_dir, "news_sources"), seen, "code", {"name": "keep", "freshness_sla_hours": "greatest", "source_tier_level": "new"})


def behind_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream events behind a cursor, and where the next cursor stands, by type."""
    e = M.cursor_skip(table(spark, sf_dir, "events"), F.col("ts"), F.col("event_id"), "2024-01-15 12:00:00", "1")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("cursor_at"), F.max_by("event_id", F.struct("ts", "event_id")).alias("cursor_id"))


#: Scripts written without blanks between words, and the dots inside their names.
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\u30fc]"
_DOTS = r"[\u00b7\u2022\u2027\u30fb\uff65]"
_IN_RUN = r"[\p{L}\p{M}\p{N}\u00b7]"


def region_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the dictionary of which a name or alias stands in an article's title, summary or content, with the first place it stands.

    Word groups of the texts, up to the longest name, meet the dictionary in an
    equi-join, and so do the substrings of runs in scripts without blanks;
    texts are never searched name by name.
    """
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}-]+", " "))
    runs = lambda c: F.regexp_replace(F.lower(c), _DOTS, "\u00b7")
    names = table(spark, sf_dir, "admin1_regions").select("geojson_key", F.explode(F.concat(F.array("admin1_name", "admin1_name_ascii", "admin1_name_zh"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    names = names.withColumn("run", runs(F.trim("name"))).withColumn("inside", F.col("run").rlike(rf"^{_IN_RUN}+$") & F.col("run").rlike(_CJK))
    names = cut(names.select("geojson_key", "inside", F.when(F.col("inside"), F.col("run")).otherwise(words(F.col("name"))).alias("gram")).filter("gram <> ''").distinct())
    sizes = names.select("inside", F.when(F.col("inside"), F.length("gram")).otherwise(F.size(F.split("gram", " "))).alias("n")).distinct().collect()
    counts = lambda inside: f"cast(array({', '.join(str(n) for n in sorted(r.n for r in sizes if r.inside == inside))}) as array<int>)"
    texts = _articles(spark, sf_dir).select("article_id", F.explode(F.expr("array(struct(0 as place, title as text), struct(1 as place, summary as text), struct(2 as place, content as text))")).alias("x")).select("article_id", "x.place", "x.text").filter("text is not null")
    grams = []
    if not all(r.inside for r in sizes) or not sizes:
        grams.append(texts.select("article_id", "place", F.split(words(F.col("text")), " ").alias("w")).select("article_id", "place", F.lit(False).alias("inside"), F.explode(F.expr(f"array_distinct(flatten(transform({counts(False)}, n -> if(size(w) < n, cast(array() as array<string>), transform(sequence(0, size(w) - n), i -> array_join(slice(w, i + 1, n), ' '))))))")).alias("gram")))
    if any(r.inside for r in sizes):
        each = texts.filter(F.col("text").rlike(_CJK)).select("article_id", "place", F.explode(F.array_distinct(F.regexp_extract_all(runs(F.col("text")), F.lit(f"{_IN_RUN}*{_CJK}{_IN_RUN}*"), F.lit(0)))).alias("r"))
        grams.append(each.select("article_id", "place", F.lit(True).alias("inside"), F.explode(F.expr(f"array_distinct(flatten(transform({counts(True)}, n -> if(length(r) < n, cast(array() as array<string>), transform(sequence(1, length(r) - n + 1), i -> substring(r, i, n))))))")).alias("gram")))
    near = small_side(names)
    hits = None
    for g in grams:
        found = g.join(near, ["inside", "gram"]).select("article_id", "geojson_key", "place")
        hits = found if hits is None else hits.unionByName(found)
    first = hits.groupBy("article_id", "geojson_key").agg(F.min("place").alias("place"))
    return first.select("article_id", "geojson_key", F.when(F.col("place") == 0, "title").when(F.col("place") == 1, "summary").otherwise("content").alias("position"))


def title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap of each linked article's title with its event's title, in every language."""
    a = _articles(spark, sf_dir).select("article_id", F.col("title").alias("t"))
    e = table(spark, sf_dir, "news_events").select("event_id", F.col("title").alias("et"))
    return links(spark, sf_dir).join(a, "article_id").join(e, "event_id").filter("t is not null and et is not null").select("event_id", "article_id", F.round(T.jaccard(T.title_tokens(F.col("t")), T.title_tokens(F.col("et"))), 6).alias("overlap"))


QUERIES = {f.__name__: f for f in [
    earlier_copies, event_matches, alert_enrichment, title_clusters, near_duplicates, merged_sources, behind_cursor, region_mentions, title_jaccard,
]}

SQL = {
    "earlier_copies": "WITH u AS ({url}), a AS (SELECT article_id, hash, u.url AS url, canonical_url FROM news_articles JOIN u USING (article_id)), m AS (SELECT article_id, nullif(min(article_id) OVER (PARTITION BY hash), CASE WHEN coalesce(hash, '') = '' THEN min(article_id) OVER (PARTITION BY hash) END) AS h, CASE WHEN coalesce(url, '') <> '' THEN min(article_id) OVER (PARTITION BY url) END AS u, CASE WHEN coalesce(canonical_url, '') <> '' THEN min(article_id) OVER (PARTITION BY canonical_url) END AS c FROM a) SELECT article_id, coalesce(h, u, c) AS first_id, CASE WHEN h IS NOT NULL THEN 'hash' WHEN u IS NOT NULL THEN 'url' ELSE 'canonical_url' END AS kind FROM m WHERE coalesce(h, u, c) < article_id",
    "title_jaccard": f"SELECT event_id, article_id, round(CASE WHEN len(list_distinct(a || b)) > 0 THEN CAST(len(list_intersect(list_distinct(a), list_distinct(b))) AS DOUBLE) / len(list_distinct(a || b)) ELSE 0 END, 6) AS overlap FROM (SELECT event_id, article_id, {tokens_sql('n.title')} AS a, {tokens_sql('e.title')} AS b FROM (SELECT DISTINCT event_id, article_id FROM event_articles) JOIN news_articles n USING (article_id) JOIN news_events e USING (event_id) WHERE n.title IS NOT NULL AND e.title IS NOT NULL)",
    "merged_sources": "SELECT coalesce(s.code, a.code) AS code, coalesce(s.name, a.name) AS name, greatest(s.freshness_sla_hours, a.f) AS freshness_sla_hours, coalesce(a.l, s.source_tier_level) AS source_tier_level FROM news_sources s FULL JOIN (SELECT lower(source_code) AS code, max(source_name) AS name, max(freshness_sla_hours) AS f, max(source_tier_level) AS l FROM news_articles WHERE source_code IS NOT NULL GROUP BY 1) a ON s.code = a.code",
    "behind_cursor": "SELECT event_type, count(*) AS n, max(ts) AS cursor_at, arg_max(event_id, (ts, event_id)) AS cursor_id FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00' OR (ts = TIMESTAMP '2024-01-15 12:00:00' AND CAST(event_id AS VARCHAR) <> '1') GROUP BY event_type",
    "region_mentions": r"""WITH raw AS (SELECT geojson_key, unnest([admin1_name, admin1_name_ascii, admin1_name_zh] || coalesce(aliases, [])) AS n FROM admin1_regions),
        r AS (SELECT geojson_key, n, regexp_replace(lower(trim(n)), '[\x{00b7}\x{2022}\x{2027}\x{30fb}\x{ff65}]', '·', 'g') AS run FROM raw WHERE n IS NOT NULL),
        i AS (SELECT geojson_key, n, run, regexp_full_match(run, '[\pL\pM\pN\x{00b7}]+') AND regexp_matches(run, '[\p{Han}\p{Hiragana}\p{Katakana}\x{30fc}]') AS inside FROM r),
        names AS (SELECT DISTINCT geojson_key, inside, CASE WHEN inside THEN run ELSE trim(regexp_replace(lower(n), '[^\pL\pM\pN-]+', ' ', 'g')) END AS gram FROM i),
        t AS (SELECT article_id, 0 AS place, title AS text FROM news_articles UNION ALL SELECT article_id, 1, summary FROM news_articles UNION ALL SELECT article_id, 2, content FROM news_articles),
        w AS (SELECT article_id, place, ' ' || trim(regexp_replace(lower(text), '[^\pL\pM\pN-]+', ' ', 'g')) || ' ' AS words, regexp_replace(lower(text), '[\x{00b7}\x{2022}\x{2027}\x{30fb}\x{ff65}]', '·', 'g') AS run FROM t WHERE text IS NOT NULL),
        h AS (SELECT article_id, geojson_key, place FROM w JOIN names ON contains(words, ' ' || gram || ' ') WHERE NOT inside AND gram <> '' UNION ALL SELECT article_id, geojson_key, place FROM w JOIN names ON contains(run, gram) WHERE inside)
        SELECT article_id, geojson_key, CASE min(place) WHEN 0 THEN 'title' WHEN 1 THEN 'summary' ELSE 'content' END AS position FROM h GROUP BY article_id, geojson_key""",
}

SQL["earlier_copies"] = SQL["earlier_copies"].format(url=_ARTICLE_SQL["normal_urls"])
