"""Whole jobs against brute force: no source, day, language or text is left out."""

import difflib
import random

from pyspark.sql import functions as F

from tidewire.operators import alike_titles
from tidewire.operators import matching as M
from tidewire.plans import articles, matching


def test_title_clusters_over_sources_and_midnight(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(1, "a", "2026-01-01 23:50:00", "Port talks resume again"), (2, "b", "2026-01-02 00:10:00", "port  talks resume again now"), (3, None, "2026-01-02 09:00:00", "port talks resume again"), (4, "a", "2026-01-03 00:00:00", " "), (5, "a", "2026-01-03 00:00:00", " ")]
    rows += [(i, rnd.choice("abc"), f"2026-01-{rnd.randint(1, 6):02} {rnd.randint(0, 23):02}:00:00", " ".join(rnd.sample("one two three four five six seven eight".split(), rnd.randint(2, 6)))) for i in range(6, 200)]
    df = spark.createDataFrame(rows, "article_id long, source_code string, crawled_at string, title string").withColumn("crawled_at", F.col("crawled_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "news_articles.parquet"))
    heads, want = [], {}
    for r in sorted(df.collect(), key=lambda r: (r.crawled_at, r.article_id)):
        w = set(r.title.lower().split())
        found = next((i for i, at, x in heads if w and x and (r.crawled_at - at).total_seconds() <= 86400 and len(w & x) / len(w | x) >= 0.6), None)
        if found is None:
            heads.append((r.article_id, r.crawled_at, w))
        want[r.article_id] = found or r.article_id
    assert {r.item_id: r.cluster_id for r in matching.title_clusters(spark, str(tmp_path)).collect()} == want


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(101, 100)]
    got = {r.id: r.root for r in M.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {101: 100}


def test_near_duplicates_of_all_sources_and_days(spark, tmp_path):
    rnd = random.Random(5)
    base = ["strong tremor shakes sanibu koza, 922 homes damaged", "科布库塔福议会通过防洪方案", "début des travaux à l’hôpital de nasada", "x" * 70 + "abc"]
    rows = [(1, "a", "2026-01-01", "Port talks resume"), (2, "b", "2026-02-01", "port talks resume!"), (3, None, None, " Port talks resume\u3000"), (4, "a", "2026-01-01", " "), (5, "a", "2026-01-01", "")]
    for i in range(6, 260):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 9)):
            t[rnd.randrange(len(t))] = rnd.choice(["", "e", "议", "s ", "1"])
        rows.append((i, rnd.choice("abc"), f"2026-01-{i % 28 + 1:02}", "".join(t)))
    df = spark.createDataFrame(rows, "article_id long, source_code string, crawled_at string, title string").withColumn("crawled_at", F.col("crawled_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "news_articles.parquet"))
    kept, want = [], {}
    for i, _, _, title in rows:
        t = title.lower().strip()
        found = next((k for k, o in kept if t and o and (t == o or difflib.SequenceMatcher(None, t, o).ratio() >= 0.85)), None)
        if found is None:
            kept.append((i, t))
        want[i] = found or i
    assert 20 < len(kept) < 250 and (want[2], want[3], want[5]) == (1, 1, 5)
    assert {r.item_id: r.kept_id for r in matching.near_duplicates(spark, str(tmp_path)).collect()} == want
    items = df.select(F.col("article_id").alias("item_id"), "title")
    assert {r.item_id: r.kept_id for r in alike_titles.near_duplicates(items, chunk=40).collect()} == want


def test_title_jaccard_of_every_language(spark, tmp_path):
    titles = [(1, "en", "Port talks resume"), (2, "zh", "新医院动工 2026"), (3, "de", "Port Gespräche resume"), (4, None, "Port talks"), (5, "en", None)]
    spark.createDataFrame(titles, "article_id long, language string, title string").write.parquet(str(tmp_path / "news_articles.parquet"))
    spark.createDataFrame([(1, "Port talks resume"), (2, "新医院动工"), (3, None)], "event_id long, title string").write.parquet(str(tmp_path / "news_events.parquet"))
    spark.createDataFrame([(1, 1), (1, 1), (2, 2), (1, 3), (1, 4), (1, 5), (3, 1)], "event_id long, article_id long").write.parquet(str(tmp_path / "event_articles.parquet"))
    # "Gespräche" is read as gespr and che: the tokens are runs of a-z, digits and Chinese characters
    assert {(r.event_id, r.article_id): r.overlap for r in matching.title_jaccard(spark, str(tmp_path)).collect()} == {(1, 1): 1.0, (2, 2): 0.5, (1, 3): 0.4, (1, 4): 0.666667}


def test_title_tokens_of_every_language(spark, tmp_path):
    titles = [("en", "Port talks"), ("zh", "新医院 动工"), ("de", "Port Talks"), (None, "the port 动工"), ("ru", None)]
    spark.createDataFrame(titles, "language string, title string").write.parquet(str(tmp_path / "news_articles.parquet"))
    got = [(r.token, r.n) for r in articles.title_token_counts(spark, str(tmp_path)).collect()]
    assert got == [("port", 3), ("talks", 2), ("动工", 2), ("新医院", 1)]


def test_region_mentions_by_every_name_and_text(spark, tmp_path):
    regions = [("A", "Nord Pas Calais", "Nord Pas Calais", "诺尔省", ["诺尔", "Hauts"]), ("B", "L'Aquila", "L'Aquila", None, ["ラクイラ", ""]), ("C", "Kôši", "Kosi", "高西达", ["ネフ・ケディ", "Коши"]), ("D", "Abc", None, "", None)]
    spark.createDataFrame(regions, "geojson_key string, admin1_name string, admin1_name_ascii string, admin1_name_zh string, aliases array<string>").write.parquet(str(tmp_path / "admin1_regions.parquet"))
    texts = [(1, "Storm in nord pas  calais", None, "Hauts"), (2, "昨日诺尔发生地震", "在高西达附近", "诺尔省"), (3, "x", "y", "Quake near l’aquila and Коши."), (4, "今日のラクイラで", "ネフ･ケディの", None), (5, "xabc北京", "诺，尔", "Nord Calais"), (6, None, None, None)]
    spark.createDataFrame(texts, "article_id long, title string, summary string, content string").write.parquet(str(tmp_path / "news_articles.parquet"))
    got = {(r.article_id, r.geojson_key, r.position) for r in matching.region_mentions(spark, str(tmp_path)).collect()}
    assert got == {(1, "A", "title"), (2, "A", "title"), (2, "C", "summary"), (3, "B", "content"), (3, "C", "content"), (4, "B", "title"), (4, "C", "summary")}


def test_bare_code_that_many_countries_share(spark):
    from tidewire.llm import place_match

    codes = [f"Q{c}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"] + [f"X{c}" for c in "ABCD"]
    regions = [(c, c, "7", f"Zedonuth{c}ba", None, None, None, f"{c}.7") for c in codes]
    ref = spark.createDataFrame(regions, "country_code string, country_name string, admin1_code string, admin1_name string, admin1_name_ascii string, admin1_name_zh string, aliases array<string>, geojson_key string")
    entries = spark.createDataFrame([("7", "QC"), ("7", "XD"), ("7", None)], "name string, country_code string")
    assert {(r.country_code, r.geojson_key) for r in place_match.map_entries(entries, ref).collect()} == {("QC", "QC.7"), ("XD", "XD.7"), (None, "UNMATCHED")}
