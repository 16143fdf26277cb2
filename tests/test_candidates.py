"""Candidates by place against brute force; bounds that lose no match."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import matching as M

ITEM = "item_id long, country string, at timestamp, title string, category string, tags array<string>, tier string, keys array<string>"
EVENT = "event_id long, country string, seen_at timestamp, e_title string, e_category string, e_tags array<string>, e_tier string, e_keys array<string>"


def _rows(rnd, n, days, titles):
    """Rows in few countries, crowded on some days and with equal times; some without country, time or title."""
    start = dt.datetime(2026, 1, 1)
    pick = lambda some: None if rnd.random() < 0.1 else some()
    when = lambda: start + dt.timedelta(hours=rnd.choice(days) * 24 + rnd.randint(0, 47) / 2)
    return [
        (i, pick(lambda: rnd.choice("AAAB")), pick(when), pick(lambda: titles(rnd)), pick(lambda: rnd.choice("xy")), pick(lambda: [rnd.choice(["ai", " AI", "war", "", None]) for _ in range(rnd.randint(0, 4))]),
         pick(lambda: rnd.choice(["official", " Social", "odd"])), pick(lambda: [rnd.choice(["A", "A:1", "A:12", "B:1", "A1::x", "", None]) for _ in range(rnd.randint(0, 3))]))
        for i in range(n)
    ]


def _titles(rnd):
    t = rnd.choice(["Strong tremor shakes Sanibu Koza, 922 homes damaged", "科布库塔福议会通过防洪方案", "Début des travaux à l’hôpital de Nasada", "aaaaaaaa eeeeeeee", "Port talks", "!!"])
    t = "".join(rnd.choice(["", "e", "议", " 1"]) if rnd.random() < 0.08 else c for c in t)
    return t + rnd.choice(["", "", " - BBC", " again in Tokyo 😀"])


def test_candidates_are_the_latest_of_the_window(spark):
    rnd = random.Random(11)
    items, events = _rows(rnd, 300, [0, 1, 4, 5, 9, 30], _titles), _rows(rnd, 400, [0, 1, 2, 5, 8, 12], _titles)
    want = set()
    for i in items:
        near = [e for e in events if i[1] and i[2] and e[2] and e[1] == i[1] and dt.timedelta(0) <= i[2] - e[2] <= dt.timedelta(hours=72)]
        want |= {(i[0], e[0]) for e in sorted(near, key=lambda e: (i[2] - e[2], e[0]))[:7]}
    items, events = spark.createDataFrame(items, ITEM), spark.createDataFrame(events, EVENT)
    got = [(r.item_id, r.event_id) for r in M.window_candidates(items, events, most=7).select("item_id", "event_id").collect()]
    assert len(want) > 500 and len(got) == len(want) and set(got) == want


def test_pairs_are_not_moved(spark):
    rnd = random.Random(12)
    items, events = spark.createDataFrame(_rows(rnd, 50, [0], _titles), ITEM), spark.createDataFrame(_rows(rnd, 50, [0], _titles), EVENT)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.window_candidates(items, events)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[: plan.index("SortMergeJoin")]
    assert "Exchange" not in above and "Window" not in above


def test_bounds_lose_no_match(spark):
    rnd = random.Random(13)
    items, events = M.numbered(spark.createDataFrame(_rows(rnd, 250, [0, 1], _titles), ITEM), spark.createDataFrame(_rows(rnd, 250, [0, 1], _titles), EVENT))
    plain = M.paired(M.title_forms(items, "title"), M.title_forms(events, "e_title", "e_"))
    near = M.paired(M.match_forms(items, "title"), M.match_forms(events, "e_title", "e_")).localCheckpoint()
    likely = M.likely(near).localCheckpoint()
    rows = lambda df: {tuple(r) for r in df.collect()}
    want = rows(M.match_events(plain))
    assert len(want) > 100 and rows(M.match_events(likely)) == want
    assert likely.count() < near.count() / 2
    # each bound against the exact value, pair by pair
    exact = near.select(T.most_letters(F.col("bag"), F.col("e_bag")).alias("letters"), T.sequence_ratio("x", "e_x").alias("ratio"), (F.col("n") + F.col("e_n")).alias("both"), T.most_words(F.col("token_bits"), F.col("e_token_bits")).alias("most"), F.size(F.array_intersect("tokens", "e_tokens")).alias("shared"))
    assert exact.filter("2 * letters < ratio * both - 1e-9 or most < shared").count() == 0


def test_words_that_share_a_bit(spark):
    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(words, words[100:]), ([], words), (["a"], ["b"])], "a array<string>, b array<string>")
    got = [r.n for r in df.select(T.most_words(T.word_bits(F.col("a")), T.word_bits(F.col("b"))).alias("n")).collect()]
    assert got[0] >= 200 and got[1] == 0 and got[2] <= 1


def test_every_event_of_the_window_is_a_candidate(spark):
    rnd = random.Random(14)
    items, events = _rows(rnd, 200, [0, 1, 4, 5, 9, 30], _titles), _rows(rnd, 900, [0, 1, 2, 5, 8, 12], _titles)
    near = lambda i, e: i[1] and i[2] and e[2] and e[1] == i[1] and dt.timedelta(0) <= i[2] - e[2] <= dt.timedelta(hours=72)
    want = {(i[0], e[0]) for i in items for e in events if near(i, e)}
    got = [(r.item_id, r.event_id) for r in M.window_candidates(spark.createDataFrame(items, ITEM), spark.createDataFrame(events, EVENT)).select("item_id", "event_id").collect()]
    assert max(sum(p[0] == i[0] for p in want) for i in items) > 200 and len(got) == len(want) and set(got) == want


def test_match_behind_hundreds_of_later_events(spark, data, tmp_path):
    from pyspark.sql.types import StructField, StructType

    from tidewire.plans import matching as P

    for name in ("news_articles", "news_events", "news_sources", "event_articles"):
        df = spark.read.parquet(f"{data}/{name}.parquet").limit(0)
        schema = StructType([StructField(f.name, f.dataType) for f in df.schema])
        at = dt.datetime(2026, 1, 5)
        given = {
            "news_articles": [{"article_id": 1, "country": "A", "crawled_at": at, "title": "Ferry to Tobala Gune sails again", "category": "transport"}],
            "news_events": [{"event_id": 1, "main_country": "A", "last_seen_at": at - dt.timedelta(hours=72), "title": "Ferry to Tobala Gune sails again", "category": "transport"}]
            + [{"event_id": 2 + i, "main_country": "A", "last_seen_at": at - dt.timedelta(minutes=i), "title": f"Grain {i}", "category": "economy"} for i in range(300)],
        }.get(name, [])
        spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in given], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [(r.item_id, r.event_id) for r in P.event_matches(spark, str(tmp_path)).collect()] == [(1, 1)]
