import random

import numpy as np

from tidewire.llm import place_match as P
from tidewire.llm import survivor as S

REGIONS = [
    ("QA", "Vandoria", "01", "New Bakevañ", "New Bakevan", "新巴科瓦", ["Новый Бакеван", "", None], "QA.01"), ("QA", "Vandoria", "2", "South Zedonuth", "South Zedonuth", None, None, "QA.2"), ("QA", "Vandoria", "03", "North Zedonuth", "North Zedonuth", "北泽多努", [], "QA.03"),
    ("QA", "Vandoria", "04", "Siligur-Sobosesur", "Siligur-Sobosesur", "西里古索博塞苏", ["Силигур-Собосесур"], "QA.04"), ("QB", "Bolandia", "01", "Zikadoth", "Zikadoth", "齐卡多", ["ジカド"], "QB.01"), ("QC", "Corvia", "01", "Zikadoth", "Zikadoth", "齐卡多", ["Zikadoth"], "QC.01"),
    ("QB", "Bolandia", "05", "Saint Togavel", "Saint Togavel", "圣托加维", ["圣托加维省"], "QB.05"), (None, None, None, None, None, None, None, None),
]
NAMES = [
    ("New Bakevañ", "QA", "QA.01"), ("Province of New Bakevan", "QA", "QA.01"), ("N. Bakevañ", "QA", "QA.01"), ("Bakevan, New", "QA", "QA.01"), ("NewBakevan", "QA", "QA.01"), ("New Bakevañ, Vandoria", "QA", "QA.01"), ("new  bakevn", "QA", "QA.01"),
    ("НОВЫЙ БАКЕВАН", "QA", "QA.01"), ("新巴科瓦省", "QA", "QA.01"), ("新巴科瓦（省）", "QA", "QA.01"), ("Zikadoth地区", "QB", "QB.01"), ("齊卡多", "QB", "QB.01"), ("新 巴科瓦", "QA", "QA.01"), ("南瓦国新巴科瓦", "QA", "QA.01"), ("新巴科瓦 / New Bakevan", None, "QA.01"), ("QA.02", "QA", "QA.2"), ("qa-2", "QA", "QA.2"), ("S. Zedonuth (region)", "QA", "QA.2"),
    ("Nth Zedonuth prov.", "QA", "QA.03"), ("Siligur Sobosesur", "QA", "QA.04"), ("Siligr-Sobosesur", "QA", "QA.04"), ("Zikadoth", "QB", "QB.01"), ("Zikadoth", "QC", "QC.01"), ("Zikadoth", None, "UNMATCHED"), ("St. Togavel", "QB", "QB.05"), ("SaintTogael", "QB", "QB.05"),
    ("the Saint Togavel area", "QB", "QB.05"), ("Ｓａｉｎｔ Тogavel​", "QB", "QB.05"), ("Togavel City", "QB", "UNMATCHED"), ("Offshore", "QA", "UNMATCHED"), ("unknown", None, "UNMATCHED"), ("?", "QA", "UNMATCHED"), ("", "QA", "UNMATCHED"), (None, "QA", "UNMATCHED"),
    ("Zikadoth", "QA", "UNMATCHED"), ("全国", "QB", "UNMATCHED"), ("word " * 5000, "QA", "UNMATCHED"),
]


def test_places(spark):
    ref = spark.createDataFrame(REGIONS, "country_code string, country_name string, admin1_code string, admin1_name string, admin1_name_ascii string, admin1_name_zh string, aliases array<string>, geojson_key string")
    rows = [(i, n, c, "clash", 1) for i, (n, c, _) in enumerate(NAMES)]
    entries = spark.createDataFrame([*rows, rows[0]], "i long, name string, country_code string, key string, token int")
    found = P.map_entries(entries, ref).collect()
    assert len(found) == len(NAMES) + 1 and found[0].key == "clash"
    wrong = [(NAMES[r.i], r.geojson_key) for r in found if r.geojson_key != NAMES[r.i][2]]
    assert not wrong
    assert P.map_entries(entries.limit(0), ref).count() == 0
    assert {r.geojson_key for r in P.map_entries(entries, ref.limit(0)).collect()} == {"UNMATCHED"}


def test_edits():
    assert P.edit_distance("bakevan", "bakevna") == 1 and P.edit_distance("abc", "") == 3 and P.edit_distance("ca", "abc") == 3 and P.edit_distance("", "") == 0
    assert [P.allowed_edits(n) for n in (1, 2, 3, 5, 6, 9, 400)] == [0, 0, 1, 1, 2, 2, 2]
    for a, b in (("bakevan", "bakevna"), ("zikadoth", "zkiadoth")):
        assert set(P.deletion_keys(a)) & set(P.deletion_keys(b))


def test_random_typos_of_every_kind(spark):
    """One typo in a word of six letters or more: swap, loss, addition, replacement."""
    ref = spark.read.parquet("/root/testdata/sf0.01/admin1_regions.parquet")
    rng = random.Random(6)
    rows, truth = [], {}
    for r in ref.select("admin1_name_ascii", "country_code", "geojson_key").dropna().collect():
        words = r.admin1_name_ascii.split(" ")
        long = max(range(len(words)), key=lambda k: len(words[k]))
        w = words[long]
        if len(w) < 6 or not w.isalpha():
            continue
        kind = rng.choice(["swap", "loss", "addition", "replacement"])
        i = rng.randint(1, len(w) - 2)
        letter = rng.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c not in w[i : i + 2]])
        if kind == "swap" and w[i] == w[i + 1]:
            kind = "loss"
        words[long] = {"swap": w[:i] + w[i + 1] + w[i] + w[i + 2 :], "loss": w[:i] + w[i + 1 :], "addition": w[:i] + letter + w[i:], "replacement": w[:i] + letter + w[i + 1 :]}[kind]
        truth[len(rows)] = (kind, r.geojson_key)
        rows.append((len(rows), " ".join(words), r.country_code))
    found = {r.i: r.geojson_key for r in P.map_entries(spark.createDataFrame(rows, "i long, name string, country_code string"), ref).collect()}
    for kind in ("swap", "loss", "addition", "replacement"):
        of_kind = [i for i, (k, _) in truth.items() if k == kind]
        assert len(of_kind) > 25 and np.mean([found[i] == truth[i][1] for i in of_kind]) >= 0.95, kind


def test_names_of_common_words_only(spark):
    """A spelling whose tokens stand in very many entries is still met."""
    ref = [("QA", "Vandoria", str(k), f"North Lake {k:03d}x", f"North Lake {k:03d}x", None, None, f"QA.{k}") for k in range(60)] + [("QA", "Vandoria", "90", "North Lake", "North Lake", None, None, "QA.90")]
    ref = spark.createDataFrame(ref, "country_code string, country_name string, admin1_code string, admin1_name string, admin1_name_ascii string, admin1_name_zh string, aliases array<string>, geojson_key string")
    got = P.map_entries(spark.createDataFrame([("North Lake", "QA"), ("North Lake 007x", "QA")], "name string, country_code string"), ref).collect()
    assert {r.name: r.geojson_key for r in got} == {"North Lake": "QA.90", "North Lake 007x": "QA.7"}


ARTICLES = [
    (1, "u1", "a", " Official ", "2026-01-01T10:00Z", None, ["x"], None), (2, "u1", "B", "social", "2026-01-02T10:00Z", 5, ["x", "y"], []), (3, "u1", "b", None, "bad", 9, None, ["r"]),
    (4, "u2", "a", "Aggregator", "2026-01-01T10:00Z", None, [], None), (5, "u2", "b", "COMMUNITY", "2026-01-01T10:00Z", None, [""], None), (6, "u3", "a", "official", None, 1, ["z"], None), (7, None, "a", "official", None, 1, ["z"], None), (8, None, "a", None, None, 1, None, None),
    (9, "u4", None, None, None, None, None, None), (10, "u4", None, "", "2 hours ago", None, None, [None]),
]
SCHEMA = "article_id long, canonical_url string, source_code string, source_tier string, published_at string, heat_score int, tags array<string>, region_tags array<string>"


def test_survivors(spark):
    df = spark.createDataFrame([(*a, 7, "x") for a in ARTICLES], SCHEMA + ", rank int, field string")
    clocks = spark.createDataFrame([("a", "UTC", "DMY"), ("b", "UTC", "DMY")], "source_code string, tz_name string, date_order string")
    got = {r.canonical_url: (r.tier_id, r.published_id, r.heat_id, r.n_rows, r.source_tier, r.heat_score) for r in S.best_representatives(df, clocks).collect()}
    assert got == {"u1": (1, 2, 2, 3, "official", 5), "u2": (4, 4, 4, 2, "aggregator", None), "u4": (9, 9, 9, 2, None, None)}
    assert S.best_representatives(df.limit(0), clocks).count() == 0


def test_quality_model_finds_good_and_bad_sources(spark):
    rng = random.Random(4)
    quality = {"good": (0.9, 0.02), "shy": (0.35, 0.02), "wild": (0.6, 0.35)}
    rows, truth, i = [], {}, 0
    for g in range(400):
        true = set(rng.sample("abcdefgh", 3))
        truth[f"u{g}"] = true
        for s, (sens, false) in quality.items():
            rows.append((i := i + 1, f"u{g}", s, "social", None, 1, [v for v in "abcdefgh" if rng.random() < (sens if v in true else false)], None))
    df = spark.createDataFrame(rows, SCHEMA)
    groups = df.select("canonical_url").distinct()
    facts = S.claim_facts(df, groups, ["tags"])
    model = S.fit_quality(facts)
    at = model["index"]
    assert model["sensitivity"][at["good"]] > model["sensitivity"][at["shy"]] + 0.2
    assert model["false_rate"][at["wild"]] > model["false_rate"][at["good"]] + 0.1
    kept = {(r.canonical_url, r.value) for r in S.true_values(facts, model).collect()}
    named = {(r.canonical_url, r.value) for r in facts.collect()}
    right = np.mean([(k in kept) == (k[1] in truth[k[0]]) for k in named])
    assert right > 0.9
