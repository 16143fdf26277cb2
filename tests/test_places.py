import random

from tidewire.operators import places as P

REGIONS = "country_code string, country_name string, admin1_code string, admin1_name string, admin1_name_ascii string, admin1_name_zh string, aliases array<string>, geojson_key string, lat double, lng double"
ROWS = [
    ("QA", "Arvonia", "01", "North Vale", "North Vale", "北谷省", ["Nordtal", None], "QA.01", 1.0, 2.0), ("QA", "Arvonia", "02", "Kesso State", "Kesso", None, [], "QA.02", 1.5, 2.5),
    ("QB", "Belmar", "01", "Kesso", "Kesso", "克索", None, "QB.01", 3.0, 4.0), ("QB", "Belmar", None, "Vale", "Vale", None, None, None, 3.0, 4.0), (None, None, None, None, None, None, None, None, None, None),
]
CITIES = [("QA:1", "Northport", "QA", "01", 1.0, 1.0, 900_000), ("QB:2", "Kesso", "QB", None, 2.0, 2.0, 10), ("QB:3", "Long Beach", "QB", None, 2.0, 2.0, 10), ("QB:4", "Solo", "QB", None, 2.0, 2.0, 10)]


def _table(spark):
    return P.name_table(spark.createDataFrame(ROWS, REGIONS), spark.createDataFrame(CITIES, "key string, name string, country_code string, admin1_code string, lat double, lng double, population long"))


def _brute(entries, name, wanted, hint):
    for spelled in dict.fromkeys([name.strip().lower(), name.split("(")[0].strip().lower()]):
        found = [e for e in entries if e["name"] == spelled]
        near = [e for e in found if hint is None or e["country_code"] == hint]
        cities = [e for e in near if e["kind"] == "city"] or [e for e in found if e["kind"] == "city" and (e["population"] >= 500_000 or " " in name or "-" in name or "'" in name or any("一" <= c <= "鿿" for c in name))]
        regions = [e for e in near if e["kind"] == "admin1"] or [e for e in found if e["kind"] == "admin1"]

        def score(e):
            s = {"city": 0.62, "admin1": 0.58, "country": 0.54}[e["kind"]] + (0.22 if e["kind"] == wanted else -0.08 if (wanted, e["kind"]) == ("admin1", "city") else -0.05 if (wanted, e["kind"]) == ("city", "admin1") else 0)
            s += 0.18 * (hint is not None and e["country_code"] == hint) + (e["kind"] == "city") * (0.10 if e["population"] >= 5e6 else 0.07 if e["population"] >= 1e6 else 0.04 if e["population"] >= 2e5 else 0)
            return round(s, 6)

        ranked = sorted(cities + regions + [e for e in found if e["kind"] == "country"], key=lambda e: (-score(e), e["key"]))
        if ranked:
            return ranked[0]["key"], score(ranked[0])
    return None


def test_resolve_equals_brute_force(spark):
    table = _table(spark)
    entries = [r.asDict() for r in table.collect()]
    rng = random.Random(3)
    names = ["Kesso", "kesso ", "North Vale", "Arvonia", "Belmar (south)", "Northport", "Solo", "Long Beach", "北谷", "北谷省", "克索", "Nordtal", "nowhere", "", "Kesso State", "Kesso(x)"]
    rows = [(i, rng.choice(names), rng.choice(["city", "admin1", "country"]), rng.choice([None, "QA", "QB", "ZZ"])) for i in range(300)] + [(999, None, "city", None)]
    got = {r.id: (r.key, r.score) for r in P.resolve(spark.createDataFrame(rows, "id int, name string, wanted string, hint string"), table, ["id"]).collect()}
    want = {i: b for i, n, w, h in rows if n and (b := _brute(entries, n, w, h))}
    assert got == want and len(want) > 200


def test_text_candidates(spark):
    rows = [(1, "Storm near North Vale hits Mar-a-Kesso and 临江省 today"), (2, "Anna Maria Keller spoke in Northport"), (3, None), (4, ""), (5, "the lake"), (6, "word " * 50_000)]
    got = {}
    for r in P.text_candidates(spark.createDataFrame(rows, "id int, t string"), "id", "t").orderBy("id", "at").collect():
        got.setdefault(r.id, []).append(r.name)
    assert got[1][:2] == ["临江省", "临江"] and {"North Vale", "North Vale hits", "Mar-a-Kesso", "Vale", "North", "Storm"} <= set(got[1]) and "near" not in got[1] and "today" not in got[1]
    assert "Maria" not in got[2] and {"Anna", "Keller", "Northport", "Anna Maria Keller"} <= set(got[2]) and not {3, 4} & set(got)


def test_running_hint_and_top(spark):
    rows = [(1, "Northport flooded; Kesso dry."), (2, "Belmar said Kesso is dry"), (3, "Kesso"), (4, None), (5, "北谷省，克索")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "article_id int, text string, name string")
    table = _table(spark)
    got = {}
    for r in P.places_in_texts(df, table).orderBy("article_id", "rank").collect():
        got.setdefault(r.article_id, []).append(r.key)
    # With a country before it, Kesso means that country's; alone, the city.
    assert got[1] == ["QA:1", "QA.02"] and got[2] == ["QB", "QB:2"] and got[3] == ["QB:2"] and got[5] == ["QA.01", "QB.01"] and 4 not in got
    assert P.places_in_texts(df.limit(0), table).count() == 0
    assert [r.rank for r in P.places_in_texts(df, table, most=1).collect()] == [0, 0, 0, 0]


def test_keys_and_kinds(spark):
    df = spark.createDataFrame([("qx.01",), ("QX_abc",), ("qx:9",), ("Qx",), ("",), (None,), ("longer",)], "k string")
    assert [r[0] for r in df.select(P.hint_of_key(df.k)).collect()] == ["QX", "QX", "QX", "QX", None, None, None]
    df = spark.createDataFrame([("临江市",), ("Vale County",), ("Vale province",), ("自治区",)], "n string")
    assert [r[0] for r in df.select(P.inferred_kind(df.n)).collect()] == ["city", "city", "admin1", "admin1"]
