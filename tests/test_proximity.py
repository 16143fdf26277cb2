import math
import random

from tidewire.operators import blocks, proximity as P


def dist(a, b):
    (x, y), (u, v) = ((math.radians(p) for p in q) for q in (a, b))
    h = math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    centres = [(0, 0), (51.5, 7.2), (-33.1, 179.999), (-33.1, -179.999), (89.995, 10), (-89.99, -100), (66.6, -180), (12.34, 56.78)]
    pts = {(round(min(90, max(-90, la + rng.uniform(-0.03, 0.03))), 5), round((lo + rng.uniform(-0.05, 0.05) / max(0.02, math.cos(math.radians(la))) + 180) % 360 - 180, 5)) for la, lo in centres for _ in range(40)}
    pts = sorted(pts | {(90.0, 0.0), (90.0, 77.0), (-90.0, 5.0)})
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "lat double, lng double")
    for radius in (2.0, 500.0):
        got = {((r.lat, r.lng), (r.lat2, r.lng2)) for r in P.near_pairs(df, radius).collect()}
        want = {(a, b) for i, a in enumerate(pts) for b in pts[i + 1 :] if dist(a, b) <= radius}
        assert got == want


def test_hot_point_is_expanded_in_blocks(spark):
    rows = [(i, 1.0, 2.0) for i in range(60)] + [(100 + i, 1.001, 2.0) for i in range(5)] + [(7, 1.0, 2.0)]
    located = spark.createDataFrame(rows, "article_id long, lat double, lng double").distinct()
    pairs = P.near_pairs(located.select("lat", "lng").distinct(), 2.0)
    got = P.expand_pairs(located, pairs, block=7)
    assert got.count() == got.distinct().count() == 65 * 64 // 2
    assert got.filter("id_a >= id_b").count() == 0


def test_locations(spark):
    geo = "array<struct<name: string, precision_level: string, lat: double, lng: double>>"
    rows = [
        (1, '{"type":"Point","coordinates":["18.5","-6.1"]}', None, None), (2, '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2.5,9]}}', None, None), (3, '{"lat":"4.5","lng":3}', None, None),
        (4, '{"type":"Point","coordinates":[0,0]}', "[10, 20, 12, 24]", None), (5, '{"type":"Polygon","coordinates":[[[1,2],[3,4]]]}', "[179, 0, -179, 2]", None), (6, '{"type":"Point","coordinates":[200,5]}', None, [("a", "CITY", 1.0, 1.0), ("b", "POINT", 7.0, 8.0)]),
        (7, "not json", "[1,2]", None), (8, None, None, None), (9, '{"lat":null,"lng":null}', "[1, 2, null, 4]", [None]), (10, '{"type":"Point","coordinates":[]}', "", []), (11, "{}", "[170, 10, -170, 10]", None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"article_id long, display_geo string, bbox string, geo_entities {geo}, lat string")
    got = {r.article_id: (r.lat, r.lng) for r in P.article_locations(df).collect()}
    assert got == {1: (-6.1, 18.5), 2: (2.5, 1.5), 3: (4.5, 3.0), 4: (22.0, 11.0), 5: (1.0, -180.0), 6: (7.0, 8.0), 11: (10.0, -180.0)}
    assert P.article_locations(df.limit(0)).count() == 0


def test_regions_with_holes_parts_and_the_180th_meridian(spark):
    sq = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    shapes = [
        ("hole", str({"type": "Polygon", "coordinates": [sq(0, 0, 10), sq(4, 4, 2)[::-1]]}).replace("'", '"')), ("parts", str({"type": "MultiPolygon", "coordinates": [[sq(20, 0, 2)], [sq(30, -5, 2)]]}).replace("'", '"')),
        ("turn", '{"type":"Polygon","coordinates":[[[178,0],[-178,0],[-178,3],[178,3],[178,0]]]}'), ("bad", "nonsense"), ("none", None), (None, None),
    ]
    pts = [(1.0, 1.0), (5.0, 5.0), (1.0, 21.0), (-4.0, 31.0), (1.0, 25.0), (1.5, 179.0), (1.5, -179.0), (1.5, 170.0)]
    got = {(r.lat, r.lng, r.key) for r in P.containing_regions(spark.createDataFrame(pts, "lat double, lng double"), spark.createDataFrame(shapes, "geojson_key string, geometry string")).collect()}
    assert got == {(1.0, 1.0, "hole"), (1.0, 21.0, "parts"), (-4.0, 31.0, "parts"), (1.5, 179.0, "turn"), (1.5, -179.0, "turn")}


def test_differing_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None, "c"]), rng.choice(["x", "y", "z", None])) for i in range(120)] + [(500 + i, "one", "same") for i in range(50)]
    got = {(r.g, r.id_a, r.id_b) for r in blocks.differing_pairs(spark.createDataFrame([(*r, 1) for r in rows], "i long, g string, v string, _nb int"), ["g"], "i", "v", block=5).collect()}
    want = {(g, i, j) for i, g, v in rows for j, h, w in rows if i < j and g == h and g is not None and v is not None and w is not None and v != w}
    assert got == want
