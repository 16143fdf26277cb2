"""Points near other points, and the region around each point.

``article_locations`` reads the location of each article with built-in JSON
and cast expressions. ``near_pairs`` hashes the *distinct* points to cells of
latitude bands as high as the radius, whose longitude cells are wide enough
for the radius at that latitude, joins each point with its own and the
neighbouring cells (half of them: each unordered pair is met once) and
verifies the exact great-circle distance. ``expand_pairs`` turns point pairs
into pairs of ids: the members of a point are spread over blocks of bounded
size, so a point that holds a third of all rows becomes many equal tasks.
``containing_regions`` covers each polygon with one-degree cells, joins the
distinct points by cell and verifies by ray casting over all rings (even-odd,
so holes are outside).

Edge cases: null, incomplete, impossible (beyond 90 or 180 degrees) and (0, 0)
locations fall through to the next form and finally give no location; rows
without location give no output; empty tables give empty results; repeated
article rows give one location per distinct (id, point). Points on the 180th
meridian and at the poles are compared across it. Extra columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

EARTH_KM = 6371.0
#: Members of a point that one task pairs with one other block.
BLOCK = 500
#: Size in degrees of the cells that polygons are covered with.
REGION_CELL = 1.0

_GEO = "type string, lat string, lng string, lon string, coordinates string, geometry struct<type: string, coordinates: string>"


def _valid(lat: str, lng: str, zero_ok: bool = False) -> str:
    rule = f"{lat} between -90 and 90 and {lng} between -180 and 180"
    return rule if zero_ok else f"{rule} and not ({lat} = 0 and {lng} = 0)"


def article_locations(articles: DataFrame, id_col: str = "article_id") -> DataFrame:
    """(id, lat, lng) of each article that has a location.

    The point of ``display_geo`` (Point, Feature with a Point, lat/lng; numbers
    may be text), else the middle of ``bbox`` (west > east crosses the 180th
    meridian), else the first entry of ``geo_entities`` of precision POINT.
    """
    df = articles.select(
        F.col(id_col),
        F.from_json("display_geo", _GEO).alias("g"),
        F.transform(F.from_json("bbox", "array<string>"), lambda x: x.try_cast("double")).alias("b"),
        F.get(F.filter("geo_entities", lambda e: e.precision_level == "POINT"), F.lit(0)).alias("e"),
    )
    df = staged(df, xy=(
        "from_json(case when g.type = 'Point' then g.coordinates when g.type = 'Feature' and g.geometry.type = 'Point' then g.geometry.coordinates end, 'array<string>')"))
    df = df.select(
        id_col, "b",
        F.expr("coalesce(try_cast(get(xy, 0) as double), try_cast(coalesce(g.lng, g.lon) as double))").alias("gx"),
        F.expr("coalesce(try_cast(get(xy, 1) as double), try_cast(g.lat as double))").alias("gy"),
        F.expr("case when size(b) = 4 and get(b, 0) between -180 and 180 and get(b, 2) between -180 and 180 and get(b, 1) between -90 and 90 and get(b, 3) between -90 and 90"
               " then get(b, 0) + if(get(b, 0) > get(b, 2), get(b, 2) + 360 - get(b, 0), get(b, 2) - get(b, 0)) / 2 end").alias("bx"),
        F.expr("(get(b, 1) + get(b, 3)) / 2").alias("by"),
        F.col("e.lng").alias("ex"), F.col("e.lat").alias("ey"),
    )
    df = staged(df.withColumnRenamed("bx", "bx0"), bx="if(bx0 > 180, bx0 - 360, bx0)")
    pick = f"case when {_valid('gy', 'gx')} then struct(gy as lat, gx as lng) when {_valid('by', 'bx', True)} then struct(by as lat, bx as lng) when {_valid('ey', 'ex')} then struct(ey as lat, ex as lng) end"
    # -0.0 and 0.0 are one place, as are longitudes -180 and 180.
    return (
        staged(df, p=pick).filter("p is not null")
        .select(id_col, (F.col("p.lat") + 0.0).alias("lat"), F.expr("if(p.lng = 180, -180D, p.lng + 0.0)").alias("lng"))
    )


def haversine_km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """SQL text of the great-circle distance on a sphere of radius 6371 km."""
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return f"(2 * {EARTH_KM} * asin(least(1D, sqrt({a}))))"


def near_pairs(points: DataFrame, radius_km: float) -> DataFrame:
    """Pairs of distinct points (lat, lng) at most ``radius_km`` apart, smaller point first.

    ``points`` holds each point once. Any radius below a quarter of the
    circumference works; cells follow it.
    """
    height = math.degrees(radius_km / EARTH_KM) * (1 + 1e-9)
    half = math.sin(min(radius_km / (2 * EARTH_KM), 1.0))
    # Cells around the circle in a band: as many as are at least as wide as the radius
    # anywhere in the band and its two neighbours; one where the pole is within reach.
    top = f"(greatest(abs((b - 1) * {height!r}D - 90), abs((b + 2) * {height!r}D - 90)))"
    width = f"(if({top} >= 90 or {half!r}D >= cos(radians({top})), 360D, 2 * degrees(asin({half!r}D / cos(radians({top}))))))"
    n_cells = f"(greatest(1, cast(floor(360 / ({width} * (1 + 1e-9))) as bigint)))"
    cells = lambda b: n_cells.replace("(b ", f"({b} ")

    base = points.select("lat", "lng", F.expr(f"cast(floor((lat + 90) / {height!r}D) as bigint)").alias("b"))
    base = staged(staged(base, n=n_cells), c="least(n - 1, cast(floor((lng + 180) / 360 * n) as bigint))")
    right = base.select(F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.col("b").alias("band"), F.col("c").alias("cell"))
    probe = base.select("lat", "lng", F.explode(F.expr("array(b, b + 1)")).alias("band"))
    probe = staged(staged(probe, n=cells("band")), c="least(n - 1, cast(floor((lng + 180) / 360 * n) as bigint))")
    probe = probe.select("lat", "lng", "band", F.explode(F.expr("array_distinct(array(pmod(c - 1, n), c, pmod(c + 1, n)))")).alias("cell"))
    ordered = "(lat < lat2 or (lat = lat2 and lng < lng2))"
    return (
        probe.join(right, ["band", "cell"])
        .filter(ordered)
        .filter(f"{haversine_km('lat', 'lng', 'lat2', 'lng2')} <= {radius_km!r}D")
        .select("lat", "lng", "lat2", "lng2")
    )


def expand_pairs(located: DataFrame, pairs: DataFrame, id_col: str = "article_id", block: int = BLOCK) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of ids at one point or at two paired points.

    ``pairs`` holds pairs of different points. No task ever holds all members
    of a point: they are hashed into ``ceil(count / block)`` blocks, and blocks
    are paired with blocks.
    """
    members = located.select("lat", "lng", F.col(id_col).alias("id"))
    sizes = members.groupBy("lat", "lng").agg(F.expr(f"cast(ceil(count(*) / {block}) as bigint)").alias("nb"))
    blocked = members.join(sizes, ["lat", "lng"]).withColumn("blk", F.expr("pmod(xxhash64(id), nb)")).drop("nb")
    one = sizes.select("lat", "lng", "nb", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.col("nb").alias("nb2"))
    two = pairs.join(sizes, ["lat", "lng"]).join(sizes.select(F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.col("nb").alias("nb2")), ["lat2", "lng2"])
    links = one.unionByName(two.select(*one.columns))
    links = links.select("lat", "lng", "lat2", "lng2", F.explode(F.expr("sequence(0L, nb - 1)")).alias("blk"), "nb2")
    links = links.select("lat", "lng", "lat2", "lng2", "blk", F.explode(F.expr("sequence(0L, nb2 - 1)")).alias("blk2"))
    left = links.join(blocked, ["lat", "lng", "blk"]).select(F.col("id").alias("id_a"), "lat", "lng", "lat2", "lng2", "blk2")
    right = blocked.select(F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.col("blk").alias("blk2"), F.col("id").alias("id_b"))
    joined = left.join(right, ["lat2", "lng2", "blk2"])
    same = "(lat = lat2 and lng = lng2)"
    return joined.filter(f"if({same}, id_a < id_b, id_a <> id_b)").select(F.expr("least(id_a, id_b)").alias("id_a"), F.expr("greatest(id_a, id_b)").alias("id_b"))


def region_edges(shapes: DataFrame, key_col: str = "geojson_key", geometry_col: str = "geometry") -> DataFrame:
    """(key, edges, box) of each readable Polygon or MultiPolygon; all rings' edges together."""
    g = shapes.select(F.col(key_col).alias("key"), F.from_json(geometry_col, "type string, coordinates string").alias("g"))
    rings = staged(g, rings=(
        "case when g.type = 'Polygon' then from_json(g.coordinates, 'array<array<array<double>>>')"
        " when g.type = 'MultiPolygon' then flatten(from_json(g.coordinates, 'array<array<array<array<double>>>>')) end")).filter("rings is not null")
    edges = F.expr("flatten(transform(rings, r -> transform(sequence(1, greatest(size(r) - 1, 1)), i -> struct(r[i - 1][0] as x1, r[i - 1][1] as y1, get(r, i)[0] as x2, get(r, i)[1] as y2))))")
    out = staged(rings.select("key", "rings"), edges=F.filter(edges, lambda e: e.x2.isNotNull() & e.y2.isNotNull())).filter("size(edges) > 0").drop("rings")
    # A ring that crosses the 180th meridian has longitudes on both sides of it: its west part is moved by a full turn.
    out = staged(out.withColumnRenamed("edges", "raw"), cross="array_max(transform(raw, e -> abs(e.x2 - e.x1))) > 180")
    out = staged(out, edges=("if(cross, transform(raw, e -> struct(if(e.x1 < 0, e.x1 + 360, e.x1) as x1, e.y1 as y1, if(e.x2 < 0, e.x2 + 360, e.x2) as x2, e.y2 as y2)), raw)"))
    return out.select("key", "edges", F.expr("struct(array_min(edges.x1) as w, array_max(edges.x1) as e, array_min(edges.y1) as s, array_max(edges.y1) as n)").alias("box"))


def containing_regions(points: DataFrame, shapes: DataFrame, cell: float = REGION_CELL) -> DataFrame:
    """(lat, lng, key) for each point and each region that contains it.

    Only the cells that a region's box touches are joined, never all points
    with all regions. Longitudes of crossing regions lie in 0..360, so each
    point is also offered one turn further east.
    """
    regions = region_edges(shapes)
    # Cells carry the key alone; edges follow once per candidate, not once per cell.
    covered = (
        regions.select("key", "box", F.explode(F.expr(f"sequence(cast(floor(box.w / {cell}) as int), cast(floor(box.e / {cell}) as int))")).alias("cx"))
        .select("key", "cx", F.explode(F.expr(f"sequence(cast(floor(box.s / {cell}) as int), cast(floor(box.n / {cell}) as int))")).alias("cy"))
    )
    located = points.select("lat", "lng", F.explode(F.expr("if(lng < 0, array(lng, lng + 360), array(lng))")).alias("x"))
    located = located.withColumn("cx", F.expr(f"cast(floor(x / {cell}) as int)")).withColumn("cy", F.expr(f"cast(floor(lat / {cell}) as int)"))
    inside = "size(filter(edges, e -> (e.y1 > lat) <> (e.y2 > lat) and x < (e.x2 - e.x1) * (lat - e.y1) / (e.y2 - e.y1) + e.x1)) % 2 = 1"
    candidates = located.join(covered, ["cx", "cy"]).select("lat", "lng", "x", "key")
    return candidates.join(regions.select("key", "edges"), "key").filter(inside).select("lat", "lng", "key").distinct()
