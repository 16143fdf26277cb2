"""URL, list, number and score expressions. Column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "referrer", "source", "from", "share", "via", "fbclid", "gclid", "msclkid", "twclid",
]
# Weights of an event's heat.
TIER_HEAT = {"official": 18, "authoritative": 14, "aggregator": 8, "community": 5, "social": 3}
TIER_ORDER = {"official": 5, "authoritative": 4, "aggregator": 3, "community": 2, "social": 1}
HOT_TAGS = ["ai", "chip", "cybersecurity", "conflict", "disaster", "protest"]
WARM_TAGS = ["science", "space", "climate", "policy", "economy", "health", "energy", "diplomacy", "transport", "crime"]


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no tracking or valueless parameters, the others sorted, no fragment, no slash at the end."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substring(u, F.length(head) + 1, F.length(u))
    path = F.regexp_replace(F.substring_index(rest, "?", 1), "/+$", "")
    query = F.when(F.contains(rest, F.lit("?")), F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise("")
    tracking = F.array(*[F.lit(x) for x in TRACKING])
    kept = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.+") & ~F.array_contains(tracking, F.lower(F.substring_index(p, "=", 1))))
    text = F.array_join(F.array_sort(kept), "&")
    return F.when(head == "", url).otherwise(F.concat(head, F.when(path == "", "/").otherwise(path), F.when(text == "", "").otherwise(F.concat(F.lit("?"), text))))


def host(url: Column) -> Column:
    """Host of an address in lower case."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def normal_tags(tags: Column, most: int = 20) -> Column:
    """Trimmed, lower case, each once, in order, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")), 1, most)


def merged_tags(first: Column, second: Column, most: int = 20) -> Column:
    """Tags of the first list, then new ones of the second."""
    empty = F.array().cast("array<string>")
    return normal_tags(F.concat(F.coalesce(first, empty), F.coalesce(second, empty)), most)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """Part of the whole, rounded half to even; 0 where the whole is not positive."""
    return F.when(whole > 0, F.bround(part / whole, digits)).otherwise(0.0)


def percent_scale(value: Column) -> Column:
    """0..100 as a whole number; shares up to 1 are scaled, null stays null."""
    v = F.when(value <= 1, value * 100).otherwise(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.bround(v, 0).cast("int"))))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _by_name(column: Column, values: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(column == name, value).otherwise(out)
    return out


def tier_order(tier: Column) -> Column:
    """Trust of a tier, higher is better."""
    return _by_name(F.lower(F.trim(tier)), TIER_ORDER, 1)


def tier_heat(order: Column) -> Column:
    """Heat of the best tier by its order."""
    return _by_name(order, {TIER_ORDER[t]: h for t, h in TIER_HEAT.items()}, 0)


def signal_heat(top: Column, mean: Column) -> Column:
    """62 % of the hottest and 38 % of the mean article, cut to a whole number."""
    return (top * F.lit(0.62) + F.bround(mean, 0) * F.lit(0.38)).cast("int")


def event_heat(top: Column, mean: Column, articles: Column, sources: Column, best_tier: Column, topic: Column, level: Column, hours: Column, severity: Column) -> Column:
    """Heat of an event from its articles, sources, topic, place, age and severity."""
    place = F.when(level == "city", 8).when(level == "admin1", 4).otherwise(0)
    fresh = F.when(hours <= 6, 18).when(hours <= 24, 12).when(hours <= 72, 6).otherwise(0)
    total = (
        signal_heat(top, mean) + F.least(F.lit(42), articles * 6) + F.least(F.lit(36), sources * 9) + tier_heat(best_tier) + topic + place + fresh
        + F.least(F.lit(24), F.bround(F.coalesce(severity, F.lit(0)) * F.lit(0.24), 0).cast("int"))
    )
    return F.least(F.lit(9999), F.greatest(F.lit(1), total)).cast("int")


def topic_heat(category: Column, tags: Column) -> Column:
    """Heat of an event's topics, at most 20."""
    has = lambda ws: F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), F.array(*[F.lit(w) for w in ws]))
    c = F.when(category.isin("technology", "science", "conflict", "disaster"), 6).when(category.isin("policy", "business"), 4).otherwise(0)
    return F.least(F.lit(20), F.when(has(HOT_TAGS), 12).otherwise(0) + F.when(has(WARM_TAGS), 8).otherwise(0) + c)


def geo_overlap(a: Column, b: Column) -> Column:
    """Bonus of two lists of place keys: same key, one within the other, or same country but other place."""
    country = lambda x: F.transform(F.filter(x, lambda k: F.contains(k, F.lit(":"))), lambda k: F.substring_index(k, ":", 1))
    nested = F.exists(a, lambda x: F.exists(b, lambda y: F.startswith(x, y) | F.startswith(y, x)))
    bonus = F.when(F.arrays_overlap(a, b), 0.14).when(nested, 0.08).when(F.arrays_overlap(country(a), country(b)), -0.24).otherwise(0.0)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), bonus).otherwise(0.0)


def key_bits(keys: Column) -> Column:
    """Beginnings of a list's place keys as bits: lists that share none have no key equal to or within another's."""
    bit = lambda k: F.when(F.length(k) < 2, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(F.substring(k, 1, 2)).bitwiseAND(63).cast("int")))
    return F.aggregate(F.filter(keys, lambda k: k.isNotNull()), F.lit(0).cast("long"), lambda m, k: m.bitwiseOR(bit(k)))


def tier_adjustment(incoming: Column, candidate: Column, base: Column, geo: Column) -> Column:
    """Correction of a match by how far apart the trust of both sources is."""
    i, c = tier_order(incoming), tier_order(candidate)
    far = F.abs(i - c)
    same = F.lower(F.trim(incoming)) == F.lower(F.trim(candidate))
    return F.when(same, 0.04).when((far >= 3) & (base < 0.95) & (geo < 0.10), -0.12).when((far == 2) & (base < 0.92) & (geo < 0.10), -0.06).when((i >= 4) & (c >= 4), 0.02).otherwise(0.0)


# Severity by colour of an alert (earthquakes, other disasters) and by kind of event.
QUAKE_ALERTS = {"red": 95, "orange": 85, "yellow": 72, "green": 58}
DISASTER_ALERTS = {"red": 96, "orange": 84, "green": 60}
EVENT_SEVERITY = {"volcanoes": 84, "severestorms": 76, "wildfires": 72}
# Weights of where a place is mentioned and of its kind.
POSITION_WEIGHT = {"title": 1.0, "summary": 0.8, "content": 0.6}
KIND_WEIGHT = {"admin1": 1.0, "city": 0.9, "country": 0.85}


def web_address(url: Column, base: Column) -> Column:
    """Absolute web address without fragment; addresses from the root are joined to the base's host, others give ''."""
    u = F.trim(F.coalesce(url, F.lit("")))
    root = F.nullif(F.regexp_extract(F.coalesce(base, F.lit("")), r"^(https?://[^/?#]+)", 1), F.lit(""))
    joined = F.coalesce(F.concat(root, u), F.lit(""))
    return F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(F.startswith(u, F.lit("/")), joined).when(u.rlike("^https?://"), F.substring_index(u, "#", 1)).otherwise("")


def article_address(url: Column, base: Column) -> Column:
    """Absolute address of an article; the fragment stays."""
    u = F.coalesce(url, F.lit(""))
    root = F.nullif(F.regexp_extract(F.coalesce(base, F.lit("")), r"^(https?://[^/?#]+)", 1), F.lit(""))
    return F.when(F.startswith(u, F.lit("/")), F.coalesce(F.concat(root, u), F.lit(""))).when(u.rlike("^https?://"), u).otherwise("")


def day_index(at: Column, hours: int = 8) -> Column:
    """Days since 1970 at a fixed offset from UTC."""
    return F.floor((F.unix_timestamp(at) + hours * 3600) / 86400).cast("int")


def hours_of_day(at: Column, hours: int = 8) -> Column:
    """Hours begun since midnight at a fixed offset, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.pmod(F.unix_timestamp(at) + hours * 3600, F.lit(86400)) / 3600)).cast("int")


def quake_severity(alert: Column, significance: Column, magnitude: Column) -> Column:
    """Severity of an earthquake: by its alert, else its significance, else its magnitude."""
    colour = _by_name(F.lower(F.trim(alert)), QUAKE_ALERTS, 0)
    number = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.bround(x, 0).cast("int")))
    return F.when(colour > 0, colour).when(significance.isNotNull(), number(significance / 10, 35, 92)).when(magnitude.isNotNull(), number(magnitude * 12, 30, 90)).otherwise(40)


def alert_severity(alert: Column, score: Column) -> Column:
    """Severity of a disaster alert by colour and score."""
    base = F.coalesce(_by_name(F.lower(F.trim(alert)), DISASTER_ALERTS, 55), F.lit(55))
    mild = F.least(F.lit(72), F.bround(55 + score * 10, 0).cast("int"))
    return F.when(score.isNull(), base).otherwise(F.greatest(base, F.when(score >= 2, 96).when(score >= 1, 84).otherwise(mild)))


def open_event_severity(category: Column, magnitude: Column) -> Column:
    """Severity of an open event by category and magnitude."""
    base = F.coalesce(_by_name(F.lower(F.trim(category)), EVENT_SEVERITY, 65), F.lit(65))
    return F.greatest(F.lit(40), F.least(F.lit(95), base + F.when(magnitude.isNotNull(), F.least(F.lit(12), F.bround(magnitude, 0).cast("int"))).otherwise(0)))


def _weight(column: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(F.lower(column) == name, value).otherwise(out)
    return out


def relevance(position: Column, kind: Column, confidence: Column) -> Column:
    """How much a text is about a place: where it is named, what kind it is, how sure the match is; hundredths, ties to even."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(confidence != 0, confidence), F.lit(1.0))))
    return F.rint((0.6 * _weight(position, POSITION_WEIGHT, 0.5) + 0.3 * _weight(kind, KIND_WEIGHT, 0.8) + 0.1 * sure) * 100) / 100


def extent(geometry: Column) -> Column:
    """[west, south, east, north] of a GeoJSON text of any nesting; null where it has no position."""
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    found = F.regexp_extract_all(geometry, F.lit(rf"\[\s*({number}\s*,\s*{number})"), F.lit(1))
    xy = F.transform(found, lambda p: F.transform(F.split(p, ","), lambda v: F.trim(v).cast("double")))
    x, y = F.transform(xy, lambda p: p[0]), F.transform(xy, lambda p: p[1])
    return F.when(F.size(xy) > 0, F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def extent_centre(box: Column) -> Column:
    """(lng, lat, altitude) of the middle of an extent; one that is wider than half the globe crosses the 180th meridian."""
    west, south, east, north = (F.get(box, F.lit(i)) for i in range(4))
    wide = east - west > 180
    span = F.when(wide, 360 - (east - west)).otherwise(east - west)
    middle = F.when(wide, (west + east + 360) / 2).otherwise((west + east) / 2)
    lng = F.when(middle > 180, middle - 360).otherwise(middle)
    altitude = F.least(F.lit(2.4), F.greatest(F.lit(0.3), F.greatest(span, north - south) / 58))
    return F.struct(F.round(lng, 6).alias("lng"), F.round((south + north) / 2, 6).alias("lat"), F.round(altitude, 4).alias("altitude"))


def query_tags(text: str | None) -> list[str]:
    """Tags asked for in a query parameter: trimmed, lower case, each once."""
    return list(dict.fromkeys(t for x in (text or "").split(",") if (t := x.strip().lower())))


def event_status(status: Column, source_class: Column) -> Column:
    """'open' or 'closed'; only events can be open."""
    s, c = F.lower(F.trim(status)), F.lower(F.trim(F.coalesce(source_class, F.lit("news"))))
    return F.when((c == "event") & s.isin("open", "active", "ongoing"), "open").otherwise("closed")


def percent_or(value: Column, default: int) -> Column:
    """0..100 as a whole number, ``default`` where there is none."""
    return F.coalesce(percent_scale(value), F.lit(default))
