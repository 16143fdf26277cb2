"""Places in texts: a table of names, look-ups with a country hint, candidates, ranking and the whole extraction.

Names are looked up by equi-join on their lower-case form, never by searching
texts name by name; per name and item only the best few rows survive one
aggregation. The running country hint of a text (the first resolved place
biases the later ones) is exact in two passes: the first place is the first one
resolved without a hint, and all later ones have its country as theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..session import cut, small_side, staged

# How likely a candidate is the kind it would be, bonuses, and confidence of a match.
KIND_PRIOR = {"city": 0.62, "admin1": 0.58, "country": 0.52}
SAME_KIND, HINTED, COUNTRY_BONUS = 0.22, 0.18, 0.02
POPULATION = [(5_000_000, 0.10), (1_000_000, 0.07), (200_000, 0.04)]
GLOBAL_CITY = 500_000
MATCH_CONFIDENCE = {"city": 0.82, "admin1": 0.84, "country": 0.8}
SAME_CONFIDENCE = 0.88
GRANULARITY = {"province": 0.06, "admin1": 0.06, "city": 0.04}
ORDER_WEIGHT = {"province": 1.0, "admin1": 1.0, "city": 0.92, "country": 0.86}
#: Places of one text, at most; the feature is a top list.
MOST = 10

CJK_RUN = r"[\x{4e00}-\x{9fff}]{2,12}"
ASCII_WORD = r"[A-Za-z]+(?:[\-'][A-Za-z]+)*"
#: Words that name no place where they stand alone; a default, callers pass their own.
NO_PLACES = ["the", "and", "for", "with", "from", "that", "this", "after", "before", "says", "said", "news", "live", "what", "when", "where", "will", "more", "than", "over", "into", "near"]


def name_table(regions: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """(name, kind, key, country_code, admin1_code, label, lat, lng, population): one row for each spelling of each place.

    ``regions``: first-level regions with their country; ``cities``: (key, name,
    country_code, admin1_code, lat, lng, population), optional.
    """
    names = F.concat(F.array("admin1_name", "admin1_name_ascii", "admin1_name_zh"), F.coalesce("aliases", F.array().cast("array<string>")))
    region = regions.filter("geojson_key is not null").select(
        F.explode(names).alias("n"), F.lit("admin1").alias("kind"), F.col("geojson_key").alias("key"), "country_code", "admin1_code", F.coalesce("admin1_name_zh", "admin1_name").alias("label"), "lat", "lng", F.lit(0).cast("long").alias("population"),
    )
    no = lambda t: F.lit(None).cast(t)
    country = regions.filter("country_code is not null").groupBy("country_code").agg(F.max("country_name").alias("n")).select(
        "n", F.lit("country").alias("kind"), F.col("country_code").alias("key"), "country_code", no("string").alias("admin1_code"), F.col("n").alias("label"), no("double").alias("lat"), no("double").alias("lng"), F.lit(0).cast("long").alias("population"),
    )
    rows = region.filter("n is not null").unionByName(country.filter("n is not null"))
    if cities is not None:
        rows = rows.unionByName(cities.filter("name is not null").select(F.col("name").alias("n"), F.lit("city").alias("kind"), "key", "country_code", "admin1_code", F.col("name").alias("label"), "lat", "lng", F.coalesce("population", F.lit(0)).cast("long").alias("population")))
    each = rows.select(F.explode(T.name_variants(F.col("n"))).alias("v"), "*").withColumn("name", F.lower("v")).drop("v", "n")
    return each.filter("name <> ''").groupBy("name", "kind", "key").agg(*[F.min(c).alias(c) for c in ("country_code", "admin1_code", "label", "lat", "lng", "population")])


def cities_of(places: DataFrame) -> DataFrame:
    """Cities that articles' places name, one row a key."""
    c = places.filter("precision_level = 'CITY' and geo_key is not null and city_name is not null")
    return c.groupBy(F.col("geo_key").alias("key")).agg(F.min("city_name").alias("name"), F.min("country_code").alias("country_code"), F.min("admin1_code").alias("admin1_code"), F.min("lat").alias("lat"), F.min("lng").alias("lng"), F.lit(0).cast("long").alias("population"))


def inferred_kind(name: Column) -> Column:
    """Kind of place a name looks like by its ending."""
    ends = lambda *words: F.lower(name).rlike("(?:" + "|".join(words) + ")$")
    return F.when(ends("省", "州", "自治区", "特别行政区"), "admin1").when(ends("市", "县", "区"), "city").when(ends(" province", " state", " prefecture", " region", " territory"), "admin1").otherwise("city")


def stated_kind(kind: Column) -> Column:
    """Kind of place an entity says it is."""
    k = F.lower(F.trim(kind))
    return F.when(k.isin("province", "state", "region", "admin1"), "admin1").when(k.isin("city", "district", "point"), "city").otherwise("country")


def hint_of_key(key: Column) -> Column:
    """Country a place key begins with; null where it names none."""
    k = F.upper(F.trim(key))
    head = F.coalesce(F.nullif(F.regexp_extract(k, r"^([^.]*)\.", 1), F.lit("")), F.nullif(F.regexp_extract(k, "^([^_]*)_", 1), F.lit("")), F.nullif(F.regexp_extract(k, "^([^:]*):", 1), F.lit("")))
    return F.substring(F.coalesce(F.trim(head), F.when(k.rlike("^[A-Z]{2,3}$"), k)), 1, 10)


def candidate_score(kind: Column, wanted: Column, in_hint: Column, population: Column) -> Column:
    """Score of a dictionary entry: its kind, the kind wanted, the hinted country, its population."""
    prior = F.when(kind == "city", KIND_PRIOR["city"]).when(kind == "admin1", KIND_PRIOR["admin1"]).otherwise(KIND_PRIOR["country"] + COUNTRY_BONUS)
    fit = F.when(kind == wanted, SAME_KIND).when((wanted == "admin1") & (kind == "city"), -0.08).when((wanted == "city") & (kind == "admin1"), -0.05).otherwise(0.0)
    size = F.lit(0.0)
    for least, bonus in reversed(POPULATION):
        size = F.when(population >= least, bonus).otherwise(size)
    return F.round(prior + fit + F.when(in_hint, HINTED).otherwise(0.0) + F.when(kind == "city", size).otherwise(0.0), 6)


def match_confidence(wanted: Column, kind: Column) -> Column:
    """Confidence of a match by the kind wanted and the kind found."""
    by_kind = F.when(kind == "city", MATCH_CONFIDENCE["city"]).when(kind == "admin1", MATCH_CONFIDENCE["admin1"]).otherwise(MATCH_CONFIDENCE["country"])
    return F.when(wanted == kind, SAME_CONFIDENCE).otherwise(by_kind)


def resolve(names: DataFrame, table: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., kind, key, country_code, admin1_code, label, lat, lng, score): the best entry of each name that has one.

    ``names``: (ids..., name, wanted, hint). Cities and regions of the hinted
    country come first; without one there, regions of any country count, and
    cities that are large or whose name can hardly be another word. Ties go to
    the smaller key. Brackets at the end of a name are tried without.
    """
    bare = F.trim(F.regexp_replace("name", r"[（(].*?[)）]$", ""))
    keyed = names.filter("name is not null").withColumn("_n", F.lower(F.trim("name"))).withColumn("_bare", F.lower(bare))
    t = small_side(table).withColumnRenamed("name", "_n")
    rows = keyed.select(*ids, "name", "wanted", "hint", F.explode(F.array_distinct(F.array("_n", "_bare"))).alias("_n"), (F.col("_n") != F.col("_bare")).alias("_two"), F.col("_n").alias("_first"))
    hits = rows.join(t, "_n").withColumn("_in", F.coalesce(F.col("country_code") == F.col("hint"), F.lit(False)))
    entry = F.struct(
        candidate_score(F.col("kind"), F.col("wanted"), F.col("_in"), F.col("population")).alias("score"), "kind", "key", "country_code", "admin1_code", "label", "lat", "lng",
    )
    best = lambda cond: F.min(F.when(cond, F.struct((-entry["score"]).alias("s"), F.col("key").alias("k"), entry.alias("e"))))
    kind, near = F.col("kind"), F.col("_in")
    far_city = (F.col("population") >= GLOBAL_CITY) | F.col("name").rlike(r"[\x{4e00}-\x{9fff}]|[ \-']")
    grouped = hits.groupBy(*ids, (F.col("_n") == F.col("_first")).alias("_exact")).agg(
        best((kind == "city") & (near | F.col("hint").isNull())).alias("c1"), best((kind == "city") & far_city).alias("c2"), best((kind == "admin1") & (near | F.col("hint").isNull())).alias("a1"), best(kind == "admin1").alias("a2"), best(kind == "country").alias("n"),
    )
    one = grouped.withColumn("e", F.array_min(F.filter(F.array(F.coalesce("c1", "c2"), F.coalesce("a1", "a2"), F.col("n")), lambda x: x.isNotNull()))).filter("e is not null")
    # The name as it stands goes before the one without brackets.
    chosen = one.groupBy(*ids).agg(F.max_by("e", F.col("_exact").cast("int")).alias("e"))
    return chosen.select(*ids, "e.e.kind", "e.e.key", "e.e.country_code", "e.e.admin1_code", "e.e.label", "e.e.lat", "e.e.lng", "e.e.score")


def with_geo_text(articles: DataFrame, title: str = "title", summary: str = "summary", content: str = "content", most: int = 8, size: int = 2800) -> DataFrame:
    """``articles`` with ``geo_text``, the text to search for places: title, ledes and the sentences most likely to name one, each once.

    Every step is kept single, as the next ones use it more than once.
    """
    df = staged(articles, _plain=T.plain_html(F.col(content)), _heads=F.array(F.trim(F.substring(T.plain_html(F.col(title)), 1, 300)), F.trim(F.substring(T.first_paragraph(F.col(summary)), 1, 400)), F.trim(F.substring(T.first_paragraph(F.col(content)), 1, 500))))
    df = staged(df, _parts=T.sentences(F.substring("_plain", 1, 4500)))
    df = staged(df, _ranked=F.slice(F.array_sort(F.filter(T.sentence_scores(F.col("_parts")), lambda x: F.length(x["text"]) >= 20)), 1, most))
    chosen = F.transform("_ranked", lambda x: F.trim(F.substring(x["text"], 1, 420)))
    df = staged(df, _every=F.filter(F.concat("_heads", F.coalesce(chosen, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))
    df = staged(df, _lowered=F.transform("_every", lambda x: F.lower(x)))
    once = F.filter("_every", lambda x, i: F.array_position(F.col("_lowered"), F.lower(x)) == i + 1)
    return df.withColumn("geo_text", F.substring(F.array_join(once, " "), 1, size)).drop("_plain", "_heads", "_parts", "_ranked", "_every", "_lowered")


def text_candidates(texts: DataFrame, id_col: str, text_col: str, no_places: list[str] | None = None) -> DataFrame:
    """(id, at, name): what may be a place in a text, in the order it is tried.

    Runs of Chinese characters with and without their ending, then groups of
    three, two and one words of three letters or more. A single word must have
    four letters, not all of them small, not be a plain word, and not stand
    between two other capitalised words, as parts of a person's name do.
    """
    stop = F.array(*[F.lit(w) for w in (NO_PLACES if no_places is None else no_places)]).cast("array<string>")
    runs = F.flatten(F.transform(F.regexp_extract_all(text_col, F.lit(f"({CJK_RUN})"), F.lit(1)), lambda r: F.array(r, T.region_stem(r))))
    tokens = F.filter(F.regexp_extract_all(text_col, F.lit(f"({ASCII_WORD})"), F.lit(1)), lambda w: F.length(w) >= 3)
    df = staged(texts.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), text_col), runs=F.array_distinct(F.filter(runs, lambda r: F.length(r) >= 2)), w=tokens)
    title = "rlike(x, '^[A-Z][^A-Z]*[a-z][^A-Z]*$')"
    plain = lambda x: F.array_contains(stop, F.lower(x))
    groups = []
    joined = lambda size: lambda i: F.concat_ws(" ", *[F.get("w", i + k) for k in range(size)])
    for size in (3, 2):
        at = F.expr(f"if(size(w) < {size}, cast(array() as array<int>), sequence(0, size(w) - {size}))")
        groups.append(F.transform(F.filter(at, lambda i: ~plain(F.get("w", i))), joined(size)))
    singles = F.expr(
        "transform(filter(if(size(w) < 1, cast(array() as array<int>), sequence(0, size(w) - 1)), i -> length(w[i]) >= 4 and lower(w[i]) != w[i] and not "
        + f"coalesce({title.replace('x', 'w[i]')} and {title.replace('x', 'get(w, i - 1)')} and {title.replace('x', 'get(w, i + 1)')}, false)), i -> w[i])"
    )
    groups.append(F.filter(singles, lambda x: ~plain(x)))
    df = df.select("_id", F.concat("runs", *groups).alias("all"))
    each = df.select("_id", F.posexplode("all").alias("at", "name"))
    first = each.groupBy("_id", F.lower("name").alias("_l")).agg(F.min(F.struct("at", "name")).alias("m"))
    return first.select(F.col("_id").alias(id_col), "m.at", "m.name")


def places_in_texts(texts: DataFrame, table: DataFrame, id_col: str = "article_id", text_col: str = "text", hint_col: str | None = None, most: int = MOST) -> DataFrame:
    """(id, rank, name, wanted, kind, key, ...): places of each text in the order they are found, each key once, at most ``most``."""
    found = text_candidates(texts, id_col, text_col)
    # Only candidates that the dictionary knows go further.
    known = small_side(table.select(F.col("name").alias("_n")).distinct())
    found = cut(found.withColumn("_n", F.lower(F.trim("name"))).join(known, "_n", "left_semi").drop("_n").withColumn("wanted", inferred_kind(F.col("name"))))
    given = texts.select(id_col, F.col(hint_col).alias("given")) if hint_col else texts.select(id_col, F.lit(None).cast("string").alias("given"))
    found = found.join(given.dropDuplicates([id_col]), id_col)
    blind = cut(resolve(found.select(id_col, "at", "name", "wanted", F.col("given").alias("hint")), table, [id_col, "at"]))
    first = blind.groupBy(id_col).agg(F.min_by(F.struct("at", "country_code"), "at").alias("f"))
    later = found.join(first, id_col).filter("given is null and at > f.at").select(id_col, "at", "name", "wanted", F.col("f.country_code").alias("hint"))
    hinted = resolve(later, table, [id_col, "at"])
    kept = blind.join(found.filter("given is not null").select(id_col, "at"), [id_col, "at"], "left_semi").unionByName(blind.join(first.select(id_col, "f.at"), [id_col, "at"], "left_semi").join(found.filter("given is null").select(id_col, "at"), [id_col, "at"], "left_semi")).unionByName(hinted)
    named = kept.join(found.select(id_col, "at", "name", "wanted"), [id_col, "at"])
    once = named.groupBy(id_col, "key").agg(F.min_by(F.struct(*[c for c in named.columns if c not in (id_col, "key")]), "at").alias("r")).select(id_col, "key", "r.*")
    w = W.partitionBy(id_col).orderBy("at")
    return once.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < most).withColumn("confidence", match_confidence(F.col("wanted"), F.col("kind"))).drop("at")


def position_of(name: Column, title: Column, summary: Column, content: Column) -> Column:
    """Where a name stands first: title, summary or content; null where in none. Names in ASCII need no letter or digit beside them unless they stand as they are."""
    def stands(text: Column) -> Column:
        return F.contains(text, name) | (name.rlike(r"^\p{ASCII}+$") & F.regexp_like(text, F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}_])"))))

    return F.when(stands(title), "title").when(stands(summary), "summary").when(stands(content), "content")


def entity_order(relevance: Column, kind: Column, position: Column, confidence: Column) -> Column:
    """Sort key of an article's places, most important first when descending."""
    weight = lambda c, table, default: V._weight(c, table, default)
    return F.struct(
        F.round(F.coalesce(relevance, F.lit(0.0)) + weight(kind, GRANULARITY, 0.0), 6).alias("r"), weight(kind, ORDER_WEIGHT, 0.8).alias("k"), weight(position, V.POSITION_WEIGHT, 0.5).alias("p"), F.coalesce(confidence, F.lit(0.0)).alias("c")
    )


def entity_label(kind: Column, country: Column, country_name: Column, admin1: Column, city: Column, name: Column) -> Column:
    """What tells two places of one kind and country apart."""
    k = F.lower(kind)
    low = lambda *c: F.lower(F.trim(F.coalesce(*c)))
    return F.when(k == "city", low(F.nullif(city, F.lit("")), name)).when(k.isin("province", "admin1"), low(F.nullif(admin1, F.lit("")), name)).when(k == "country", F.coalesce(F.nullif(F.upper(F.trim(country)), F.lit("")), low(F.nullif(country_name, F.lit("")), name))).otherwise(low(name))
