"""Matching of items to events, ordered folds and merges.

Matches are equi-joins first: on exact keys, or on country and hour window,
with cheap scores before dear ones. Only the folds that depend on order run in
Python, grouped by a key and fed in a stated order.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..session import cut, small_side, staged

#: Hours an event is open for further items.
LOOKBACK_H = 72
#: Least score of a match, and least title similarity that is looked at.
LEAST_SCORE, LEAST_TITLE = 0.84, 0.55
#: What bounds are lowered by, so that no rounding loses a pair.
SLACK = 1e-6


def any_key_matches(incoming: DataFrame, stored: DataFrame, keys: dict[str, tuple[Column, Column]], id_col: str = "id") -> DataFrame:
    """(in_id, id, kind): stored rows that share any key with an incoming row, the first kind of key and smallest id.

    ``keys``: kind -> (expression over incoming, over stored), in order of
    preference. Each key is an equi-join of (kind, value) rows, never an OR.
    """
    rows = lambda df, side, name: df.select(F.col(id_col).alias(name), F.explode(F.array(*[F.struct(F.lit(i).alias("k"), e[side].cast("string").alias("v")) for i, e in enumerate(keys.values())])).alias("x")).select(name, "x.k", "x.v").filter("v is not null and v <> ''")
    hits = rows(incoming, 0, "in_id").join(rows(stored, 1, "id"), ["k", "v"])
    best = hits.groupBy("in_id").agg(F.min(F.struct("k", "id")).alias("b"))
    names = F.array(*[F.lit(k) for k in keys])
    return best.select("in_id", F.col("b.id").alias("id"), F.get(names, F.col("b.k")).alias("kind"))


def numbered(items: DataFrame, events: DataFrame, hours: int = LOOKBACK_H) -> tuple[DataFrame, DataFrame]:
    """Events with ``_g``, their place in their country by time, and items with ``_p``, how many events of their country were last seen before or with them.

    items: (item_id, country, at, ...); events: (event_id, country, seen_at, ...).
    Items without an event in the last ``hours`` are left out. Places are
    counted within a country's day and carried on over its days, so no task
    sorts a whole country.
    """
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400)
    items, events = items.filter("country is not null and at is not null").withColumn("_d", day("at")), events.filter("country is not null and seen_at is not null").withColumn("_d", day("seen_at"))
    seen = F.col("seen_at").alias("_s")
    days = events.select("country", "_d", seen).unionByName(items.select("country", "_d", F.lit(None).cast(events.schema["seen_at"].dataType).alias("_s"))).groupBy("country", "_d").agg(F.count("_s").alias("_n"), F.max("_s").alias("_s"))
    w = W.partitionBy("country").orderBy("_d").rowsBetween(W.unboundedPreceding, -1)
    before = small_side(cut(days.select("country", "_d", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.max("_s").over(w).alias("_last"))))
    w = W.partitionBy("country", "_d").orderBy("seen_at", F.desc("event_id"))
    placed_events = events.withColumn("_g", F.row_number().over(w) - 1).join(before, ["country", "_d"]).withColumn("_g", F.col("_g") + F.col("_before")).drop("_d", "_before", "_last")
    kept = [c for c in items.columns if c not in ("country", "_d")]
    rows = items.select("country", "_d", F.col("at").alias("_t"), F.lit(None).cast(events.schema["seen_at"].dataType).alias("_s"), F.struct(*kept).alias("_i"))
    rows = rows.unionByName(events.select("country", "_d", F.col("seen_at").alias("_t"), seen), allowMissingColumns=True)
    w = W.partitionBy("country", "_d").orderBy("_t", F.col("_s").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.select("country", "_d", "_i", "_s", F.count("_s").over(w).alias("_p"), F.max("_s").over(w).alias("_l")).filter("_s is null").join(before, ["country", "_d"])
    recent = F.coalesce("_l", "_last") >= F.col("_i.at") - F.expr(f"interval {hours} hours")
    return placed.filter(recent).select("country", "_i.*", (F.col("_p") + F.col("_before")).alias("_p")), placed_events


def paired(items: DataFrame, events: DataFrame, hours: int = LOOKBACK_H, most: int | None = None) -> DataFrame:
    """Pairs of items and the events of their country last seen within ``hours`` before them: all, or of ``numbered`` ones the latest ``most``.

    All: events stand in blocks of ``hours``, each under its own block and the
    next, so an item meets one block. The latest: blocks are of ``most`` events
    by their place. No pair is moved.
    """
    window = (F.col("seen_at") <= F.col("at")) & (F.col("seen_at") >= F.col("at") - F.expr(f"interval {hours} hours"))
    if most is None:
        block, of_item, of_event = (lambda s: F.floor(s / (hours * 3600))), F.unix_timestamp("at"), F.unix_timestamp("seen_at")
    else:
        block, of_item, of_event = (lambda g: F.floor(g / most)), F.col("_p") - 1, F.col("_g")
        window &= (F.col("_g") < F.col("_p")) & (F.col("_g") >= F.col("_p") - most)
    left = items.withColumn("_b", block(of_item))
    right = events.withColumn("_b", F.explode(F.array(block(of_event), block(of_event) + 1)))
    return left.join(right, ["country", "_b"]).filter(window).drop("_b", "_g", "_p")


def window_candidates(items: DataFrame, events: DataFrame, hours: int = LOOKBACK_H, most: int | None = None) -> DataFrame:
    """Events of an item's country last seen within ``hours`` before it, all or the latest ``most``.

    items: (item_id, country, at, ...); events: (event_id, country, seen_at, ...).
    """
    if most is None:
        return paired(items, events, hours)
    return paired(*numbered(items, events, hours), hours, most)


def title_forms(df: DataFrame, title: str, prefix: str = "") -> DataFrame:
    """``df`` with the squeezed normal title and its tokens, made once a row and not once a pair."""
    df = staged(df, _normal=T.normal_title(F.col(title)))
    return staged(df, **{f"{prefix}x": F.regexp_replace("_normal", " ", ""), f"{prefix}tokens": T.tokens_of(F.col("_normal"))}).drop("_normal")


def match_forms(df: DataFrame, title: str, prefix: str = "") -> DataFrame:
    """``title_forms``, tags in normal form and, as numbers, what ``likely`` compares; rows without a title's letters match nothing and are left out."""
    c = lambda name: prefix + name
    none = F.array().cast("array<string>")
    df = title_forms(df, title, prefix).drop(title).filter(F.col(c("x")) != "")
    df = staged(df, _tags=V.normal_tags(F.coalesce(c("tags"), none))).drop(c("tags")).withColumnRenamed("_tags", c("tags"))
    trust = F.lower(F.trim(F.coalesce(c("tier"), F.lit("authoritative"))))
    made = {"n": F.length(c("x")), "token_bits": T.word_bits(F.col(c("tokens"))), "tag_bits": T.word_bits(F.col(c("tags"))), "key_bits": V.key_bits(F.coalesce(c("keys"), none)), "trust": trust, "trusted": V.tier_order(trust) >= 4}
    return staged(df, **{c(k): e for k, e in made.items()}).withColumn(c("bag"), T.letter_bag(c("x")))


def likely(candidates: DataFrame) -> DataFrame:
    """Pairs of ``match_forms`` rows without those that cannot reach the least score.

    Every part of the score is replaced by a bound from above: shared tokens,
    tags and letters by common bits, place keys by their beginnings. The gestalt
    ratio cannot exceed the share of letters that both titles have.
    """
    tokens = T.most_words(F.col("token_bits"), F.col("e_token_bits"))
    overlap = tokens / F.greatest(F.lit(1), F.col("token_bits.n") + F.col("e_token_bits.n") - tokens)
    rest = (
        F.least(F.lit(0.12), T.most_words(F.col("tag_bits"), F.col("e_tag_bits")) * F.lit(0.04)) + F.when(F.col("category") == F.col("e_category"), 0.08).otherwise(0.0) + 0.03
        + F.when(F.col("key_bits").bitwiseAND(F.col("e_key_bits")) != 0, 0.14).otherwise(0.0) + F.when(F.col("trust") == F.col("e_trust"), 0.04).when(F.col("trusted") & F.col("e_trusted"), 0.02).otherwise(0.0)
    )
    base = F.greatest(F.lit(LEAST_TITLE), LEAST_SCORE - rest) - SLACK
    need = F.least("n", "e_n", (base - 0.28 * overlap) * (F.col("n") + F.col("e_n")) / 1.44)  # one title within the other, or the ratio that the score lacks; one comparison, so that it is the join's own condition
    return candidates.filter(T.most_letters(F.col("bag"), F.col("e_bag")) >= need).drop("bag", "e_bag")


def match_events(candidates: DataFrame) -> DataFrame:
    """(item_id, event_id, score): the best event of each item at or above the least score.

    Needs x, e_x, tokens, e_tokens (see ``title_forms``), category, e_category,
    tags, e_tags, tier, e_tier, keys, e_keys. Equal titles need no ratio; others
    only where 0.72 * 2 * shorter / (both) + 0.28 * token overlap, which the
    similarity cannot exceed, reaches the least one and, with all else that
    counts, the least score.
    """
    x, y = F.col("x"), F.col("e_x")
    a, b = F.length(x), F.length(y)
    none = F.array().cast("array<string>")
    near = candidates.filter("x <> '' and e_x <> ''").withColumn("_same", x == y)
    overlap = F.size(F.array_intersect(V.normal_tags(F.coalesce("tags", none)), V.normal_tags(F.coalesce("e_tags", none))))
    near = staged(near, _held=F.when(F.col("_same"), 1.0).otherwise(T.held_within(x, y)), _shared=T.jaccard(F.col("tokens"), F.col("e_tokens")) * 0.28, geo=V.geo_overlap(F.coalesce("keys", none), F.coalesce("e_keys", none)), _tags=F.least(F.lit(0.12), overlap * F.lit(0.04)), _kind=F.when(F.col("category") == F.col("e_category"), 0.08).otherwise(0.0))
    most = staged(near, _most=F.greatest("_held", 1.44 * F.least(a, b) / (a + b) + F.col("_shared")))
    near = most.filter((F.col("_most") >= LEAST_TITLE - SLACK) & (F.col("_most") + F.col("_tags") + F.col("_kind") + 0.07 + F.col("geo") >= LEAST_SCORE - SLACK)).drop("_most")
    near = near.withColumn("_ratio", T.sequence_ratio(F.when(~F.col("_same"), x), F.when(~F.col("_same"), y)))
    near = staged(near, base=F.when(F.col("_same"), 1.0).otherwise(F.greatest("_held", F.col("_ratio") * 0.72 + F.col("_shared")))).filter(F.col("base") >= LEAST_TITLE)
    score = (
        F.col("base") + F.col("_tags") + F.col("_kind") + 0.03 + F.col("geo")
        + V.tier_adjustment(F.coalesce("tier", F.lit("authoritative")), F.coalesce("e_tier", F.lit("authoritative")), F.col("base"), F.col("geo"))
    )
    scored = near.withColumn("score", F.least(F.lit(1.0), score)).filter(F.col("score") >= LEAST_SCORE)
    best = scored.groupBy("item_id").agg(F.max(F.struct("score", "seen_at", (-F.col("event_id")).alias("n"))).alias("b"))
    return best.select("item_id", (-F.col("b.n")).alias("event_id"), F.col("b.score").alias("score"))


def enrichment_score(hours: Column, shared: Column, km: Column, has_point: Column, is_disaster: Column) -> Column:
    """Score of an alert against an event: time, tags, distance, kind."""
    time = F.when(hours <= 12, 0.45).when(hours <= 48, 0.28).when(hours <= 120, 0.12).otherwise(0.0)
    near = F.when(km <= 150, 0.35).when(km <= 500, 0.22).when(km <= 1200, 0.08).when(~has_point, 0.08).otherwise(0.0)
    return time + F.when(shared, 0.25).otherwise(0.0) + F.coalesce(near, F.lit(0.0)) + F.when(is_disaster, 0.08).otherwise(0.0)


#: What Python's str.split takes for blanks.
SPLIT_BLANKS = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of the connected component of each id that has an edge and is not its root itself.

    edges: (u, v) of longs. Large and small stars in turn, so a long chain takes few rounds.
    """
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        mark = now


def alike_groups(items: DataFrame, threshold: float = 0.6, hours: int = 24) -> DataFrame:
    """items with ``group``: items of different groups are never alike within ``hours``, whatever their source or day.

    items: (item_id, at, title). Equal word sets of one window are one row.
    Sets at or above the threshold share a word among their rarest
    size - threshold * size + 1, so those words and the window (or the next)
    are the keys of an equi-join; groups are the components of its verified pairs.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("title"), SPLIT_BLANKS), lambda w: w != "")))
    rows = items.withColumn("_w", F.coalesce(words, F.array().cast("array<string>"))).withColumn("_b", F.floor(F.unix_timestamp("at") / (hours * 3600)))
    sets = cut(rows.filter(F.size("_w") > 0).groupBy("_w", "_b").agg(F.min("item_id").alias("_id")))
    each = sets.select("_id", F.explode("_w").alias("_k"))
    ranked = each.join(each.groupBy("_k").agg(F.count("*").alias("_n")), "_k").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_n", "_k"))).alias("_r"))
    rare = ranked.select("_id", F.explode(F.expr(f"slice(_r, 1, cast(size(_r) - ceil({threshold}D * size(_r) - 1e-9D) + 1 as int))")).alias("_x")).select("_id", "_x._k")
    keyed = cut(rare.join(sets, "_id"))
    later = keyed.select("_k", "_b", F.col("_id").alias("u"), F.col("_w").alias("_wu"))
    earlier = keyed.select("_k", F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"), F.col("_b").alias("_bv"), F.col("_id").alias("v"), F.col("_w").alias("_wv"))
    a, b = F.size("_wu"), F.size("_wv")
    pairs = later.join(earlier, ["_k", "_b"]).filter("_bv < _b or v < u").filter(F.least(a, b) >= (threshold - 1e-9) * F.greatest(a, b))
    shared = F.size(F.array_intersect("_wu", "_wv"))
    roots = components(pairs.filter(shared >= (threshold - 1e-9) * (a + b - shared)).select("u", "v"))
    named = sets.join(roots.withColumnRenamed("id", "_id"), "_id", "left").select("_w", "_b", F.coalesce("root", "_id").alias("group"))
    return rows.join(named, ["_w", "_b"], "left").withColumn("group", F.coalesce("group", "item_id")).drop("_w", "_b")


def fold_clusters(items: DataFrame, threshold: float = 0.6, hours: int = 24) -> DataFrame:
    """(item_id, cluster_id): items in order of time join the first cluster whose first item is alike and near in time.

    items: (group, item_id, at, title). The order matters, so each group is
    folded in Python; a window of ``hours`` bounds what an item is compared
    with. Groups are chosen by the caller, see ``alike_groups``; those of one
    item need no fold, and one task folds many.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "item_id"])
        live: dict[object, list[tuple[int, pd.Timestamp, set[str]]]] = {}
        out = []
        for group, item, at, title in zip(pdf["group"], pdf["item_id"], pdf["at"], pdf["title"]):
            words = set((title or "").lower().split())
            heads = live[group] = [h for h in live.get(group, []) if (at - h[1]).total_seconds() <= hours * 3600]
            found = next((h[0] for h in heads if words and h[2] and len(words & h[2]) / len(words | h[2]) >= threshold), None)
            if found is None:
                heads.append((item, at, words))
                found = item
            out.append((item, found))
        return pd.DataFrame(out, columns=["item_id", "cluster_id"])

    sized = cut(items.join(items.groupBy("group").agg(F.count("*").alias("_n")), "group"))
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = sized.filter("_n > 1").drop("_n").groupBy(F.pmod(F.xxhash64("group"), F.lit(parts))).applyInPandas(fold, "item_id long, cluster_id long")
    return many.unionByName(sized.filter("_n = 1").select(F.col("item_id").cast("long"), F.col("item_id").cast("long").alias("cluster_id")))


def merge_by_key(stored: DataFrame, incoming: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Upsert: rows of both by key. rules: column -> 'new', 'keep', 'greatest', 'longest' or 'union'.

    ``new`` takes the incoming value unless null, ``keep`` the stored one unless
    null. Incoming rows that repeat a key are reduced to their maxima first.
    """
    new = incoming.groupBy(key).agg(*[F.max(c).alias(f"_n_{c}") for c in rules])
    joined = stored.select(key, *rules).join(new, key, "full")
    out = []
    for c, rule in rules.items():
        old, fresh = F.col(c), F.col(f"_n_{c}")
        made = {
            "new": F.coalesce(fresh, old), "keep": F.coalesce(old, fresh), "greatest": F.greatest(old, fresh),
            "longest": F.when(F.coalesce(F.length(fresh), F.lit(-1)) > F.coalesce(F.length(old), F.lit(-1)), fresh).otherwise(old) if rule == "longest" else fresh,
            "union": V.merged_tags(old, fresh) if rule == "union" else fresh,
        }[rule]
        out.append(made.alias(c))
    return joined.select(key, *out)


def cursor_skip(items: DataFrame, updated: Column, item_id: Column, cursor_at: str, cursor_id: str) -> DataFrame:
    """Items behind a cursor: updated later, or at the same time with another id."""
    at = F.lit(cursor_at).cast("timestamp_ntz")
    return items.filter((updated > at) | ((updated == at) & (item_id.cast("string") != cursor_id)))


def near_duplicate_fold(items: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(item_id, kept_id): items in order of id; one is dropped for the first kept one of its block that is alike.

    items: (block, item_id, title). Blocks are exact keys such as a country and
    day; within one the first of alike titles stays.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, str]] = []
        out = []
        for item, title in sorted(zip(pdf["item_id"], pdf["title"])):
            t = (title or "").lower().strip()
            found = None
            for k, other in kept:
                if t == other:
                    found = k
                elif t and other and 2 * min(len(t), len(other)) / (len(t) + len(other)) >= threshold:
                    m = difflib.SequenceMatcher(None, t, other)
                    if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold:
                        found = k
                if found is not None:
                    break
            if found is None:
                kept.append((item, t))
            out.append((item, item if found is None else found))
        return pd.DataFrame(out, columns=["item_id", "kept_id"])

    return items.groupBy("block").applyInPandas(fold, "item_id long, kept_id long")

