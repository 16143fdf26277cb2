"""Best representative of each group of copies.

Single-valued fields are taken from the row that is best by stated orders
(trust, recency, completeness), each field on its own, as plain maxima, so a
group that holds a third of all rows is reduced before it moves.

Multi-valued fields keep every value judged true by a latent two-sided quality
model: a source that carries a story either names a value or does not; its
sensitivity (names a true value) and its false-positive rate (names a wrong
one; specificity is one minus it) are inferred together with the truth of all
values by expectation-maximisation. Facts of the same shape (the same sources
for and against) are counted once, so a step is a pass over distinct shapes.
Rows are reduced to distinct (group, source, value) first: what is collected
per group is bounded by the number of sources, never by the number of copies.

The model's parameters are three numbers per source, held on the driver;
sources are the feed registry, whose size does not follow the articles.

Edge cases: rows without a group key are in no group; a null source counts as
one source of its own; null and empty lists name no value; repeated rows count
as copies; an unreadable time ranks last; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timestamps import normalise_instants
from ..session import cut

ITERATIONS = 12
#: Posterior from which on a value is kept.
KEEP = 0.5
# Prior counts: (true named, true not named), (wrong named, wrong not named).
SENSITIVITY_PRIOR = (6.0, 4.0)
FALSE_PRIOR = (1.0, 9.0)
TRUTH_PRIOR = 0.5

# Trust of a source tier, best first; anything else ranks last.
TIER_RANK = {"official": 0, "authoritative": 1, "aggregator": 2, "community": 2, "social": 3}
_LAST_TIER = 4
_NEVER = -(2**62)


def tier_rank(column: str) -> Column:
    """Rank of a tier, ignoring letter case and outer blanks; 0 is best."""
    t = F.lower(F.regexp_replace(F.regexp_replace(column, r"^[\s\p{Z}]+", ""), r"[\s\p{Z}]+$", ""))
    out = F.lit(_LAST_TIER)
    for name, rank in TIER_RANK.items():
        out = F.when(t == name, rank).otherwise(out)
    return out


def best_rows(rows: DataFrame, clocks: DataFrame) -> DataFrame:
    """(canonical_url, n_rows, and the id and value of the best tier, time and heat) of each group of two or more.

    The time of publication is read as an instant; a row enters once without
    it and once more with it where it is readable, and the larger wins.
    """
    base = rows.filter("canonical_url is not null").select("article_id", "canonical_url", "source_code", "published_at", "source_tier", "heat_score", tier_rank("source_tier").alias("rank"))
    keyed = base.select(F.struct("article_id", "canonical_url", "source_tier", "heat_score", "rank").alias("row"), "source_code", "published_at")
    timed = normalise_instants(keyed, clocks, ["published_at"], id_col="row").select("row.*", F.col("utc_ms").alias("at"), F.lit(0).alias("one"))
    all_rows = base.select("article_id", "canonical_url", "source_tier", "heat_score", "rank", F.lit(_NEVER).cast("long").alias("at"), F.lit(1).alias("one")).unionByName(timed)
    value = F.struct("article_id", "source_tier", "at", "heat_score")
    trust, first = (-F.col("rank")).alias("trust"), (-F.col("article_id")).alias("first")
    best = all_rows.groupBy("canonical_url").agg(
        F.sum("one").alias("n_rows"),
        F.max_by(value, F.struct(trust, "at", first)).alias("t"),
        F.max_by(value, F.struct("at", trust, first)).alias("p"),
        F.max_by(value, F.struct(F.col("heat_score").isNotNull().alias("has"), "at", trust, first)).alias("h"),
    )
    readable = F.when(F.col("p.at") != _NEVER, F.col("p.at"))
    return best.filter("n_rows >= 2").select(
        "canonical_url", "n_rows", F.col("t.article_id").alias("tier_id"), F.col("p.article_id").alias("published_id"), F.col("h.article_id").alias("heat_id"),
        F.lower(F.trim("t.source_tier")).alias("source_tier"), readable.alias("published_ms"), F.col("h.heat_score").alias("heat_score"),
    )


def claim_facts(rows: DataFrame, groups: DataFrame, fields: list[str]) -> DataFrame:
    """(canonical_url, field, value, named array<string>, silent array<string>) of every value named in a group."""
    members = rows.filter("canonical_url is not null").join(groups.select("canonical_url"), "canonical_url", "left_semi")
    members = members.select("canonical_url", F.coalesce(F.lower(F.trim("source_code")), F.lit("")).alias("src"), *fields)
    cover = members.groupBy("canonical_url").agg(F.collect_set("src").alias("sources"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("vs")) for f in fields]))
    claims = members.select("canonical_url", "src", each.alias("x")).select("canonical_url", "src", "x.field", F.explode("x.vs").alias("value"))
    claims = claims.select("canonical_url", "src", "field", F.trim("value").alias("value")).filter("value <> ''")
    facts = claims.groupBy("canonical_url", "field", "value").agg(F.collect_set("src").alias("named"))
    return facts.join(cover, "canonical_url").select("canonical_url", "field", "value", F.sort_array("named").alias("named"), F.sort_array(F.array_except("sources", "named")).alias("silent"))


def _posterior(named: list, silent: list, model: dict) -> tuple[np.ndarray, ...]:
    """Posterior of each fact, with its flat votes (fact, source, vote) for the sums."""
    index, yes, no = model["index"], model["yes"], model["no"]
    n_named = np.array([len(x) for x in named], dtype=np.int64)
    n_silent = np.array([len(x) for x in silent], dtype=np.int64)
    at_named = np.array([index[s] for x in named for s in x], dtype=np.int64)
    at_silent = np.array([index[s] for x in silent for s in x], dtype=np.int64)
    fact_named = np.repeat(np.arange(len(named)), n_named)
    fact_silent = np.repeat(np.arange(len(named)), n_silent)
    logit = np.full(len(named), model["prior"])
    np.add.at(logit, fact_named, yes[at_named])
    np.add.at(logit, fact_silent, no[at_silent])
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60))), fact_named, at_named, fact_silent, at_silent


def _model(sources: list[str], sensitivity: np.ndarray, false_rate: np.ndarray) -> dict:
    return {
        "index": {s: i for i, s in enumerate(sources)}, "sensitivity": sensitivity, "false_rate": false_rate, "prior": float(np.log(TRUTH_PRIOR / (1 - TRUTH_PRIOR))),
        "yes": np.log(sensitivity / false_rate), "no": np.log((1 - sensitivity) / (1 - false_rate)),
    }


def fit_quality(facts: DataFrame, iterations: int = ITERATIONS) -> dict:
    """Sensitivity and false-positive rate of each source."""
    shapes = cut(facts.groupBy("named", "silent").agg(F.count("*").alias("n")))
    sources = sorted(r[0] for r in shapes.select(F.explode(F.concat("named", "silent"))).distinct().collect())  # one row a source
    n = len(sources)
    model = _model(sources, np.full(n, SENSITIVITY_PRIOR[0] / sum(SENSITIVITY_PRIOR)), np.full(n, FALSE_PRIOR[0] / sum(FALSE_PRIOR)))
    for _ in range(iterations if n else 0):

        def run(batches: Iterator[pd.DataFrame], model: dict = model) -> Iterator[pd.DataFrame]:
            acc = np.zeros((4, n))  # true named, true, wrong named, wrong
            for pdf in batches:
                p, fn, sn, fs, ss = _posterior(list(pdf["named"]), list(pdf["silent"]), model)
                w = pdf["n"].to_numpy(dtype=float)
                for k, q in ((0, w * p), (2, w * (1 - p))):
                    np.add.at(acc[k], sn, q[fn])
                    np.add.at(acc[k + 1], sn, q[fn])
                    np.add.at(acc[k + 1], ss, q[fs])
            yield pd.DataFrame({"s": np.tile(np.arange(n), 4), "k": np.repeat(np.arange(4), n), "v": acc.ravel()})

        sums = np.zeros((4, n))
        for r in shapes.mapInPandas(run, "s int, k int, v double").groupBy("s", "k").agg(F.sum("v").alias("v")).collect():
            sums[r["k"], r["s"]] = r["v"]
        sensitivity = (sums[0] + SENSITIVITY_PRIOR[0]) / (sums[1] + sum(SENSITIVITY_PRIOR))
        false_rate = (sums[2] + FALSE_PRIOR[0]) / (sums[3] + sum(FALSE_PRIOR))
        # A source is never judged worse than chance, or the model could swap true and wrong.
        false_rate = np.minimum(false_rate, 0.95 * sensitivity)
        model = _model(sources, np.clip(sensitivity, 1e-3, 1 - 1e-3), np.clip(false_rate, 1e-4, 1 - 1e-3))
    return model


def true_values(facts: DataFrame, model: dict, keep: float = KEEP) -> DataFrame:
    """(canonical_url, field, value, truth) of each value judged true."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = _posterior(list(pdf["named"]), list(pdf["silent"]), model)[0]
            yield pdf[["canonical_url", "field", "value"]].assign(truth=p)[p >= keep]

    return facts.mapInPandas(run, "canonical_url string, field string, value string, truth double")


def best_representatives(articles: DataFrame, clocks: DataFrame, fields: tuple[str, ...] = ("tags", "region_tags")) -> DataFrame:
    """One surviving record of each group: best tier, time and heat with their rows, and all values judged true."""
    best = cut(best_rows(articles, clocks))
    facts = cut(claim_facts(articles, best, list(fields)))
    kept = true_values(facts, fit_quality(facts))
    lists = kept.groupBy("canonical_url").agg(*[F.sort_array(F.collect_set(F.when(F.col("field") == f, F.col("value")))).alias(f) for f in fields])
    empty = F.array().cast("array<string>")
    return best.join(lists, "canonical_url", "left").select(*best.columns, *[F.coalesce(f, empty).alias(f) for f in fields])
