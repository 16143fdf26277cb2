"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer. Each source gets its share of the
total as whole passes over the source plus a part of one more pass; the part
is all documents whose hash lies below a threshold. Thresholds are found
without sorting: tokens are summed by source and hash bucket, the bucket in
which the budget ends is the boundary, and only the boundary bucket is split
into finer ones, level by level. Because the part is a prefix of the hash
order, a larger total contains every smaller one.

Default total: the largest one that every listed source present in the corpus
can fill at its share within its repeats; targets are scaled to the sources
that are present. With a total given, a source that cannot fill its share
gives all it may, and the report shows the shares reached.

Edge cases: documents of unlisted sources and of null source are left out;
listed sources without documents are reported with zero; documents of no
tokens are never taken in the part and count nothing; repeated rows count as
rows; null targets count as 0, null repeats as 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, small_side

LEVELS = 4
#: Bits of the hash that one level tells apart.
BITS = 12
SEED = "mixture"


def mix_sources(sizes: DataFrame, targets: DataFrame, total: int | None = None, id_col: str = "doc_id", seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(picked, report). picked: (id, source, n_tokens, copies) of each document in the mixture.

    ``sizes``: (id, source, n_tokens); ``targets``: (source, target_share, max_repeats).
    report: one row per listed source.
    """
    goal = targets.groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.lit(1), F.coalesce(F.max("max_repeats"), F.lit(1))).cast("long").alias("max_repeats"))
    docs = cut(
        sizes.select(F.col(id_col), "source", F.col("n_tokens").cast("long"), F.expr(f"pmod(xxhash64('{seed}', {id_col}), {2 ** (BITS * LEVELS)})").alias("h"))
        .join(small_side(goal.select("source")), "source", "left_semi")
    )
    supply = docs.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n_docs"))
    plan = goal.join(supply, "source", "left").fillna(0, ["supply", "n_docs"])
    one = W.partitionBy(F.lit(1))  # one row per listed source
    plan = plan.withColumn("present", F.sum(F.when(F.col("supply") > 0, F.col("target_share"))).over(one))
    plan = plan.withColumn("share", F.when((F.col("supply") > 0) & (F.col("present") > 0), F.col("target_share") / F.col("present")).otherwise(0.0))
    most = F.min(F.when(F.col("share") > 0, F.col("supply") * F.col("max_repeats") / F.col("share"))).over(one)
    plan = plan.withColumn("total", F.lit(total).cast("double") if total is not None else F.floor(most).cast("double"))
    plan = plan.withColumn("budget", F.least(F.floor(F.coalesce(F.col("total"), F.lit(0.0)) * F.col("share") + 1e-6).cast("long"), F.col("supply") * F.col("max_repeats")))
    plan = plan.withColumn("passes", F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(F.lit(0)).cast("long"))
    plan = cut(plan.withColumn("rest", F.col("budget") - F.col("passes") * F.col("supply")))

    # edge: the bucket [edge, edge + 1) at the current level in which the rest ends.
    state = plan.select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("edge"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = docs.join(small_side(state.withColumnRenamed("edge", "above")), "source").filter(f"shiftright(h, {shift + BITS}) = above")
        hist = inside.groupBy("source", F.expr(f"shiftright(h, {shift})").alias("bucket"), "left").agg(F.sum("n_tokens").alias("t"))
        # At most 2^BITS buckets a source, whatever the corpus.
        run = hist.withColumn("upto", F.sum("t").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)))
        first = run.filter("upto > left").groupBy("source").agg(F.min(F.struct("bucket", (F.col("left") - (F.col("upto") - F.col("t"))).alias("left"), "t")).alias("b"))
        state = state.select("source", F.col("left").alias("_l"), F.col("edge").alias("_e")).join(first, "source", "left")
        past = F.shiftleft(F.col("_e") + 1, BITS)  # the rest takes the whole bucket: end behind it
        state = cut(state.select("source", F.coalesce("b.left", "_l").alias("left"), F.coalesce("b.bucket", past).alias("edge"), F.col("b.t").alias("t")))
        edge = state
        state = state.drop("t")
    # One hash value is left: take it if that comes nearer to the budget.
    edge = edge.select("source", F.expr("edge + if(t is not null and left > 0 and t - left <= left, 1, 0)").alias("threshold"))
    plan = cut(plan.join(edge, "source"))
    taken = docs.join(small_side(plan.select("source", "passes", "threshold", "max_repeats")), "source")
    picked = taken.select(id_col, "source", "n_tokens", F.expr("least(max_repeats, passes + if(h < threshold, 1, 0))").alias("copies")).filter("copies > 0")
    got = picked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("used_docs"), F.max("copies").alias("most_copies"))
    report = plan.join(got, "source", "left").fillna(0, ["mixed_tokens", "used_docs", "most_copies"])
    whole = F.sum("mixed_tokens").over(one)
    report = report.select(
        "source", "target_share", F.col("share").alias("scaled_share"), "max_repeats", F.col("supply").alias("available_tokens"), F.col("n_docs").alias("available_docs"),
        F.col("budget").alias("budget_tokens"), "mixed_tokens", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0).alias("actual_share"), "used_docs", "most_copies",
    )
    return picked, report
