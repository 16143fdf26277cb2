"""Pairs within groups, built from distinct values and blocks of bounded size.

Only distinct values of a group are paired; their rows follow by membership, so
a value that a third of all rows share is compared once. Values of a group and
rows of a value are spread over blocks by a hash, blocks are paired with
blocks: no task ever holds a whole group, and what is made is in proportion to
the pairs that come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a group, and rows of a value, that one block holds on average.
BLOCK = 500


def differing_pairs(rows: DataFrame, group: list[str], id_col: str, value: str | list[str], block: int = BLOCK) -> DataFrame:
    """(group..., id_a, id_b), id_a < id_b, of rows of one group whose ``value`` differs.

    ``value`` is a column or several. Groups with one value are left out before
    anything is paired. A row with a null group column belongs to no group, one
    with a null value to no pair.
    """
    names = [value] if isinstance(value, str) else value
    keys = [f"_v{i}" for i in range(len(names))]
    rows = rows.select(*group, F.col(id_col).alias("_id"), *(F.col(v).alias(k) for v, k in zip(names, keys))).dropna(subset=[*group, *keys])
    values = rows.groupBy(*group, *keys).agg(F.count("*").alias("_n"))
    groups = values.groupBy(*group).agg(F.count("*").alias("_m")).filter("_m > 1")
    values = values.join(groups, group).select(*group, *keys, F.expr(f"cast(ceil(_n / {block}) as bigint)").alias("_nb"), F.expr(f"cast(ceil(_m / {block}) as bigint)").alias("_mb"))
    # Pairs of distinct values, blocks of values against blocks.
    part = F.expr(f"pmod(xxhash64({', '.join(keys)}), _mb)")
    spread = F.explode(F.expr("sequence(0L, _mb - 1)"))
    a = values.withColumn("_pa", part).select(*group, *(F.col(k).alias(f"{k}a") for k in keys), F.col("_nb").alias("_na"), "_pa", spread.alias("_pb"))
    b = values.withColumn("_pb", part).select(*group, *(F.col(k).alias(f"{k}b") for k in keys), F.col("_nb").alias("_nbb"), "_pb", spread.alias("_pa"))
    struct = lambda end: F.struct(*(F.col(f"{k}{end}").alias(k) for k in keys))
    pairs = a.join(b, [*group, "_pa", "_pb"]).filter(struct("a") < struct("b"))
    # Their rows: blocks of one value's rows against blocks of the other's.
    pairs = pairs.select(*group, *(f"{k}a" for k in keys), *(f"{k}b" for k in keys), "_nbb", F.explode(F.expr("sequence(0L, _na - 1)")).alias("_ba"))
    pairs = pairs.select("*", F.explode(F.expr("sequence(0L, _nbb - 1)")).alias("_bb")).drop("_nbb")
    members = rows.join(values.select(*group, *keys, "_nb"), [*group, *keys]).withColumn("_blk", F.expr("pmod(xxhash64(_id), _nb)"))
    side = lambda end: members.select(*group, *(F.col(k).alias(f"{k}{end}") for k in keys), F.col("_blk").alias(f"_b{end}"), F.col("_id").alias(f"_i{end}"))
    joined = pairs.join(side("a"), [*group, *(f"{k}a" for k in keys), "_ba"]).join(side("b"), [*group, *(f"{k}b" for k in keys), "_bb"])
    return joined.filter("_ia <> _ib").select(*group, F.least("_ia", "_ib").alias("id_a"), F.greatest("_ia", "_ib").alias("id_b"))
