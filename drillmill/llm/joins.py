"""Joins and components that the llm operators share; hot groups are salted by their own size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillmill.session import bounded, cut

PER_SALT = 500
#: Rows of a few short columns that may be broadcast (under 5 MB).
BROADCAST_ROWS = 30_000


def self_pairs(rows: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Pairs of rows with equal keys that meet the condition, on the columns with the suffixes _a and _b.

    Groups are counted first: groups of one go no further, and the rows of one side of a large group are spread over a part
    for every PER_SALT rows, so that no task holds the whole group.
    """
    keys, rows = list(keys), cut(rows)
    others = [c for c in rows.columns if c not in keys]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.ceil(F.col("_n") / PER_SALT).cast("int").alias("_parts"))
    common = rows.join(bounded(counts, BROADCAST_ROWS), keys)
    a = common.select(*keys, *(F.col(c).alias(f"{c}_a") for c in others), F.pmod(F.xxhash64(*others), F.col("_parts")).cast("int").alias("_part"))
    b = common.select(*keys, *(F.col(c).alias(f"{c}_b") for c in others), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return a.join(b, [*keys, "_part"]).where(condition).drop("_part")


def roots(parents: DataFrame, within: Sequence[str], node: str) -> DataFrame:
    """within, node, root: where the pointers from node to up end (up is NULL for a root). Pointers never form a circle.

    Each step doubles how far a pointer reaches, until none moves.
    """
    keys = list(within)
    now, moved = cut(parents.select(*keys, node, F.coalesce("up", node).alias("root"))), True
    while moved:
        up = now.select(*keys, F.col(node).alias("root"), F.col("root").alias("next"))
        further = cut(now.join(up, [*keys, "root"]).select(*keys, node, F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        moved = not further.where("moved").isEmpty()
        now = further.drop("moved")
    return now
