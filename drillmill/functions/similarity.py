"""Normalised Indel similarity: 2 * LCS / (len a + len b), 1 for two empty texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def indel_ratio(a: str, b: str) -> float:
    """Bit-parallel longest common subsequence: one big-integer step for each character of b."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return 2.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Equal texts, the common case, are told without Python: the function sees '' for them."""
    same = a == b
    return F.when(same, F.lit(1.0)).otherwise(_ratio(F.when(~same, a).otherwise(""), F.when(~same, b).otherwise("")))


def similarity_short(a: Column, b: Column) -> Column:
    """The same by nested folds in the JVM; for texts of a few dozen characters, as its cost grows with the cube."""
    xs, ys = F.filter(F.split(a, ""), lambda x: x != ""), F.filter(F.split(b, ""), lambda x: x != "")
    zero = F.transform(F.concat(F.array(F.lit("")), ys), lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        step = lambda acc, j: F.concat(acc, F.array(F.when(F.element_at(ys, j) == x, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(acc, -1), F.element_at(prev, j + 1)))))
        return F.aggregate(F.when(F.size(ys) > 0, F.sequence(F.lit(1), F.size(ys))).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), step)

    lcs = F.element_at(F.aggregate(xs, zero, row), -1)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(F.try_divide(lcs * 2.0, total))
