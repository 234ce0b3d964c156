"""Readers of the project's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def forms_once(forms: DataFrame, columns: Sequence[str], key: str = "form_id", arrived: str = "received_at") -> DataFrame:
    """One row per form: the delivery that arrived first.

    Forms are delivered again with the same fields; if the fields differ, the earliest delivery wins, a delivery without
    a time counts as the latest, and ties go to the smallest field values, so the result never depends on row order.
    Rows without a key can't be addressed and are left out. One shuffle, of the needed columns only.
    """
    kept = [c for c in columns if c != key]
    order = F.struct(F.col(arrived).isNull().alias("late"), F.col(arrived).alias("at"), *(F.col(c) for c in kept))
    return (
        forms.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(order).alias("first"))
        .select(key, *(F.col("first")[c].alias(c) for c in kept))
    )
