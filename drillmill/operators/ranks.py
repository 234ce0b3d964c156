"""Places of rows in a total order without gathering them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drillmill.session import cut


def with_place(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds the 1-based place of each row in the order given.

    Rows are range-partitioned, sorted and written once, as both uses of a row's partition must see the same one; the sizes of
    the partitions, a row for each, become offsets.
    """
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    offset = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = parts.join(F.broadcast(offset.select("_part", "_first", "_offset")), "_part")
    return joined.withColumn(name, F.col("_id") - F.col("_first") + F.col("_offset") + 1).drop("_part", "_id", "_first", "_offset")
