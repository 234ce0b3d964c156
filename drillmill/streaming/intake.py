"""Streaming intake: answers that arrive as files become output rows, batch by batch.

The batch operators do the work in foreachBatch; only the de-duplication of repeated answers keeps state, bounded by a
watermark on their arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RESPONSES = "source_file string, page_no int, task string, raw string, error string"


def read_responses(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def distinct_responses(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """An answer that is sent again within the delay counts once."""
    timed = stream.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", delay)
    return timed.dropDuplicatesWithinWatermark(["source_file", "page_no", "task", "raw"]).drop("arrived_at")


def start_intake(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows of each micro-batch under its number, so that a repeated batch overwrites itself."""
    from drillmill.plans.pipeline import rows_from_responses

    def write(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        rows_from_responses(kept.select("source_file").distinct(), kept).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
