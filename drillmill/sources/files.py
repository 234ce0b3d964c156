"""Input folders as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmill.functions.text import base_name, suffix

#: Suffixes that are read (fixed values).
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")


def is_input(path: Column) -> Column:
    """By suffix, in any case."""
    return suffix(path).isin(*SUFFIXES)


def order_files(files: DataFrame) -> DataFrame:
    """Input files only, by lower-case name, then path."""
    return files.where(is_input(F.col("path"))).orderBy(F.lower(base_name(F.col("path"))), "path")


#: The same suffixes for a listing: each letter in both cases.
_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x[1:]) for x in SUFFIXES) + "}"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, source_file, content, modified_at of a folder's files, not of its subfolders; raises if there is no such folder.

    The listing is filtered by suffix, so that other files aren't read.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", _GLOB).load(folder)
    return raw.where(is_input(F.col("path"))).select("path", base_name(F.col("path")).alias("source_file"), "content", F.col("modificationTime").alias("modified_at"))


def latest_files(files: DataFrame) -> DataFrame:
    """One row per source_file that was sent more than once: the latest, by path where times are equal."""
    order = F.struct("modified_at", "path")
    return files.groupBy("source_file").agg(F.max(order).alias("x")).select("source_file", F.col("x.path").alias("path"), F.col("x.modified_at").alias("modified_at"))
