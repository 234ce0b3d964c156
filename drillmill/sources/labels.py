"""Ground truth in JSON lines, demo samples, prompt and report texts."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmill.schema import FORM_SCHEMA, LABEL_SCHEMA, LIST_FIELDS


def _value(name: str, v: object) -> object:
    if v is None:
        return None
    if name in LIST_FIELDS:
        return [str(x) for x in v] if isinstance(v, list) else [str(v)]
    return "; ".join(map(str, v)) if isinstance(v, list) else str(v)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """source_file, fields; blank lines are skipped and the last line of a source_file wins.

    The winner depends on the order of lines, which a distributed read doesn't show, and labels are made by hand, hence few:
    the driver reads them. For files without repeated names, use read_labels_distributed.
    """
    rows: dict[str, tuple] = {}
    with Path(path).open(encoding="utf-8") as lines:
        for line in lines:
            if line.strip():
                x = json.loads(line)
                rows[x["source_file"]] = tuple(_value(f.name, x["fields"].get(f.name)) for f in FORM_SCHEMA)
    return spark.createDataFrame(list(rows.items()), LABEL_SCHEMA)


def read_labels_distributed(spark: SparkSession, path: str) -> DataFrame:
    """The same by Spark's JSON reader; raises when the result is used if a source_file comes twice."""
    df = spark.read.schema(LABEL_SCHEMA).json(path)
    once = df.groupBy("source_file").agg(F.count("*").alias("k"), F.first("fields").alias("fields"))
    return once.select("source_file", F.when(F.col("k") == 1, F.col("fields")).otherwise(F.raise_error(F.concat(F.lit("labelled twice: "), "source_file")).cast(FORM_SCHEMA)).alias("fields"))


def read_samples(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """source_file, fields, path of every labelled sample, repeats kept; empty if there are no labels."""
    if not Path(path).exists():
        return spark.createDataFrame([], LABEL_SCHEMA).withColumn("path", F.lit(None).cast("string"))
    return spark.read.schema(LABEL_SCHEMA).json(path).withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "source_file"))


def one_sample(samples: DataFrame, source_file: str) -> DataFrame:
    return samples.where(F.col("source_file") == source_file).limit(1)


def label_cells(labels: DataFrame) -> DataFrame:
    from drillmill.operators.extract import unpivot_forms

    return unpivot_forms(labels.select("source_file", "fields.*"), ["source_file"])


def read_text(path: str) -> str | None:
    """A prompt or a rendered report; None if there is no such file."""
    p = Path(path)
    return p.read_text(encoding="utf-8") if p.exists() else None


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select("source_file", "fields").write.mode("overwrite").option("ignoreNullFields", "false").json(path)
