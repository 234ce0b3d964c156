"""Ablations: one evaluation over configurations x documents, and each configuration's difference to the baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillmill.operators.metrics import field_scores, join_cells, overall, score_cells

BASELINE = "full pipeline (baseline)"
#: Configurations: settings that differ from the defaults (fixed values).
ABLATIONS: dict[str, dict] = {
    BASELINE: {},
    "no deskew": {"do_deskew": False},
    "no CLAHE": {"use_clahe": False},
    "no checkbox pass": {"checkbox_enabled": False},
    "no OSD orientation": {"enable_osd_orientation": False},
    "300 DPI (vs 600)": {"pdf_render_dpi": 300},
    "VLM only (no CV, no checkbox)": {"preprocess_enabled": False, "checkbox_enabled": False},
}


def evaluate_configs(gold: DataFrame, pred: DataFrame, configs: Sequence[str], key: Sequence[str], with_similarity: bool = False) -> DataFrame:
    """config, overall_exact, macro_f1 and delta to the baseline. pred has a column config; the configurations are few."""
    per = gold.withColumn("config", F.explode(F.array(*(F.lit(c) for c in configs))))  # a handful of copies of each cell
    scored = score_cells(join_cells(per, pred, ["config", *key]), with_similarity)
    totals = overall(field_scores(scored, ["config"]), by=["config"])
    one = F.lit(1).alias("k")
    base = totals.where(F.col("config") == configs[0]).select(F.col("overall_exact").alias("base"), one)
    return totals.select("*", one).join(F.broadcast(base), "k").withColumn("delta", F.col("overall_exact") - F.col("base")).drop("base", "k")
