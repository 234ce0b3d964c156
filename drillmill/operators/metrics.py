"""Field-level evaluation: exact match, similarity, precision, recall, F1; everything additive, one shuffle per step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillmill.functions.similarity import similarity
from drillmill.functions.text import item_set_of, to_scalar
from drillmill.schema import LIST_FIELDS, field_meta


def join_cells(gold: DataFrame, pred: DataFrame, key: Sequence[str], missing_docs: str = "drop") -> DataFrame:
    """Gold cells with the predicted value beside them.

    A document without any prediction is left out (or counts as empty with missing_docs="penalize"); a missing field of a
    predicted document counts as empty.
    """
    key = list(key)
    if missing_docs == "drop":
        gold = gold.join(pred.select(*key).distinct(), key, "left_semi")
    p = pred.select(*key, "field", F.struct("is_list", "scalar", "items").alias("p"))
    return gold.select(*key, "field", F.struct("is_list", "scalar", "items").alias("g")).join(p, [*key, "field"], "left")


def score_cells(joined: DataFrame, with_similarity: bool = True) -> DataFrame:
    """Adds is_set, exact, sim, tp, fp, fn to each cell."""
    is_set = F.col("field").isin(LIST_FIELDS)
    parts = lambda x: (F.coalesce(F.col(f"{x}.is_list"), F.lit(False)), F.col(f"{x}.scalar"), F.col(f"{x}.items"))
    df = joined.withColumn("is_set", is_set)
    for x in "gp":
        df = df.withColumn(f"{x}s", F.when(~F.col("is_set"), to_scalar(*parts(x)))).withColumn(f"{x}i", F.when(F.col("is_set"), item_set_of(*parts(x))))
    tp, fp, fn = F.size(F.array_intersect("pi", "gi")), F.size(F.array_except("pi", "gi")), F.size(F.array_except("gi", "pi"))
    df = df.withColumn("tp", F.when(F.col("is_set"), tp)).withColumn("fp", F.when(F.col("is_set"), fp)).withColumn("fn", F.when(F.col("is_set"), fn))
    exact = F.when(F.col("is_set"), (F.col("fp") == 0) & (F.col("fn") == 0)).otherwise(F.col("gs") == F.col("ps"))
    sim = F.when(~F.col("is_set"), similarity(F.coalesce("ps", F.lit("")), F.coalesce("gs", F.lit("")))) if with_similarity else F.lit(None).cast("double")
    return df.withColumn("exact", exact.cast("int")).withColumn("sim", sim).drop("gs", "ps", "gi", "pi", "g", "p")


def field_scores(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per field: n, exact, rates, tp, fp, fn, precision, recall, f1; all 30 fields, even without documents."""
    sums = scored.groupBy(*by, "field").agg(
        F.count("*").alias("n"), F.sum("exact").alias("exact"), F.sum("sim").alias("sim_sum"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
    )
    if not by:
        meta = field_meta(scored.sparkSession).select("field", F.col("is_list").alias("is_set"))
        sums = F.broadcast(meta).join(sums, "field", "left")
    else:
        sums = sums.withColumn("is_set", F.col("field").isin(LIST_FIELDS))
    sums = sums.na.fill(0, ["n", "exact", "sim_sum"])
    for c in ("tp", "fp", "fn"):
        sums = sums.withColumn(c, F.when(F.col("is_set"), F.coalesce(c, F.lit(0))))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0))
    sums = sums.withColumn("precision", F.when(F.col("is_set"), rate(F.col("tp"), F.col("tp") + F.col("fp"))))
    sums = sums.withColumn("recall", F.when(F.col("is_set"), rate(F.col("tp"), F.col("tp") + F.col("fn"))))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    sums = sums.withColumn("f1", F.when(F.col("is_set"), f1))
    over_n = lambda c: F.coalesce(F.try_divide(c, F.col("n")), F.lit(0.0))
    return sums.withColumn("exact_rate", over_n(F.col("exact"))).withColumn("mean_similarity", F.when(~F.col("is_set"), over_n(F.col("sim_sum")))).drop("sim_sum")


def overall(scores: DataFrame, n_docs: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """overall_exact over all cells and macro_f1 over the set fields, from the field scores."""
    total = scores.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum("exact"), F.sum("n")), F.lit(0.0)).alias("overall_exact"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        F.sum("n").alias("cells"), F.sum("exact").alias("exact_cells"),
    )
    if n_docs is None:
        return total
    one = F.lit(1).alias("k")  # a row each
    return total.select("*", one).join(F.broadcast(n_docs.select("*", one)), "k").drop("k")


def evaluate(gold: DataFrame, pred: DataFrame, key: Sequence[str] = ("source_file",), missing_docs: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(field scores, one-row summary with n_docs)."""
    scores = field_scores(score_cells(join_cells(gold, pred, key, missing_docs)))
    common = gold.select(*key).distinct()
    if missing_docs == "drop":
        common = common.join(pred.select(*key).distinct(), list(key), "left_semi")
    return scores, overall(scores, common.agg(F.count("*").alias("n_docs")))
