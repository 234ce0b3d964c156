"""Whole runs: a folder of forms to rows, and labels to an evaluation."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmill.functions.jsonx import response_cells
from drillmill.functions.text import base_name
from drillmill.operators.ablation import ABLATIONS, evaluate_configs
from drillmill.operators.checkbox import checkbox_cells, checkbox_pass, locate_groups
from drillmill.operators.extract import backfill, extract_rows
from drillmill.operators.metrics import evaluate
from drillmill.operators.predict import MockPredictor
from drillmill.ports import ask_pages, ask_regions, rasterise, read_words
from drillmill.schema import FIELD_LIST
from drillmill.session import cut
from drillmill.settings import Settings
from drillmill.sources.files import read_files
from drillmill.sources.labels import label_cells


def rows_from_responses(files: DataFrame, responses: DataFrame, settings: Settings | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Output rows of files from stored answers; overrides are the checkbox pass's cells, by default those of stored answers.

    A page whose answer is an error makes the whole file NA, as a failed call does in a serial run; with
    failure_scope="page" only that page's fields are missing. An answer that holds no object costs its page only.
    """
    settings = settings or Settings()
    if not settings.checkbox_enabled:
        overrides = None
    elif overrides is None:
        overrides = checkbox_cells(responses)
    rows = extract_rows(files, response_cells(responses), overrides)
    if settings.failure_scope == "page":
        return rows
    # a page that was asked again and answered then is no failure
    asked = responses.where(F.col("task") == "page").groupBy("source_file", "page_no").agg(F.max(F.col("raw").isNotNull()).alias("answered"))
    failed = asked.where(~F.col("answered")).select("source_file").distinct()
    return backfill(files, rows.join(failed, "source_file", "left_anti"))


def run_batch(spark: SparkSession, folder: str, settings: Settings | None = None, prompt: str = "") -> DataFrame:
    """Rows of all files of a folder; one page's answer is asked for once and kept in the checkpoint folder."""
    settings = settings or Settings()
    return rows_of_files(read_files(spark, folder), settings, prompt)


def rows_of_files(files: DataFrame, settings: Settings, prompt: str) -> DataFrame:
    files = cut(files)
    pages = cut(rasterise(files, settings))
    answers = cut(ask_pages(pages, settings, prompt))
    overrides = run_checkbox_pass(pages, settings) if settings.checkbox_enabled else None
    return rows_from_responses(files.select("source_file"), answers, settings, overrides)


def run_checkbox_pass(pages: DataFrame, settings: Settings) -> DataFrame:
    """Override cells of the pages: words, labels, regions, one question for each region, kept before use. Words are read once a page."""
    regions = locate_groups(read_words(pages))
    asked = regions.join(pages.select("source_file", "page_no", "image"), ["source_file", "page_no"])
    return checkbox_pass(pages, cut(ask_regions(asked, settings)))


def run_eval(labels: DataFrame, predictor: MockPredictor | RealPredictor | None = None) -> tuple[DataFrame, DataFrame]:
    gold = label_cells(labels)
    return evaluate(gold, (predictor or MockPredictor()).predict(gold))


def row_cells(rows: DataFrame) -> DataFrame:
    """Output rows as predicted cells: texts, as sets are read from their joined text."""
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).alias("scalar")) for f in FIELD_LIST]
    each = rows.select("source_file", F.explode(F.array(*cells)).alias("c"))
    return each.select("source_file", "c.field", F.lit(False).alias("is_list"), "c.scalar", F.lit(None).cast("array<string>").alias("items"))


class RealPredictor:
    """Predicts the labelled files by a whole run over their folder."""

    def __init__(self, folder: str, settings: Settings | None = None, prompt: str = ""):
        self.folder, self.settings, self.prompt = folder, settings or Settings(), prompt

    def predict(self, label_cells: DataFrame) -> DataFrame:
        wanted = label_cells.select("source_file").distinct()
        return row_cells(run_batch(label_cells.sparkSession, self.folder, self.settings, self.prompt).join(wanted, "source_file", "left_semi"))


def run_ablations(labels: DataFrame, folder: str, settings: Settings | None = None, prompt: str = "") -> DataFrame:
    """config, overall_exact, macro_f1, delta of each configuration of ABLATIONS: a run and its answers for each, one evaluation."""
    gold, settings = label_cells(labels), settings or Settings()
    runs = [RealPredictor(folder, settings.with_overrides(**changes), prompt).predict(gold).withColumn("config", F.lit(name)) for name, changes in ABLATIONS.items()]
    return evaluate_configs(gold, functools.reduce(DataFrame.unionByName, runs), list(ABLATIONS), ["source_file"])


def extract_one(spark: SparkSession, path: str, settings: Settings | None = None, prompt: str = "") -> DataFrame:
    """The output row of one file; it is made even if nothing could be read."""
    settings = settings or Settings()
    file = spark.read.format("binaryFile").load(path).select(base_name(F.col("path")).alias("source_file"), "content")
    return rows_of_files(file, settings, prompt)
