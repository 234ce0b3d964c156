"""Checkbox answers: whitelist, coercion, and the override cells they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillmill.functions.jsonx import json_slice
from drillmill.functions.text import multi_join
from drillmill.operators.layout import LINE, colon_x, group_lines, has_keywords, value_roi
from drillmill.schema import CHECKBOX_SPEC


def keep_options(selected: Column, options: Column) -> Column:
    """Answers among the options or NA; order and repeats stay."""
    return F.filter(selected, lambda x: F.array_contains(options, x) | (x == "NA"))


def coerce_selection(selected: Column, multi: Column) -> Column:
    """[NA] for nothing, and for other than one answer where one is allowed."""
    na = F.array(F.lit("NA"))
    s = F.coalesce(selected, F.array().cast("array<string>"))
    return F.when(F.size(s) == 0, na).when(~multi & (F.size(s) != 1), na).otherwise(s)


def group_value(selected: Column, output: Column) -> Column:
    """STRUCT<is_list, scalar, items> of a group: [NA] counts as nothing found, which gives NA again."""
    na = F.array(F.lit("NA"))
    s = F.when(F.size(selected) == 0, na).otherwise(selected)
    scalar = F.when(output == "first", F.element_at(s, 1)).when(output == "join", multi_join(s))
    return F.struct((output == "list").alias("is_list"), scalar.alias("scalar"), F.when(output == "list", s).alias("items"))


def _groups(spec) -> list[Column]:
    names = ("page_no", "field", "keywords", "options", "multi", "band_lo", "band_hi", "output")
    many = lambda v: F.array(*(F.lit(x) for x in v)) if isinstance(v, list) else F.lit(v)
    return [F.struct(*(many(v).alias(n) for n, v in zip(names, row, strict=True))) for row in spec]


def on_groups(rows: DataFrame, spec=CHECKBOX_SPEC) -> DataFrame:
    """rows (with page_no) once for each checkbox group of their page, the group's columns beside them; other pages have none."""
    own = F.filter(F.array(*_groups(spec)), lambda g: g["page_no"] == F.col("page_no"))
    kept = [F.col(c) for c in rows.columns]
    return rows.select(*kept, F.explode(own).alias("g")).select(*kept, *(F.col(f"g.{n}").alias(n) for n in ("field", "keywords", "options", "multi", "band_lo", "band_hi", "output")))


def locate_groups(words: DataFrame, spec=CHECKBOX_SPEC) -> DataFrame:
    """source_file, page_no, field, options, multi, output and the region (vx1 to vy2) right of each group's label that is found.

    A group sees only the words that begin in its band of the page. The topmost line with all its keywords is the label; the region begins
    at the line's first colon.
    """
    top, height = F.col("top"), F.col("page_height")
    seen = on_groups(words, spec).where((top >= F.floor(height * F.col("band_lo"))) & (top < F.floor(height * F.col("band_hi"))))
    key = [*LINE, "field"]
    about = ["options", "multi", "output", "keywords", "page_width", "page_height"]
    lines = group_lines(seen, [*key, *about])
    labels = lines.where(has_keywords(F.col("line_text"), F.col("keywords")))
    first = labels.groupBy("source_file", "page_no", "field").agg(F.min_by(F.struct("block_num", "par_num", "line_num", "x1", "y1", "x2", *about), F.struct("y1", "first_idx")).alias("b")).select("source_file", "page_no", "field", "b.*")
    found = first.join(colon_x(seen, key), key, "left")
    box = value_roi(F.col("x1"), F.col("y1"), F.col("x2"), F.col("colon_x"), F.col("page_width"), F.col("page_height"))
    return found.select("source_file", "page_no", "field", "options", "multi", "output", box.alias("r")).select("source_file", "page_no", "field", "options", "multi", "output", "r.vx1", "r.vy1", "r.vx2", "r.vy2")


def answered(answers: DataFrame) -> DataFrame:
    """Override cells of answers (source_file, page_no, raw, and the group's field, options, multi, output): always a value."""
    none = F.array().cast("array<string>")
    selected = F.coalesce(F.from_json(F.get_json_object(json_slice(F.col("raw")), "$.selected"), "array<string>"), none)
    value = group_value(coerce_selection(keep_options(selected, F.col("options")), F.col("multi")), F.col("output"))
    return answers.select("source_file", "page_no", "field", value.alias("v")).select("source_file", "page_no", "field", "v.*")


def checkbox_pass(pages: DataFrame, answers: DataFrame, spec=CHECKBOX_SPEC) -> DataFrame:
    """Override cells of every group of every page that could be read: NA where its label wasn't found or the model failed.

    pages: source_file, page_no; answers: source_file, page_no, field, raw, one row for each region asked about.
    """
    known = pages.where(F.col("page_no").isNotNull()).select("source_file", "page_no").distinct()
    once = answers.groupBy("source_file", "page_no", "field").agg(F.max("raw").alias("raw"))
    return answered(on_groups(known, spec).join(once, ["source_file", "page_no", "field"], "left"))


def checkbox_cells(responses: DataFrame, field: str | None = None) -> DataFrame:
    """Override cells of stored checkbox answers; a repeated answer counts once.

    responses: source_file, page_no, task, raw, and field, the group that an answer is about. Without that column an answer belongs to
    the group named, by default the method of alarm activation, which this table's answers are about.
    """
    answers = responses.where((F.col("task") == "checkbox") & F.col("raw").isNotNull())
    if "field" not in responses.columns:
        answers = answers.withColumn("field", F.lit(field or "Method_of_Alarm_Activation"))
    groups = F.array(*_groups(CHECKBOX_SPEC))
    rows = answers.select("source_file", "page_no", "raw", F.explode(F.filter(groups, lambda g: g["field"] == F.col("field"))).alias("g")).select("source_file", "page_no", "raw", "g.field", "g.options", "g.multi", "g.output")
    return answered(rows).dropDuplicates()
