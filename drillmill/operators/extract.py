"""From cells to one row per file: page sharding, overrides, page merge, wide projection, backfill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillmill.functions.text import csv_list, csv_scalar
from drillmill.schema import CHECKBOX_FIELDS, FIELD_LIST, FIRST_PAGE_FIELDS, LIST_FIELDS, NA

VALUE = ("is_list", "scalar", "items")


def page_of_field(field_no: Column, boundary: int = FIRST_PAGE_FIELDS) -> Column:
    return F.when(field_no < boundary, 1).otherwise(2)


def unpivot_forms(forms: DataFrame, key: Sequence[str], fields: Sequence[str] = tuple(FIELD_LIST)) -> DataFrame:
    """key, field, is_list, scalar, items: one row per field."""
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    cells = [F.struct(F.lit(f).alias("field"), F.lit(f in LIST_FIELDS).alias("is_list"), (none if f in LIST_FIELDS else F.col(f)).alias("scalar"), (F.col(f) if f in LIST_FIELDS else empty).alias("items")) for f in fields]
    return forms.select(*key, F.explode(F.array(*cells)).alias("c")).select(*key, "c.*")


def override_cells(cells: DataFrame, overrides: DataFrame, fields: Sequence[str] = tuple(CHECKBOX_FIELDS)) -> DataFrame:
    """Overrides win over cells of the same file, page and field, NA included, and make cells that are missing."""
    key = ["source_file", "page_no", "field"]
    kept = overrides.where(F.col("field").isin(list(fields))).select(*key, F.struct(*VALUE).alias("new"), F.lit(True).alias("given"))
    joined = cells.select(*key, F.struct(*VALUE).alias("old")).join(kept, key, "full_outer")
    return joined.withColumn("v", F.when(F.col("given"), F.col("new")).otherwise(F.col("old"))).select(*key, "v.*")


def merge_pages(cells: DataFrame, key: Sequence[str] = ("source_file",)) -> DataFrame:
    """Of each key and field the cell of the last page, even if it is NULL or NA.

    Where one page has the cell twice, a value goes before NULL, and the greatest value before others.
    """
    value = F.struct(*VALUE)
    given = F.col("scalar").isNotNull() | F.col("items").isNotNull()
    last = F.max_by(value, F.struct("page_no", given.alias("given"), "scalar", "items"))
    return cells.groupBy(*key, "field").agg(last.alias("v")).select(*key, "field", "v.*")


def wide_rows(cells: DataFrame, key: Sequence[str] = ("source_file",), fields: Sequence[str] = tuple(FIELD_LIST)) -> DataFrame:
    """key and the 30 texts of the output: unknown fields dropped, missing ones NA. One aggregation, no job for the pivot."""
    text = F.when(F.col("is_list"), csv_list(F.col("items"))).otherwise(csv_scalar(F.col("scalar")))
    long = cells.where(F.col("field").isin(list(fields))).select(*key, "field", text.alias("t"))
    return long.groupBy(*key).pivot("field", list(fields)).agg(F.max("t")).na.fill(NA, list(fields))


def backfill(files: DataFrame, rows: DataFrame, fields: Sequence[str] = tuple(FIELD_LIST), key: str = "source_file") -> DataFrame:
    """Exactly one row per file: files without a result get NA everywhere."""
    return files.select(key).dropDuplicates([key]).join(rows, key, "left").na.fill(NA, list(fields))


def filled_count(fields: Sequence[str] = tuple(FIELD_LIST)) -> Column:
    """Number of cells of an output row that aren't NA."""
    return F.size(F.filter(F.array(*(F.col(f) for f in fields)), lambda x: x != NA))


def split_fields(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checkbox cells, other cells)."""
    is_box = F.col("field").isin(CHECKBOX_FIELDS)
    return cells.where(is_box), cells.where(~is_box)


def zip_residents(forms: DataFrame, key: str = "form_id") -> DataFrame:
    """key, resident_no and the aligned entries of the resident lists, with Y or N for away."""
    lists = F.arrays_zip(F.col("Name_of_Individuals_Residing_in_the_Residence").alias("name"), F.col("To_Evacuate").alias("to_evacuate"), F.col("At_Safe_Area").alias("at_safe_area"), F.col("Evacuation_Details").alias("details"))
    rows = forms.select(key, F.col("including_away_at_the_Time_of_the_Evacuation").alias("away_list"), F.posexplode(lists).alias("at", "r"))
    names = ("name", "to_evacuate", "at_safe_area", "details")
    away = F.when(F.coalesce(F.array_contains("away_list", F.col("r")["name"]), F.lit(False)), "Y").otherwise("N")
    return rows.select(key, (F.col("at") + 1).alias("resident_no"), *(F.col("r")[n].alias(n) for n in names), away.alias("away"))


def extract_rows(files: DataFrame, cells: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Output rows of all files: cells, overridden, merged over pages, made wide, backfilled."""
    if overrides is not None:
        cells = override_cells(cells, overrides)
    return backfill(files, wide_rows(merge_pages(cells)))

