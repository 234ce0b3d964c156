"""Model answers as JSON: the exact reading in an Arrow UDF, and a fast one for clean answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drillmill.functions.text import strip_code_fences
from drillmill.schema import FORM_SCHEMA

CELL = T.StructType([T.StructField("field", T.StringType()), T.StructField("is_list", T.BooleanType()), T.StructField("scalar", T.StringType()), T.StructField("items", T.ArrayType(T.StringType()))])


def json_slice(c: Column) -> Column:
    """From the first { to the last } of an answer without its fences; '' if there is no such stretch."""
    t = strip_code_fences(F.coalesce(c, F.lit("")))
    first = F.instr(t, "{")
    last = F.length(t) - F.instr(F.reverse(t), "}") + 1
    return F.when((first > 0) & (F.instr(t, "}") > 0) & (last >= first), F.substr(t, first, last - first + 1)).otherwise("")


def read_object(text: str | None) -> dict:
    """The object in a sliced answer, by Python's rules: last of equal keys, {} for anything else."""
    try:
        found = json.loads(text or "")
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def _text(v: object) -> str | None:
    return None if v is None else v if isinstance(v, str) else str(v)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cells(texts: pd.Series) -> pd.Series:
    """Each pair as the JSON of a CELL."""
    out = []
    for t in texts:
        row = []
        for k, v in read_object(t).items():
            many = isinstance(v, list)
            row.append(json.dumps({"field": k, "is_list": many, "scalar": None if many else _text(v), "items": [str(x) for x in v] if many else None}, ensure_ascii=False))
        out.append(row)
    return pd.Series(out, dtype=object)


def parse_cells(raw: Column) -> Column:
    """ARRAY<STRUCT<field, is_list, scalar, items>> of an answer, read exactly; empty for what holds no object."""
    return F.transform(_cells(json_slice(raw)), lambda x: F.from_json(x, CELL.simpleString()))


def parse_fast(raw: Column) -> Column:
    """Struct of the 30 fields by from_json, without Python; differs from the exact reading on malformed answers."""
    return F.from_json(json_slice(raw), FORM_SCHEMA.simpleString(), {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})


def response_cells(responses: DataFrame, task: str = "page") -> DataFrame:
    """source_file, page_no, field, is_list, scalar, items of the answers to a task."""
    rows = responses.where((F.col("task") == task) & F.col("raw").isNotNull())
    return rows.select("source_file", "page_no", F.explode(parse_cells(F.col("raw"))).alias("c")).select("source_file", "page_no", "c.*")
