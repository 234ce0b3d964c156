"""Outputs: CSV rows, stored answers, markdown report."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmill.operators.ablation import BASELINE
from drillmill.schema import CHECKBOX_FIELDS, FIELD_LIST, LIST_FIELDS

_CSV = {"header": "true", "escape": '"', "lineSep": "\n", "encoding": "UTF-8", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def write_csv(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """source_file and the 30 fields in order, sorted by lower-case name; doubled quotes, record end "\\n".

    single_file gathers the rows into one file, for small runs; without it each task writes a sorted part.
    """
    out = rows.select("source_file", *FIELD_LIST)
    out = out.orderBy(F.lower("source_file"), "source_file")
    (out.coalesce(1) if single_file else out).write.mode("overwrite").options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in ("source_file", *FIELD_LIST))
    return spark.read.schema(schema).options(**(_CSV | {"multiLine": "true"})).csv(path)


def store_responses(responses: DataFrame, path: str) -> DataFrame:
    """Written once and read back: later steps never ask the model again."""
    responses.write.mode("overwrite").parquet(path)
    return responses.sparkSession.read.parquet(path)


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "|".join("---" for _ in head) + "|", *("| " + " | ".join(str(x) for x in r) + " |" for r in rows)]


def render_markdown(scores: DataFrame, summary: DataFrame, title: str = "Evaluation report", numeric_order: bool = False) -> str:
    """The report of at most 30 score rows. Scalar rows are ordered by the formatted rate ("100.0%" before "66.7%"), or by its
    value with numeric_order."""
    s, rows = summary.first(), {r["field"]: r for r in scores.collect()}
    lines = [f"# {title}", "", f"- **Documents evaluated:** {s['n_docs']}", f"- **Overall exact-match (all cells):** {s['overall_exact']:.1%}", f"- **Macro-F1 over set fields:** {s['macro_f1']:.3f}", ""]
    box = [[f, "set" if f in LIST_FIELDS else "scalar", f"{rows[f]['exact_rate']:.1%}", f"{rows[f]['f1' if f in LIST_FIELDS else 'mean_similarity']:.3f}"] for f in sorted(CHECKBOX_FIELDS)]
    lines += ["## Checkbox fields", *_table(["field", "type", "exact", "F1 / sim"], box), ""]
    scalars = [[f, f"{r['exact_rate']:.1%}", f"{r['mean_similarity']:.3f}", r["n"]] for f, r in sorted(rows.items()) if f not in LIST_FIELDS]
    scalars.sort(key=(lambda x: rows[x[0]]["exact_rate"]) if numeric_order else lambda x: x[1])
    lines += ["## Scalar (text) fields", *_table(["field", "exact-match", "mean sim", "n"], scalars), ""]
    sets = [[f, f"{r['precision']:.3f}", f"{r['recall']:.3f}", f"{r['f1']:.3f}", f"{r['exact_rate']:.1%}"] for f, r in sorted(rows.items()) if f in LIST_FIELDS]
    sets.sort(key=lambda x: x[3])
    return "\n".join([*lines, "## Set / list fields", *_table(["field", "precision", "recall", "F1", "exact-set"], sets), ""])


def plot_rows(scores: DataFrame) -> list[tuple[str, float]]:
    """Bars of a chart: scalars by exact rate, then sets by F1, ascending."""
    rows = scores.collect()
    scalars = sorted((r["exact_rate"], r["field"]) for r in rows if r["field"] not in LIST_FIELDS)
    sets = sorted((r["f1"], f"{r['field']} (set)") for r in rows if r["field"] in LIST_FIELDS)
    return [(f, v) for v, f in scalars + sets]


def render_ablations(table: DataFrame) -> str:
    rows = sorted(table.collect(), key=lambda r: (r["config"] != BASELINE, r["config"]))
    return "\n".join(_table(["configuration", "exact-match", "difference to baseline"], [[r["config"], f"{r['overall_exact']:.1%}", f"{r['delta']:+.1%}"] for r in rows]))


def write_text(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
