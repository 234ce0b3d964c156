"""Queries of the core: name -> (spark, folder) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmill.functions import jsonx, text
from drillmill.functions.similarity import similarity, similarity_short
from drillmill.operators import ablation, checkbox, extract, layout, metrics, packed, predict, units
from drillmill.operators.ranks import with_place
from drillmill.plans.pipeline import rows_from_responses
from drillmill.schema import CHECKBOX_FIELDS, FIELD_LIST, LIST_FIELDS, checkbox_spec, field_meta
from drillmill.session import checkpoint_dir
from drillmill.sources import files as file_source
from drillmill.sources import sinks, synthetic
from drillmill.sources.tables import forms_once, read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Pieces of SQL that several queries share.
_NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_EDGE = r"[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x1c-\x1f\x0b]+"
_STRIP = "regexp_replace({0}, '^" + _EDGE + "|" + _EDGE + "$', '', 'g')"
_CELL = "coalesce(CASE WHEN is_list THEN nullif(array_to_string(list_filter(list_transform(items, lambda x: " + _STRIP.format("coalesce(x, 'None')") + "), lambda x: x <> '' AND upper(x) <> 'NA'), '; '), '') ELSE nullif(" + _STRIP.format("scalar") + ", '') END, 'NA')"
_KINDS = ", ".join(f"('{f}', {f in LIST_FIELDS}, {i})" for i, f in enumerate(FIELD_LIST))
_META = f"meta AS (SELECT * FROM (VALUES {_KINDS}) t(field, is_set, field_no))"
_FORMS = "once AS (SELECT DISTINCT ON (form_id) * FROM forms ORDER BY form_id, received_at)"
_GOLD = (
    f"{_FORMS}, gold AS ("
    + " UNION ALL ".join(f"SELECT form_id, '{f}' AS field, {f in LIST_FIELDS} AS is_list, {'CAST(NULL AS VARCHAR)' if f in LIST_FIELDS else chr(34) + f + chr(34)} AS scalar, {chr(34) + f + chr(34) if f in LIST_FIELDS else 'CAST(NULL AS VARCHAR[])'} AS items FROM once" for f in FIELD_LIST)
    + ")"
)
_MERGED = "merged AS (SELECT source_file, field, is_list, scalar, items FROM (SELECT *, row_number() OVER (PARTITION BY source_file, field ORDER BY page_no DESC, (scalar IS NOT NULL OR items IS NOT NULL) DESC, scalar DESC NULLS LAST, items DESC NULLS LAST) AS k FROM cells) WHERE k = 1)"
_SETOF = "list_distinct(list_filter(list_transform(coalesce({0}, []), lambda x: " + _NORM.format("x") + "), lambda x: x <> '' AND x <> 'na'))"


@query("normalize_text", f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def normalize_text(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query("csv_cell", f"SELECT form_id, page_no, field, {_CELL} AS cell FROM cells")
def csv_cell(spark, folder):
    cell = F.when(F.col("is_list"), text.csv_list(F.col("items"))).otherwise(text.csv_scalar(F.col("scalar")))
    return read_table(spark, folder, "cells").select("form_id", "page_no", "field", cell.alias("cell"))


@query("item_set", f"SELECT form_id, page_no, field, array_to_string(list_sort({_SETOF.format('CASE WHEN is_list THEN items ELSE string_split(scalar, ' + chr(39) + ';' + chr(39) + ') END')}), '|') AS item_set FROM cells")
def item_set(spark, folder):
    items = text.item_set_of(F.col("is_list"), F.col("scalar"), F.col("items"))
    return read_table(spark, folder, "cells").select("form_id", "page_no", "field", F.array_join(F.sort_array(items), "|").alias("item_set"))


@query("scalar_norm", "SELECT form_id, page_no, field, CASE WHEN t = 'na' THEN '' ELSE t END AS norm FROM (SELECT *, " + _NORM.format("CASE WHEN is_list THEN array_to_string(list_transform(items, lambda x: coalesce(x, 'None')), '; ') ELSE scalar END") + " AS t FROM cells)")
def scalar_norm(spark, folder):
    t = text.to_scalar(F.col("is_list"), F.col("scalar"), F.col("items"))
    return read_table(spark, folder, "cells").select("form_id", "page_no", "field", t.alias("norm"))


_T = _STRIP.format("raw")


@query("strip_fences", f"SELECT source_file, page_no, task, CASE WHEN starts_with(t, '```') THEN regexp_replace(regexp_replace(t, '^```(?i:json)?\\s*', ''), '\\s*```$', '') ELSE t END AS body FROM (SELECT *, {_T} AS t FROM responses)")
def strip_fences(spark, folder):
    return read_table(spark, folder, "responses").select("source_file", "page_no", "task", text.strip_code_fences(F.col("raw")).alias("body"))


@query("parse_json")
def parse_json(spark, folder):
    return jsonx.response_cells(read_table(spark, folder, "responses"))


@query("parse_json_fast")
def parse_json_fast(spark, folder):
    rows = read_table(spark, folder, "responses").where((F.col("task") == "page") & F.col("raw").isNotNull())
    return rows.select("source_file", "page_no", jsonx.parse_fast(F.col("raw")).alias("fields"))


@query("safe_stem", r"SELECT path, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]+$', '\1'), '[^A-Za-z0-9_.-]+', '_', 'g') AS stem FROM files")
def safe_stem(spark, folder):
    return read_table(spark, folder, "files").select("path", text.safe_stem(F.col("path")).alias("stem"))


@query("file_filter_sort", r"SELECT path, row_number() OVER (ORDER BY lower(regexp_extract(path, '([^/]*)$', 1)), path) AS place FROM files WHERE regexp_matches(lower(path), '\.(pdf|png|jpe?g|tiff?|bmp)$')")
def file_filter_sort(spark, folder):
    kept = read_table(spark, folder, "files").where(file_source.is_input(F.col("path")))
    return with_place(kept.select("path", F.lower(text.base_name(F.col("path"))).alias("name")), ["name", "path"], "place").select("path", "place")


@query("latest_files", "SELECT source_file, max_by(path, struct_pack(m := modified_at, p := path)) AS path, max(modified_at) AS modified_at FROM files GROUP BY source_file")
def latest_files(spark, folder):
    return file_source.latest_files(read_table(spark, folder, "files"))


@query("page_shard", f"WITH {_META} SELECT c.page_no, m.field, CASE WHEN m.field_no < 24 THEN 1 ELSE 2 END AS shard, count(*) AS n FROM cells c JOIN meta m USING (field) GROUP BY ALL")
def page_shard(spark, folder):
    meta = field_meta(spark).select("field", extract.page_of_field(F.col("field_no")).alias("shard"))
    return read_table(spark, folder, "cells").join(F.broadcast(meta), "field").groupBy("page_no", "field", "shard").agg(F.count("*").alias("n"))


@query("page_merge_last_wins", f"WITH {_MERGED} SELECT source_file, field, {_CELL} AS cell FROM merged")
def page_merge_last_wins(spark, folder):
    merged = extract.merge_pages(read_table(spark, folder, "cells"))
    return merged.select("source_file", "field", F.when(F.col("is_list"), text.csv_list(F.col("items"))).otherwise(text.csv_scalar(F.col("scalar"))).alias("cell"))


_PIVOT = ", ".join(f"max(CASE WHEN field = '{f}' THEN cell END) AS \"{f}\"" for f in FIELD_LIST)
_WIDE = f"wide AS (SELECT source_file, {_PIVOT} FROM (SELECT source_file, field, {_CELL} AS cell FROM merged) GROUP BY source_file)"
_FILLED = ", ".join(f"coalesce(\"{f}\", 'NA') AS \"{f}\"" for f in FIELD_LIST)


@query("pivot_wide", f"WITH {_MERGED}, {_WIDE} SELECT source_file, {_FILLED} FROM wide")
def pivot_wide(spark, folder):
    return extract.wide_rows(extract.merge_pages(read_table(spark, folder, "cells")))


@query("all_na_backfill", f"WITH {_MERGED}, {_WIDE} SELECT f.source_file, {_FILLED} FROM (SELECT DISTINCT source_file FROM files) f LEFT JOIN wide w USING (source_file)")
def all_na_backfill(spark, folder):
    return extract.backfill(read_table(spark, folder, "files"), pivot_wide(spark, folder))


@query("filled_count", f"WITH {_MERGED}, {_WIDE} SELECT source_file, CAST({' + '.join(f'CAST(coalesce({chr(34)}{f}{chr(34)}, {chr(39)}NA{chr(39)}) <> {chr(39)}NA{chr(39)} AS INT)' for f in FIELD_LIST)} AS INT) AS filled FROM (SELECT DISTINCT source_file FROM files) f LEFT JOIN wide w USING (source_file)")
def filled_count(spark, folder):
    return all_na_backfill(spark, folder).select("source_file", extract.filled_count().alias("filled"))


_OPTIONS = "['Pull Station', 'Smoke Detector', 'Other']"


@query("checkbox_override_cells")
def checkbox_override_cells(spark, folder):
    return checkbox.checkbox_cells(read_table(spark, folder, "responses"))


@query("option_filter", f"WITH {_FORMS} SELECT form_id, list_filter(Method_of_Alarm_Activation, lambda x: list_contains({_OPTIONS}, x) OR x = 'NA') AS kept FROM once")
def option_filter(spark, folder):
    once = forms_once(read_table(spark, folder, "forms"), ["form_id", "Method_of_Alarm_Activation"])
    options = F.array(*(F.lit(o) for o in ("Pull Station", "Smoke Detector", "Other")))
    return once.select("form_id", checkbox.keep_options(F.col("Method_of_Alarm_Activation"), options).alias("kept"))


def _coerce_sql(multi: bool) -> str:
    return f"CASE WHEN len(coalesce(s, [])) = 0 THEN ['NA']{'' if multi else ' WHEN len(s) <> 1 THEN ' + chr(91) + chr(39) + 'NA' + chr(39) + chr(93)} ELSE s END"


@query("coerce_selection", f"WITH {_FORMS} SELECT form_id, {_coerce_sql(True)} AS multi, {_coerce_sql(False)} AS single FROM (SELECT form_id, Method_of_Alarm_Activation AS s FROM once)")
def coerce_selection(spark, folder):
    once = forms_once(read_table(spark, folder, "forms"), ["form_id", "Method_of_Alarm_Activation"])
    s = F.col("Method_of_Alarm_Activation")
    return once.select("form_id", checkbox.coerce_selection(s, F.lit(True)).alias("multi"), checkbox.coerce_selection(s, F.lit(False)).alias("single"))




@query(
    "override_merge",
    """WITH base AS (SELECT DISTINCT form_id, field, is_list, scalar, items FROM cells),
    c AS (SELECT form_id, field, scalar FROM (SELECT *, row_number() OVER (PARTITION BY form_id, field ORDER BY scalar NULLS LAST) k FROM base WHERE NOT is_list AND field IN ('Evacuation_Type', 'Type_of_Evacuation', 'was_drill_observed')) WHERE k = 1),
    once AS (SELECT DISTINCT ON (form_id) form_id, Evacuation_Type FROM forms ORDER BY form_id, received_at),
    o AS (SELECT form_id, 'Evacuation_Type' AS field, CASE WHEN Evacuation_Type = 'Other' THEN 'NA' ELSE Evacuation_Type END AS scalar FROM once WHERE Evacuation_Type IS NOT NULL)
    SELECT coalesce(c.form_id, o.form_id) AS form_id, coalesce(c.field, o.field) AS field, CASE WHEN o.form_id IS NOT NULL THEN o.scalar ELSE c.scalar END AS scalar
    FROM c FULL JOIN o ON c.form_id = o.form_id AND c.field = o.field""",
)
def override_merge(spark, folder):
    """Overrides exist for the forms that give a type: they win where they exist, and only there."""
    cells = read_table(spark, folder, "cells").where(~F.col("is_list") & F.col("field").isin("Evacuation_Type", "Type_of_Evacuation", "was_drill_observed"))
    key = F.col("form_id").cast("string").alias("source_file")
    once = cells.groupBy("form_id", "field").agg(F.min("scalar").alias("scalar"))
    none = F.lit(None).cast("array<string>").alias("items")
    base = once.select(key, F.lit(1).alias("page_no"), "field", F.lit(False).alias("is_list"), "scalar", none)
    forms = forms_once(read_table(spark, folder, "forms"), ["form_id", "Evacuation_Type"]).where("Evacuation_Type IS NOT NULL")
    value = F.when(F.col("Evacuation_Type") == "Other", "NA").otherwise(F.col("Evacuation_Type"))
    over = forms.select(key, F.lit(1).alias("page_no"), F.lit("Evacuation_Type").alias("field"), F.lit(False).alias("is_list"), value.alias("scalar"), none)
    return extract.override_cells(base, over).select(F.col("source_file").cast("long").alias("form_id"), "field", "scalar")


@query("extract_responses")
def extract_responses(spark, folder):
    return rows_from_responses(read_table(spark, folder, "files").where(file_source.is_input(F.col("path"))), read_table(spark, folder, "responses"))


@query("split_fields", "WITH " + _META + " SELECT is_box, field, count(*) AS n FROM (SELECT field, field IN (" + ", ".join(f"'{f}'" for f in CHECKBOX_FIELDS) + ") AS is_box FROM cells) GROUP BY ALL")
def split_fields(spark, folder):
    box, other = extract.split_fields(read_table(spark, folder, "cells"))
    per = lambda df, flag: df.groupBy("field").agg(F.count("*").alias("n")).select(F.lit(flag).alias("is_box"), "field", "n")
    return per(box, True).unionByName(per(other, False))


_ENTRY = "CASE WHEN i <= len({0}) THEN {0}[i] END"


@query(
    "zip_residents",
    f"WITH {_FORMS}, n AS (SELECT *, greatest(coalesce(len(Name_of_Individuals_Residing_in_the_Residence), -1), coalesce(len(To_Evacuate), -1), coalesce(len(At_Safe_Area), -1), coalesce(len(Evacuation_Details), -1)) AS k FROM once "
    "WHERE Name_of_Individuals_Residing_in_the_Residence IS NOT NULL AND To_Evacuate IS NOT NULL AND At_Safe_Area IS NOT NULL AND Evacuation_Details IS NOT NULL), "
    "r AS (SELECT *, unnest(range(1, k + 1)) AS i FROM n) "
    f"SELECT form_id, CAST(i AS INT) AS resident_no, {_ENTRY.format('Name_of_Individuals_Residing_in_the_Residence')} AS name, {_ENTRY.format('To_Evacuate')} AS to_evacuate, {_ENTRY.format('At_Safe_Area')} AS at_safe_area, {_ENTRY.format('Evacuation_Details')} AS details, "
    f"CASE WHEN coalesce(list_contains(including_away_at_the_Time_of_the_Evacuation, {_ENTRY.format('Name_of_Individuals_Residing_in_the_Residence')}), false) THEN 'Y' ELSE 'N' END AS away FROM r",
)
def zip_residents(spark, folder):
    columns = ["form_id", "Name_of_Individuals_Residing_in_the_Residence", "including_away_at_the_Time_of_the_Evacuation", "To_Evacuate", "At_Safe_Area", "Evacuation_Details"]
    return extract.zip_residents(forms_once(read_table(spark, folder, "forms"), columns))


def _gold_and_pred(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Gold cells from the forms, predicted ones from the cells; a cell written twice counts once."""
    gold = extract.unpivot_forms(forms_once(read_table(spark, folder, "forms"), ["form_id", *FIELD_LIST]), ["form_id"])
    pred = extract.merge_pages(read_table(spark, folder, "cells").withColumn("page_no", F.lit(1)), ["form_id"])
    return gold, pred


_PRED = "pred AS (SELECT form_id, field, is_list, scalar, items FROM (SELECT *, row_number() OVER (PARTITION BY form_id, field ORDER BY scalar DESC NULLS LAST, items DESC NULLS LAST) AS k FROM cells) WHERE k = 1)"
_SCORED = (
    f"{_GOLD}, {_PRED}, both_cells AS (SELECT g.form_id, g.field, g.is_list AS is_set, g.scalar AS gs, g.items AS gi, p.scalar AS ps, p.items AS pi FROM gold g LEFT JOIN pred p ON g.form_id = p.form_id AND g.field = p.field "
    "WHERE g.form_id IN (SELECT form_id FROM pred)), "
    f"norm AS (SELECT form_id, field, is_set, {_NORM.format('gs')} AS gs, {_NORM.format('ps')} AS ps, {_SETOF.format('gi')} AS gi, {_SETOF.format('pi')} AS pi FROM both_cells), "
    "sets AS (SELECT *, len(list_intersect(pi, gi)) AS tp, len(pi) - len(list_intersect(pi, gi)) AS fp, len(gi) - len(list_intersect(pi, gi)) AS fn FROM norm), "
    "scored AS (SELECT form_id, field, is_set, CASE WHEN is_set THEN tp END AS tp, CASE WHEN is_set THEN fp END AS fp, CASE WHEN is_set THEN fn END AS fn, "
    "CAST(CASE WHEN is_set THEN fp = 0 AND fn = 0 ELSE (CASE WHEN gs = 'na' THEN '' ELSE gs END) = (CASE WHEN ps = 'na' THEN '' ELSE ps END) END AS INT) AS exact FROM sets)"
)
_FIELD_SCORES = (
    f"{_SCORED}, sums AS (SELECT field, is_set, count(*) AS n, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM scored GROUP BY field, is_set), "
    "rates AS (SELECT *, CASE WHEN is_set THEN CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END END AS p, CASE WHEN is_set THEN CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END END AS r, CAST(exact AS DOUBLE) / n AS e FROM sums), "
    "f1s AS (SELECT *, CASE WHEN is_set THEN CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END END AS f FROM rates)"
)


@query("field_metrics", f"WITH {_FIELD_SCORES} SELECT field, is_set, n, exact, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(e, 6) AS exact_rate FROM f1s")
def field_metrics(spark, folder):
    """The flagship: gold forms against extracted cells, per field."""
    scores = metrics.field_scores(metrics.score_cells(metrics.join_cells(*_gold_and_pred(spark, folder), ["form_id"]), with_similarity=False))
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "exact_rate")]
    return scores.select("field", "is_set", "n", "exact", "tp", "fp", "fn", *rounded)


@query("overall_metrics", f"WITH {_FIELD_SCORES} SELECT (SELECT count(DISTINCT form_id) FROM gold WHERE form_id IN (SELECT form_id FROM pred)) AS n_docs, CAST(sum(n) AS BIGINT) AS cells, CAST(sum(exact) AS BIGINT) AS exact_cells, round(CAST(sum(exact) AS DOUBLE) / sum(n), 6) AS overall_exact, round(avg(f), 6) AS macro_f1 FROM f1s")
def overall_metrics(spark, folder):
    gold, pred = _gold_and_pred(spark, folder)
    _, summary = metrics.evaluate(gold, pred, ["form_id"])
    return summary.select("n_docs", "cells", "exact_cells", F.round("overall_exact", 6).alias("overall_exact"), F.round("macro_f1", 6).alias("macro_f1"))


@query("field_similarity")
def field_similarity(spark, folder):
    scores = metrics.field_scores(metrics.score_cells(metrics.join_cells(*_gold_and_pred(spark, folder), ["form_id"])))
    return scores.where(~F.col("is_set")).select("field", "n", F.round("mean_similarity", 6).alias("mean_similarity"))




# Longest common subsequence by nested folds over code points.
_LCS_ROW = "list_reduce(list_transform(range(1, len(b) + 1), lambda j: [CAST(j AS BIGINT)]), lambda acc, x: list_append(acc, CASE WHEN b[x[1]] = c[1] THEN prev[x[1]] + 1 ELSE greatest(acc[len(acc)], prev[x[1] + 1]) END), [CAST(0 AS BIGINT)])"
_LCS = f"list_reduce(list_transform(a, lambda ch: [ch]), lambda prev, c: {_LCS_ROW}, list_transform(range(0, len(b) + 1), lambda z: CAST(0 AS BIGINT)))"
_CODES = "list_transform(string_split(lower({0}), ''), lambda ch: CAST(unicode(ch) AS BIGINT))"
_RATIO = f"WITH t AS (SELECT p_partkey, {_CODES.format('p_name')} AS a, {_CODES.format('p_type')} AS b FROM part) SELECT p_partkey, round(2.0 * list_last({_LCS}) / (len(a) + len(b)), 6) AS ratio FROM t"


@query("similarity", _RATIO)
def similarity_query(spark, folder):
    part = read_table(spark, folder, "part")
    a, b = F.lower("p_name"), F.lower("p_type")
    return part.select("p_partkey", F.round(similarity(a, b), 6).alias("ratio"))


@query("similarity_short", _RATIO)
def similarity_short_query(spark, folder):
    part = read_table(spark, folder, "part")
    return part.select("p_partkey", F.round(similarity_short(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))


@query("checkbox_breakout", f"WITH {_FIELD_SCORES} SELECT field, CASE WHEN is_set THEN 'set' ELSE 'scalar' END AS kind, round(e, 6) AS exact_rate, CAST(row_number() OVER (ORDER BY field) AS INT) AS place FROM f1s WHERE field IN ({', '.join(f'{chr(39)}{f}{chr(39)}' for f in CHECKBOX_FIELDS)})")
def checkbox_breakout(spark, folder):
    order = {f: i for i, f in enumerate(sorted(CHECKBOX_FIELDS), 1)}
    place = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    rows = field_metrics(spark, folder).where(F.col("field").isin(CHECKBOX_FIELDS))
    return rows.select("field", F.when(F.col("is_set"), "set").otherwise("scalar").alias("kind"), "exact_rate", F.element_at(place, F.col("field")).alias("place"))


@query("report_sort", f"WITH {_FIELD_SCORES} SELECT field, round(e, 6) AS exact_rate, CAST(row_number() OVER (ORDER BY round(e, 6), field) AS BIGINT) AS place FROM f1s WHERE NOT is_set")
def report_sort(spark, folder):
    rows = field_metrics(spark, folder).where(~F.col("is_set")).select("field", "exact_rate")
    return with_place(rows, ["exact_rate", "field"], "place")


@query(
    "ablation_delta",
    f"WITH {_SCORED}, per AS (SELECT c.config, s.field, CASE WHEN c.config = 'no checkbox pass' AND s.field IN ({', '.join(f'{chr(39)}{f}{chr(39)}' for f in CHECKBOX_FIELDS)}) THEN e.exact WHEN c.config = 'first page only' AND NOT (s.field IN ({', '.join(f'{chr(39)}{f}{chr(39)}' for f in FIELD_LIST[:24])})) THEN e.exact ELSE s.exact END AS exact "
    "FROM scored s JOIN (SELECT form_id, field, CAST(CASE WHEN is_set THEN len(gi) = 0 ELSE gs IN ('', 'na') END AS INT) AS exact FROM norm) e USING (form_id, field) "
    f"CROSS JOIN (VALUES ('{ablation.BASELINE}'), ('no checkbox pass'), ('first page only')) c(config)), totals AS (SELECT config, CAST(sum(exact) AS DOUBLE) / count(*) AS overall_exact FROM per GROUP BY config) "
    f"SELECT config, round(overall_exact, 6) AS overall_exact, round(overall_exact - (SELECT overall_exact FROM totals WHERE config = '{ablation.BASELINE}'), 6) AS delta FROM totals",
)
def ablation_delta(spark, folder):
    """Predictions without checkbox fields and without second pages, against all of them."""
    gold, pred = _gold_and_pred(spark, folder)
    configs = [ablation.BASELINE, "no checkbox pass", "first page only"]
    field = F.col("field")
    keep = {configs[0]: F.lit(True), configs[1]: ~field.isin(CHECKBOX_FIELDS), configs[2]: field.isin(FIELD_LIST[:24])}
    # one row per cell and configuration; a dropped cell stays as an empty one
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    variants = F.array(*(F.struct(F.lit(c).alias("config"), F.when(k, F.col("scalar")).otherwise(none).alias("scalar"), F.when(k, F.col("items")).otherwise(empty).alias("items")) for c, k in keep.items()))
    per = pred.select("form_id", "field", "is_list", F.explode(variants).alias("v")).select("form_id", "field", "is_list", "v.*")
    table = ablation.evaluate_configs(gold, per, configs, ["form_id"])
    return table.select("config", F.round("overall_exact", 6).alias("overall_exact"), F.round("delta", 6).alias("delta"))


def _words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the documents' lines on a grid, standing in for OCR: a line is a line of text, a word a run without blanks."""
    docs = read_table(spark, folder, "documents").where(F.col("text").isNotNull())
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_num", "line"))
    words = lines.select("doc_id", "line_num", F.posexplode(F.split("line", " ")).alias("token_idx", "text"))
    n = F.length("text")
    return words.select(
        F.col("doc_id").cast("string").alias("source_file"), F.lit(1).alias("page_no"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), "line_num", "token_idx", "text",
        (F.col("token_idx") * 40).alias("left"), (F.col("line_num") * 20).alias("top"), (n * 8).alias("width"), F.lit(16).alias("height"),
    )


_WORDS = (
    "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_num FROM documents WHERE text IS NOT NULL), "
    "words AS (SELECT CAST(doc_id AS VARCHAR) AS source_file, line_num, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS token_idx FROM lines), "
    "grid AS (SELECT *, token_idx * 40 AS x, line_num * 20 AS y, length(text) * 8 AS w, 16 AS h FROM words WHERE trim(text) <> ''), "
    f"grouped AS (SELECT source_file, line_num, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2, min(token_idx) AS first_idx, trim(regexp_replace(string_agg({_NORM.format('text')}, ' ' ORDER BY token_idx), ' +', ' ', 'g')) AS line_text FROM grid GROUP BY source_file, line_num)"
)


@query("line_group", f"WITH {_WORDS} SELECT source_file, CAST(line_num AS INT) AS line_num, line_text, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2 FROM grouped")
def line_group(spark, folder):
    return layout.group_lines(_words(spark, folder)).select("source_file", "line_num", "line_text", "x1", "y1", "x2", "y2")


_SPEC_VALUES = "(VALUES ('alarm', ['alarm']), ('door unit', ['door', 'unit']), ('station call', ['call', 'station'])) spec(field, keywords)"


def _anchor_spec(spark):
    return spark.createDataFrame([("alarm", ["alarm"]), ("door unit", ["door", "unit"]), ("station call", ["call", "station"])], "field string, keywords array<string>")


@query("anchor_by_spec", f"WITH {_WORDS}, hits AS (SELECT s.field, g.*, row_number() OVER (PARTITION BY source_file, s.field ORDER BY y1, first_idx) AS k FROM grouped g CROSS JOIN {_SPEC_VALUES.replace('spec(', 's(')} WHERE len(list_filter(s.keywords, lambda w: contains(g.line_text, w))) = len(s.keywords)) SELECT source_file, field, line_text, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2 FROM hits WHERE k = 1")
def anchor_by_spec(spark, folder):
    hits = layout.anchor_lines(layout.group_lines(_words(spark, folder)), _anchor_spec(spark))
    return hits.select("source_file", "field", "line_text", "x1", "y1", "x2", "y2")


_COLONS = "colons AS (SELECT source_file, line_num, CAST(trunc(arg_min(x + 0.8 * w, token_idx)) AS INT) AS colon_x FROM (SELECT *, token_idx * 40 AS x, length(text) * 8 AS w FROM words) WHERE contains(text, ':') GROUP BY source_file, line_num)"


@query("colon_position", f"WITH {_WORDS}, {_COLONS} SELECT source_file, CAST(line_num AS INT) AS line_num, colon_x FROM colons")
def colon_position(spark, folder):
    return layout.colon_x(_words(spark, folder), ["source_file", "line_num"]).where("colon_x is not null")


@query(
    "value_roi",
    f"WITH {_WORDS}, {_COLONS}, j AS (SELECT g.source_file, g.line_num, g.x1, greatest(g.y1 - 25, 0) AS top, coalesce(c.colon_x, least(g.x2 + 10, 2549)) AS c FROM grouped g LEFT JOIN colons c ON g.source_file = c.source_file AND g.line_num = c.line_num) "
    "SELECT source_file, CAST(line_num AS INT) AS line_num, CAST(least(c + 2, 2549) AS INT) AS vx1, CAST(top AS INT) AS vy1, CAST(greatest(2540, least(c + 2, 2549) + 1) AS INT) AS vx2, CAST(least(top + 95, 3300) AS INT) AS vy2, CAST(least(c + 5, 2549) AS INT) AS kx2 FROM j",
)
def value_roi(spark, folder):
    words = _words(spark, folder)
    lines = layout.group_lines(words).join(layout.colon_x(words, ["source_file", "line_num"]), ["source_file", "line_num"], "left")
    roi = layout.value_roi(F.col("x1"), F.col("y1"), F.col("x2"), F.col("colon_x"), F.lit(2550), F.lit(3300))
    return lines.select("source_file", "line_num", roi.alias("r")).select("source_file", "line_num", "r.*")


#: Groups to look for in the documents' lines: page, field, keywords, options, several, band, output.
_BOXES = ((1, "alarm", ["alarm"], ["Yes", "No"], False, 0.0, 0.5, "first"), (1, "door", ["door"], ["Yes", "No"], False, 0.05, 0.9, "first"), (1, "staff", ["staff"], ["Yes", "No"], True, 0.1, 1.0, "list"))
_BOX_VALUES = ", ".join(f"('{f}', {k}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for _, f, k, _, _, lo, hi, _ in _BOXES)


@query(
    "checkbox_regions",
    f"WITH {_WORDS}, seen AS (SELECT g.*, s.field, s.keywords FROM grid g CROSS JOIN (VALUES {_BOX_VALUES}) s(field, keywords, lo, hi) WHERE g.y >= floor(200 * s.lo) AND g.y < floor(200 * s.hi)), "
    f"l AS (SELECT source_file, field, keywords, line_num, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, min(token_idx) AS first_idx, trim(regexp_replace(string_agg({_NORM.format('text')}, ' ' ORDER BY token_idx), ' +', ' ', 'g')) AS t, CAST(trunc(arg_min(x + 0.8 * w, token_idx) FILTER (WHERE contains(text, ':'))) AS INT) AS colon FROM seen GROUP BY ALL), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY source_file, field ORDER BY y1, first_idx) AS n FROM l WHERE len(list_filter(keywords, lambda w: contains(t, w))) = len(keywords)), "
    "c AS (SELECT *, greatest(y1 - 25, 0) AS top, coalesce(colon, least(x2 + 10, 2549)) AS c FROM k WHERE n = 1) "
    "SELECT source_file, field, CAST(least(c + 2, 2549) AS INT) AS vx1, CAST(top AS INT) AS vy1, CAST(greatest(2540, least(c + 2, 2549) + 1) AS INT) AS vx2, CAST(least(top + 95, 200) AS INT) AS vy2 FROM c",
)
def checkbox_regions(spark, folder):
    """Where each group's label stands in its band of the page, and the region that a model would be asked about."""
    words = _words(spark, folder).withColumn("page_width", F.lit(2550)).withColumn("page_height", F.lit(200))
    return checkbox.locate_groups(words, _BOXES).select("source_file", "field", "vx1", "vy1", "vx2", "vy2")


@query("checkbox_always_valued", f"WITH pages AS (SELECT DISTINCT source_file, page_no FROM responses WHERE page_no IN (1, 2)) SELECT source_file, page_no, field, CASE WHEN is_list THEN 'list' ELSE 'NA' END AS v FROM pages JOIN (VALUES {', '.join(f'({p}, {chr(39)}{f}{chr(39)}, {str(o == chr(108) + chr(105) + chr(115) + chr(116)).lower()})' for p, f, _, _, _, _, _, o in checkbox.CHECKBOX_SPEC)}) s(page_no, field, is_list) USING (page_no)")
def checkbox_always_valued(spark, folder):
    """The override cells of pages on which no label is found: each group of pages 1 and 2 gets its empty value, other pages none."""
    responses = read_table(spark, folder, "responses")
    none = responses.where(F.lit(False)).select("source_file", "page_no", F.lit("").alias("field"), "raw")
    cells = checkbox.checkbox_pass(responses, none)
    return cells.select("source_file", "page_no", "field", F.when(F.col("is_list"), F.when(F.array_contains("items", "NA"), "list")).otherwise(F.col("scalar")).alias("v"))


@query(
    "skew_median_clamp",
    "WITH a AS (SELECT l_orderkey AS page, round(degrees(atan2(l_discount * 100 - 5, l_quantity - 25)), 6) AS angle, l_quantity - 25 AS dx FROM lineitem) "
    "SELECT page, round(least(greatest(coalesce(quantile_cont(CASE WHEN dx <> 0 AND angle > -45 AND angle < 45 THEN angle END, 0.5), 0.0), -10.0), 10.0), 3) AS skew FROM a GROUP BY page",
)
def skew_median_clamp(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    segments = lines.select(F.col("l_orderkey").alias("page"), F.lit(25.0).alias("x1"), F.lit(5.0).alias("y1"), F.col("l_quantity").alias("x2"), (F.col("l_discount") * 100).alias("y2"))
    return layout.skew_angles(segments, ["page"]).select("page", F.round("skew", 3).alias("skew"))


@query("osd_parse", "SELECT p_partkey, CASE WHEN p_size % 5 * 90 IN (90, 180, 270) THEN CAST(p_size % 5 * 90 AS INT) END AS rotate FROM part")
def osd_parse(spark, folder):
    report = F.concat(F.lit("Page number: 0\nRotate: "), ((F.col("p_size") % 5) * 90).cast("string"), F.lit("\nScript: Latin"))
    return read_table(spark, folder, "part").select("p_partkey", text.rotation(report).alias("rotate"))


@query(
    "downscale_dims",
    "WITH d AS (SELECT p_partkey, p_size * 100 AS w, p_size * 70 + 300 AS h FROM part), s AS (SELECT *, sqrt(1000000.0 / (CAST(w AS DOUBLE) * h)) AS f FROM d) "
    "SELECT p_partkey, CAST(CASE WHEN CAST(w AS DOUBLE) * h > 1000000 THEN greatest(1, trunc(w * f)) ELSE w END AS INT) AS width, CAST(CASE WHEN CAST(w AS DOUBLE) * h > 1000000 THEN greatest(1, trunc(h * f)) ELSE h END AS INT) AS height FROM s",
)
def downscale_dims(spark, folder):
    dims = text.downscaled(F.col("p_size") * 100, F.col("p_size") * 70 + 300)
    return read_table(spark, folder, "part").select("p_partkey", dims.alias("d")).select("p_partkey", "d.*")


@query("one_sample", "SELECT source_file, count(*) AS n FROM cells WHERE source_file = 'archive_binder_main.pdf' GROUP BY source_file")
def one_sample(spark, folder):
    return read_table(spark, folder, "cells").where(F.col("source_file") == "archive_binder_main.pdf").groupBy("source_file").agg(F.count("*").alias("n"))


@query("multi_split", "WITH " + _FORMS + " SELECT form_id, array_to_string(string_split(Type_of_Evacuation, '; '), '|') AS parts FROM once")
def multi_split(spark, folder):
    once = forms_once(read_table(spark, folder, "forms"), ["form_id", "Type_of_Evacuation"])
    return once.select("form_id", F.array_join(text.multi_split(F.col("Type_of_Evacuation")), "|").alias("parts")).withColumn("parts", F.when(F.col("parts").isNull(), F.lit(None)).otherwise(F.col("parts")))


@query("checkbox_spec", "SELECT * FROM (VALUES (1, 'Evacuation_Type', false), (1, 'Method_of_Alarm_Activation', true), (1, 'Type_of_Evacuation', true), (2, 'Did_evacuation_time_meet_location_requirement', false)) t(page_no, field, multi)")
def checkbox_spec_query(spark, folder):
    return checkbox_spec(spark).select("page_no", "field", "multi")


@query("mock_perturb")
def mock_perturb(spark, folder):
    gold = extract.unpivot_forms(forms_once(read_table(spark, folder, "forms"), ["form_id", *FIELD_LIST]), ["form_id"])
    return predict.perturb(gold.withColumn("form_id", F.col("form_id").cast("string")), "form_id")


@query("synth_forms")
def synth_forms(spark, folder):
    return synthetic.synthetic_labels(spark, 1000).select("source_file", "fields.*")


@query("csv_roundtrip", f"WITH {_MERGED}, {_WIDE} SELECT source_file, {_FILLED} FROM wide")
def csv_roundtrip(spark, folder):
    """Rows written to CSV in the shared folder and read again."""
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(pivot_wide(spark, folder), path)
    return sinks.read_csv(spark, path)


# Times by cases over regular expressions; the units of bare numbers are those stated in the form or printed on its template.
_TIME_CASES = r"""CASE
    WHEN regexp_full_match(t, '\d+:\d\d:\d\d') THEN CAST(split_part(t, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(t, ':', 2) AS DOUBLE) * 60 + CAST(split_part(t, ':', 3) AS DOUBLE)
    WHEN regexp_full_match(t, '\d+:\d\d') THEN CAST(split_part(t, ':', 1) AS DOUBLE) * 60 + CAST(split_part(t, ':', 2) AS DOUBLE)
    WHEN regexp_full_match(t, '\d+ ?h ?\d+ ?m ?\d+ ?s') THEN CAST(regexp_extract(t, '^(\d+)', 1) AS DOUBLE) * 3600 + CAST(regexp_extract(t, 'h ?(\d+)', 1) AS DOUBLE) * 60 + CAST(regexp_extract(t, 'm ?(\d+)', 1) AS DOUBLE)
    WHEN regexp_full_match(t, '\d+ ?(min|minutes|m|'') ?(and )?\d+ ?(sec|seconds|s|")?') THEN CAST(regexp_extract(t, '^(\d+)', 1) AS DOUBLE) * 60 + CAST(regexp_extract(t, '(\d+)[^\d]*$', 1) AS DOUBLE)
    WHEN regexp_full_match(t, '[\d.]+ ?(hr|hours|hour)') THEN CAST(regexp_extract(t, '^([\d.]+)', 1) AS DOUBLE) * 3600
    WHEN regexp_full_match(t, '[\d.]+ ?(min\.?|mins|minutes?|m)') THEN CAST(regexp_extract(t, '^([\d.]+)', 1) AS DOUBLE) * 60
    WHEN regexp_full_match(t, '[\d.]+ ?(s|secs?\.?|seconds)') THEN CAST(regexp_extract(t, '^([\d.]+)', 1) AS DOUBLE)
    WHEN regexp_full_match(t, '\d+(\.\d+)?') THEN CAST(t AS DOUBLE) * scale END"""
_WORD_CASES = "".join(f"WHEN starts_with(t, '{w} ') THEN '{n}' || substr(t, {len(w) + 1}) " for n, w in enumerate(units.WORDS, 1))
_P4 = rf"""WITH once AS (SELECT DISTINCT ON (form_id) * FROM forms ORDER BY form_id, received_at),
    u AS (SELECT o.*, lower(coalesce(Description_of_evacuation, '') || ' . ' || coalesce(Problems_noted_correction_actions_taken, '')) AS d, lower(bare_time_unit) AS printed FROM once o LEFT JOIN form_templates USING (template_code)),
    v AS (SELECT *, coalesce(nullif(regexp_extract(d, '(?:times on this sheet are|clock was read|all times noted) in (seconds|minutes)', 1), ''), nullif(regexp_extract(d, '(seconds|minutes) by stopwatch', 1), ''), printed) AS unit FROM u),
    long AS ({' UNION ALL '.join(f"SELECT form_id, '{f}' AS field, {f} AS raw, CASE unit WHEN 'seconds' THEN 1.0 WHEN 'minutes' THEN 60.0 WHEN 'hundredths of a minute' THEN 0.6 END AS scale FROM v" for f in units.TIME_FIELDS)}),
    a AS (SELECT *, regexp_replace(replace(replace(lower(trim(raw)), 'half a ', '.5 '), ',', '.'), '^(approx\.|about) ', '') AS t FROM long),
    b AS (SELECT * EXCLUDE (t), CASE {_WORD_CASES} ELSE t END AS t FROM a),
    c AS (SELECT * EXCLUDE (t), regexp_replace(regexp_replace(replace(t, ' and a half', '.5'), '^(\d+) 1/2', '\1.5'), '^1/2', '.5') AS t FROM b),
    e AS (SELECT * EXCLUDE (t), replace(t, '½', '.5') AS t FROM c),
    s AS (SELECT form_id, field, {_TIME_CASES} AS x FROM e)
    SELECT form_id, field, CAST(floor(round(x, 6) + 0.5) AS INT) AS seconds FROM s WHERE x IS NOT NULL"""


@query("p4_found", _P4)
def p4_found(spark, folder):
    return units.to_seconds(read_table(spark, folder, "forms"), read_table(spark, folder, "form_templates"))


@query("p4_units")
def p4_units(spark, folder):
    return units.unit_report(read_table(spark, folder, "forms"), read_table(spark, folder, "form_templates"))


@query("p5_found")
def p5_found(spark, folder):
    return packed.found(read_table(spark, folder, "forms"))

