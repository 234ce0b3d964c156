import math

import pytest
from pyspark.sql import functions as F

from drillmill.operators import ablation, checkbox, extract, layout, metrics, predict
from drillmill.operators.ranks import with_place
from drillmill.schema import FIELD_LIST, LIST_FIELDS, SCALAR_FIELDS, checkbox_spec, json_schema, page_schema

CELLS = "source_file string, page_no int, field string, is_list boolean, scalar string, items array<string>"


def test_schema_families():
    assert len(FIELD_LIST) == 30
    assert len(LIST_FIELDS) == 6
    assert not set(LIST_FIELDS) & set(SCALAR_FIELDS)
    assert [len(page_schema(n)) for n in (1, 2, 3)] == [24, 6, 6]
    assert json_schema(page_schema(2))["required"][0] == "Problems_noted_correction_actions_taken"


def test_override_merge_wide_backfill(spark):
    cells = spark.createDataFrame(
        [("a", 1, "Location", False, "x", None), ("a", 2, "Location", False, None, None), ("a", 1, "Evacuation_Type", False, "Other", None), ("a", 1, "nonsense", False, "z", None), ("a", 1, "To_Evacuate", True, None, ["1", "NA"])], CELLS
    )
    over = spark.createDataFrame([("a", 1, "Evacuation_Type", False, "NA", None), ("a", 1, "Method_of_Alarm_Activation", True, None, ["Other"]), ("a", 1, "Location", False, "no", None)], CELLS)
    files = spark.createDataFrame([("a",), ("b",)], "source_file string")
    rows = {r.source_file: r for r in extract.extract_rows(files, cells, over).collect()}
    assert rows["a"].Location == "NA"  # the last page wins, even with NULL
    assert rows["a"].Evacuation_Type == "NA"  # an override of NA erases
    assert rows["a"].Method_of_Alarm_Activation == "Other"  # and one without a cell makes one
    assert rows["a"].To_Evacuate == "1"
    assert set(rows["b"][1:]) == {"NA"}
    assert list(rows["a"].asDict()) == ["source_file", *FIELD_LIST]
    counted = extract.extract_rows(files, cells, over).select("source_file", extract.filled_count().alias("n")).collect()
    assert {r.source_file: r.n for r in counted} == {"a": 2, "b": 0}


def test_merge_prefers_values_on_one_page(spark):
    cells = spark.createDataFrame([("a", 1, "Location", False, None, None), ("a", 1, "Location", False, "x", None)], CELLS)
    assert extract.merge_pages(cells).first().scalar == "x"


@pytest.mark.parametrize(("s", "multi", "want"), [([], True, ["NA"]), ([], False, ["NA"]), (["Yes", "No"], False, ["NA"]), (["Yes"], False, ["Yes"]), (["a", "b"], True, ["a", "b"]), (["NA", "Yes"], True, ["NA", "Yes"]), (["Yes", "Yes"], False, ["NA"]), (None, True, ["NA"])])
def test_coercion(spark, s, multi, want):
    df = spark.createDataFrame([(s,)], "s array<string>")
    assert df.select(checkbox.coerce_selection(F.col("s"), F.lit(multi)).alias("r")).first().r == want


def test_options_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(["Other", "x", "NA", "Other"],)], "s array<string>")
    assert df.select(checkbox.keep_options(F.col("s"), F.array(F.lit("Other"))).alias("r")).first().r == ["Other", "NA", "Other"]


def test_checkbox_cells(spark):
    df = spark.createDataFrame([("a", 1, "checkbox", '```json\n{"selected": ["Other", "Siren"]}\n```', None), ("b", 1, "checkbox", "broken", None), ("c", 1, "checkbox", None, "failed")], "source_file string, page_no int, task string, raw string, error string")
    rows = {r.source_file: r["items"] for r in checkbox.checkbox_cells(df).collect()}
    assert rows == {"a": ["Other"], "b": ["NA"]}


def test_lines_anchor_colon_roi(spark):
    words = [("f", 1, 1, 1, 1, 0, "Evacuation", 10, 100, 80, 20), ("f", 1, 1, 1, 1, 1, "Type:", 100, 98, 50, 20), ("f", 1, 1, 1, 2, 2, "Type", 10, 300, 40, 20), ("f", 1, 1, 1, 2, 3, "of", 60, 300, 20, 20), ("f", 1, 1, 1, 2, 4, "Evacuation", 90, 300, 90, 20), ("f", 1, 1, 1, 2, 5, " ", 0, 0, 1, 1)]
    df = spark.createDataFrame(words, "source_file string, page_no int, block_num int, par_num int, line_num int, token_idx int, text string, left int, top int, width int, height int")
    lines = layout.group_lines(df)
    got = {r.line_num: (r.line_text, r.x1, r.y1, r.x2, r.y2) for r in lines.collect()}
    assert got == {1: ("evacuation type", 10, 98, 150, 120), 2: ("type of evacuation", 10, 300, 180, 320)}
    anchors = {r.field: r.y1 for r in layout.anchor_lines(lines, checkbox_spec(spark)).collect()}
    assert anchors == {"Evacuation_Type": 98, "Type_of_Evacuation": 98}  # one keyword set, one row
    colons = {r.line_num: r.colon_x for r in layout.colon_x(df, ["line_num"]).collect()}
    assert colons == {1: 140, 2: None}
    glyphs = spark.createDataFrame([(2, ":", 200, 211), (2, "x", 1, 2)], "line_num int, glyph string, left int, right int")
    assert {r.line_num: r.colon_x for r in layout.colon_x(df, ["line_num"], glyphs).collect()} == {1: 140, 2: 205}
    roi = lines.select("line_num", layout.value_roi(F.col("x1"), F.col("y1"), F.col("x2"), F.lit(None).cast("int"), F.lit(500), F.lit(110)).alias("r")).where("line_num = 1").first().r
    assert (roi.vx1, roi.vy1, roi.vx2, roi.vy2) == (162, 73, 490, 110)


def test_skew(spark):
    seg = [("flat", 0.0, 0.0, 100.0, 1.0), ("steep", 0.0, 0.0, 10.0, 5.0), ("none", 0.0, 0.0, 0.0, 5.0), ("even", 0.0, 0.0, 100.0, 2.0), ("even", 0.0, 0.0, 100.0, 4.0)]
    df = spark.createDataFrame(seg, "p string, x1 double, y1 double, x2 double, y2 double")
    got = {r.p: r.skew for r in layout.skew_angles(df, ["p"]).collect()}
    assert got["none"] == 0.0
    assert got["steep"] == 10.0
    assert abs(got["flat"]) < 1
    assert got["even"] == pytest.approx((math.degrees(math.atan2(2, 100)) + math.degrees(math.atan2(4, 100))) / 2, abs=1e-5)


def _cells(spark, rows):
    return spark.createDataFrame([(d, f, f in LIST_FIELDS, None if f in LIST_FIELDS else v, v if f in LIST_FIELDS else None) for d, f, v in rows], "source_file string, field string, is_list boolean, scalar string, items array<string>")


def test_metrics(spark):
    gold = _cells(spark, [("d", "Location", "Den"), ("d", "Date", "1"), ("d", "Method_of_Alarm_Activation", ["Pull Station", "Smoke Detector"]), ("gone", "Location", "x")])
    pred = _cells(spark, [("d", "Location", "den."), ("d", "Method_of_Alarm_Activation", ["Pull Station", "Other"])])
    scores, summary = metrics.evaluate(gold, pred)
    rows = {r.field: r for r in scores.collect()}
    assert len(rows) == 30
    m = rows["Method_of_Alarm_Activation"]
    assert (m.precision, m.recall, m.exact) == (0.5, 0.5, 0)
    assert (rows["Location"].exact, rows["Location"].n) == (1, 1)
    assert rows["Date"].exact == 0
    assert rows["To_Evacuate"].precision == rows["To_Evacuate"].recall == rows["To_Evacuate"].f1 == 1.0
    assert summary.first().n_docs == 1
    same = metrics.evaluate(gold, gold)[1].first()
    assert same.overall_exact == 1.0
    penal, _ = metrics.evaluate(gold, pred, missing_docs="penalize")
    assert {r.field: r.n for r in penal.collect()}["Location"] == 2


def test_golden_algebra():
    """tp, fp, fn, exact of the six set fields of a published table give its F1 values and totals."""
    counts = {"To_Evacuate": (37, 2, 4), "At_Safe_Area": (37, 2, 3), "Name": (39, 1, 2), "Evacuation_Details": (27, 0, 2), "Method": (15, 1, 0), "away": (6, 0, 0)}
    f1 = [2 * tp / (2 * tp + fp + fn) for tp, fp, fn in counts.values()]
    assert abs(sum(f1) / 6 - 0.9595) < 1e-3
    assert round((260 + 55) / 360, 3) == 0.875


def test_ablation_delta(spark):
    gold = _cells(spark, [("d", "Location", "Den"), ("d", "Date", "1")])
    pred = _cells(spark, [("d", "Location", "Den"), ("d", "Date", "1")])
    per = pred.withColumn("config", F.explode(F.array(F.lit("base"), F.lit("bad")))).withColumn("scalar", F.when((F.col("config") == "bad") & (F.col("field") == "Date"), "2").otherwise(F.col("scalar")))
    got = {r.config: (r.overall_exact, r.delta) for r in ablation.evaluate_configs(gold, per, ["base", "bad"], ["source_file"]).collect()}
    assert got == {"base": (1.0, 0.0), "bad": (0.5, -0.5)}


def test_mock_is_deterministic_and_errs_as_told(spark):
    gold = spark.range(4000).select(F.col("id").cast("string").alias("source_file"), F.lit("Location").alias("field"), F.lit(False).alias("is_list"), F.lit("kitchen").alias("scalar"), F.lit(None).cast("array<string>").alias("items"))
    a, b = ({r.source_file: r.scalar for r in predict.perturb(g, seed=3).collect()} for g in (gold, gold.repartition(7)))
    assert a == b
    na = sum(v == "NA" for v in a.values()) / len(a)
    wrong = sum(v not in ("NA", "kitchen") for v in a.values()) / len(a)
    assert 0.03 < na < 0.07
    assert 0.04 < wrong < 0.1


def test_places(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert all(r.place == r.v + 1 for r in with_place(df, ["v"], "place").collect())
    assert with_place(df.where("v < 0"), ["v"], "place").count() == 0
