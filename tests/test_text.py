import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drillmill.functions import jsonx, text
from drillmill.functions.similarity import indel_ratio, similarity, similarity_short


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [("Method of Alarm Activation", "method of alarm activation"), ("Yes/No?", "yes no"), ("  a  B ", "a b"), (None, ""), ("JOSÉ", "jos")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, text.normalize_text) == want


@pytest.mark.parametrize(("raw", "want"), [(None, "NA"), ("   ", "NA"), ("  hello  ", "hello"), ("na", "na"), (" x\t", "x")])
def test_csv_scalar(spark, raw, want):
    assert one(spark, raw, text.csv_scalar) == want


@pytest.mark.parametrize(("raw", "want"), [(["a", "b"], "a; b"), (["a", "NA", "  ", "b"], "a; b"), ([], "NA"), (["NA"], "NA"), (None, "NA"), (["a", None], "a; None")])
def test_csv_list(spark, raw, want):
    assert one(spark, raw, text.csv_list, "array<string>") == want


@pytest.mark.parametrize(("raw", "want"), [("my form (final).pdf", "my_form_final_"), ("/a/b/Report-2024.PNG", "Report-2024"), (".hidden", ".hidden"), ("a.tar.gz", "a.tar")])
def test_stem(spark, raw, want):
    assert one(spark, raw, text.safe_stem) == want


@pytest.mark.parametrize(("raw", "want"), [('```json\n{"a": 1}\n```', '{"a": 1}'), ("```JSON {} ```", "{}"), ("plain", "plain"), ("x ```{}```", "x ```{}```"), (None, None)])
def test_fences(spark, raw, want):
    assert one(spark, raw, text.strip_code_fences) == want


def test_item_set_and_scalar(spark):
    assert sorted(one(spark, ["A", "NA", "", "a"], text.to_item_set, "array<string>")) == ["a"]
    df = spark.createDataFrame([(False, "Pull Station; Smoke Detector", None), (True, None, ["a", "b"]), (False, "NA", None)], "l boolean, s string, i array<string>")
    rows = df.select(text.item_set_of(F.col("l"), F.col("s"), F.col("i")).alias("x"), text.to_scalar(F.col("l"), F.col("s"), F.col("i")).alias("y")).collect()
    assert sorted(rows[0].x) == ["pull station", "smoke detector"]
    assert [r.y for r in rows] == ["pull station smoke detector", "a b", ""]


CASES = ['{"a": 1}', '```json\n{"a": "x"}\n```', 'Sure:\n{"x": "y"}\nHope', "not json", "[1, 2]", '{"a":"x"} and {"a":"y"}', "{'a':'x'}", '{"a":1,"a":2}', '{"a": ["p", 3, null], "b": null}', '{"cut": "of', "", None, "}{", '{"n": NaN}', '{"d": {"e": 1}}']


def test_parse_json_is_python_json(spark):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(CASES)], "i int, raw string").select("i", jsonx.parse_cells(F.col("raw")).alias("c")).collect()
    for r in rows:
        t = (CASES[r.i] or "").strip()
        if t.startswith("```"):
            t = t.strip("`").removeprefix("json")
        a, b = t.find("{"), t.rfind("}")
        try:
            want = json.loads(t[a : b + 1]) if 0 <= a < b else {}
        except ValueError:
            want = {}
        want = want if isinstance(want, dict) else {}
        got = {c.field: (c["items"] if c.is_list else c.scalar) for c in r.c}
        assert got == {k: [str(x) for x in v] if isinstance(v, list) else None if v is None else str(v) for k, v in want.items()}, CASES[r.i]


def test_parse_fast_clean(spark):
    row = one(spark, '{"Site_Address": "1 Elm", "To_Evacuate": ["1:00"]}', jsonx.parse_fast)
    assert row.Site_Address == "1 Elm"
    assert row.To_Evacuate == ["1:00"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *_next(row, x, b)]
    return row[-1]


def _next(prev, x, b):
    out, left = [], 0
    for j, y in enumerate(b):
        left = prev[j] + 1 if x == y else max(left, prev[j + 1])
        out.append(left)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("abcd é", max_size=25), st.text("abcd é", max_size=25))
def test_indel_is_lcs(a, b):
    want = 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))
    assert indel_ratio(a, b) == pytest.approx(want)


def test_similarity_columns(spark):
    pairs = [("kitten", "sitting"), ("", ""), ("a", ""), ("same", "same"), ("abc", "cab")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("x"), similarity_short(F.col("a"), F.col("b")).alias("y"))
    for r in df.collect():
        assert r.x == pytest.approx(indel_ratio(r.a, r.b)) == pytest.approx(r.y)


def test_geometry_functions(spark):
    df = spark.createDataFrame([("Rotate: 90\n", 4000, 3000), ("Rotate: 45", 10, 10), (None, None, None)], "o string, w int, h int")
    rows = df.select(text.rotation(F.col("o")).alias("r"), text.downscaled(F.col("w"), F.col("h")).alias("d")).collect()
    assert [r.r for r in rows] == [90, None, None]
    assert rows[0].d.width * rows[0].d.height <= 1_000_000
    assert (rows[1].d.width, rows[1].d.height) == (10, 10)
