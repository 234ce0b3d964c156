import datetime

import pytest
from pyspark.sql import functions as F

from drillmill.operators import packed, units

SPLITS = [
    ('"Heat Detector / boiler room" ;  Other', ["Heat Detector / boiler room", "Other"]),
    ("'Heat Detector / boiler room' + Pull Station", ["Heat Detector / boiler room", "Pull Station"]),
    ("1) Smoke Detector 2) Panel Test Key", ["Smoke Detector", "Panel Test Key"]),
    ("• Heat Detector • Other", ["Heat Detector", "Other"]),
    ("Air Horn||Smoke Detector", ["Air Horn", "", "Smoke Detector"]),
    ("4:36, and 1:24", ["4:36", "1:24"]),
    ("4:40 3:58", ["4:40", "3:58"]),
    ("2:50 43s", ["2:50", "43s"]),
    ("4:48 w/ staff", ["4:48 w/ staff"]),
    ("Heat Detector (hall, upstairs)", ["Heat Detector (hall, upstairs)"]),
    ("Shift change and Supervised", ["Shift change", "Supervised"]),
    ("3:08 - 4:31", ["3:08", "4:31"]),
    ('Pull "Station, odd', ['Pull "Station', "odd"]),
    ('Smoke Detector "hall, up" ; Other', ['Smoke Detector "hall, up"', "Other"]),
    ("", [""]),
]


@pytest.mark.parametrize(("text", "want"), SPLITS)
def test_split(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(packed.split_values(F.col("t")).alias("v")).first().v == want


def test_long_text_is_split_whole(spark):
    text = "; ".join(f"v{i}" for i in range(20_000))
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.size(packed.split_values(F.col("t"))).alias("n")).first().n == 20_000


def test_packed_rows(make_forms):
    forms = make_forms(
        {"form_id": 1, "Method_of_Alarm_Activation": ["A;;B", "NA", None, "C"], "Type_of_Evacuation": "one"},
        {"form_id": 1, "Method_of_Alarm_Activation": ["A;;B", "NA", None, "C"], "Type_of_Evacuation": "one", "received_at": datetime.datetime(2025, 1, 1)},
        {"form_id": 2, "Method_of_Alarm_Activation": ["A", "B"], "To_Evacuate": []},
        {"form_id": 3},
        {"form_id": None, "Type_of_Evacuation": "x; y"},
        {"form_id": 4, "Type_of_Evacuation": "x; y; x"},
    )
    clash = forms.withColumn("field", F.lit("z")).withColumn("texts", F.lit(1)).withColumn("slots", F.lit(1))
    for df in (forms, clash):
        got = sorted((r.form_id, r.field, r.item_no, r.item_value) for r in packed.found(df).collect())
        m, t = packed.PACKED_FIELDS[:2]
        assert got == [(1, m, 1, "A"), (1, m, 3, "B"), (1, m, 6, "C"), (4, t, 1, "x"), (4, t, 2, "y"), (4, t, 3, "x")]
    assert packed.found(forms.where("1 = 0")).count() == 0


TIMES = [
    ("2 min 2 sec", 122), ("2:41", 161), ("0:04:07", 247), ("1min55", 115), ("4' 26\"", 266), ("00h 03m 20s", 200), ("2 minutes and 51 seconds", 171), ("3,1 min", 186), ("0.02 hr", 72), (".01 hours", 36),
    ("257s", 257), ("187 secs.", 187), ("1 MIN.", 60), ("approx. 3 min", 180), ("half a minute", 30), ("3 1/2 min", 210), ("5½ min", 330), ("1/2 min", 30), ("one and a half minutes", 90), ("eight minutes", 480),
    ("> 4 min", None), ("2-3 min", None), ("under 3 minutes", None), ("fast", None), ("n/a", None), ("", None), ("12:", None),
]


@pytest.fixture()
def templates(spark):
    return spark.createDataFrame([("FD-A", "t", 1, "minutes"), ("FD-D", "t", 1, "hundredths of a minute"), ("FD-X", "t", 0, None)], "template_code string, title string, revision int, bare_time_unit string")


def test_stated_times(make_forms, templates):
    ground = units.TIME_FIELDS[0]
    forms = make_forms(*({"form_id": i, ground: t} for i, (t, _) in enumerate(TIMES)))
    got = {r.form_id: r.seconds for r in units.to_seconds(forms, templates).collect()}
    assert got == {i: s for i, (_, s) in enumerate(TIMES) if s is not None}


def test_bare_times(make_forms, templates):
    ground, text = units.TIME_FIELDS[0], units.TEXT_FIELDS[0]
    forms = make_forms(
        {"form_id": 1, "template_code": "FD-A", ground: "2.5"}, {"form_id": 2, "template_code": "FD-D", ground: "250"}, {"form_id": 3, "template_code": "FD-X", ground: "41"},
        {"form_id": 4, "template_code": "FD-X", ground: "41", text: "Fine. Times on this sheet are in seconds."}, {"form_id": 5, "template_code": None, ground: "41"},
        {"form_id": 6, "template_code": "FD-X", ground: "2", text: "Clock in the kitchen is 9 minutes fast."}, {"form_id": 7, "template_code": "FD-X", ground: "2", text: "(minutes by stopwatch)"},
    )
    got = {r.form_id: r.seconds for r in units.to_seconds(forms, templates).collect()}
    assert got == {1: 150, 2: 150, 4: 41, 7: 120}
    assert units.to_seconds(forms.where("1 = 0"), templates).count() == 0
    assert units.to_seconds(forms, templates.where("1 = 0")).where("form_id = 1").count() == 0


def test_seconds_wait_for_no_estimate(make_forms, templates):
    ground, text = units.TIME_FIELDS[0], units.TEXT_FIELDS[0]
    forms = make_forms({"form_id": 1, "template_code": "FD-A", ground: "2.5"}, {"form_id": 2, "template_code": "FD-X", ground: "41", text: "Times on this sheet are in seconds."})
    unread = forms.withColumn(ground, F.raise_error(F.lit("forms are read")).cast("string"))
    assert units.to_seconds(unread, templates).columns == ["form_id", "field", "seconds"]  # nothing runs before the rows are asked for
    with pytest.raises(Exception, match="forms are read"):
        units.to_seconds(unread, templates).collect()
    plan = units.to_seconds(forms, templates)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # forms once
    assert sorted((r.form_id, r.seconds) for r in units.to_seconds(forms, templates).collect()) == [(1, 150), (2, 41)]


def test_told_units_make_the_rows_and_estimates_the_report(make_forms, templates):
    """FD-A prints minutes over numbers that look like seconds; FD-X prints nothing over numbers that are clearly seconds."""
    ground, safe = units.TIME_FIELDS
    n = units.MIN_LINKS
    forms = make_forms(
        *({"form_id": i, ground: "100 s", safe: "200 s"} for i in range(n)),
        *({"form_id": n + i, "template_code": "FD-A", ground: "100 s", safe: "200"} for i in range(n)),
        *({"form_id": 2 * n + i, "template_code": "FD-X", ground: "100 s", safe: "200"} for i in range(n)),
    )
    report = {r.source: (r.unit, r.known_by) for r in units.unit_report(forms, templates).collect()}
    assert report["sheet:FD-A"] == ("minutes", "printed, estimate differs")
    assert report["sheet:FD-X"] == ("seconds", "estimated")
    got = {(r.form_id // n, r.field): r.seconds for r in units.to_seconds(forms, templates).collect()}
    assert got == {(0, ground): 100, (0, safe): 200, (1, ground): 100, (1, safe): 12_000, (2, ground): 100}


def _row(a, b, links, mid, near=1.0):
    return {"source0": a, "source1": b, "links": links, "mid": mid, "near": near}


def test_graph_propagates_and_rejects():
    import math

    rows = [_row("stated", "stated", 100, 0.6), _row("stated", "sheet:M", 50, 0.6 - math.log(60) + 0.05), _row("sheet:M", "sheet:S", 50, 0.6 + math.log(60)), _row("stated", "sheet:X", 50, 0.6 - 2.0), _row("stated", "sheet:Y", 50, 0.6, 0.4), _row("stated", "sheet:Z", 3, 0.6)]
    got = units.solve_sources(rows, {"sheet:M": None, "sheet:S": None, "sheet:X": None, "sheet:Y": None, "sheet:Z": None})
    assert got["sheet:M"][0] == "minutes"
    assert got["sheet:S"][:2] == ("seconds", "estimated")  # reached through M
    assert all(got[s][:2] == (None, "not resolved") for s in ("sheet:X", "sheet:Y", "sheet:Z"))  # between units; scattered; too few links


def test_print_starts_and_checks():
    import math

    rows = [_row("stated", "stated", 100, 0.6), _row("stated", "sheet:M", 50, 0.6 - math.log(60)), _row("sheet:P", "sheet:Q", 50, 0.6 + math.log(60))]
    got = units.solve_sources(rows, {"sheet:M": "seconds", "sheet:P": "minutes", "sheet:Q": None})
    assert got["sheet:M"][:2] == ("seconds", "printed, estimate differs")
    assert got["sheet:Q"][:2] == ("seconds", "estimated")  # only from what P prints
    assert units.recovered(rows, {"sheet:M": "minutes", "sheet:P": "minutes"}) == (1, 2)


def test_hidden_units_are_recovered(spark):
    folder = "/root/testdata/sf0.1"
    known = units.read_templates(spark.read.parquet(f"{folder}/form_templates.parquet"))
    estimates = units.pair_estimates(units.measurements(spark.read.parquet(f"{folder}/forms.parquet"), known)).collect()
    right, asked = units.recovered(estimates, {f"sheet:{c}": u for c, u in known.items()})
    assert asked >= 4
    assert right / asked >= 0.9


def test_estimate_agrees_with_print(spark):
    report = {r.source: r for r in units.unit_report(spark.read.parquet("/root/testdata/sf0.01/forms.parquet"), spark.read.parquet("/root/testdata/sf0.01/form_templates.parquet")).collect()}
    known = [r for s, r in report.items() if s.startswith("sheet:") and r.agrees is not None]
    assert known
    assert all(r.agrees for r in known)
