import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from drillmill import cli
from drillmill.operators import checkbox
from drillmill.operators.ablation import ABLATIONS
from drillmill.plans.pipeline import RealPredictor, extract_one, rows_from_responses, run_ablations, run_batch, run_checkbox_pass, run_eval
from drillmill.ports import MockRasteriser, get_backend, rasterise, read_words, register_backend
from drillmill.schema import CHECKBOX_FIELDS, FIELD_LIST, LIST_FIELDS
from drillmill.settings import Settings, load_settings
from drillmill.sources import files, labels, sinks, synthetic
from drillmill.sources.tables import forms_once


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 30


def test_names_of_sql_and_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_files(spark, tmp_path):
    for n in ("b.PDF", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(b"one\ftwo")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_bytes(b"x")
    df = files.read_files(spark, str(tmp_path))
    assert [r.source_file for r in files.order_files(df).collect()] == ["a.png", "b.PDF"]
    pages = rasterise(df, Settings())
    assert sorted((r.source_file, r.page_no) for r in pages.collect()) == [("a.png", 1), ("b.PDF", 1), ("b.PDF", 2)]
    assert read_words(pages).where("text = 'two' AND source_file = 'b.PDF'").count() == 1
    with pytest.raises(Exception):  # noqa: B017, PT011
        files.read_files(spark, str(tmp_path / "none")).count()


def test_batch_of_mock_answers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    rows = run_batch(spark, str(tmp_path), Settings(checkbox_enabled=False)).collect()
    assert len(rows) == 1
    assert "NA" not in set(rows[0])
    erased = run_batch(spark, str(tmp_path)).first().asDict()  # no label is found: NA takes the model's value
    assert {f for f, v in erased.items() if v == "NA"} == set(CHECKBOX_FIELDS)


def boxes():
    import json
    import re

    class Boxes:
        """Ticks the first option and one that isn't there."""

        def __init__(self, settings):
            pass

        def chat(self, *, prompt, images, json_schema, temperature, max_tokens):
            if "selected" not in json_schema["properties"]:
                return "{}"
            if "Announced" in prompt:
                raise TimeoutError
            return json.dumps({"selected": [re.search(r": ([^,?]+)", prompt)[1], "Siren"]})

    return Boxes


def test_checkbox_pass(spark, tmp_path):
    register_backend("boxes", boxes())
    lines = [""] * 20 + ["Method of Alarm Activation: x", "Evacuation Type: y", "Evacuation type again: z"]
    (tmp_path / "a.pdf").write_bytes("\n".join(lines).encode() + b"\f" + "\n".join([""] * 125 + ["Did evac time meet location requirement: no"]).encode())
    (tmp_path / "b.pdf").write_bytes("\n".join(["Method of Alarm Activation: x"] + lines[:20]).encode())
    settings = Settings(vlm_backend="boxes", pdf_render_dpi=300)
    pages = rasterise(files.read_files(spark, str(tmp_path)), settings)
    regions = {(r.source_file, r.field): r for r in checkbox.locate_groups(read_words(pages)).collect()}
    assert set(regions) == {("a.pdf", f) for f in CHECKBOX_FIELDS}
    assert regions["a.pdf", "Evacuation_Type"].vy1 == 20 * 21 - 25  # the topmost of two lines
    got = {(r.source_file, r.field): r.scalar or r["items"] for r in run_checkbox_pass(pages, settings).collect()}
    assert got["a.pdf", "Method_of_Alarm_Activation"] == ["Pull Station"]
    assert got["a.pdf", "Evacuation_Type"] == "Full Evacuation to Outside"
    assert got["a.pdf", "Did_evacuation_time_meet_location_requirement"] == "Yes"
    assert got["a.pdf", "Type_of_Evacuation"] == "NA"  # the model failed
    assert {f: v for (n, f), v in got.items() if n == "b.pdf"} == {"Method_of_Alarm_Activation": ["NA"], "Evacuation_Type": "NA", "Type_of_Evacuation": "NA"}  # outside its band; no second page


def test_a_repeated_call_mends_a_page(spark):
    answers = spark.createDataFrame([("a", 1, "page", None, "timeout"), ("a", 1, "page", '{"Location": "Den"}', None)], "source_file string, page_no int, task string, raw string, error string")
    assert rows_from_responses(answers.select("source_file").distinct(), answers).first().Location == "Den"


def test_failed_page_makes_the_form_na(spark):
    answers = spark.createDataFrame([("a", 1, "page", '{"Location": "Den"}', None), ("a", 2, "page", None, "timeout"), ("b", 1, "page", '{"Location": "Den"}', None), ("b", 2, "page", "no json", None)], "source_file string, page_no int, task string, raw string, error string")
    names = answers.select("source_file").distinct()
    got = {r.source_file: r.Location for r in rows_from_responses(names, answers).collect()}
    assert got == {"a": "NA", "b": "Den"}
    got = {r.source_file: r.Location for r in rows_from_responses(names, answers, Settings(failure_scope="page")).collect()}
    assert got["a"] == "Den"


def test_rasteriser_errors_are_rows(spark):
    class Broken(MockRasteriser):
        def pages(self, name, content, dpi):
            raise OSError("broken")

    df = spark.createDataFrame([("a", bytearray(b"x"))], "source_file string, content binary")
    assert rasterise(df, Settings(), Broken).first().error == "broken"


def test_labels_csv_report(spark, tmp_path):
    made = synthetic.synthetic_labels(spark, 12, 5)
    assert made.collect() == synthetic.synthetic_labels(spark, 12, 5).repartition(3).orderBy("source_file").collect()
    row = made.first().fields
    assert len(row.To_Evacuate) == len(row.At_Safe_Area) == len(row.Name_of_Individuals_Residing_in_the_Residence)
    path = tmp_path / "labels.jsonl"
    lines = [json.dumps({"source_file": r.source_file, "fields": r.fields.asDict()}) for r in made.collect()]
    path.write_text("\n".join([lines[0].replace("Supports", "X"), "", *lines]))
    got = labels.read_labels(spark, str(path))
    assert got.count() == 12
    assert got.orderBy("source_file").first().fields == made.orderBy("source_file").first().fields  # the last line wins
    with pytest.raises(Exception, match="labelled twice"):
        labels.read_labels_distributed(spark, str(path)).collect()
    assert labels.read_samples(spark, str(path), "/x/").count() == 13
    assert labels.read_samples(spark, str(tmp_path / "no"), "/x").count() == 0
    scores, summary = run_eval(got)
    text = sinks.render_markdown(scores, summary)
    assert "**Documents evaluated:** 12" in text
    assert len(sinks.plot_rows(scores)) == 30
    out = tmp_path / "r"
    assert cli.main(["eval", "--labels", str(path), "--out-dir", str(out)]) == 0
    assert (out / "metrics.md").exists()
    assert cli.main(["eval", "--labels", str(tmp_path / "no")]) == 1
    assert cli.main(["info"]) == 0


def test_csv_round_trip(spark, tmp_path):
    base = spark.createDataFrame([("b.pdf", 'say "hi", x'), ("A.pdf", "two\nlines")], "source_file string, Location string")
    df = base.select("source_file", *(F.col(f) if f == "Location" else F.lit("NA").alias(f) for f in FIELD_LIST))
    sinks.write_csv(df, str(tmp_path / "o"), single_file=True)
    assert {r.source_file: r.Location for r in sinks.read_csv(spark, str(tmp_path / "o")).collect()} == {"b.pdf": 'say "hi", x', "A.pdf": "two\nlines"}
    part = next((tmp_path / "o").glob("*.csv")).read_text()
    assert part.startswith("source_file,Site_Address")
    assert part.index("A.pdf") < part.index("b.pdf")


def test_settings():
    s = load_settings({"DRILLMILL_PDF_RENDER_DPI": "300", "DRILLMILL_USE_CLAHE": "no", "OTHER": "1"})
    assert (s.pdf_render_dpi, s.use_clahe, s.temperature) == (300, False, 0.0)
    with pytest.raises(ValueError, match="unknown backend"):
        get_backend(Settings(vlm_backend="nope"))


def test_forms_once(make_forms):
    import datetime

    forms = make_forms({"form_id": 1, "Location": "late", "received_at": datetime.datetime(2025, 1, 1)}, {"form_id": 1, "Location": "early"}, {"form_id": 1, "Location": "undated", "received_at": None}, {"form_id": None})
    assert [tuple(r) for r in forms_once(forms, ["form_id", "Location"]).collect()] == [(1, "early")]


def test_streaming_intake(spark, tmp_path):
    from drillmill.streaming.intake import distinct_responses, read_responses, start_intake

    rows = [("a.pdf", 1, "page", '{"Location": "Den"}', None)] * 2
    spark.createDataFrame(rows, "source_file string, page_no int, task string, raw string, error string").write.parquet(str(tmp_path / "in"))
    q = start_intake(distinct_responses(read_responses(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.source_file, r.Location) for r in got] == [("a.pdf", "Den")]


def test_real_predictor_and_ablations(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    row = run_batch(spark, str(tmp_path), Settings(checkbox_enabled=False)).first().asDict()
    fields = {f: row[f].split("; ") if f in LIST_FIELDS else row[f] for f in FIELD_LIST}
    (tmp_path / "labels.jsonl").write_text(json.dumps({"source_file": "a.pdf", "fields": fields}))
    gold = labels.read_labels(spark, str(tmp_path / "labels.jsonl"))
    _, summary = run_eval(gold, RealPredictor(str(tmp_path), Settings(checkbox_enabled=False)))
    assert summary.first().overall_exact == 1.0
    rows = run_ablations(gold, str(tmp_path)).collect()
    table = {r.config: r for r in rows}
    assert set(table) == set(ABLATIONS)
    assert table["no checkbox pass"].delta == pytest.approx(4 / 30)
    assert sinks.render_ablations(spark.createDataFrame(rows)).count("\n") == len(ABLATIONS) + 1
    one = extract_one(spark, str(tmp_path / "a.pdf"), Settings(checkbox_enabled=False)).first()
    assert one.Location == row["Location"]
