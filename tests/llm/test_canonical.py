import pytest
from pyspark.sql import functions as F

from drillmill.llm import canonical
from drillmill.llm.strings import DeleteIndex, deletes, weighted_distance


@pytest.fixture()
def reference(spark):
    return spark.read.parquet("/root/testdata/sf0.001/canonical_values.parquet")


WEATHER = [("Clear", 101), ("celar", 101), ("sun ", 101), ("quite part cloudy", 102), ("parlty cpdy", 102), ("grey skioes", 103), ("O'cast", 103), ("wet / rsin", 104), ("T-stomr", 105), ("Light smow", 106), ("Slret/hail", 107), ("fog / miist today", 108), ("gysty", 109), ("hot n hukid", 110), ("v. cild", 111), ("weather: Overcast", 103), ("mild temos, 66 deg", 112), ("hail (per staff)", 107), ("panel beeping", 0), ("72", 0), ("Tues", 0), ("x" * 5000, 0), ("?", 0)]


def test_weather(make_forms, reference):
    rows = [{"form_id": i, "Weather_Conditions": t} for i, (t, _) in enumerate(WEATHER)] + [{"form_id": 100, "Weather_Conditions": t} for t in (None,)] + [{"form_id": 101, "Weather_Conditions": " na "}, {"form_id": 102, "Weather_Conditions": "  "}]
    forms = make_forms(*rows, *rows[:3]).withColumn("field", F.lit(1)).withColumn("answer", F.lit("q"))
    got = {r.form_id: r.canonical_id for r in canonical.found(forms, reference).collect()}
    assert got == {i: c for i, (_, c) in enumerate(WEATHER)}
    missed = {r.answer: r.forms for r in canonical.unmatched(forms, reference).collect()}
    assert missed["panel beeping"] == 1
    assert canonical.found(forms.where("1 = 0"), reference).count() == 0
    assert {r.canonical_id for r in canonical.found(forms, reference.where("1 = 0")).collect()} == {0}


@pytest.mark.parametrize(
    ("field", "text", "want"),
    [("Part_of_Day", "in the p.m. (afternnoon)", "Afternoon"), ("Part_of_Day", "Early a.m.", "Early morning"), ("Part_of_Day", "mdi-mornimg", "Morning"), ("Part_of_Day", "shift B", None), ("Part_of_Day", "o/n ", "Overnight"), ("was_drill_observed", "✓.", "Yes"), ("was_drill_observed", "npoe", "No"), ("was_drill_observed", "partyl obbserved", "Partly observed"), ("Centrally_Monitored_Fire_Alarm_Station", "SÍ", "Yes"), ("Centrally_Monitored_Fire_Alarm_Station", "unmmointored", "No"), ("Centrally_Monitored_Fire_Alarm_Station", "in-hose alarm only", "Local alarm only")],
)
def test_other_fields(reference, field, text, want):
    entries = [(r.canonical_id, r.canonical) for r in reference.collect() if r.field == field]
    assert dict(entries).get(canonical.Matcher(entries, {}, canonical.read_aliases()).find(text)) == want


def test_long_entries_and_answers():
    long = "automatic sprinkler system with remote supervision by the county fire control centre"
    assert canonical.Matcher([(1, long)], {}).find(long.replace("sprinkler", "sprinklr")) == 1
    assert canonical.Matcher([(1, "clear")], {}).find("clear " * 50_000) == 0
    assert canonical.Matcher([(1, "clear")], {}).find("x" * 1_000_000) == 0


def test_aliases_are_an_input():
    assert canonical.Matcher([(1, "Clear")], {}).find("cloudless") == 0
    assert canonical.Matcher([(1, "Clear")], {}, {"clear": ["cloudless"]}).find("cloudlss") == 1


def test_frequency_breaks_ties():
    entries = [(1, "tan"), (2, "ton")]
    assert canonical.Matcher(entries, {"ton": 5}).find("tpn") in (1, 2)
    assert canonical.Matcher([(1, "taxn"), (2, "tuxn")], {"tuxn": 5}).find("t9xn") == 2
    assert canonical.Matcher([(1, "taxn"), (2, "tuxn")], {}).find("t9xn") == 1


def test_distance_and_index():
    assert weighted_distance("abc", "abc", 2) == 0
    assert weighted_distance("celar", "clear", 2) == pytest.approx(0.8)
    assert weighted_distance("cleear", "clear", 2) == pytest.approx(0.7)
    assert weighted_distance("abc", "xyzq", 2) > 2
    assert "ac" in deletes("abc", 1)
    words = ["rainy", "windy", "snow", "y"]
    assert [w for w, _ in DeleteIndex(words).near("rianyy")] == ["rainy"]
    assert DeleteIndex(words).near("n") == []
