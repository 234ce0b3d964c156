"""Synthetic forms: every value is a hash of seed, row and field, so rows don't depend on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmill.schema import FORM_SCHEMA

_STREETS = ("Maple St", "Oak Ave", "Cedar Ln", "Birch Rd", "Elm Ct")
_AGENCIES = ("Northside Supports", "Lakeview Homes", "Hillcrest Services", "Riverside Care")
_PARTS = ("Morning", "Afternoon", "Evening", "Overnight")
_SKY = ("Clear", "Rain", "Snow", "Cloudy", "Windy")
_GIVEN = ("A.", "B.", "C.", "D.", "E.", "F.", "G.", "H.")
_SURNAMES = ("Ames", "Boyd", "Cole", "Dunn", "Ellis", "Frost", "Grant", "Hale")
_WAYS = ("Used main exit", "Assisted", "Used ramp", "Walked alone")


def _draw(seed: int, row: Column, *what: str) -> Column:
    return F.xxhash64(F.lit(seed), row, *(F.lit(w) for w in what))


def _pick(pool: tuple[str, ...], h: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in pool)), (F.pmod(h, F.lit(len(pool))) + 1).cast("int"))


def _number(h: Column, lo: int, hi: int) -> Column:
    return (F.pmod(h, F.lit(hi - lo + 1)) + lo).cast("int")


def synthetic_labels(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """source_file, fields of n forms: the residents' lists are aligned, all fields filled."""
    row = F.col("id")
    d = lambda *w: _draw(seed, row, *w)
    clock = lambda w: F.format_string("%d:%02d %s", _number(d(w, "h"), 1, 12), _number(d(w, "m"), 0, 59), _pick(("AM", "PM"), d(w, "p")))
    yes_no = lambda w: _pick(("Yes", "No"), d(w))
    many = F.sequence(F.lit(1), _number(d("residents"), 2, 4))
    of = lambda w, make: F.transform(many, lambda k: make(F.xxhash64(F.lit(seed), row, F.lit(w), k)))
    time = lambda h: F.format_string("%d:%02d", _number(h, 1, 3), _number(F.hash(h), 0, 59))
    names = of("name", lambda h: F.concat_ws(" ", _pick(_GIVEN, h), _pick(_SURNAMES, F.hash(h).cast("long"))))
    values = {
        "Site_Address": F.concat_ws(" ", _number(d("no"), 1, 999).cast("string"), _pick(_STREETS, d("street"))), "DDSO_Provider_Agency": _pick(_AGENCIES, d("agency")),
        "Date": F.format_string("%02d/%02d/2026", _number(d("mo"), 1, 12), _number(d("day"), 1, 28)), "Part_of_Day": _pick(_PARTS, d("part")),
        "Total_time_to_evacuate_to_ground": F.format_string("%d min %d sec", _number(d("g"), 1, 4), _number(d("gs"), 0, 59)), "Total_time_for_all_to_reach_safe_area": F.format_string("%d min", _number(d("s"), 5, 9)),
        "Weather_Conditions": _pick(_SKY, d("sky")), "Method_of_Alarm_Activation": F.array(_pick(("Pull Station", "Smoke Detector", "Other"), d("method"))),
        "Evacuation_Type": _pick(("Full Evacuation to Outside", "Other"), d("etype")), "Type_of_Evacuation": _pick(("Announced", "Unannounced", "Supervised; Unannounced"), d("type")),
        "Location_of_Simulated_Fire": _pick(("Kitchen", "Den", "Laundry"), d("fire")), "Blocked_Exits_by_Simulated_Fire": _pick(("Side exit", "Back exit", "None"), d("exit")), "Location": _pick(("1st floor", "2nd floor"), d("loc")),
        "Name_of_Individuals_Residing_in_the_Residence": names, "including_away_at_the_Time_of_the_Evacuation": F.when(d("away") % 2 == 0, F.slice(names, 1, 1)).otherwise(F.array(F.lit("NA"))),
        "To_Evacuate": of("evac", time), "At_Safe_Area": of("safe", time), "Evacuation_Details": of("how", lambda h: _pick(_WAYS, h)),
        "Description_of_evacuation": _pick(("All left by the main exit.", "One resident needed help."), d("desc")), "Problems_noted_correction_actions_taken": _pick(("None; none needed", "Door sticks; oiled"), d("prob")),
    }
    cols = []
    for f in FORM_SCHEMA:
        c = values.get(f.name)
        cols.append((clock(f.name) if f.name.startswith("Time_") else yes_no(f.name) if c is None else c).alias(f.name))
    return spark.range(n).select(F.format_string("synthetic_form_%05d.pdf", "id").alias("source_file"), F.struct(*cols).alias("fields"))
