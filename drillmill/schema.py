"""The form's schema, the one place from which field lists, families and page shards are derived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Field names in the form's order; True for lists (fixed values).
_FIELDS = (
    ("Site_Address", False), ("DDSO_Provider_Agency", False), ("Date", False), ("Time_Evacuation_Started", False), ("Part_of_Day", False),
    ("Total_time_to_evacuate_to_ground", False), ("Total_time_for_all_to_reach_safe_area", False), ("Centrally_Monitored_Fire_Alarm_Station", False),
    ("Time_Monitoring_Station_Notified_of_Drill", False), ("Time_Monitoring_Station_Reactivated", False), ("Time_Monitoring_Station_Received_Alarm", False),
    ("Weather_Conditions", False), ("Method_of_Alarm_Activation", True), ("Evacuation_Type", False), ("Type_of_Evacuation", False),
    ("Location_of_Simulated_Fire", False), ("Blocked_Exits_by_Simulated_Fire", False), ("Location", False),
    ("Name_of_Individuals_Residing_in_the_Residence", True), ("including_away_at_the_Time_of_the_Evacuation", True), ("To_Evacuate", True), ("At_Safe_Area", True),
    ("Evacuation_Details", True), ("Description_of_evacuation", False), ("Problems_noted_correction_actions_taken", False),
    ("Did_Evacuation_proceed_in_accordance_with_evac_plan", False), ("Were_all_exits_escape_route_clear_of_obstructions", False),
    ("Did_alarms_bells_horns_strobes_function_properly", False), ("Did_evacuation_time_meet_location_requirement", False), ("was_drill_observed", False),
)

FORM_SCHEMA = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if many else T.StringType()) for n, many in _FIELDS])
FIELD_LIST = [f.name for f in FORM_SCHEMA]
LIST_FIELDS = [f.name for f in FORM_SCHEMA if isinstance(f.dataType, T.ArrayType)]
SCALAR_FIELDS = [n for n in FIELD_LIST if n not in LIST_FIELDS]
CHECKBOX_FIELDS = ["Did_evacuation_time_meet_location_requirement", "Evacuation_Type", "Method_of_Alarm_Activation", "Type_of_Evacuation"]
RESIDENT_FIELDS = ["Name_of_Individuals_Residing_in_the_Residence", "To_Evacuate", "At_Safe_Area", "Evacuation_Details"]
FIRST_PAGE_FIELDS = 24
LABEL_SCHEMA = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("fields", FORM_SCHEMA)])
NA = "NA"

_SPEC_SCHEMA = "page_no int, field string, keywords array<string>, options array<string>, multi boolean, band_lo double, band_hi double, output string"
#: The checkbox groups of the form (fixed values).
CHECKBOX_SPEC = (
    (1, "Method_of_Alarm_Activation", ["method", "alarm", "activ"], ["Pull Station", "Smoke Detector", "Other"], True, 0.05, 0.45, "list"),
    (1, "Evacuation_Type", ["evacuation", "type"], ["Full Evacuation to Outside", "Other"], False, 0.05, 0.45, "first"),
    (1, "Type_of_Evacuation", ["type", "evacuation"], ["Announced", "Unannounced", "Supervised"], True, 0.05, 0.45, "join"),
    (2, "Did_evacuation_time_meet_location_requirement", ["evac", "time", "meet", "locat", "require"], ["Yes", "No"], False, 0.65, 0.98, "first"),
)


def checkbox_spec(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHECKBOX_SPEC), _SPEC_SCHEMA)


def page_schema(page_no: int, boundary: int = FIRST_PAGE_FIELDS) -> T.StructType:
    """Fields asked for on a page: the first page has those before the boundary, any other page the rest."""
    return T.StructType(FORM_SCHEMA.fields[:boundary] if page_no == 1 else FORM_SCHEMA.fields[boundary:])


def field_meta(spark: SparkSession) -> DataFrame:
    """field, field_no, is_list, page_no, is_checkbox of the 30 fields."""
    rows = [(f, i, f in LIST_FIELDS, 1 if i < FIRST_PAGE_FIELDS else 2, f in CHECKBOX_FIELDS) for i, f in enumerate(FIELD_LIST)]
    return spark.createDataFrame(rows, "field string, field_no int, is_list boolean, page_no int, is_checkbox boolean")


def json_schema(schema: T.StructType) -> dict:
    """JSON Schema of a page's answer, for a model's decoding grammar or prompt."""
    kinds = {f.name: {"type": "array", "items": {"type": "string"}} if isinstance(f.dataType, T.ArrayType) else {"type": "string"} for f in schema}
    return {"type": "object", "properties": kinds, "required": list(kinds)}
