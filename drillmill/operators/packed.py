"""Several values packed in one field (problem 5).

A text is split on its quote characters: odd pieces are literals, even pieces are split on delimiters, and array folds put
the values together again with their ordinals. Everything is a Catalyst expression; no row leaves the JVM and nothing is
shuffled but the de-duplication of forms.

Defined results: a NULL, blank or NA text (any case) is missing and gives no value, but an entry of a list keeps its
number; an empty slot between two delimiters takes a number and gives no row; an unclosed quote is an ordinary character;
a field in which no text holds two values gives no rows; texts of any length are split whole; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillmill.sources.tables import forms_once

SPLIT, OPEN, CLOSE = "\ue000", "\ue001", "\ue002"

#: A mark, with a conjunction after it if there is one. A slash after a lone "w" or "c" (with, care of) is part of a word.
_MARK = r"(?:[;,|+&\t•·]|\r?\n|(?<!\b[wWcC])/|(?<=\s)[-–—](?=\s))"
_AND = r"(?:\s+(?:and|or)(?=\s|$|\x22))?"
_DELIMITER = rf"(?i)[  ]*{_MARK}{_AND}|(?:^|(?<=\s))(?:and)(?=\s|$)|(?:^|(?<=\s))\d{{1,3}}[.)](?=\s)|(?<=\d|\ds)[  ]+(?=\d+(?::\d\d|s\b))"
#: A bullet or number that leads the text, and stands before its first value.
_LEAD = r"^\s*(?:[•·*]|\d{1,3}[.)](?=\s)|[-–—](?=\s))\s*"
#: Single quotes count only around a whole value: between delimiters or the ends of the text.
_SINGLE = r"(^|[;,|/+&\t\n•]\s*|\band\s+|\s-\s+|\d[.)]\s+)'([^']*)'(?=\s*(?:$|[;,|/+&\t\n•]|and\b|-\s|\d{1,3}[.)]\s))"
_BRACKETS = r"\([^()\x22]*\)|\[[^\[\]\x22]*\]"


def is_missing(c: Column) -> Column:
    """NULL, blank or NA in any case."""
    t = F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return c.isNull() | t.isin("", "NA")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_values(text: Column) -> Column:
    """ARRAY<STRING> of the slots of one text; an empty slot is an empty string."""
    text = F.regexp_replace(F.translate(text, "“”" + SPLIT + OPEN + CLOSE, '""'), _LEAD, "")
    # single quotes around values become double ones; twice, as neighbours share a delimiter
    text = F.regexp_replace(F.regexp_replace(text, _SINGLE, '$1"$2"'), _SINGLE, '$1"$2"')
    # outside quotes, a remark in brackets is a literal as well: its quote marks are told apart afterwards
    pieces = F.split(text, '"')
    n = F.size(pieces)

    def piece(p: Column, i: Column) -> Column:
        quoted = (i % 2 == 1) & (i < n - 1)
        unclosed = (i % 2 == 1) & (i == n - 1)
        parts = F.split(F.regexp_replace(p, f"({_BRACKETS})", f"{OPEN}($1{OPEN}"), OPEN)
        cut = F.array_join(F.transform(parts, lambda q: F.when(q.startswith("(("), F.substr(q, F.lit(2))).when(q.startswith("(["), F.substr(q, F.lit(2))).otherwise(F.regexp_replace(q, _DELIMITER, SPLIT))), "")
        return F.when(quoted, F.concat(F.lit(OPEN), p, F.lit(CLOSE))).when(unclosed, F.concat(F.lit('"'), cut)).otherwise(cut)

    whole = F.array_join(F.transform(pieces, piece), "")
    slots = F.transform(F.split(whole, SPLIT), _strip)
    enclosed = rf"^{OPEN}([^{OPEN}{CLOSE}]*){CLOSE}$"

    def finish(v: Column) -> Column:
        v = F.regexp_replace(v, _LEAD, "")
        return F.when(v.rlike(enclosed), _strip(F.regexp_extract(v, enclosed, 1))).otherwise(F.translate(v, OPEN + CLOSE, '""'))

    return F.transform(slots, finish)


def unpack_fields(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, field, item_no, item_value: the values of every packed field, one per row with its place in the field."""
    kinds = dict(df.dtypes)
    entries = [F.struct(F.lit(f).alias("field"), (F.col(f) if kinds[f].startswith("array") else F.array(F.col(f))).alias("texts")) for f in fields]
    long = df.select(key, F.explode(F.array(*entries)).alias("e")).select(key, F.col("e.field").alias("field"), F.col("e.texts").alias("texts"))
    # each text is split once; a text's slots stay together until it is known whether any of them holds two values
    per_text = F.transform("texts", lambda e: F.when(is_missing(e), F.array(F.lit(""))).otherwise(split_values(e)))
    split = long.where(F.size("texts") > 0).select(key, "field", per_text.alias("slots"))
    packed = split.where(F.exists("slots", lambda s: F.size(F.filter(s, lambda v: v != "")) >= 2))
    rows = packed.select(key, "field", F.posexplode(F.flatten("slots")).alias("at", "item_value"))
    return rows.where(F.col("item_value") != "").select(key, "field", (F.col("at") + 1).cast("int").alias("item_no"), "item_value")


PACKED_FIELDS = ("Method_of_Alarm_Activation", "Type_of_Evacuation", "To_Evacuate")


def found(forms: DataFrame) -> DataFrame:
    return unpack_fields(forms_once(forms, ["form_id", *PACKED_FIELDS]), "form_id", PACKED_FIELDS)
