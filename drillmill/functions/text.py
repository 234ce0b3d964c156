"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() takes off.
_SPACE = r"[\s\x1c-\x1f\x85]"
_EDGE = rf"(?U)^{_SPACE}+|{_SPACE}+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def normalize_text(c: Column) -> Column:
    """Lower case, every run of anything but a-z and 0-9 one space, trimmed; NULL gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def strip_code_fences(c: Column) -> Column:
    """Takes an opening fence (with or without json) and a closing one off a text that starts with a fence."""
    t = strip(c)
    inner = F.regexp_replace(F.regexp_replace(t, rf"^(?i)(?U)```(?:json)?{_SPACE}*", ""), rf"(?U){_SPACE}*```$", "")
    return F.when(t.startswith("```"), inner).otherwise(t)


def csv_scalar(c: Column) -> Column:
    """A scalar cell of the output: stripped, NA if nothing is left."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("NA"))


def csv_list(c: Column) -> Column:
    """A list cell of the output: items stripped, blanks and NA (any case) dropped, joined by '; '; NA if none is left."""
    items = F.filter(F.transform(c, lambda x: strip(F.coalesce(x, F.lit("None")))), lambda x: (x != "") & (F.upper(x) != "NA"))
    return F.coalesce(F.nullif(F.array_join(items, "; "), F.lit("")), F.lit("NA"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def safe_stem(path: Column) -> Column:
    """File name without its last suffix, unsafe characters as '_'; a leading dot belongs to the name."""
    return F.regexp_replace(F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", ""), r"[^A-Za-z0-9_.-]+", "_")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))


def to_item_set(items: Column) -> Column:
    """Normalised, distinct items without '' and 'na'; NULL gives an empty set."""
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), normalize_text), lambda x: (x != "") & (x != "na"))
    return F.array_distinct(kept)


def item_set_of(is_list: Column, scalar: Column, items: Column) -> Column:
    """Item set of a cell: lists as they are, scalars split at ';'."""
    return to_item_set(F.when(is_list, items).otherwise(F.split(scalar, ";")))


def to_scalar(is_list: Column, scalar: Column, items: Column) -> Column:
    """Comparable text of a cell; a list is joined by '; ', NA and NULL are ''. The order of items counts."""
    joined = F.array_join(F.transform(items, lambda x: F.coalesce(x, F.lit("None"))), "; ")
    t = normalize_text(F.when(is_list, joined).otherwise(scalar))
    return F.when(t == "na", "").otherwise(t)


def multi_join(c: Column) -> Column:
    return F.array_join(c, "; ")


def multi_split(c: Column) -> Column:
    return F.split(c, "; ")


def rotation(osd: Column) -> Column:
    """Degrees that an orientation report asks for; NULL unless 90, 180 or 270."""
    d = F.nullif(F.regexp_extract(osd, r"Rotate:\s+(\d+)", 1), F.lit("")).try_cast("int")
    return F.when(d.isin(90, 180, 270), d)


def downscaled(width: Column, height: Column, cap: int = 1_000_000) -> Column:
    """STRUCT<width, height> after scaling down to at most cap pixels."""
    area = width.cast("double") * height
    s = F.sqrt(F.try_divide(F.lit(float(cap)), area))
    side = lambda x: F.when(area > cap, F.greatest(F.lit(1), (x * s).cast("int"))).otherwise(x.cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def line_angle(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy.cast("double"), dx.cast("double")))
