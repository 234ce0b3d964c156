"""OCR words to lines, anchors, colons and value regions; skew of line segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillmill.functions.text import line_angle, normalize_text

PAGE = ("source_file", "page_no")
LINE = (*PAGE, "block_num", "par_num", "line_num")
MAX_SPEC = 1000


def group_lines(words: DataFrame, key: Sequence[str] = LINE, offset: Column | int = 0) -> DataFrame:
    """Lines of words: text of normalised tokens in their order, bounding box, first token.

    A line's tokens are gathered as one list; its length is that of a line.
    """
    off = offset if isinstance(offset, Column) else F.lit(offset)
    tokens = words.where(F.trim("text") != "").withColumn("norm", normalize_text(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("token_idx", "norm")))
    lines = tokens.groupBy(*key).agg(
        ordered.alias("tokens"), F.min("token_idx").alias("first_idx"), F.min("left").alias("x1"), F.min(F.col("top") + off).alias("y1"),
        F.max(F.col("left") + F.col("width")).alias("x2"), F.max(F.col("top") + F.col("height") + off).alias("y2"),
    )
    text = F.trim(F.regexp_replace(F.array_join(F.transform("tokens", lambda t: t["norm"]), " "), " +", " "))
    return lines.withColumn("line_text", text).drop("tokens")


def has_keywords(line_text: Column, keywords: Column) -> Column:
    """Every keyword, normalised, is somewhere in the text."""
    return F.forall(keywords, lambda k: F.instr(line_text, normalize_text(k)) > 0)


def anchor_lines(lines: DataFrame, spec: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """page, field and the box of the topmost line that holds a spec row's keywords; ties go to the first token.

    spec is the list of checkbox groups, of checked size: it becomes a literal that each line is unfolded over.
    """
    rows = spec.limit(MAX_SPEC + 1).collect()
    if len(rows) > MAX_SPEC:
        raise ValueError(f"a spec of more than {MAX_SPEC} groups")
    if not rows:
        return lines.select(*page, F.lit("").alias("field"), "x1", "y1", "x2", "y2", "line_text").where(F.lit(False))
    groups = [F.struct(F.lit(r["field"]).alias("field"), F.array(*(F.lit(k) for k in r["keywords"])).alias("keywords"), F.lit(r["page_no"] if "page_no" in spec.columns else None).cast("int").alias("page_no")) for r in rows]
    on = lambda g: has_keywords(F.col("line_text"), g["keywords"]) & (g["page_no"].isNull() | (g["page_no"] == F.col("page_no"))) if "page_no" in lines.columns else has_keywords(F.col("line_text"), g["keywords"])
    hits = lines.withColumn("field", F.explode(F.transform(F.filter(F.array(*groups), on), lambda g: g["field"])))
    box = F.struct("x1", "y1", "x2", "y2", "line_text")
    return hits.groupBy(*page, "field").agg(F.min_by(box, F.struct("y1", "first_idx")).alias("b")).select(*page, "field", "b.*")


def colon_x(words: DataFrame, key: Sequence[str], glyphs: DataFrame | None = None) -> DataFrame:
    """key, colon_x: 0.8 into the first token with a colon, else the middle of the leftmost colon glyph, else NULL."""
    has = F.instr("text", ":") > 0
    first = words.groupBy(*key).agg(F.min_by(F.struct("left", "width"), F.when(has, F.col("token_idx"))).alias("t"))
    token = first.select(*key, (F.col("t.left") + 0.8 * F.col("t.width")).cast("int").alias("token_x"))
    if glyphs is None:
        return token.withColumnRenamed("token_x", "colon_x")
    mid = glyphs.where(F.col("glyph") == ":").groupBy(*key).agg(F.min(F.floor((F.col("left") + F.col("right")) / 2)).cast("int").alias("glyph_x"))
    return token.join(mid, list(key), "left").select(*key, F.coalesce("token_x", "glyph_x").alias("colon_x"))


def value_roi(x1: Column, y1: Column, x2: Column, colon: Column, width: Column, height: Column) -> Column:
    """STRUCT<vx1, vy1, vx2, vy2, kx2>: the value's region right of a colon, and where the key ends."""
    top = F.greatest(y1 - 25, F.lit(0))
    bottom = F.least(top + 95, height)
    c = F.coalesce(colon, F.least(x2 + 10, width - 1))  # before greatest and least, which skip NULLs
    left = F.least(c + 2, width - 1)
    right = F.greatest(width - 10, left + 1)
    return F.struct(left.cast("int").alias("vx1"), top.cast("int").alias("vy1"), right.cast("int").alias("vx2"), bottom.cast("int").alias("vy2"), F.least(c + 5, width - 1).cast("int").alias("kx2"))


def skew_angles(segments: DataFrame, key: Sequence[str], limit: float = 10.0) -> DataFrame:
    """key, skew: exact median angle of the near-horizontal segments, clamped; 0 if there are none.

    segments: x1, y1, x2, y2. Angles are counted per rounded value first, so that a page with a third of all segments
    is a short histogram and not a list.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    angle = F.round(line_angle(dx, dy), 6)
    flat = (dx != 0) & (angle > -45) & (angle < 45)
    counts = segments.select(*key, F.when(flat, angle).alias("angle")).groupBy(*key, "angle").agg(F.count("*").alias("n"))
    mid = counts.groupBy(*key).agg(F.percentile("angle", 0.5, F.col("n")).alias("mid"))
    clamped = F.least(F.greatest(F.coalesce("mid", F.lit(0.0)), F.lit(-limit)), F.lit(limit))
    return mid.select(*key, clamped.alias("skew"))
