"""Same postal address written differently (problem 6): top-down hierarchy matching.

A text is parsed into levels: region (post code), locality, street, number and, below them, direction, street type and unit.
They are linked level by level, each only among the records that agree above it:

- locality: a spelling points at the nearest spelling within two edits among those before it in (count, text), and the pointers are
  followed to their ends; counts only order the spellings. A text without a locality takes the one that its region names.
- street and number: spellings of one locality and number point at each other in the same way.
- direction, type, unit: the writings with most levels of one locality, street and number are the places; a writing with missing levels inherits the
  levels of the places that it fits: of one, it is that place; of several, it stays open and says so.
- a writing without locality inherits candidates from all localities: the places with its number and street (else of the street nearest to it) that it
  fits. Where no locality has any, such writings are places among themselves.

Scale: texts are parsed once per distinct text. Groups are those of one locality, street and number; a number and street that very many
localities have is only joined to, and counted with partial aggregation. Pairs of one place are the result asked for, made
by a self-join with salts by its size.

Defined results: texts without a number and a street hold no address; equal texts are no pair; forms delivered again count
once; ambiguous writings give no pairs; names of any length meet within two edits; empty tables give none.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drillmill.llm.names import fold
from drillmill.llm.joins import roots, self_pairs
from drillmill.llm.strings import meeting_forms, weighted_distance
from drillmill.session import cut
from drillmill.sources.tables import forms_once

ADDRESS = "Site_Address"

#: Written forms of street types, directions and parts of town names (fixed values).
TYPES = {w: k for k, ws in {
    "street": "street str st", "avenue": "avenue ave av avn aven", "road": "road rd", "lane": "lane ln la", "drive": "drive dr drv", "court": "court ct crt",
    "place": "place pl plc", "terrace": "terrace terr ter", "boulevard": "boulevard blvd boul bvd", "way": "way wy", "circle": "circle cir", "square": "square sq",
    "highway": "highway hwy", "parkway": "parkway pkwy", "trail": "trail trl",
}.items() for w in ws.split()}
DIRECTIONS = {"n": "n", "north": "n", "no": "n", "s": "s", "south": "s", "so": "s", "e": "e", "east": "e", "w": "w", "west": "w"}
TOWN_PARTS = DIRECTIONS | {"mt": "mount", "mount": "mount", "ft": "fort", "fort": "fort", "st": "saint", "saint": "saint", "up": "upper", "upr": "upper", "upper": "upper", "lower": "lower", "lwr": "lower", "new": "new", "old": "old", "port": "port", "pt": "port"}
HOUSE = r"(?:home|house|ira|cottage|lodge|residence|villa|manor|icf)"

_ZIP = re.compile(r"\b(\d{5})(?:-\d{4})?\b")
_STATE = re.compile(r"[\s,;]+(?:n\.?\s?y\b\.?|new york\b\.?)(?=[\s,;.-]*$|[\s,;.-]+\d{5})|(?<=[\s,;])(?:n\.?\s?y\b\.?|new york\b\.?)(?=[\s,;.-]*$)")
_UNIT_WORD = re.compile(r"(?:\b(?:apartment|apt|unit|suite|ste)\b\.?\s*#?\s*)(\d+)(?:\s?-?\s?([a-z])(?![\w.]))?")
_UNIT_HASH = re.compile(r"#\s*(\d+)(?:\s?-?\s?([a-z])(?![\w.]))?")


def _near_type(word: str) -> str | None:
    if word in TYPES:
        return TYPES[word]
    if len(word) >= 5:
        for full in set(TYPES.values()):
            if len(full) >= 5 and weighted_distance(word, full, 1.7) <= 1.7:
                return full
    return None


def parse_address(text: str) -> dict | None:
    """Levels of an address: number, street, and direction, type, unit, town and zip where written; None if there is none."""
    t = fold(text).replace("\r", "\n").replace("\n", ", ")
    t = " ".join(re.sub(r"\([^()]*\)", " ", t).split())
    t = re.sub(rf"(?:^|(?<=[,;\s]))(?:the )?[^\W\d]+ {HOUSE}\s*(?:,|;|\s-\s|$)", ", ", t)
    out: dict = dict.fromkeys(("number", "street", "dir", "type", "unit", "town", "zip", "saint"))
    zips = [m for m in _ZIP.finditer(t)]
    if zips:
        m = zips[-1]
        out["zip"] = m[1]
        t = t[: m.start()] + " , " + t[m.end() :]
    t = _STATE.sub(" , ", t.strip(" ,;.-") + " ")
    m = _UNIT_WORD.search(t)
    if not m:  # "#12 Elm Street" is a number, "Elm Street #12" or ", #12" a unit
        hits = list(_UNIT_HASH.finditer(t))
        m = next((h for h in reversed(hits) if re.search(r"\d", t[: h.start()]) or not re.match(r"\s+[a-z]", t[h.end() :]) or len(hits) > 1), None)
        if m and not re.search(r"\d", t[: m.start()] + t[m.end() :]):
            m = None
    if m:
        out["unit"] = m[1].lstrip("0") + (m[2] or "")
        t = t[: m.start()] + " , " + t[m.end() :]
    segments = [s for s in (re.findall(r"[\w']+", x) for x in re.split(r"[,;]|\s[-–]\s", t.replace("#", " "))) if s]
    at = next(((i, j) for i, s in enumerate(segments) for j, w in enumerate(s) if w.isdigit()), None)
    if at is None:
        return None
    i, j = at
    seg = segments[i]
    out["number"] = seg[j].lstrip("0") or "0"
    before, after = seg[:j], seg[j + 1 :]
    if before and before[-1] in ("no", "nr", "number"):
        before = before[:-1]
    rest = [s for k, s in enumerate(segments) if k != i]

    def street_first(words: list[str]) -> list[str]:
        """Reads [direction] street [type] off the front; returns what is left."""
        w = list(words)
        if len(w) > 1 and w[0] in DIRECTIONS and w[1] not in TYPES:
            out["dir"] = DIRECTIONS[w.pop(0)]
        if not w:
            return []
        # "Old Mill Road": words up to a street type are the street, unless a part of a town's name stands between
        end = next((k for k in range(2, min(4, len(w))) if w[k] in TYPES and not (w[k] == "st" and k + 1 < len(w)) and not any(_near_type(x) or x in TOWN_PARTS for x in w[1:k])), 1)
        out["street"], w = "".join(w[:end]), w[end:]
        if w and (kind := _near_type(w[0])):
            out["type"] = kind
            if w.pop(0) == "st" and w:
                out["saint"] = "st"  # "Elm St Albans" may be Elm Street, Albans or Elm, Saint Albans
        return w

    def street_last(words: list[str]) -> list[str]:
        """Reads [town] [direction] street [type] off the end; returns what is left."""
        w = list(words)
        if len(w) > 1 and (kind := _near_type(w[-1])):
            out["type"] = kind
            w.pop()
        out["street"] = w.pop()
        if w and w[-1] in DIRECTIONS:
            out["dir"] = DIRECTIONS[w.pop()]
        return w

    town: list[str] = []
    left: list[str] = []
    # without any street type, a word that begins town names ("North", "Fort") after the number means that the street leads
    untyped = not any(_near_type(x) for x in after[1:])
    typed_before = any(_near_type(x) for x in before[1:]) or bool(before and after and untyped and after[0] in TOWN_PARTS)
    if after and not typed_before:
        left = street_first(after)
        town = before or left
    elif before:
        town = street_last(before) or after
    elif rest:  # the number stands alone: its street is the segment next to it
        k = min(i, len(rest) - 1)
        left = street_first(rest.pop(k))
        town = left
    if not out["street"] or out["street"].isdigit() or len(out["street"]) < 2:
        return None
    if not town:
        town = next((s for s in rest if not any(w.isdigit() for w in s)), [])
    if town and out["type"] is None and len(town) == 1 and (kind := _near_type(town[0])):
        out["type"], town = kind, []
    if town:
        head = [TOWN_PARTS[w] for w in town[:-1] if w in TOWN_PARTS]
        base = "".join(w for k, w in enumerate(town) if k == len(town) - 1 or w not in TOWN_PARTS)
        out["town"] = " ".join([*head, base])
    out["saint"] = f"saint {out['town']}" if out["saint"] and out["town"] and town is left else None
    return out


LEVELS = T.StructType([T.StructField(c, T.StringType()) for c in ("number", "street", "dir", "type", "unit", "town", "zip", "saint")])


@F.pandas_udf(LEVELS)
def _parse(texts: pd.Series) -> pd.DataFrame:
    rows = [parse_address(t) or {} for t in texts]
    return pd.DataFrame(rows, columns=[f.name for f in LEVELS], dtype=object).astype(object).where(lambda d: d.notna(), None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _slips(words: pd.Series) -> pd.Series:
    return pd.Series([sorted(meeting_forms(w, 1 if len(w) < 6 else 2)) for w in words], dtype=object)


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x, y, 2.0) for x, y in zip(a, b, strict=True)], dtype="float64")


def _most(a: str, b: str, sure: bool) -> Column:
    """Edits that may lie between two spellings: two in long ones, one in short ones. Where no locality speaks for it (not sure), one of
    two edits must be a likely slip of typing."""
    return F.when(F.least(F.length(a), F.length(b)) >= 6, 2.0 if sure else 1.9).otherwise(1.0)


def _nearest(nodes: DataFrame, within: list[str], word: str, sure: bool = True) -> DataFrame:
    """within, word, root: each spelling (with its count n) and the one at the end of the spellings that it follows."""
    several = nodes.groupBy(*within).agg(F.count("*").alias("k")).where("k > 1").drop("k")  # one alone meets none
    forms = nodes.join(several, within, "left_semi").select(*within, word, "n", F.explode(_slips(word)).alias("form"))
    meets = self_pairs(forms, [*within, "form"], F.struct("n_b", f"{word}_b") > F.struct("n_a", f"{word}_a"))
    near = meets.select(*within, f"{word}_a", f"{word}_b", "n_b").distinct().withColumn("d", _distance(f"{word}_a", f"{word}_b")).where(F.col("d") <= _most(f"{word}_a", f"{word}_b", sure))
    up = near.groupBy(*within, F.col(f"{word}_a").alias(word)).agg(F.max_by(f"{word}_b", F.struct(-F.col("d"), "n_b", f"{word}_b")).alias("up"))
    return roots(nodes.join(up, [*within, word], "left"), within, word)


def _town_roots(parsed: DataFrame) -> DataFrame:
    """town, town_root. Parts of names such as Fort or North must be the same."""
    head, base = F.regexp_extract("town", r"^(.*) ", 1), F.regexp_extract("town", r"([^ ]*)$", 1)
    towns = parsed.where("town is not null").groupBy(head.alias("head"), base.alias("base")).agg(F.sum("n").alias("n"))
    full = lambda c: F.trim(F.concat_ws(" ", "head", c))
    return _nearest(towns, ["head"], "base").select(full("base").alias("town"), full("root").alias("town_root"))


def settle(writings: list[tuple]) -> list[int]:
    """For the writings (direction, type, unit; None where missing) of one group: the place of each, from 0,
    or -1 if it fits several places."""
    size = len(writings[0])
    order = sorted(range(len(writings)), key=lambda i: (-sum(v is not None for v in writings[i]), tuple(v or "" for v in writings[i])))
    places: list[list] = []
    by: dict[tuple, dict[tuple, set[int]]] = defaultdict(lambda: defaultdict(set))
    masks: set[tuple] = {tuple(v is not None for v in w) for w in writings}

    def enter(p: int) -> None:
        for mask in masks:
            if all(places[p][k] is not None for k in range(size) if mask[k]):
                by[mask][tuple(places[p][k] for k in range(size) if mask[k])].add(p)

    out = [-1] * len(writings)
    for i in order:
        w = writings[i]
        mask = tuple(v is not None for v in w)
        fits = by[mask][tuple(v for v in w if v is not None)]
        if len(fits) == 1:
            out[i] = next(iter(fits))
        elif not fits:
            # no place has all its levels: it may complete the one place that contradicts none of them
            loose = [p for p, q in enumerate(places) if all(a is None or b is None or a == b for a, b in zip(w, q, strict=True))]
            if len(loose) == 1:
                p = loose[0]
                places[p] = [b if a is None else a for a, b in zip(w, places[p], strict=True)]
            elif loose:
                continue
            else:
                p = len(places)
                places.append(list(w))
            out[i] = p
            enter(p)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _settle(groups: pd.Series) -> pd.Series:
    none = lambda v: None if v == "" else v
    return pd.Series([settle([tuple(none(v) for v in w.split("|")) for w in g]) for g in groups], dtype=object)


def places(forms: DataFrame) -> DataFrame:
    """form_id, text, town, number, street, place (-1: fits several) of each form whose address can be read."""
    once = forms_once(forms, ["form_id", ADDRESS]).where(F.col(ADDRESS).isNotNull()).withColumnRenamed(ADDRESS, "text")
    texts = once.groupBy("text").agg(F.count("*").alias("n"))
    read = cut(texts.select("text", "n", _parse("text").alias("p")).where("p.number is not null").select("text", "n", "p.*"))
    named = read.where("town is not null").groupBy("town").agg(F.sum("n").alias("seen"))
    saints = named.select(F.col("town").alias("saint"), F.col("seen").alias("saint_seen"))
    read = read.join(named, "town", "left").join(saints, "saint", "left")
    is_saint = F.coalesce("saint_seen", F.lit(0)) > F.coalesce("seen", F.lit(0))
    read = cut(read.select("text", "n", "number", "street", "dir", F.when(~is_saint, F.col("type")).alias("type"), "unit", F.when(is_saint, F.col("saint")).otherwise(F.col("town")).alias("town"), "zip"))
    towns = _town_roots(read)
    located = read.join(towns, "town", "left").drop("town").withColumnRenamed("town_root", "town")
    # region level: the locality that most texts with this post code name
    counts = located.where("zip is not null and town is not null").groupBy("zip", "town").agg(F.sum("n").alias("n"))
    of_zip = counts.groupBy("zip").agg(F.max_by("town", F.struct("n", "town")).alias("zip_town"))
    located = cut(located.join(of_zip, "zip", "left").withColumn("town", F.coalesce("town", "zip_town")).drop("zip_town"))
    here = located.where("town is not null")
    spelled = cut(_nearest(here.groupBy("town", "number", "street").agg(F.sum("n").alias("n")), ["town", "number"], "street"))
    levels = [F.coalesce(c, F.lit("")).alias(c) for c in ("dir", "type", "unit")]
    known = cut(here.join(spelled, ["town", "number", "street"]).select("text", "town", "number", F.col("root").alias("street"), *levels))
    told = _settled(known, ["town", "number", "street"])
    lost = cut(_without_town(located.where("town is null"), spelled, told, levels))
    return once.join(told.select("text", "town", "number", "street", "place").unionByName(lost), "text").select("form_id", "text", "town", "number", "street", "place")


def _settled(known: DataFrame, within: list[str]) -> DataFrame:
    """known with the place of each text among those of its group, -1 if it fits several."""
    w = F.concat_ws("|", "dir", "type", "unit").alias("w")
    groups = known.groupBy(*within).agg(F.collect_set(w).alias("ws"))
    settled = groups.withColumn("p", _settle("ws")).select(*within, F.explode(F.arrays_zip("ws", "p")).alias("x")).select(*within, F.col("x.ws").alias("w"), F.col("x.p").alias("place"))
    return cut(known.withColumn("w", w).join(settled, [*within, "w"]).drop("w"))


def _without_town(open_texts: DataFrame, spelled: DataFrame, told: DataFrame, levels: list) -> DataFrame:
    """text, town, number, street, place of the texts that name no locality: -1 if places of several localities fit."""
    texts = cut(open_texts.select("text", "n", "number", "street", *levels))
    streets = texts.groupBy("number", "street").agg(F.sum("n").alias("n"))
    same = spelled.select("number", "street", "town", "root")
    exact = streets.join(same, ["number", "street"]).select("number", "street", "town", "root", F.lit(0.0).alias("d"))
    rest = streets.join(same.select("number", "street").distinct(), ["number", "street"], "left_anti")
    forms = rest.select("number", "street", F.explode(_slips("street")).alias("form"))
    others = same.select("number", F.col("street").alias("other"), "town", "root", F.explode(_slips("street")).alias("form"))
    near = forms.join(others, ["number", "form"]).select("number", "street", "other", "town", "root").distinct()
    near = near.withColumn("d", _distance("street", "other")).where(F.col("d") <= _most("street", "other", False)).select("number", "street", "town", "root", "d")
    streets_of = exact.unionByName(near).groupBy("number", "street", "town", "root").agg(F.min("d").alias("d"))
    nearest = streets_of.groupBy("number", "street").agg(F.min("d").alias("d"))
    candidates = cut(streets_of.join(nearest, ["number", "street", "d"]).select("number", "street", "town", "root"))
    # a place has the levels of all its writings
    full = told.where("place >= 0").groupBy("town", "number", "street", "place").agg(*(F.max(c).alias(f"{c}_p") for c in ("dir", "type", "unit"))).withColumnRenamed("street", "root")
    met = texts.join(candidates, ["number", "street"]).join(full, ["town", "number", "root"])
    pairs = [(F.col(c), F.col(f"{c}_p")) for c in ("dir", "type", "unit")]
    fits, loose = F.lit(True), F.lit(True)
    for w, p in pairs:
        fits, loose = fits & ((w == "") | (w == p)), loose & ((w == "") | (p == "") | (w == p))
    met = met.withColumn("fits", fits).withColumn("loose", loose).where("loose")
    at = F.struct("town", "root", "place")
    counted = met.groupBy("text", "number").agg(F.count_if("fits").alias("k"), F.count("*").alias("all"), F.min_by(at, F.when(F.col("fits"), F.lit(0)).otherwise(1)).alias("x"))
    one = (F.col("k") == 1) | (F.col("k") == 0) & (F.col("all") == 1)
    inherited = cut(counted.select("text", F.when(one, F.col("x.town")).alias("town"), "number", F.when(one, F.col("x.root")).alias("street"), F.when(one, F.col("x.place")).otherwise(-1).alias("place")))
    alone = texts.join(inherited, "text", "left_anti")
    own = _nearest(alone.groupBy("number", "street").agg(F.sum("n").alias("n")), ["number"], "street", False)
    among = _settled(alone.join(own, ["number", "street"]).select("text", F.lit(None).cast("string").alias("town"), "number", F.col("root").alias("street"), "dir", "type", "unit"), ["number", "street"])
    return inherited.unionByName(among.select("text", "town", "number", "street", "place"))


def found(forms: DataFrame) -> DataFrame:
    """form_a, form_b: forms of one place whose texts differ."""
    known = places(forms).where("place >= 0").select("form_id", F.xxhash64("text").alias("t"), F.xxhash64("text", F.lit("again")).alias("u"), F.xxhash64("town", "number", "street", "place").alias("k"))
    pairs = self_pairs(known, ["k"], (F.col("form_id_a") < F.col("form_id_b")) & ((F.col("t_a") != F.col("t_b")) | (F.col("u_a") != F.col("u_b"))))
    return pairs.select(F.col("form_id_a").alias("form_a"), F.col("form_id_b").alias("form_b"))


def open_addresses(forms: DataFrame) -> DataFrame:
    """form_id, text of the addresses that fit several places."""
    return places(forms).where("place < 0").select("form_id", "text")
