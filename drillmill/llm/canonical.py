"""Mapping of typed answers to a reference list (problem 2).

The reference list and the other names of its entries that an input table gives are put into a symmetric-delete dictionary, small and of checked
size, that every worker builds once. An answer is tidied (case, marks, words that only decorate it) and looked up; entries
within the edits that their length allows are ranked by weighted Damerau-Levenshtein distance and then by how often the
entry occurs as such in the data. If no entry is near the whole answer, its words are corrected one by one against the
words of the dictionary. What is near nothing is reported as unmatched (canonical_id 0).

Scale: a map over the rows with a cache of answers per worker; nothing is shuffled but the de-duplication of forms, and the
reference frequencies, which are counts of exact hits: at most one row for each dictionary entry.

Defined results: NULL, blank or NA answers (any case) give no row; answers of any length are looked up whole;
what is longer than the longest entry and its edits is near none; ties go to the more frequent entry, then to the smaller id; forms delivered again count once; no reference list
leaves all answers unmatched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillmill.llm.strings import DeleteIndex
from drillmill.sources.tables import forms_once

FIELDS = ("Weather_Conditions", "Part_of_Day", "Centrally_Monitored_Fire_Alarm_Station", "was_drill_observed")
MAX_ENTRIES = 20_000
CACHE = 200_000

#: The default table of other names, an input like the reference list itself: entry in lower case -> other names.
ALIASES = Path(__file__).with_name("canonical_aliases.json")


def read_aliases(path: Path = ALIASES) -> dict[str, list[str]]:
    return json.loads(path.read_text(encoding="utf-8"))


#: Words that say nothing about the answer (fixed values).
_FRONT = re.compile(r"^(?:weather|it was|quite|mostly|in the|during|the)\s+")
_BACK = re.compile(r"(?:\s+(?:today|outside|at start|shift|drill)|\s+\d+\s*(?:deg|f|c|degrees))$")
_ASIDE = re.compile(r"\([^()]*\)")


def tidy(text: str) -> str:
    t = text.lower().replace("’", "'").replace("'", "")
    t = re.sub(r"\b([a-z])\.(?=[a-z]\.)", r"\1", t)  # a.m. -> am.
    return " ".join(re.sub(r"[^\w✓]+", " ", t).split())


def undecorated(t: str) -> str:
    while True:
        s = _BACK.sub("", _FRONT.sub("", t))
        if s == t or not s:
            return t
        t = s


class Matcher:
    """Reference list of one field."""

    def __init__(self, entries: Sequence[tuple[int, str]], frequency: dict[str, int], aliases: Mapping[str, Sequence[str]] | None = None):
        self.ids: dict[str, int] = {}
        for cid, name in sorted(entries):
            for n in (name, *(aliases or {}).get(name.strip().lower(), ())):
                self.ids.setdefault(tidy(n), cid)
        self.ids.pop("", None)
        self.frequency = frequency
        self.index = DeleteIndex(self.ids)
        self.tokens = DeleteIndex({w for n in self.ids for w in n.split()})

    def variants(self, text: str) -> list[str]:
        whole, plain = tidy(text), tidy(_ASIDE.sub(" ", text))
        return [v for v in dict.fromkeys((whole, plain, undecorated(whole), undecorated(plain))) if v]

    def exact(self, text: str) -> str | None:
        return next((v for v in self.variants(text) if v in self.ids), None)

    def find(self, text: str) -> int:
        if (hit := self.exact(text)) is not None:
            return self.ids[hit]
        best: tuple[float, int, int] | None = None
        for v in self.variants(text):
            for name, d in self.index.near(v):
                rank = (round(d, 6), -self.frequency.get(name, 0), self.ids[name])
                if best is None or rank < best:
                    best = rank
        if best is None:
            for v in self.variants(text):
                words = v.split()
                if len(words) < 2:
                    continue
                fixed, cost = [], 0.0
                for w in words:
                    near = [(0.0, w)] if w in self.tokens.at and w in self.tokens.words else sorted((d, x) for x, d in self.tokens.near(w))
                    if not near:
                        break
                    fixed.append(near[0][1])
                    cost += near[0][0]
                else:
                    for name in (" ".join(fixed), undecorated(" ".join(fixed))):
                        if name in self.ids:
                            rank = (round(cost, 6), -self.frequency.get(name, 0), self.ids[name])
                            if best is None or rank < best:
                                best = rank
        return best[2] if best else 0


def _entries(canonical: DataFrame) -> dict[str, list[tuple[int, str]]]:
    rows = canonical.where(F.col("field").isNotNull() & F.col("canonical").isNotNull()).select("canonical_id", "field", "canonical").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a reference list of more than {MAX_ENTRIES} entries isn't broadcast")
    out: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        out.setdefault(r["field"], []).append((r["canonical_id"], r["canonical"]))
    return out


def _lookup(entries, frequency, aliases, exact: bool):
    made: dict = {}

    def run(fields: pd.Series, texts: pd.Series) -> pd.Series:
        if "m" not in made:
            made["m"] = {f: Matcher(e, frequency.get(f, {}), aliases) for f, e in entries.items()}
            made["seen"] = {}
        matchers, seen, out = made["m"], made["seen"], []
        for f, t in zip(fields, texts, strict=True):
            if (f, t) not in seen:
                if len(seen) >= CACHE:
                    seen.clear()
                m = matchers.get(f)
                seen[f, t] = (None if exact else 0) if m is None else m.exact(t) if exact else m.find(t)
            out.append(seen[f, t])
        return pd.Series(out, dtype=object if exact else "int32")

    return F.pandas_udf(run, "string" if exact else "int")


def answers(forms: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """form_id, field, answer of every answer that isn't missing."""
    once = forms_once(forms, ["form_id", *fields])
    items = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("answer")) for f in fields))
    long = once.select("form_id", F.explode(items).alias("x")).select("form_id", "x.field", "x.answer")
    return long.where(F.col("answer").isNotNull() & ~F.upper(F.regexp_replace("answer", r"(?U)^\s+|\s+$", "")).isin("", "NA"))


def map_answers(forms: DataFrame, canonical: DataFrame, fields: Sequence[str] = FIELDS, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """form_id, field, answer, canonical_id. aliases: other names of entries; {} for none, by default those of ALIASES."""
    entries = _entries(canonical)
    aliases = read_aliases() if aliases is None else dict(aliases)
    if sum(map(len, aliases.values())) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} other names aren't broadcast")
    rows = answers(forms, fields)
    exact: Column = _lookup(entries, {}, aliases, True)("field", "answer")
    frequency: dict[str, dict[str, int]] = {}
    # exact hits only: at most one row for each dictionary entry
    for r in rows.select("field", exact.alias("name")).where(F.col("name").isNotNull()).groupBy("field", "name").count().collect():
        frequency.setdefault(r["field"], {})[r["name"]] = r["count"]
    return rows.withColumn("canonical_id", _lookup(entries, frequency, aliases, False)("field", "answer"))


def found(forms: DataFrame, canonical: DataFrame) -> DataFrame:
    return map_answers(forms, canonical).select("form_id", "field", "canonical_id")


def unmatched(forms: DataFrame, canonical: DataFrame) -> DataFrame:
    """field, answer, forms: the answers that match no entry, with the number of forms that give them."""
    rows = map_answers(forms, canonical).where(F.col("canonical_id") == 0)
    return rows.groupBy("field", "answer").agg(F.count("*").alias("forms"))
