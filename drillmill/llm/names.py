"""Variant spellings of names typed by people (problem 1).

Every name is rewritten into all its canonical forms: nicknames into given names, names into initials, tokens into both
orders, type words of organisations into their codes, legal forms away, and each form again with letters missing, so that
typing slips meet. The forms are exploded and equi-joined; a link scores by how rare the form is that both share, in bits, less
what the rewriting cost.

Residents: names of one form meet on (form_id, form). The rarity of a form is the share of all residents of the corpus that
have it, smoothed towards what such a form has without any data, so that small and large inputs are judged alike. An exact check of
the spelled-out parts follows. In a form the best links go first; what fits two residents equally well stays open unless
both lists are of one length and their places agree; an entry left over is linked to the one resident it fits, also if that resident has another.

Agencies: the forms of the distinct spellings of one type of organisation are equi-joined; a spelling points at the one of those before
it in (count, text) that it meets on the rarest form at the fewest edits, and the pointers are followed to their ends. Counts
only order the spellings: two spellings are linked whatever their counts are.

Scale: residents go on only from forms where an entry is a name that differs from all residents, and forms that both lists of a form have
are picked within the row, so that what is exploded and shuffled is about what matches. The agency side works on distinct texts.
Pairs of one organisation are the result asked for; they are made by a self-join with salts by its size.

Defined results: missing texts (NULL, blank, NA), times, ticks and remarks are no names; equal texts are no pair; repeated
forms and rows count once; empty tables give none; names of any length meet within two edits.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drillmill.llm.joins import BROADCAST_ROWS, roots, self_pairs
from drillmill.llm.strings import DeleteIndex, meeting_forms, weighted_distance
from drillmill.session import bounded, cut
from drillmill.sources.tables import forms_once

RESIDENTS, SAFE, AGENCY = "Name_of_Individuals_Residing_in_the_Residence", "At_Safe_Area", "DDSO_Provider_Agency"

#: Short names by given name (fixed values).
NICKNAMES = {
    "alexandra": ("alex", "sandra", "lexi", "sasha"), "anthony": ("tony",), "beatrice": ("bea", "trixie"), "christopher": ("chris", "kit"),
    "deborah": ("deb", "debbie"), "dorothy": ("dot", "dottie", "dolly"), "edward": ("ed", "eddie", "ned", "ted"), "elizabeth": ("beth", "betty", "liz", "lizzie", "eliza"),
    "francis": ("frank", "fran"), "frederick": ("fred", "freddy"), "gerald": ("gerry", "jerry"), "harold": ("hal", "harry"),
    "isabella": ("bella", "izzy"), "james": ("jim", "jimmy", "jamie"), "josephine": ("jo", "josie"), "katherine": ("kate", "kathy", "katie", "kay", "kit"),
    "lawrence": ("larry", "laurie"), "leonard": ("len", "lenny", "leo"), "margaret": ("meg", "maggie", "peggy", "greta"), "michael": ("mick", "mike"),
    "nicholas": ("nick", "nicky"), "oliver": ("ollie",), "patricia": ("pat", "patty", "trish", "tricia"), "raymond": ("ray",),
    "richard": ("rick", "richie", "dick", "rich"), "robert": ("bob", "rob", "bobby"), "samuel": ("sam", "sammy"), "susan": ("sue", "susie", "suzie"), "quentin": ("quent",), "yolanda": ("yoli",),
    "theodore": ("ted", "teddy", "theo"), "thomas": ("tom", "tommy"), "valentina": ("val", "tina"), "vincent": ("vince", "vinny"),
    "abigail": ("abby", "gail"), "andrew": ("andy", "drew"), "barbara": ("barb", "babs"), "benjamin": ("ben", "benny", "benji"), "catherine": ("cathy", "cath", "cat"), "charles": ("charlie", "chuck", "chas"),
    "cynthia": ("cindy",), "daniel": ("dan", "danny"), "david": ("dave", "davy"), "donald": ("don", "donnie"), "eleanor": ("ellie", "nell", "nora"), "eugene": ("gene",), "gregory": ("greg",), "henry": ("hank", "harry"),
    "jacob": ("jake",), "jennifer": ("jen", "jenny"), "jessica": ("jess", "jessie"), "john": ("jack", "johnny"), "jonathan": ("jon", "nathan"), "joseph": ("joe", "joey"), "joshua": ("josh",), "judith": ("judy",),
    "kenneth": ("ken", "kenny"), "matthew": ("matt",), "melissa": ("mel", "missy"), "nathaniel": ("nate", "nat", "nathan"), "pamela": ("pam",), "philip": ("phil",), "rebecca": ("becky", "becca"), "ronald": ("ron", "ronnie"),
    "sarah": ("sally", "sadie"), "stephen": ("steve", "stevie"), "timothy": ("tim", "timmy"), "victoria": ("vicky", "tori"), "walter": ("walt", "wally"),
    "virginia": ("ginny", "ginger"), "wilhelmina": ("mina", "billie", "willa"), "william": ("bill", "will", "billy", "liam"), "zachary": ("zach", "zack"),
}
FORMAL = defaultdict(set)
for _name, _short in NICKNAMES.items():
    FORMAL[_name].add(_name)
    for _s in _short:
        FORMAL[_s].add(_name)

_TITLE = re.compile(r"^(?:mr|mrs|ms|mx|miss|dr|nurse|supervisor|sr|jr)\b\.?\s+", re.I)
_TAIL = re.compile(r"\s*(?:\([^()]*\)|[-–]\s*(?:yes|no|ok|y|n)\b|\b(?:ok|yes)$|[✓✔]$|(?<=\s)[xX]$|\d+:\d\d\b.*|\b\d+\s*s(?:ec)?\b.*|w/.*)\s*$", re.I)
_NO_NAME = {"y", "yes", "n", "no", "na", "n/a", "ok", "x", "none", "all", "ja", "si", "sí"}
_SPECIAL = _NO_NAME | set("mr mrs ms mx miss dr nurse supervisor sr jr staff visitor visitors guest relief nobody w s sec".split())
_REMARK = re.compile(r"\d|\b(?:staff|visitor|visitors|guest|relief|nobody)\b", re.I)


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l")


def person_core(text: str | None) -> str:
    """The name in an entry, without titles, ticks, times and remarks; empty if there is none."""
    t = (text or "").strip()
    words = t.lower().replace(",", " ").replace(".", " ").split()
    if words and all(map(str.isalpha, words)) and _SPECIAL.isdisjoint(words):
        return t
    while True:
        s = _TITLE.sub("", _TAIL.sub("", t)).strip()
        if s == t:
            break
        t = s
    if fold(t) in _NO_NAME or _REMARK.search(t) or not any(c.isalpha() for c in t):
        return ""
    return t


class Person:
    """What a written name may stand for: readings (given, middle, last), each part a whole word, an initial or empty."""

    __slots__ = ("monogram", "readings")

    def __init__(self, core: str):
        self.readings: list[tuple[str, str, str, float]] = []
        self.monogram = ""
        letters = core.replace(".", "")
        if re.fullmatch(r"[A-Z]{2,3}", letters) and not re.search(r"[a-z]", core):
            self.monogram = letters.lower()
            return
        t = fold(core)
        if "," in t:
            last, _, rest = t.partition(",")
            parts = self._words(rest)
            last = " ".join(self._words(last))
            if last:
                self.readings.append((parts[0] if parts else "", parts[1] if len(parts) > 1 else "", last, 0.0))
            return
        w = self._words(t)
        if len(w) == 1:
            self.readings += [(w[0], "", "", 0.0), ("", "", w[0], 0.0)]
        elif len(w) == 2:
            self.readings += [(w[0], "", w[1], 0.0), (w[1], "", w[0], 0.5)]
        elif len(w) >= 3:
            self.readings += [(w[0], " ".join(w[1:-1]), w[-1], 0.0), (w[1], w[2], w[0], 0.5)]

    @staticmethod
    def _words(t: str) -> list[str]:
        return [x for x in re.split(r"[^\w'-]+", t) if x]


def _given(word: str) -> set[str]:
    return FORMAL.get(word, {word})


#: Kinds of forms with the bits that sharing one says without any data: given name or initial with surname, surname, given name with
#: the surname's initial, two initials, given name, first initial.
PRIOR_BITS = {"il": 11.0, "l": 10.0, "gi": 9.0, "ii": 9.0, "g": 6.0, "i": 4.0}
#: Residents that the prior counts for; bits that a whole given name says beyond its initial; bits lost by a slip, by turned
#: parts, by a monogram. A link of a leftover entry says at least LEAST bits.
PRIOR_WEIGHT, GIVEN_BITS, SLIP_BITS, TURNED_BITS, MONOGRAM_BITS, LEAST = 64, 3.0, 4.0, 1.0, 1.0, 5.0


def rewritings(p: Person, slips: bool = True) -> dict[str, tuple[float, str]]:
    """Canonical form -> (bits of the rewriting, gained or lost; the form whose rarity counts). Forms carry their kind, so that
    only like forms meet; those with letters missing (slips) carry a mark, so that they meet each other and the whole form."""
    out: dict[str, tuple[float, str]] = {}

    def add(form: str, bits: float, base: str) -> None:
        if form not in out or bits > out[form][0]:
            out[form] = (bits, base)

    if p.monogram:
        a, b = p.monogram[0], p.monogram[-1]
        add(f"m:{a}{b}", -MONOGRAM_BITS, f"ii:{a}|{b}")
        return out
    for given, _, last, cost in p.readings:
        turned = -TURNED_BITS if cost else 0.0
        names = sorted(_given(given)) if len(given) > 1 else []
        initials = sorted({given[0]} | {n[0] for n in names}) if given else []
        if len(last) > 1:
            for f in names:
                add(f"gl:{f}|{last}", turned + GIVEN_BITS, f"il:{f[0]}|{last}")
            for i in initials:
                add(f"il:{i}|{last}", turned, f"il:{i}|{last}")
                add(f"m:{i}{last[0]}", turned - MONOGRAM_BITS, f"ii:{i}|{last[0]}")
            add(f"l:{last}", turned, f"l:{last}")
            for d in meeting_forms(last, 1 if len(last) < 7 else 2) if slips else ():
                add(f"~l:{d}", turned - SLIP_BITS / (1 if d != last else 2), f"l:{last}")
        tail = last[:1]
        for f in names:
            if tail:
                add(f"gi:{f}|{tail}", turned, f"gi:{f}|{tail}")
            add(f"g:{f}", turned, f"g:{f}")
            for d in meeting_forms(f, 1) if slips else ():
                add(f"~g:{d}", turned - SLIP_BITS / (1 if d != f else 2), f"g:{f}")
            if not last:
                add(f"g1:{f[0]}", turned - 1.0, f"i:{f[0]}")
        if len(given) == 1 and len(last) > 1:
            add(f"g1:{given}", turned, f"i:{given}")  # a lone given name may stand for it
        for i in initials:
            if tail:
                add(f"ii:{i}|{tail}", turned, f"ii:{i}|{tail}")
    return out


def key_of(form: str) -> int:
    """A form as a 64-bit number."""
    return xxhash.xxh3_64_intdigest(form) - (1 << 63)


@functools.lru_cache(200_000)
def _slip_forms(kind: str, word: str) -> frozenset[str]:
    return frozenset(f"~{kind}:{d}" for d in meeting_forms(word, 2 if kind == "l" and len(word) >= 7 else 1))


def slip_words(p: Person) -> Iterator[tuple[str, str, float]]:
    """(kind, word, bits) of the words of a name that may hold slips."""
    for given, _, last, cost in () if p.monogram else p.readings:
        turned = -TURNED_BITS if cost else 0.0
        if len(last) > 1:
            yield "l", last, turned
        for f in sorted(_given(given)) if len(given) > 1 else ():
            yield "g", f, turned


def shared_forms(residents: list[str], entries: list[str]) -> list[tuple[str, int, int, int, float]]:
    """(side, place in its list, key, base, bits) of the forms that names of both lists have.

    Entries that are a resident's text as it stands need none. Of forms with letters missing that the same words share, as equal
    words do in all their forms, the one that says most stands for all.
    """
    exact: list[dict] = [defaultdict(list), defaultdict(list)]
    words: list[dict] = [defaultdict(list), defaultdict(list)]
    for k, texts, skip in ((1, entries, set(residents)), (0, residents, ())):
        if k == 0 and not exact[1]:
            return []
        for t, n in {t: n for n, t in reversed(list(enumerate(texts)))}.items():
            if t and t not in skip and (core := person_core(t)):
                p = Person(core)
                for form, (bits, base) in rewritings(p, False).items():
                    exact[k][form].append((n, base, bits))
                for kind, word, bits in slip_words(p):
                    words[k][kind, word].append((n, bits))
    out = [("re"[k], n, key_of(form), key_of(base), bits) for form in exact[0].keys() & exact[1].keys() for k in (0, 1) for n, base, bits in exact[k][form]]
    both = set().union(*(_slip_forms(*w) for w in words[0])) & set().union(*(_slip_forms(*w) for w in words[1]))
    owners: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
    for k in (0, 1):
        for w in words[k]:
            for form in _slip_forms(*w) & both:
                owners[form][k].append(w)
    lost = lambda form, w: -SLIP_BITS / (2 if form == f"~{w[0]}:{w[1]}" else 1)
    best: dict[tuple, tuple[float, str]] = {}
    for form, (r, e) in owners.items():
        reason, says = (tuple(r), tuple(e)), (sum(lost(form, w) for w in r + e), form)
        if reason not in best or says > best[reason]:
            best[reason] = says
    for reason, (_, form) in best.items():
        out += [("re"[k], n, key_of(form), key_of(f"{w[0]}:{w[1]}"), bits + lost(form, w)) for k in (0, 1) for w in reason[k] for n, bits in words[k][w]]
    return out


def compatible(a: Person, b: Person) -> bool:
    """False if both names are spelled out and differ beyond a slip."""
    if a.monogram or b.monogram:
        return True
    for ga, ma, la, _ in a.readings:
        for gb, mb, lb, _ in b.readings:
            if ma and mb and ma[0] != mb[0]:
                continue
            if len(ga) > 1 and len(gb) > 1 and not (_given(ga) & _given(gb)) and not any(weighted_distance(x, y, 2.0) <= 2.0 for x in _given(ga) | {ga} for y in _given(gb) | {gb}):
                continue
            if len(ga) == 1 and gb and ga != gb[0] and not any(ga == x[0] for x in _given(gb)):
                continue
            if len(gb) == 1 and ga and gb != ga[0] and not any(gb == x[0] for x in _given(ga)):
                continue
            if len(la) > 1 and len(lb) > 1 and weighted_distance(la, lb, 2.5) > 2.5:
                continue
            if len(la) == 1 and lb and la != lb[0] or len(lb) == 1 and la and lb != la[0]:
                continue
            return True
    return False


def assign(residents: list[str], entries: list[str], links: list[tuple[int, int, float]]) -> list[tuple[str, str]]:
    """Pairs of differing texts that stand for one resident. links: (entry, resident, bits) by place in the lists."""
    texts = list(dict.fromkeys(t for t in residents if person_core(t)))
    options = list(dict.fromkeys(e for e in entries if person_core(e)))
    people, others = [Person(person_core(t)) for t in texts], [Person(person_core(e)) for e in options]
    same_length = len(residents) == len(entries)
    best: dict[tuple[int, int], float] = {}
    for e, i, bits in links:
        pair = (options.index(entries[e]), texts.index(residents[i]))
        if bits > best.get(pair, -99.0) and compatible(people[pair[1]], others[pair[0]]):
            best[pair] = bits
    for i, t in enumerate(texts):
        if t in options:
            best = {p: s for p, s in best.items() if p[0] != options.index(t)} | {(options.index(t), i): 99.0}
    scored = [(round(2 * s), e, i) for (e, i), s in best.items()]
    partner: dict[int, int] = {}
    taken: set[int] = set()
    for level in sorted({s for s, _, _ in scored}, reverse=True):
        # all links of one score are judged together: what isn't mutual at that score is ambiguous, unless places agree
        now = [(e, i) for s, e, i in scored if s == level and e not in partner and i not in taken]
        of_e, of_i = Counter(e for e, _ in now), Counter(i for _, i in now)
        sure = [(e, i) for e, i in now if of_e[e] == of_i[i] == 1]
        placed = [(e, i) for e, i in now if (e, i) not in sure and same_length and entries.index(options[e]) == residents.index(texts[i])]
        for e, i in sure + placed:
            if e not in partner and i not in taken:
                partner[e] = i
                taken.add(i)
    for e in range(len(options)):  # a second writing of a resident that has one already
        fits = {i for (x, i), s in best.items() if x == e and s >= LEAST}
        if e not in partner and len(fits) == 1:
            partner[e] = fits.pop()
    return sorted((min(texts[i], options[e]), max(texts[i], options[e])) for e, i in partner.items() if texts[i] != options[e])


_SHARED = T.ArrayType(T.StructType([T.StructField("side", T.StringType()), T.StructField("no", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("base", T.LongType()), T.StructField("bits", T.DoubleType())]))


@F.pandas_udf(_SHARED)
def _shared_forms(residents: pd.Series, entries: pd.Series) -> pd.Series:
    names = ("side", "no", "key", "base", "bits")
    return pd.Series([[dict(zip(names, x, strict=True)) for x in shared_forms(list(r), list(e))] for r, e in zip(residents, entries, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("prior", T.FloatType())])))
def _bases(texts: pd.Series) -> pd.Series:
    """The forms of a name whose rarity counts, with their prior share."""
    out = []
    for t in texts:
        core = person_core(t)
        forms = {base for _, base in rewritings(Person(core), False).values()} if core else ()
        out.append([{"key": key_of(f), "prior": 2.0 ** -PRIOR_BITS[f.split(":")[0]]} for f in forms])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _assign(residents: pd.Series, entries: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([[list(p) for p in assign(list(r), list(e), [(x["e"], x["r"], x["bits"]) for x in found])] for r, e, found in zip(residents, entries, links, strict=True)], dtype=object)


def rarity(residents: DataFrame) -> DataFrame:
    """key, bits: of each form of the residents (text, n), how rare it is among all of them."""
    each = residents.select("n", F.explode(_bases("text")).alias("x")).groupBy("x.key").agg(F.sum("n").alias("n"), F.min("x.prior").alias("prior"))
    total = residents.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    share = (F.col("n") + PRIOR_WEIGHT * F.col("prior")) / (F.lit(total) + PRIOR_WEIGHT)
    return each.select("key", (-F.log2(share)).alias("bits"))


def person_links(forms: DataFrame) -> DataFrame:
    """form_id, residents, entries, links (e, r, bits: places in the lists): all names of a form that share a form."""
    blank = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    once = cut(forms_once(forms, ["form_id", RESIDENTS, SAFE]).select("form_id", blank(F.col(RESIDENTS)).alias("residents"), blank(F.col(SAFE)).alias("entries")))
    # an entry without two letters is no name; one that is a resident's text as it stands needs no link
    asked = once.where(F.exists("entries", lambda e: e.rlike(r"(?U)\p{L}.*\p{L}|^\p{L}\.?$") & ~F.array_contains(F.col("residents"), e)) & (F.size("residents") > 0))
    kept = cut(asked.withColumn("forms", _shared_forms("residents", "entries")).where(F.size("forms") > 0))
    each = kept.select("form_id", F.explode("forms").alias("f")).select("form_id", "f.*")
    side = lambda x: each.where(F.col("side") == x).select("form_id", "key", F.col("base").alias(f"base_{x}"), F.col("no").alias(x), F.col("bits").alias(f"bits_{x}"))
    met = side("e").join(side("r"), ["form_id", "key"])
    people = once.select(F.explode("residents").alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    rare = bounded(rarity(people), BROADCAST_ROWS)
    met = met.groupBy("form_id", "e", "r", "base_r").agg(F.max((F.col("bits_r") + F.col("bits_e")) / 2).alias("bits"))
    scored = met.join(rare.select(F.col("key").alias("base_r"), F.col("bits").alias("rare")), "base_r").select("form_id", "e", "r", (F.col("rare") + F.col("bits")).alias("bits"))
    best = scored.groupBy("form_id", "e", "r").agg(F.max("bits").alias("bits")).groupBy("form_id").agg(F.collect_list(F.struct("e", "r", "bits")).alias("links"))
    return kept.select("form_id", "residents", "entries").join(best, "form_id")


def person_pairs(forms: DataFrame) -> DataFrame:
    pairs = person_links(forms).select("form_id", F.explode(_assign("residents", "entries", "links")).alias("p"))
    return pairs.select(F.lit("person").alias("kind"), "form_id", F.col("p")[0].alias("name_a"), F.col("p")[1].alias("name_b"))


#: The two words of an organisation's type by its code (fixed values). A word stands for one of them as it is, abbreviated or misspelt.
TYPES = {
    "rs": ("residential", "services"), "fs": ("family", "supports"), "ds": ("developmental", "services"), "ch": ("community", "homes"),
    "cn": ("care", "network"), "hp": ("habilitation", "partners"), "la": ("living", "alternatives"), "sa": ("support", "agency"),
}
_LEGAL = {"inc", "incorporated", "llc", "ltd", "corp", "corporation", "co", "the"}
_GENERIC = {"agency", "ddso", "agcy", "provider"}
_LINK = {"of", "at", "in", "for"}
_FULL = sorted({w for pair in TYPES.values() for w in pair})
_WORDS = DeleteIndex(w for w in _FULL if len(w) >= 5)


def abbreviates(word: str, full: str) -> bool:
    """The full word's first letter, then some of its letters in their order."""
    rest = iter(full[1:])
    return len(word) >= 2 and word[0] == full[0] and all(c in rest for c in word[1:])


@functools.cache
def _type_words(word: str) -> frozenset[str]:
    """The type words that a word may stand for: itself, with or without a plural s, what it abbreviates, else what it is near to."""
    plural = {w for w in _FULL if w.rstrip("s") == word.rstrip("s")}
    if plural:
        return frozenset(plural)
    short = {w for w in _FULL if abbreviates(word, w)} if len(word) <= 8 else set()
    near = {w for w, _ in _WORDS.near(word)} if len(word) >= 4 else set()
    return frozenset(short | near)


def agency_readings(text: str) -> list[tuple[str, str]]:
    """(type code or empty, stem) readings of an agency's name."""
    t = fold(text)
    t = re.sub(r"\b([a-z])\.\s?([a-z])\.?(?=\W|$)", r"\1\2", t)  # r.s. -> rs
    words = [w for w in re.split(r"[^a-z0-9]+", t) if w and w not in _LEGAL]
    out = []
    for code, (first, second) in TYPES.items():
        for i in range(len(words) - 1):
            if first in _type_words(words[i]) and second in _type_words(words[i + 1]):
                rest = words[:i] + words[i + 2 :]
                if i == 0 and rest and rest[0] in _LINK:
                    rest = rest[1:]
                if rest:
                    out.append((code, "".join(rest)))
    if out:
        return list(dict.fromkeys(out))
    if len(words) > 1 and (words[-1] in TYPES or words[0] in TYPES):
        return [(words[-1], "".join(words[:-1]))] if words[-1] in TYPES else [(words[0], "".join(words[1:]))]
    stem = "".join(w for w in words if w not in _GENERIC and w not in _LINK)
    return [("", stem)] if stem else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _readings(texts: pd.Series) -> pd.Series:
    """Readings as "type:stem"; neither part holds a colon."""
    return pd.Series([[f"{a}:{b}" for a, b in agency_readings(t)] for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _forms(stems: pd.Series) -> pd.Series:
    return pd.Series([sorted(meeting_forms(s, 1 if len(s) < 6 else 2)) for s in stems], dtype=object)


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x, y, 2.0) for x, y in zip(a, b, strict=True)], dtype="float64")


def agency_classes(forms: DataFrame) -> DataFrame:
    """text, class: every spelling of an agency that can be told, with the type and stem of its organisation."""
    clean = forms.where(F.col(AGENCY).isNotNull() & ~F.upper(F.regexp_replace(AGENCY, r"(?U)^\s+|\s+$", "")).isin("", "NA"))
    counted = clean.groupBy(F.col(AGENCY).alias("text")).agg(F.countDistinct("form_id").alias("n"))
    read = cut(counted.select("text", "n", F.explode(_readings("text")).alias("r")).select("text", "n", F.split_part("r", F.lit(":"), F.lit(1)).alias("type"), F.split_part("r", F.lit(":"), F.lit(2)).alias("stem")))
    nodes = read.groupBy("type", "stem").agg(F.sum("n").alias("n"))
    typed = nodes.where("type <> ''")
    exploded = typed.select("type", "stem", "n", F.explode(_forms("stem")).alias("form"))
    meets = self_pairs(exploded, ["type", "form"], F.struct("n_b", "stem_b") > F.struct("n_a", "stem_a"))
    # how many stems of the type have the form: the fewer, the more it says
    rare = exploded.groupBy("type", "form").agg(F.count("*").alias("stems"))
    best = meets.join(rare, ["type", "form"]).groupBy("type", "stem_a", "stem_b", "n_b").agg(F.min("stems").alias("stems"))
    near = best.withColumn("d", _distance("stem_a", "stem_b")).where("d <= 2.0")
    score = -F.log2("stems") - SLIP_BITS * F.col("d")
    parents = near.groupBy("type", "stem_a").agg(F.max_by("stem_b", F.struct(score, "n_b", "stem_b")).alias("up")).withColumnRenamed("stem_a", "stem")
    found = roots(typed.join(parents, ["type", "stem"], "left"), ["type"], "stem")
    ends = found.join(typed, ["type", "stem"])
    whole = read.where("type <> ''").join(found, ["type", "stem"])
    # several readings of one text: the organisation with most forms
    sizes = ends.groupBy("type", "root").agg(F.sum("n").alias("size"))
    told = whole.join(sizes, ["type", "root"]).groupBy("text").agg(F.max_by(F.struct("type", "root"), F.struct("size", "type", "root")).alias("c"))
    # a name without its type stands for the one organisation of that stem, however spelled; of several it stays open
    bare = read.where("type = ''").select("text", F.explode(_forms("stem")).alias("form"), "stem")
    orgs = sizes.where("root is not null").select("type", "root", F.explode(_forms("root")).alias("form"))
    hits = bare.join(orgs, "form").select("text", "stem", "type", "root").distinct().withColumn("d", _distance("stem", "root")).where("d <= 2.0")
    closest = hits.groupBy("text").agg(F.min("d").alias("d"))
    one = hits.join(closest, ["text", "d"]).groupBy("text").agg(F.count("*").alias("k"), F.first(F.struct("type", "root")).alias("c")).where("k = 1").select("text", "c")
    return told.unionByName(one)


def agency_pairs(forms: DataFrame) -> DataFrame:
    classes = agency_classes(forms).select(F.col("text").alias("name"), F.xxhash64("c").alias("c"))
    pairs = self_pairs(classes, ["c"], F.col("name_a") < F.col("name_b"))
    return pairs.select(F.lit("agency").alias("kind"), F.lit(0).cast("long").alias("form_id"), "name_a", "name_b")


def found(forms: DataFrame) -> DataFrame:
    return person_pairs(forms).unionByName(agency_pairs(forms))
