"""Personal information inside free text (problem 3): a skip-chain conditional random field.

Tokens are labelled B/I of five types or O. Each sentence is a linear chain whose weights were learned once by pii_train.py
(maximum likelihood on generated sentences) and lie beside this file. A form's texts are one document: words in them that
repeat or resemble each other (short forms of a given name, equal beginnings), however far apart, are joined by skip edges, which favour one
type; loopy message passing (sum-product between the chains' forward-backward passes) carries what one mention shows to the others, and the
labels are decoded from the result.

What a word looks like in general English is read from a public tokenizer's vocabulary (its path is a parameter): whether it is an entry with
and without a capital, and which of them comes first.

Scale: a map over rows; forms don't meet. Sentences are scored once per worker while they stay in its cache, forms
without repeated words need no message passing, and a word has at most two skip edges (to the mentions before and after
it), so the cost grows with the text's length only.

Defined results: NULL, blank and NA texts hold nothing; texts of any length are labelled whole; a span that a text holds
twice is one row; NULL entries of a list keep their number; forms delivered again count once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillmill.llm.names import FORMAL, NICKNAMES
from drillmill.llm.tokenizer import VOCABULARY, read_ranks
from drillmill.sources.tables import forms_once

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "STREET_ADDRESS", "PERSON_NAME")
LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
N = len(LABELS)
TYPE_OF = np.array([0] + [1 + k // 2 for k in range(N - 1)])
TEXTS, LIST = ("Description_of_evacuation", "Problems_noted_correction_actions_taken"), "Evacuation_Details"

#: Given names that are common in the United States, besides those with short forms (fixed values).
COMMON_GIVEN = {*NICKNAMES, *(s for v in NICKNAMES.values() for s in v), *"aaron adam alan albert amanda amber amy andrea angela anna arthur ashley austin brandon brenda brian bruce bryan carl carlos carol carolyn christina christine claire craig crystal deshawn diane dennis dylan earl emily emma eric erica ethan evelyn frances gary george gloria grace hannah heather helen ian irene isaac jane janet janice jason jean jeffrey jeremy jerome jesus joan jordan jose joyce juan julia julie justin karen keith kelly kevin kyle laura lauren linda lisa logan lori louis lucas lucy luis madison maria marie marilyn mark martha mary megan michelle miguel monica nancy natalie nicole noah olivia patrick paul paula peter rachel ralph randy roger rosa rose roy russell ruth ryan samantha sandra sara scott sean sharon shirley sofia sophia stephanie tara teresa terry tiffany todd tracy tyler vanessa vera wanda wayne wendy".split()}
STREET_WORDS = "street|str|st|avenue|avn|ave|av|road|rd|lane|ln|la|drive|drv|dr|court|crt|ct|place|pl|terrace|terr|ter|boulevard|boul|blvd|way|wy|circle|cir|square|sq|parkway|pkwy|trail|trl|crescent|cres|highway|hwy"

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_ABBREVIATIONS = {"mr", "mrs", "ms", "mx", "dr", "no", "sec", "soc", "ext", "tel", "apt", "ave", "av", "st", "str", "rd", "ln", "drv", "ct", "pl", "terr", "ter", "blvd", "ph", "sr", "rev", "lic", "unit", "num", "co"}
#: Spans that look like a type; they are features of the chain, which weighs them against their context.
_LOOKS = {
    "e": re.compile(r"[\w.+-]+\s?(?:@|\[at\]|\(at\))\s?[\w-]+(?:(?:\.|\s?\[dot\]\s?|\sdot\s)[\w-]+)+|[\w.+-]+ at [\w-]+(?: dot [\w-]+)+|[\w.+-]+ at [\w-]+(?:\.[\w-]+)+", re.I),
    "p": re.compile(r"(?<![\w-])(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-]?)?\d{3}[\s.-]?\d{4}(?!\w)(?:,?\s?(?:ext\.?|x)\s?\d{1,5})?", re.I),
    "s": re.compile(r"(?<![\w-])\d{3}[- ]?\d{2}[- ]?\d{4}(?![\w-])"),
    "i": re.compile(r"(?<![\w-])(?:[A-Z]{1,3}-?\d{4,}[A-Z]?|\d{4,}[A-Z]|\d{3,4}(?:[ -]\d{3,4}){1,3}|\d{5,})(?![\w-])"),
    "l": re.compile(r"(?:\b(?:ssn|social(?: security)?|soc\. sec\.|passport|(?:driver'?s? )?licen[cs]e|dl|medicaid|medicare|member|patient|client|resident|case|employee|student|insurance|tax|mrn|tabs|cin)\b)(?: ?(?:id|no|number|num|nr|card)\b\.?| ?#)?\s?[:#]?\s*(?=[\w-]*\d)", re.I),
    "a": re.compile(rf"(?<![\w-])\d{{1,5}} (?:[NSEW]\.? )?(?:[^\W\d_]+ ){{1,3}}(?:{STREET_WORDS})\b\.?(?:,? (?:apt|apartment|unit|ste|suite|#)\.? ?#?\d+ ?-?[A-Z]?\b|,? ?#\d+[A-Z]?\b)?", re.I),
}


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """(offset, sentence): cut at line ends and after . ! ? before a capital, but not after initials and abbreviations."""
    start = 0
    for m in re.finditer(r"\n+|(?<=[.!?])\s+(?=[A-Z(\"])|(?<=[a-z]) - (?=[A-Z])|;\s+(?=[A-Z])", text):
        before = re.search(r"([^\W\d_]+)\.$", text[start : m.start()])
        if m[0][0] != "\n" and before and (len(before[1]) == 1 or before[1].lower() in _ABBREVIATIONS and before[1] != "Co"):
            continue
        if m.start() > start:
            yield start, text[start : m.start()]
        start = m.end()
    if start < len(text):
        yield start, text[start:]


def shape(w: str) -> str:
    if w.isdigit():
        return f"d{min(len(w), 10)}"
    if not w[0].isalpha():
        return w
    if len(w) == 1:
        return "X" if w.isupper() else "x"
    return "XX" if w.isupper() else "Xx" if w[0].isupper() else "xx"


def read_lexicon(path: str = VOCABULARY) -> dict[str, str]:
    """Word in lower case -> T or l if the vocabulary has it only with or without a capital, t or L if both, the capital or the other first."""
    ranks: dict[str, dict[bool, int]] = {}
    for piece, rank in read_ranks(Path(path).read_bytes()).items():
        word = piece.decode("utf-8", "replace")[1:] if piece[:1] == b" " else ""
        if len(word) > 1 and word.isalpha() and (word.islower() or word.istitle()):
            ranks.setdefault(word.lower(), {})[word.istitle()] = rank
    return {w: ("t" if r[True] < r[False] else "L") if len(r) == 2 else "T" if True in r else "l" for w, r in ranks.items()}


def word_kind(word: str, lexicon: dict[str, str]) -> str:
    """The lexicon's letter of a lower-case word; + for one made of two common words, e for a common word with an ending, ? for others."""
    if (got := lexicon.get(word)) is not None:
        return got
    common = lambda w: lexicon.get(w, "T") in "lL"
    if any(word.endswith(e) and len(word) - len(e) > 3 and (common(word[: -len(e)]) or common(word[: -len(e)] + "e")) for e in ("s", "er", "ers", "ing", "ed", "or", "ly")):
        return "e"
    return "+" if any(common(word[:k]) and common(word[k:]) for k in range(3, len(word) - 2)) else "?"


def features(sentence: str, lexicon: dict[str, str]) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """Token offsets and the features of each token. Words that the lexicon doesn't know have no identity of their own."""
    spans = [m.span() for m in _TOKEN.finditer(sentence)]
    words = [sentence[a:b] for a, b in spans]
    lower = [w.lower() for w in words]
    kind = [word_kind(w, lexicon) if len(w) > 1 and w.isalpha() else "." for w in lower]
    low = [f"<{shape(w)}>" if w.isdigit() else f"<{k}>" if k in "?+e" else w for w, k in zip(lower, kind, strict=True)]
    shapes = [shape(w) for w in words]
    given = [x in COMMON_GIVEN for x in lower]
    looks: list[list[str]] = [[] for _ in words]
    for name, pattern in _LOOKS.items():
        for m in pattern.finditer(sentence):
            a, b = m.span()
            first = True
            for k, (s, e) in enumerate(spans):
                if s >= a and e <= b:
                    looks[k].append(f"r{name}{'B' if first else 'I'}")
                    first = False
                elif name == "l" and s >= b and e - b < 16 and (s == b or sentence[b:s].strip() == "" or looks[k - 1] and looks[k - 1][-1].startswith("after")):
                    looks[k].append("afterB" if s == b else "afterI")
                elif s > b + 16:
                    break
    caps = "A" if sum(x == "XX" for x in shapes) > 2 else "a"
    out = []
    n = len(words)
    for k in range(n):
        p1, p2 = (low[k - 1] if k else "^"), (low[k - 2] if k > 1 else "^")
        n1, n2 = (low[k + 1] if k + 1 < n else "$"), (low[k + 2] if k + 2 < n else "$")
        ps, ns = (shapes[k - 1] if k else "^"), (shapes[k + 1] if k + 1 < n else "$")
        pk, nk = (kind[k - 1] if k else "^"), (kind[k + 1] if k + 1 < n else "$")
        g = ("G" if given[k] else "g") + ("G" if k and given[k - 1] else "g") + ("G" if k + 1 < n and given[k + 1] else "g")
        f = ["b", f"w{low[k]}", f"s{shapes[k]}", f"p{p1}", f"n{n1}", f"pp{p2}|{p1}", f"nn{n1}|{n2}", f"t{ps}|{shapes[k]}|{ns}", f"g{g}|{shapes[k]}", f"c{caps}{shapes[k]}{ps}", f"1{'1' if k == 0 else '0'}{shapes[k]}{given[k]:d}"]
        f += [f"k{kind[k]}{shapes[k]}", f"kk{pk}{ps}|{kind[k]}{shapes[k]}|{nk}{ns}", f"kc{caps}{kind[k]}{shapes[k]}", f"kp{kind[k]}{shapes[k]}|{p1}", f"kn{kind[k]}{shapes[k]}|{n1}"]
        if kind[k] in "?+eT":
            f += [f"x{lower[k][-2:]}", f"x{lower[k][-3:]}|{shapes[k]}"]
        f += looks[k]
        if looks[k]:
            f.append("R" + ".".join(looks[k]))
        out.append(f)
    return spans, out


class Crf:
    """Chain weights, inference in log space."""

    def __init__(self, weights: dict[str, np.ndarray], trans: np.ndarray):
        self.weights, self.trans = weights, trans
        self.zero = np.zeros(N)

    @classmethod
    def load(cls, path: Path | None = None) -> Crf:
        raw = json.loads((path or Path(__file__).with_name("pii_weights.json")).read_text())
        return cls.unpack(raw)

    @classmethod
    def unpack(cls, raw: dict) -> Crf:
        weights = {}
        for f, pairs in raw["weights"].items():
            w = np.zeros(N)
            w[[int(k) for k in pairs]] = list(pairs.values())
            weights[f] = w
        return cls(weights, np.array(raw["trans"]))

    def unary(self, feats: list[list[str]]) -> np.ndarray:
        u = np.zeros((len(feats), N))
        get = self.weights.get
        for k, fs in enumerate(feats):
            row = u[k]
            for f in fs:
                if (w := get(f)) is not None:
                    row += w
        return u

    def viterbi(self, u: np.ndarray) -> np.ndarray:
        n = len(u)
        back = np.zeros((n, N), np.int8)
        score = u[0] + self.trans[0]  # row 0: after O, as at the start
        for k in range(1, n):
            s = score[:, None] + self.trans
            back[k] = s.argmax(0)
            score = s.max(0) + u[k]
        out = np.zeros(n, np.int8)
        out[-1] = score.argmax()
        for k in range(n - 1, 0, -1):
            out[k - 1] = back[k][out[k]]
        return out

    def marginals(self, u: np.ndarray) -> np.ndarray:
        """Label probabilities of each token (forward-backward)."""
        n = len(u)
        t = np.exp(self.trans)
        e = np.exp(u - u.max(1, keepdims=True))
        a = np.zeros((n, N))
        b = np.ones((n, N))
        a[0] = e[0] * t[0]
        a[0] /= a[0].sum()
        for k in range(1, n):
            a[k] = (a[k - 1] @ t) * e[k]
            a[k] /= a[k].sum()
        for k in range(n - 2, -1, -1):
            b[k] = t @ (b[k + 1] * e[k + 1])
            b[k] /= b[k].sum()
        m = a * b
        return m / m.sum(1, keepdims=True)


_NUMBER = re.compile(r"\d+")


def _mask(m: re.Match) -> str:
    d = m[0]
    country = d[0] == "1" and len(d) in (1, 4, 7, 8, 11)  # alone, or run together with the next parts of a phone number
    return ("1" if country else "0" if d[0] == "0" else "5") + "5" * (len(d) - 1)


#: Strength of a skip edge for equal types (log), and rounds of message passing.
SKIP, ROUNDS = 1.5, 3
CACHE = 100_000


class Tagger:
    def __init__(self, crf: Crf, lexicon: dict[str, str], skip: float = SKIP, cache: int = CACHE):
        self.crf, self.lexicon, self.cache = crf, lexicon, cache
        self.seen: dict[str, tuple[list[tuple[int, int]], np.ndarray, np.ndarray]] = {}
        agree = np.where(TYPE_OF[:, None] == TYPE_OF[None, :], np.exp(skip), 1.0)
        agree[0, :] = agree[:, 0] = 1.0  # O says nothing about the other mention
        self.agree = agree / agree.mean()

    def _score(self, sentence: str) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        # features see the length of a number, a leading 0 and a 1 that may be a country code, so sentences that differ in other digits are one
        sentence = _NUMBER.sub(_mask, sentence)
        got = self.seen.get(sentence)
        if got is None:
            spans, feats = features(sentence, self.lexicon)
            u = self.crf.unary(feats)
            got = (spans, u, self.crf.viterbi(u) if len(u) else np.zeros(0, np.int8))
            if self.cache and len(sentence) < 400:
                if len(self.seen) >= self.cache:
                    self.seen.clear()
                self.seen[sentence] = got
        return got

    def _key(self, word: str) -> str | None:
        """What mentions of one name have in common; None for words that are no name by themselves."""
        w = word.lower()
        if len(w) < 3 or not w.isalpha() or w not in COMMON_GIVEN and (self.lexicon.get(w, "?") in "lL" or word.islower() and w in self.lexicon):
            return None
        return min(FORMAL[w]) if w in FORMAL else w[:5]

    def label(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], np.ndarray]]:
        """(number of the text, token offsets in it, labels) of each sentence of a document's texts."""
        parts = [(no, [(at + a, at + b) for a, b in spans], u, y) for no, text in enumerate(texts) for at, s in sentences(text) for spans, u, y in (self._score(s),)]
        labels = [p[3] for p in parts]
        last: dict[str, tuple[int, int]] = {}
        edges = []
        for i, (no, spans, _, _) in enumerate(parts):
            for k, (a, b) in enumerate(spans):
                if b - a >= 3 and (key := self._key(texts[no][a:b])):
                    if key in last:
                        edges.append((last[key], (i, k)))
                    last[key] = (i, k)
        if edges and any(labels[i].any() for pair in edges for i, _ in pair):
            self._pass(parts, labels, edges)
        return [(no, spans, y) for (no, spans, _, _), y in zip(parts, labels, strict=True)]

    def _pass(self, parts: list, labels: list[np.ndarray], edges: list) -> None:
        """Loopy belief propagation over the skip edges; relabels the sentences they touch."""
        touched = sorted({i for pair in edges for i, _ in pair})
        extra = {i: np.zeros_like(parts[i][2]) for i in touched}
        sent: dict[tuple, np.ndarray] = {}
        for _ in range(ROUNDS):
            marg = {i: self.crf.marginals(parts[i][2] + extra[i]) for i in touched}
            fresh = {}
            for x, y in edges:
                for src, dst in ((x, y), (y, x)):
                    belief = marg[src[0]][src[1]] / np.exp(sent.get((dst, src), self.crf.zero))  # without what dst said itself
                    belief /= belief.sum()
                    fresh[src, dst] = np.log(belief @ self.agree)
            sent = fresh
            extra = {i: np.zeros_like(parts[i][2]) for i in touched}
            for (_, dst), message in sent.items():
                extra[dst[0]][dst[1]] += message
        for i in touched:
            labels[i] = self.crf.viterbi(parts[i][2] + extra[i])

    def find_all(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(type, start, end) of every span of each text of a document."""
        held = [t if t and t.strip() and t.strip().upper() != "NA" else "" for t in texts]
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for no, offsets, row in self.label(held):
            prev = 0
            for (a, b), y in zip(offsets, row, strict=True):
                kind = int(TYPE_OF[y])
                if kind:
                    if y % 2 == 1 or not prev or TYPE_OF[prev] != kind:  # B, or an I that follows something else
                        out[no].append((TYPES[kind - 1], a, b))
                    else:
                        out[no][-1] = (out[no][-1][0], out[no][-1][1], b)
                prev = int(y)
        return [[x for x in (_trim(text, *s) for s in spans) if x] for text, spans in zip(held, out, strict=True)]

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        return self.find_all([text])[0]


_TITLES = re.compile(r"^(?:mr|mrs|ms|mx|miss|dr|prof|officer|nurse|supervisor)\b\.?\s+", re.I)


def _trim(text: str, kind: str, a: int, b: int) -> tuple[str, int, int] | None:
    """Takes titles, possessive endings and outer marks off, and drops what can't be of its kind."""
    if kind == "PERSON_NAME":
        if m := _TITLES.match(text[a:b]):
            a += m.end()
        if m := re.search(r"['’]s$", text[a:b]):
            b -= len(m[0])
    while a < b and text[a] in " ,;:.#-–\"'/" or a < b and text[a] in "([" and kind != "PHONE":
        a += 1
    while a < b and text[b - 1] in " ,;:-–\"'/#([.":
        b -= 1
    if b > a and text[b - 1] == ")" and "(" not in text[a:b]:
        b -= 1
    span = text[a:b]
    digits = sum(c.isdigit() for c in span)
    if kind == "PHONE" and digits < 7 or kind == "ID_NUMBER" and digits < 4 or kind == "PERSON_NAME" and (digits or not any(c.isalpha() for c in span)) or kind == "STREET_ADDRESS" and not (digits and any(c.isalpha() for c in span)) or kind == "EMAIL" and not re.search(r"@|at", span, re.I):
        return None
    return (kind, a, b) if span else None


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join(out) + text[at:]


_taggers: dict[tuple, Tagger] = {}


def tagger(shared, skip: float = SKIP, cache: int = CACHE) -> Tagger:
    """The worker's tagger, made once from the broadcast weights and lexicon."""
    if (skip, cache) not in _taggers:
        raw, lexicon = shared.value
        _taggers[skip, cache] = Tagger(Crf.unpack(raw), lexicon, skip, cache)
    return _taggers[skip, cache]


def _shared(spark, path: str):
    """Weights and lexicon (fixed, under 2 MB) go to the workers as a broadcast: a zipped package has no files beside its modules."""
    return spark.sparkContext.broadcast((json.loads(Path(__file__).with_name("pii_weights.json").read_text()), read_lexicon(path)))


def _texts(forms: DataFrame) -> DataFrame:
    return forms_once(forms, ["form_id", *TEXTS, LIST])


def _form(row: tuple) -> list[tuple[str, int, str | None]]:
    *texts, items = row
    return [(f, 0, x) for f, x in zip(TEXTS, texts, strict=True)] + [(LIST, k, x) for k, x in enumerate(items if items is not None else (), 1)]


def found(forms: DataFrame, path: str = VOCABULARY, skip: float = SKIP, cache: int = CACHE) -> DataFrame:
    """form_id, field, item_no, pii_type, span."""
    shared = _shared(forms.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tagger(shared, skip, cache)
        for batch in batches:
            rows = []
            for form_id, *row in zip(batch["form_id"], *(batch[f] for f in (*TEXTS, LIST)), strict=True):
                parts = _form(row)
                for (field, no, x), spans in zip(parts, t.find_all([x for _, _, x in parts]), strict=True):
                    rows += [(form_id, field, no, kind, span) for kind, span in dict.fromkeys((kind, x[a:b]) for kind, a, b in spans)]
            yield pd.DataFrame(rows, columns=["form_id", "field", "item_no", "pii_type", "span"]).astype({"form_id": "int64", "item_no": "int32"})

    return _texts(forms).mapInPandas(run, "form_id long, field string, item_no int, pii_type string, span string")


def redacted(forms: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """form_id and the three fields with typed placeholders in place of personal information."""
    shared = _shared(forms.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tagger(shared)
        for batch in batches:
            out = batch.copy()
            cleaned = []
            for row in zip(*(batch[f] for f in (*TEXTS, LIST)), strict=True):
                texts = [x for _, _, x in _form(row)]
                cleaned.append([redact(x, spans) if x else x for x, spans in zip(texts, t.find_all(texts), strict=True)])
            for k, f in enumerate(TEXTS):
                out[f] = pd.Series([c[k] for c in cleaned], dtype=object, index=batch.index)
            out[LIST] = pd.Series([None if x is None else c[len(TEXTS) :] for x, c in zip(batch[LIST], cleaned, strict=True)], dtype=object, index=batch.index)
            yield out

    fields = ", ".join(f"{f} string" for f in TEXTS)
    return _texts(forms).select("form_id", *TEXTS, LIST).mapInPandas(run, f"form_id long, {fields}, {LIST} array<string>")
