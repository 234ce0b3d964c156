"""Long exact spans shared between records (problem 9): seed and extend.

Seeds: of every window of w = min_chars - k + 1 consecutive k-grams the one with the smallest hash is kept (winnowing), so
any run of min_chars characters that two texts share holds a seed that both have at that place. Equal seeds that overlap each
other (a stretch that repeats a short period) are one entry with first place, step and count. Seeds that two texts share are
joined; at the first shared seed of a run the texts are extended both ways, character by character, and a run of min_chars
or more makes a link. Of entries with a step every alignment is tried that differs in what surrounds it.

`found` extends each run once: where two seeds agree with the seeds before them, the run was met there. `shared_report` goes
through no pairs at all: every stretch of min_chars belongs to the leftmost smallest seed in it, a seed with all stretches that
belong to it is a class of equal strings, and a stretch is shared if its class, or a class with an equal stretch, stands in
another text.

Scale: equal texts are one text until the end. Seeds, not texts, are shuffled: counted with partial aggregation, of which
the shared ones go on. Texts are read again for the windows around the seeds that need them; what is joined to them, and the list
of shared seeds, is broadcast behind a check of its size and shuffled beyond it. A seed, or a class of copies, that very many
texts share is spread over as many salted parts as its count asks for. Lineage is cut through the shared checkpoint folder.

Defined results: characters are code points, as stored; NULL, empty and short texts share nothing; a run within one text
counts only against other texts; repeated doc_ids with the same text count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillmill.session import bounded, cut

MIN_CHARS = 200
#: A seed or a text that more records share than this is spread over as many parts as it takes.
PER_SALT = 500
#: Rows of two or three numbers that may be broadcast (under 5 MB).
BROADCAST_ROWS = 100_000

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_TOP = np.iinfo(np.uint64).max

#: Characters hashed in one go, and the powers that this takes, made once per worker.
BLOCK = 1_000_000
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, BLOCK), base, dtype=np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        if n <= 4 * BLOCK:
            _powers[int(base)] = have
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * _power(_B, len(codes)))))


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end), from prefix sums of a polynomial (wrapping arithmetic)."""
    with np.errstate(over="ignore"):
        return _mix((sums[end] - sums[start]) * _power(_INV, len(sums))[start] + (end - start).astype(np.uint64))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    n = len(codes) - k + 1
    at = np.arange(max(n, 0))
    return range_hashes(prefix_sums(codes), at, at + k) if n > 0 else np.empty(0, np.uint64)


def _sliding(values: np.ndarray, w: int, of: np.ufunc, fill: int) -> np.ndarray:
    """Minimum or maximum of each w neighbours: suffixes of one block of w and prefixes of the next."""
    n = len(values)
    blocks = np.concatenate((values, np.full(-n % w, fill, np.uint64))).reshape(-1, w)
    left = of.accumulate(blocks, axis=1).ravel()
    right = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(right[: n - w + 1], left[w - 1 : n])


def winnow(hashes: np.ndarray, w: int, last: np.ndarray | None = None) -> np.ndarray:
    """Positions whose hash is the smallest of some window of w hashes (all such positions where several are equal).

    last: for each position the last one of its text; windows lie within one text. Without it all hashes are one text's.
    """
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(w, n)
    low = _sliding(hashes, w, np.minimum, _TOP)
    if last is not None:
        low[np.arange(n - w + 1) + w - 1 > last[: n - w + 1]] = 0
    # a window's minimum is at most each of its hashes, so a position is chosen if the largest minimum around it equals it
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate((edge, low, edge)), w, np.maximum, 0) == hashes)


class Block:
    """Some texts, one after the other: hashes of their k-grams, each with its text, and the seeds."""

    def __init__(self, texts: list[str], k: int, w: int):
        self.k, self.w = k, w
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        codes = _code_points("".join(texts))
        self.sums = prefix_sums(codes)
        self.owner = np.repeat(np.arange(len(texts)), sizes)[: max(0, len(codes) - k + 1)]
        places = np.arange(len(self.owner))
        self.last = (ends - k)[self.owner]
        self.hashes = np.where(places <= self.last, range_hashes(self.sums, places, np.minimum(places + k, len(codes))), _TOP)
        at = winnow(self.hashes, w, self.last)
        self.at = at[at <= self.last[at]]  # in the joined text

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the text, hash, place in it)."""
        owner = self.owner[self.at]
        return owner, self.hashes[self.at], self.at - self.starts[owner]

    def entries(self) -> tuple[np.ndarray, ...]:
        """(index of the text, hash, first place, step, count, link): seeds, those that overlap at one step as one entry.

        link tells the seed before, and how far before; 0, which agrees with none, for a seed without one and for several places.
        """
        owner, h, at = self.seeds()
        before = np.zeros(len(at), np.uint64)
        near = np.zeros(len(at), bool)
        near[1:] = (owner[1:] == owner[:-1]) & (at[1:] - at[:-1] <= self.k)
        with np.errstate(over="ignore"):
            before[1:] = _mix(h[:-1] * np.uint64(3) + (at[1:] - at[:-1]).astype(np.uint64))
        order = np.lexsort((at, h, owner))
        o, g, a = owner[order], h[order], at[order]
        gap = np.where((g[1:] == g[:-1]) & (o[1:] == o[:-1]), a[1:] - a[:-1], 0)
        first, step, count = repeats(np.where(gap < self.k, gap, 0))
        rows = order[first]
        single = near[rows] & (count == 1)
        link = np.where(single, before[rows] | np.uint64(1), np.uint64(0))
        return owner[rows], h[rows], at[rows], step, count, link

    def classes(self, min_chars: int) -> tuple[np.ndarray, ...]:
        """(index of the text, seed, class, lo, hi, step, count): the stretches of min_chars that start at lo to hi belong to the
        seed; class is the hash of all of them together. Equal classes of one text at one step are one row."""
        n = len(self.hashes) - self.w + 1
        x = np.arange(max(n, 0))
        x = x[x + self.w - 1 <= self.last[x]] if n > 0 else x
        if not len(x):
            none = np.empty(0, np.int64)
            return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
        low = _sliding(self.hashes, self.w, np.minimum, _TOP)[x]
        i = np.searchsorted(self.at, x)
        seed_hash = self.hashes[self.at]
        while (wrong := np.flatnonzero(seed_hash[i] != low)).size:  # the first seed of the window that is its minimum
            i[wrong] += 1
        new = np.concatenate(([True], (i[1:] != i[:-1]) | (x[1:] != x[:-1] + 1)))
        cut_at = np.flatnonzero(new)
        lo, hi = x[cut_at], x[np.concatenate((cut_at[1:] - 1, [len(x) - 1]))]
        h = seed_hash[i[cut_at]]
        c = range_hashes(self.sums, lo, hi + min_chars)
        owner = self.owner[lo]
        order = np.lexsort((lo, c, h, owner))
        o, g, d, a = owner[order], h[order], c[order], lo[order]
        gap = np.where((g[1:] == g[:-1]) & (o[1:] == o[:-1]) & (d[1:] == d[:-1]), a[1:] - a[:-1], 0)
        first, step, count = repeats(np.where(gap <= min_chars, gap, 0))
        rows = order[first]
        return owner[rows], h[rows], c[rows], lo[rows] - self.starts[owner[rows]], hi[rows] - self.starts[owner[rows]], step, count


def repeats(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, step, count) of the stretches of equal gaps above 0 in a sorted list; what has no such gap is a stretch of one.

    Where one stretch ends another may start at the same element.
    """
    run = np.concatenate(([True], gap[1:] != gap[:-1])) if len(gap) else np.empty(0, bool)
    start = np.flatnonzero(run & (gap > 0))
    end = np.flatnonzero(np.concatenate((run[1:], [True])) & (gap > 0)) if len(gap) else start
    alone = np.ones(len(gap) + 1, bool)
    alone[:-1] &= gap == 0
    alone[1:] &= gap == 0
    first = np.concatenate((start, np.flatnonzero(alone)))
    step = np.concatenate((gap[start], np.zeros(alone.sum(), np.int64)))
    count = np.concatenate((end - start + 2, np.ones(alone.sum(), np.int64)))
    return first, step, count


def _pieces(reps: np.ndarray, texts: list[str], overlap: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(rep, offset, text) lists of about BLOCK characters; a longer text comes in pieces that share `overlap` characters, so
    that every window lies in one of them."""
    ids, offsets, parts, size = [], [], [], 0
    for rep, text in zip(reps, texts, strict=True):
        for at in range(0, max(1, len(text) - overlap), BLOCK):
            piece = text[at : at + BLOCK + overlap]
            ids.append(rep)
            offsets.append(at)
            parts.append(piece)
            size += len(piece)
            if size >= BLOCK:
                yield ids, offsets, parts
                ids, offsets, parts, size = [], [], [], 0
    if parts:
        yield ids, offsets, parts


def _blocks(batches: Iterator[pd.DataFrame], k: int, w: int) -> Iterator[tuple[np.ndarray, np.ndarray, Block]]:
    for batch in batches:
        for ids, offsets, parts in _pieces(batch["rep"].to_numpy(), batch["text"].tolist(), k + w - 2):
            yield np.array(ids, np.int64), np.array(offsets, np.int64), Block(parts, k, w)


def _entries(k: int, w: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, offsets, block in _blocks(batches, k, w):
            owner, h, at, step, count, link = block.entries()
            yield pd.DataFrame({"rep": ids[owner], "h": h.view(np.int64), "at": (at + offsets[owner]).astype("int32"), "step": step.astype("int32"), "cnt": count.astype("int32"), "link": link.view(np.int64)})

    return run


def _classes(k: int, w: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, offsets, block in _blocks(batches, k, w):
            owner, h, c, lo, hi, step, count = block.classes(k + w - 1)
            more = offsets[owner]
            yield pd.DataFrame({"rep": ids[owner], "h": h.view(np.int64), "c": c.view(np.int64), "lo": (lo + more).astype("int32"), "hi": (hi + more).astype("int32"), "step": step.astype("int32"), "cnt": count.astype("int32")})

    return run


def _common(a: str, b: str) -> int:
    """Number of characters that both start with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _run_through(a: str, i: int, b: str, j: int, k: int) -> int:
    """Length of the run of both texts around the seeds at i and j; 0 if they differ."""
    if a[i : i + k] != b[j : j + k]:
        return 0
    return _common(a[:i][::-1], b[:j][::-1]) + k + _common(a[i + k :], b[j + k :])


def aligned(a: str, i: int, step_a: int, count_a: int, b: str, j: int, step_b: int, count_b: int, k: int, min_chars: int) -> bool:
    """Whether some place of one entry and some place of the other lie in a run of min_chars."""
    if count_a == count_b == 1:
        return _run_through(a, i, b, j, k) >= min_chars
    if step_a == step_b and min(count_a, count_b) > 1:
        if min(count_a, count_b) * step_a - step_a + k >= min_chars and a[i : i + k] == b[j : j + k]:
            return True  # one stretch of the period lies in the other
        places = [(x, 0) for x in range(count_a)] + [(0, y) for y in range(1, count_b)]  # one for each alignment
    else:
        places = [(x, y) for x in range(count_a) for y in range(count_b)]
    return any(_run_through(a, i + x * step_a, b, j + y * step_b, k) >= min_chars for x, y in places)


def _verify(k: int, min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = (batch[c].tolist() for c in ("text_a", "off_a", "step_a", "kept_a", "text_b", "off_b", "step_b", "kept_b"))
            hit = np.fromiter((aligned(*row, k, min_chars) for row in zip(*columns, strict=True)), bool, len(batch))
            yield batch.loc[hit, ["ra", "rb"]]

    return run


def text_classes(documents: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, rep; texts: rep, text) of the texts that are long enough; rep is the smallest doc_id of a text.

    Only hashes are compared; texts stay where they are, but for the copies, which are left out by their ids.
    """
    long = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select("doc_id", "text")
    keyed = long.select("doc_id", F.xxhash64("text").alias("k1"), F.md5("text").alias("k2"))
    reps = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = cut(keyed.join(reps, ["k1", "k2"]).select("doc_id", "rep").distinct())
    copies = bounded(members.where("doc_id <> rep").select("doc_id"), BROADCAST_ROWS)
    return members, long.join(copies, "doc_id", "left_anti").select(F.col("doc_id").alias("rep"), "text")


def _k(min_chars: int, k: int | None) -> int:
    k = k or max(1, min_chars // 2)  # long seeds hardly meet by chance; the rest of min_chars is the winnowing window
    if not 0 < k <= min_chars:
        raise ValueError("a seed has at most min_chars characters")
    return k


def _in_several(rows: DataFrame) -> DataFrame:
    """Rows whose seed isn't alone, with the parts that their seed is spread over."""
    counts = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    often = counts.select("h", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts"))
    return cut(rows.join(bounded(often, BROADCAST_ROWS), "h"))


def linked_texts(texts: DataFrame, min_chars: int = MIN_CHARS, k: int | None = None) -> DataFrame:
    """ra, rb: two different texts that share a run of at least min_chars code points, ra < rb."""
    k = _k(min_chars, k)
    margin = min_chars - k
    common = _in_several(cut(texts.mapInPandas(_entries(k, margin + 1), "rep long, h long, at int, step int, cnt int, link long")))
    # where all seeds of a hash follow the same seed, every run was met before
    started = common.groupBy("h").agg(F.min("link").alias("l0"), F.max("link").alias("l1")).where("l0 <> l1 OR l0 = 0").select("h")
    common = common.join(bounded(started, BROADCAST_ROWS), "h", "left_semi")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("at", "step", "cnt", "link")]
    left = common.select("h", F.col("rep").alias("ra"), *side("a"), F.pmod(F.xxhash64("rep", "at"), F.col("salts")).cast("int").alias("salt"))
    right = common.select("h", F.col("rep").alias("rb"), *side("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    first = (F.col("link_a") != F.col("link_b")) | (F.col("link_a") == 0)
    pairs = cut(left.join(right, ["h", "salt"]).where((F.col("ra") < F.col("rb")) & first).select("ra", "at_a", "step_a", "cnt_a", "rb", "at_b", "step_b", "cnt_b").distinct())
    ends = [pairs.select(*(F.col(f"{c}{x}").alias(c.strip("_")) for c in ("r", "at_", "step_", "cnt_"))) for x in "ab"]
    needed = ends[0].union(ends[1]).distinct().withColumnRenamed("r", "rep")
    windows = texts.join(bounded(needed, BROADCAST_ROWS), "rep").select("rep", "at", "step", "cnt", *_window(k, margin))
    with_text = pairs
    for x in "ab":
        end = windows.select(F.col("rep").alias(f"r{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("at", "step", "cnt", "off", "kept", "text")))
        with_text = with_text.join(end, [f"r{x}", f"at_{x}", f"step_{x}", f"cnt_{x}"])
    return with_text.mapInPandas(_verify(k, min_chars), "ra long, rb long").distinct()


def _window(k: int, margin: int) -> list:
    """off, kept, text: what surrounds an entry; off is where it starts in that. Of a stretch of very many steps the inner ones
    are left out: those kept have all surroundings that places of it can have."""
    most = (F.floor(F.lit(margin) / F.greatest("step", F.lit(1))) + 2) * 2
    kept = F.least("cnt", most).cast("int")
    off = F.least("at", F.lit(margin))
    half = (kept / 2).cast("int")
    head = F.substr("text", F.col("at") - off + 1, off + half * F.col("step"))
    tail = F.substr("text", F.col("at") + (half + F.col("cnt") - kept) * F.col("step") + 1, (kept - half - 1) * F.col("step") + k + margin)
    return [off.alias("off"), kept.alias("kept"), F.concat(head, tail).alias("text")]


def found(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_a, doc_b: documents whose texts share a run of at least min_chars code points."""
    members, texts = text_classes(documents, min_chars)
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    salts = cut(sizes.select("rep", "n", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts")))
    copies = salts.where("n > 1").select(F.col("rep").alias("ra"), F.col("rep").alias("rb"))
    pairs = linked_texts(texts, min_chars).unionByName(copies)
    placed = members.join(salts, "rep").select("doc_id", "rep", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"))
    for x in "ab":  # the members of a text with very many copies come in parts
        parts = salts.select(F.col("rep").alias(f"r{x}"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias(f"s{x}"))
        pairs = pairs.join(parts, f"r{x}")
    for x in "ab":
        pairs = pairs.join(placed.select(F.col("doc_id").alias(f"d{x}"), F.col("rep").alias(f"r{x}"), F.col("salt").alias(f"s{x}")), [f"r{x}", f"s{x}"])
    once = pairs.where("ra <> rb OR da < db")
    return once.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"))


def shared_stretches(texts: DataFrame, min_chars: int = MIN_CHARS, k: int | None = None) -> DataFrame:
    """rep, s, e: stretches [s, e) of a text that stand in other texts as well, each run of min_chars in one of them."""
    k = _k(min_chars, k)
    rows = cut(texts.mapInPandas(_classes(k, min_chars - k + 1), "rep long, h long, c long, lo int, hi int, step int, cnt int"))
    common = _in_several(rows)
    at_first = [F.min("rep").alias("r0"), F.max("rep").alias("r1"), F.min_by("lo", "rep").alias("lo"), F.min_by("hi", "rep").alias("hi")]
    classes = cut(common.groupBy("h", "c").agg(*at_first))
    whole = classes.where("r0 <> r1").select("h", "c", F.lit(0).alias("t0"), (F.col("hi") - F.col("lo")).alias("t1"))
    # a class of one text may share some of its stretches with other classes of its seed
    split = classes.groupBy("h").agg(F.count("*").alias("n"), F.min("r0").alias("m0"), F.max("r1").alias("m1"), F.max(F.col("r0") == F.col("r1")).alias("open")).where("n > 1 AND m0 <> m1 AND open").select("h")
    asked = classes.join(split, "h", "left_semi").select(F.col("r0").alias("rep"), "r1", "h", "c", "lo", "hi")
    inside = F.substr("text", F.col("lo") + 1, F.col("hi") - F.col("lo") + min_chars)
    grams = F.transform(F.array(inside), lambda x: F.transform(F.sequence(F.lit(0), F.col("hi") - F.col("lo")), lambda t: F.struct(t.alias("t"), F.xxhash64(F.substr(x, t + 1, F.lit(min_chars))).alias("g"))))
    each = texts.join(bounded(asked, BROADCAST_ROWS), "rep").select("rep", "r1", "h", "c", F.explode(F.element_at(grams, 1)).alias("x"))
    each = cut(each.select("rep", "r1", "h", "c", "x.t", "x.g"))
    twice = each.groupBy("h", "g").agg(F.min("rep").alias("m0"), F.max("r1").alias("m1")).where("m0 <> m1").select("h", "g")
    hits = each.where("rep = r1").join(twice, ["h", "g"], "left_semi")
    # starts that follow each other are one stretch; a class has at most as many as the winnowing window
    start = F.array().cast("array<struct<t0:int,t1:int>>")
    fold = F.aggregate(F.sort_array("ts"), start, lambda acc, t: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["t1"] == t - 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["t0"].alias("t0"), t.alias("t1"))))).otherwise(F.concat(acc, F.array(F.struct(t.alias("t0"), t.alias("t1"))))))
    parts = hits.groupBy("h", "c").agg(F.collect_set("t").alias("ts")).select("h", "c", F.explode(fold).alias("x")).select("h", "c", "x.t0", "x.t1")
    told = whole.unionByName(parts)
    return common.join(told, ["h", "c"]).select("rep", (F.col("lo") + F.col("t0")).alias("s"), (F.col("lo") + F.col("t1") + (F.col("cnt") - 1) * F.col("step") + min_chars).alias("e"))


def shared_report(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_chars, shared_chars, shared_share, copies: how much of each document stands in other documents."""
    members, texts = text_classes(documents, min_chars)
    # union of intervals: per start only the farthest end matters, which bounds a text's rows by its length
    longest = shared_stretches(texts, min_chars).groupBy("rep", "s").agg(F.max("e").alias("e"))
    intervals = F.array_sort(F.collect_list(F.struct("s", "e")))
    start = F.struct(F.lit(0).alias("covered"), F.lit(-1).alias("end"))
    fold = F.aggregate(F.col("i"), start, lambda acc, x: F.struct((acc["covered"] + F.greatest(x["e"] - F.greatest(x["s"], acc["end"]), F.lit(0))).alias("covered"), F.greatest(acc["end"], x["e"]).alias("end")))
    covered = longest.groupBy("rep").agg(intervals.alias("i")).select("rep", fold["covered"].alias("covered"))
    copies = members.groupBy("rep").agg((F.count("*") - 1).alias("copies"))
    per = members.join(copies, "rep").join(covered, "rep", "left").select("doc_id", "copies", "covered")
    all_docs = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).dropDuplicates(["doc_id"])
    shared = F.when(F.col("copies") > 0, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    out = all_docs.join(per, "doc_id", "left").select("doc_id", "n_chars", shared.cast("int").alias("shared_chars"), F.coalesce("copies", F.lit(0)).alias("copies"))
    return out.withColumn("shared_share", F.round(F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)), 6))
