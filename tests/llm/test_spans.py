import random
from collections import defaultdict

import numpy as np
import pytest

from drillmill.llm import spans


def brute(rows, n):
    grams = defaultdict(set)
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            grams[t[k : k + n]].add(i)
    return {(a, b) for ids in grams.values() for a in ids for b in ids if a < b}


def texts(seed, count=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh é火") for _ in range(rnd.randint(50, 400)))
    rows = [(i, word()) for i in range(count)]
    for i in range(count, count * 2):
        a, b = rnd.choice(rows)[1], rnd.choice(rows)[1]
        cut = rnd.randint(0, len(a))
        rows.append((i, word()[: rnd.randint(0, 60)] + a[cut : cut + rnd.randint(20, 130)] + "|" + b[: rnd.randint(0, 130)]))
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, ""), (903, None), (904, "x")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_a, r.doc_b) for r in spans.found(docs, 60).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 60)


def test_exact_length_matters(spark):
    run = "".join(chr(97 + (i * i) % 26) for i in range(200))
    rows = [(1, "AAA" + run), (2, run + "BBB"), (3, "C" + run[1:]), (4, run[:-1] + "D")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_a, r.doc_b) for r in spans.found(docs).collect()} == brute(rows, 200)


def test_periods(spark):
    rows = [(1, "ab" * 1000), (2, "xy" + "ab" * 150 + "zz"), (3, "q" * 5000), (4, "r" + "q" * 250), (5, "q" * 199), (6, "q" * 100 + "w" * 150), (7, "v" + "q" * 100 + "w" * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_a, r.doc_b) for r in spans.found(docs).collect()} == brute(rows, 200)


def test_report(spark):
    run = "".join(chr(97 + (i * 7 + i * i) % 26) for i in range(300))
    rows = [(1, "A" * 100 + run), (2, run + "B" * 300), (3, "alone" * 10), (4, None), (5, run + "C"), (6, run + "C"), (6, run + "C")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_chars, r.shared_chars, r.copies, r.shared_share) for r in spans.shared_report(docs).collect()}
    assert got[1] == (400, 300, 0, 0.75)
    assert got[2] == (600, 300, 0, 0.5)
    assert got[3][1:] == (0, 0, 0.0)
    assert got[4] == (0, 0, 0, 0.0)
    assert got[5] == got[6] == (301, 301, 1, 1.0)


def test_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "x" * 10)], "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("h", F.lit("a"))
    assert spans.found(docs).count() == 0
    assert spans.found(docs.where("1 = 0")).count() == 0
    assert spans.shared_report(docs.where("1 = 0")).count() == 0


def test_winnow_covers_every_window():
    rnd = np.random.default_rng(3)
    for n in (1, 5, 51, 200, 1000):
        h = rnd.integers(0, 40, n).astype(np.uint64)
        at = set(spans.winnow(h, 7).tolist())
        for s in range(max(1, n - 6)):
            w = h[s : s + 7]
            assert any(s + k in at and w[k] == w.min() for k in range(len(w)))


def test_blocks_are_like_single_texts():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abc é") for _ in range(rnd.randint(60, 300))) for _ in range(30)] + ["x" * 200, "ab" * 80]
    for of in (lambda b: b.seeds(), lambda b: b.entries(), lambda b: b.classes(60)):
        together = of(spans.Block(texts, 40, 21))
        for i, t in enumerate(texts):
            alone = of(spans.Block([t], 40, 21))
            rows = lambda parts, owner: sorted(zip(*(p[owner].tolist() for p in parts[1:]), strict=True))
            assert rows(together, together[0] == i) == rows(alone, alone[0] == 0)
    owner, _, at, step, count, _ = spans.Block(texts, 40, 21).entries()
    assert [(int(a), int(s), int(c)) for a, s, c in zip(at[owner == 30], step[owner == 30], count[owner == 30], strict=True)] == [(0, 1, 161)]


def test_classes_hold_every_stretch_once():
    rnd = random.Random(6)
    for text in ["".join(rnd.choice("ab") for _ in range(300)), "ab" * 100, "x" * 150, "abc" * 20]:
        _, _, _, lo, hi, step, count = spans.Block([text], 12, 19).classes(30)
        starts = [x + j * s for a, b, s, c in zip(lo, hi, step, count, strict=True) for j in range(c) for x in range(a, b + 1)]
        assert set(starts) == set(range(len(text) - 29))


def test_long_texts_come_in_pieces(spark, monkeypatch):
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcdefgh") for _ in range(9000))
    got = list(spans._pieces([1, 2], [long, "short"], 198))
    monkeypatch.setattr(spans, "BLOCK", 1000)
    pieces = [(i, o, t) for ids, offs, parts in spans._pieces([1, 2], [long, "short" * 50], 198) for i, o, t in zip(ids, offs, parts)]
    assert len(got) == 1
    assert {i for i, _, _ in pieces} == {1, 2}
    assert all(long[o : o + len(t)] == t for i, o, t in pieces if i == 1)
    assert {s // 1 for s in range(9000 - 199)} <= {s for i, o, t in pieces if i == 1 for s in range(o, o + len(t) - 198)}


def shifted_periods(seed, count, periods, sizes):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(p)) for p in periods]
    rows = []
    for i in range(count):
        text = ""
        for _ in range(rnd.randint(1, 2)):
            word, at = rnd.choice(words), rnd.randint(0, 59)
            text += "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 40))) + (word * 40)[at : at + rnd.randint(*sizes)]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_shifted_periods(spark, seed):
    rows = shifted_periods(seed, 120, (1, 30, 37, 45, 60), (195, 320))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_a, r.doc_b) for r in spans.found(docs).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 200)


@pytest.mark.parametrize("seed", [5, 6])
def test_random_periods(spark, seed):
    rows = shifted_periods(seed, 150, (20, 67, 80, 99, 100, 101, 118), (195, 420))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_a, r.doc_b) for r in spans.found(docs).collect()} == brute(rows, 200)


def covered(rows, n):
    """Characters of each text that lie in a stretch of n that another, different text has."""
    grams = defaultdict(set)
    for _, t in rows:
        for x in range(len(t) - n + 1):
            grams[t[x : x + n]].add(t)
    return {i: len({x + y for x in range(len(t) - n + 1) if len(grams[t[x : x + n]]) > 1 for y in range(n)}) for i, t in rows}


@pytest.mark.parametrize("seed", [1, 7])
def test_report_against_brute_force(spark, seed):
    rows = [r for r in texts(seed) if r[1]][:-3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.shared_chars for r in spans.shared_report(docs, 60).collect()} == covered(rows, 60)
    rows = shifted_periods(seed, 60, (1, 30, 67, 100), (195, 420))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.shared_chars for r in spans.shared_report(docs).where("copies = 0").collect()} == {i: n for i, n in covered(rows, 200).items() if sum(t == dict(rows)[i] for _, t in rows) == 1}


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(spans, "PER_SALT", 3)
    run = "".join(chr(97 + (i * i) % 26) for i in range(250))
    rows = [(i, run) for i in range(10)] + [(i, f"{i}" + run + "|" * i) for i in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_a, r.doc_b) for r in spans.found(docs).collect()]
    assert len(got) == len(set(got)) == 190
    monkeypatch.setattr(spans, "BROADCAST_ROWS", 0)
    assert {(r.doc_a, r.doc_b) for r in spans.found(docs).collect()} == set(got)


def test_steps_without_a_common_period():
    """One seed of 8 that recurs at 5 in one text and at 7 in the other: every two places are tried."""
    a, b = "abababba" * 3, "zz" + "abababba" * 2
    want = any(spans._run_through(a, i, b, j, 8) >= 16 for i in (0, 8, 16) for j in (2, 10))
    assert want
    assert spans.aligned(a, 0, 8, 3, b, 2, 8, 2, 8, 16)
    assert spans.aligned(a, 0, 8, 3, b, 10, 0, 1, 8, 10)
    assert not spans.aligned("q" + a[:8] + "r", 1, 0, 1, "s" + a[:8] + "t", 1, 0, 1, 8, 9)
