import pytest
from pyspark.sql import functions as F

from drillmill.llm import addresses as A

PARSED = [
    ("1005 Kelunmoor Av apartment 4B, Fort Wrenpoint NY 00381", ("1005", "kelunmoor", None, "avenue", "4b", "fort wrenpoint", "00381")),
    ("ularadle boulevard 1468, pinewold, n.y.", ("1468", "ularadle", None, "boulevard", None, "pinewold", None)),
    ("#147 Loringleigh Drive,Larchsedge NY", ("147", "loringleigh", None, "drive", None, "larchsedge", None)),
    ("Apt 1C, 249 Melumrise Terrace, Ft. Cobblewold, New York", ("249", "melumrise", None, "terrace", "1c", "fort cobblewold", None)),
    ("Heron  Home - 1475 Holunham Crt,Mount Cranecross, N.Y.", ("1475", "holunham", None, "court", None, "mount cranecross", None)),
    ("1071 OLELSIDE LN (CEDAR COTTAGE); LARCHBRIDGE 00131-2071", ("1071", "olelside", None, "lane", None, "larchbridge", "00131")),
    ("No. 856 W Pemunvale St.; Mount Stonewold", ("856", "pemunvale", "w", "street", None, "mount stonewold", None)),
    ("SELUNTREE #1152, FT WRENPOINT", ("1152", "seluntree", None, None, None, "fort wrenpoint", None)),
    ("96 Lamlomarch Road #4C, East Cranebank", ("96", "lamlomarch", None, "road", "4c", "e cranebank", None)),
    ("1018 Golloham", ("1018", "golloham", None, None, None, None, None)),
]


@pytest.mark.parametrize(("text", "want"), PARSED)
def test_parse(text, want):
    p = A.parse_address(text)
    assert tuple(p[k] for k in ("number", "street", "dir", "type", "unit", "town", "zip")) == want


@pytest.mark.parametrize("text", ["see cover sheet", "NA", "", "   ", "Elm Street", "12345", "12"])
def test_no_address(text):
    assert A.parse_address(text) is None


def test_streets_of_several_words():
    p = A.parse_address("12 Old Mill Road, Albany")
    assert (p["street"], p["type"], p["town"]) == ("oldmill", "road", "albany")
    p = A.parse_address("12 Elm St Albans")
    assert (p["street"], p["town"]) == ("elm", "albans")


def test_settle():
    w = [(None, "avenue", "1a"), (None, "avenue", None), (None, None, None), (None, "road", None), (None, "avenue", "2b"), (None, None, "2b")]
    got = A.settle(w)
    assert got[0] != got[4] != got[3]
    assert got[1] == -1  # two units
    assert got[2] == -1
    assert got[5] == got[4]
    assert A.settle([(None, "avenue", None), (None, None, "3c")]) == [0, 0]  # they complete each other


def found(make_forms, texts):
    forms = make_forms(*({"form_id": i, A.ADDRESS: t} for i, t in enumerate(texts)))
    return {(r.form_a, r.form_b) for r in A.found(forms).collect()}


def test_counts_do_not_decide(make_forms):
    for more, less in ((2, 1), (4, 1)):
        pairs = found(make_forms, ["12 Elmgate Road, Pinewold"] * more + ["12 Elmgate Road, Pinewolt"] * less)
        assert pairs == {(a, b) for a in range(more) for b in range(more, more + less)}


def test_missing_localities(make_forms):
    texts = ["12 Elmgate Road, Pinewold", "12 Elmgaet Rd", "7 Oakmont Lane, Pinewold", "7 Oakmont Lane, Ashford", "7 Oakmont", "9 Larkspur Way", "9 Larskpur Wy", "31 Quinormore Lane, Ashford", "31 quinnoromre ln"]
    assert found(make_forms, texts) == {(0, 1), (5, 6), (7, 8)}
    long = "Llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogogoch"
    assert found(make_forms, [f"3 {long} Road, Ashford", f"3 {long[:20]}{long[21:]} Road, Ashford"]) == {(0, 1)}


def test_chains_of_spellings(make_forms):
    word = "abcdefghijklmnop"
    chain = [word + "zy" * k for k in range(6)]  # two letters more each
    texts = [f"12 {t} Road, Ashford" for t in chain]
    assert len(found(make_forms, texts)) == 15


def test_found(make_forms):
    site = A.ADDRESS
    rows = ["10 Elmgate Avenue, Ashford NY 00101"] * 3 + ["10 Elmgate Ave., 00101", "10 Elmgaet Avenue, Ashford", "10 elmgate", "10 Elmgate Road, Ashford", "10 Elmgate Avenue, Ashbridge", "11 Elmgate Avenue, Ashford", "20 Oakmont Lane Apt 2B, Ashford", "Oakmont Ln 20, Unit 2-B", "20 Oakmont Lane #3, Ashford", "20 Oakmont Lane", "see cover sheet", None, "NA"]
    forms = make_forms(*({"form_id": i, site: t} for i, t in enumerate(rows))).withColumn("place", F.lit(1)).withColumn("n", F.lit(1))
    got = {(r.form_a, r.form_b) for r in A.found(forms.unionByName(forms)).collect()}
    same = {0, 1, 2, 3, 4}
    want = {(a, b) for a in same for b in same if a < b and rows[a] != rows[b]} | {(9, 10)}
    assert got == want
    assert {r.form_id for r in A.open_addresses(forms).collect()} == {5, 12}
    assert A.found(forms.where("1 = 0")).count() == 0


def test_saint_or_street(make_forms):
    rows = ["148 Tolumfield Road, Saint Cranefold", "12 Oak Lane, St. Cranefold", "148 TOLUMFIELD ST. CRANEFOLD", "9 Elm St Ashford", "9 Elm Street, Ashford", "Mt. Otterburn Juniper Cottage, 1301 Brenevvale St.", "1301 Brenevvale Street, Mount Otterburn"]
    forms = make_forms(*({"form_id": i, A.ADDRESS: t} for i, t in enumerate(rows)))
    assert {(r.form_a, r.form_b) for r in A.found(forms).collect()} == {(0, 2), (3, 4), (5, 6)}


def test_localities_of_similar_counts(make_forms):
    texts = ["Otercross, 1110 Hurelridge Avenue", "1110 Hurelridge Av Ottercross, N.Y.", "1110 Hurelridge Avenue, Pinewold"]
    forms = make_forms(*({"form_id": i, A.ADDRESS: t} for i, t in enumerate(texts)))
    assert {(r.form_a, r.form_b) for r in A.found(forms).collect()} == {(0, 1)}
