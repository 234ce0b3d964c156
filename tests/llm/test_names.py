import pytest

from drillmill.llm import names

LINKS = [
    (["Bexholt, Elizabeth", "C. Brinison", "Ursula Jurbury"], ["Bexholt, Elizabeth", "C. Brinisin", "Ursula J."], {("C. Brinisin", "C. Brinison"), ("Ursula J.", "Ursula Jurbury")}),
    (["M. Cadholt", "Dorothy Zanquist", "Haskmond, Gerald"], ["Cadholt Margaret ok", "D. Zanquisst - yes", "Gerald H. - yes"], {("Cadholt Margaret ok", "M. Cadholt"), ("D. Zanquisst - yes", "Dorothy Zanquist"), ("Gerald H. - yes", "Haskmond, Gerald")}),
    (["Harold Pellenko", "Ursula Drayfield"], ["Hal", "UMD"], {("Hal", "Harold Pellenko"), ("UMD", "Ursula Drayfield")}),
    (["V. Doreau"], ["Ginny Doreau 4:10"], {("Ginny Doreau 4:10", "V. Doreau")}),
    (["Ada Yellow", "Bo Green"], ["Y", "yes"], set()),
    (["Ada Yellow"], ["3:40", "relief staff x2", "NA", "", "1 visitor"], set()),
    (["Ann Lee", "Amy Lee"], ["A. Lee"], set()),  # fits both, and the lists differ in length
    (["Ann Lee", "Amy Lee"], ["NA", "A. Lee"], {("A. Lee", "Amy Lee")}),
    (["Zachary Lunfield", "L. Lunfield"], ["Z. Lunfield", "L. Lunfield"], {("Z. Lunfield", "Zachary Lunfield")}),
    (["Michael Cadholt", "Margaret Cadholt"], ["Margaret Cadholt", "Mike C."], {("Michael Cadholt", "Mike C.")}),
    (["Robert Haskfield"], ["Bob Haskfield", "R. Haskfield"], {("Bob Haskfield", "Robert Haskfield"), ("R. Haskfield", "Robert Haskfield")}),
    (["Nathaniel Orr", "Jennifer Poe"], ["Nate Orr", "Jen P."], {("Nate Orr", "Nathaniel Orr"), ("Jen P.", "Jennifer Poe")}),
    (["Bo Wolfeschlegelsteinhausenbergerdorffwelchevoralternw"], ["B. Wolfeschlegelsteinhausenbergerdorfwelchevoralternw"], {("B. Wolfeschlegelsteinhausenbergerdorfwelchevoralternw", "Bo Wolfeschlegelsteinhausenbergerdorffwelchevoralternw")}),
    ([], ["x"], set()),
    (["", "NA"], [], set()),
]


def test_residents(make_forms):
    forms = make_forms(*({"form_id": i, names.RESIDENTS: r, names.SAFE: e} for i, (r, e, _) in enumerate(LINKS)))
    got = {i: set() for i in range(len(LINKS))}
    for r in names.person_pairs(forms.unionByName(forms)).collect():
        assert (r.name_a, r.name_b) not in got[r.form_id]
        got[r.form_id].add((r.name_a, r.name_b))
    for i, (_, _, want) in enumerate(LINKS):
        assert got[i] == {(min(p), max(p)) for p in want}, LINKS[i]


def test_slip_words_make_the_forms_with_slips():
    for text in ("Orin P. Thalison", "Solrin, Priya", "OPT", "Cher", "H. Elldane", "Kate Marner-Lowe", "x" * 60 + " Bo"):
        p = names.Person(text)
        slips = {form for kind, word, _ in names.slip_words(p) for form in names._slip_forms(kind, word)}
        assert slips | names.rewritings(p, False).keys() == names.rewritings(p).keys()


def test_rare_forms_say_more(spark):
    people = spark.createDataFrame([("Ann Lee", 900), ("Bo Quillfeather", 1), ("Al Lee", 80)], "text string, n long")
    bits = {r.key: r.bits for r in names.rarity(people).collect()}
    assert bits[names.key_of("l:quillfeather")] > bits[names.key_of("l:lee")]


def test_nicknames():
    for short, long in (("Nate", "Nathaniel"), ("Jen", "Jennifer"), ("Becky", "Rebecca")):
        assert names.rewritings(names.Person(f"{short} Orr")).keys() & {f"gl:{long.lower()}|orr"}


@pytest.mark.parametrize(
    ("text", "code", "stem"),
    [("Dorornock Residential Services", "rs", "dorornock"), ("Residential Svcs (Kelqrmoor)", "rs", "kelqrmoor"), ("Family Supports of Mavabley", "fs", "mavabley"), ("Falun Nock Living Alts", "la", "falunnock"), ("Dorornock R.S.", "rs", "dorornock"), ("The Mavidland Cr Netwk, Inc.", "cn", "mavidland"), ("Wexithstead agency", "", "wexithstead"), ("Willoholm Support Agcy", "sa", "willoholm"), ("NORUNLOCK CARE NETOWRK", "cn", "norunlock")],
)
def test_agency_readings(text, code, stem):
    assert (code, stem) in names.agency_readings(text)


def test_found(make_forms):
    agency = names.AGENCY
    spell = ["Dorornock Residential Services"] * 6 + ["Doronrock Res Svc", "Dorornock R.S.", "Dorornock", "the dorornock residential services inc", "Dorornock Family Supports", None, "NA", "Pemberrow Family Supports", "Pemberrow FS"]
    forms = make_forms(*({"form_id": i, agency: t, names.RESIDENTS: ["Ann Lee", None], names.SAFE: ["Lee, Ann", None]} for i, t in enumerate(spell)))
    rows = [tuple(r) for r in names.found(forms.unionByName(forms)).collect()]
    assert len(rows) == len(set(rows))
    pairs = {r[2:] for r in rows if r[0] == "agency"}
    assert ("Doronrock Res Svc", "Dorornock Residential Services") in pairs
    assert ("Dorornock R.S.", "the dorornock residential services inc") in pairs
    assert ("Pemberrow FS", "Pemberrow Family Supports") in pairs
    assert not any("Dorornock Family Supports" in p for p in pairs)
    assert not any("Dorornock" in p for p in pairs)  # of two organisations of that stem it tells neither
    assert all(a < b for a, b in pairs)
    assert sum(r[0] == "person" for r in rows) == len(spell)
    assert names.found(forms.where("1 = 0")).count() == 0


def test_counts_do_not_decide(make_forms):
    for more, less in ((3, 2), (5, 2), (1, 1)):
        spell = ["Dorornock Residential Services"] * more + ["Dorornok Residential Services"] * less + ["x" * 45 + " Care Network", "x" * 20 + "y" + "x" * 25 + " Care Network"]
        pairs = {(r.name_a, r.name_b) for r in names.agency_pairs(make_forms(*({"form_id": i, names.AGENCY: t} for i, t in enumerate(spell)))).collect()}
        assert ("Dorornock Residential Services", "Dorornok Residential Services") in pairs
        assert len(pairs) == 2


def test_type_words():
    assert names.abbreviates("svcs", "services") and names.abbreviates("agcy", "agency") and not names.abbreviates("svcs", "supports") and not names.abbreviates("s", "services")
    assert "developmental" in names._type_words("devel") and "network" in names._type_words("netowrk")


def test_salts(make_forms, monkeypatch):
    from drillmill.llm import joins

    monkeypatch.setattr(joins, "PER_SALT", 2)
    spell = [f"Dorornock {w} Services" for w in ("Residential", "residential", "RESIDENTIAL", "Resid", "Res", "Res.", "resid")]
    pairs = [(r.name_a, r.name_b) for r in names.agency_pairs(make_forms(*({"form_id": i, names.AGENCY: t} for i, t in enumerate(spell)))).collect()]
    assert len(pairs) == len(set(pairs)) == 21


def test_slips_of_similar_counts(make_forms):
    spell = ["Ibettnnock Supp Agcy", "Ibettnock Support Agency", "Kelqrmoor Care Network", "Kelqrmor Care Network", "Kelqrmoor Care Netwk"]
    forms = make_forms(*({"form_id": i, names.AGENCY: t} for i, t in enumerate(spell)))
    pairs = {(r.name_a, r.name_b) for r in names.agency_pairs(forms).collect()}
    assert pairs == {(spell[0], spell[1])} | {(a, b) for a in spell[2:] for b in spell[2:] if a < b}
