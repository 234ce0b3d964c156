import numpy as np
import pytest
from pyspark.sql import functions as F

from drillmill.llm import pii, pii_train


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.Crf.load(), pii.read_lexicon())


CASES = [
    ("Guardian of Isabella Haskfield called back at 845 555 0130 ext. 66 after the drill. ph 518-555-0103", [("PERSON_NAME", "Isabella Haskfield"), ("PHONE", "845 555 0130 ext. 66"), ("PHONE", "518-555-0103")]),
    ("Sent file for CIN AH24074W to thomas.tevini@nightline.test by mistake.", [("ID_NUMBER", "AH24074W"), ("EMAIL", "thomas.tevini@nightline.test")]),
    ("Contact for repairs: (518)555-0192 / kesoff_amara at firesafe dot invalid", [("PHONE", "(518)555-0192"), ("EMAIL", "kesoff_amara at firesafe dot invalid")]),
    ("Orin Lunström's hearing aid was off; strobe moved closer.", [("PERSON_NAME", "Orin Lunström")]),
    ("told ada lunner to use the ramp, not the steps", [("PERSON_NAME", "ada lunner")]),
    ("KATHERINE PELLHOLT LEFT BY THE WRONG DOOR.", [("PERSON_NAME", "KATHERINE PELLHOLT")]),
    ("Ms. Draylish held the front door.", [("PERSON_NAME", "Draylish")]),
    ("Bus took all to 1109 Corardbrook Terr #1 for an hour.", [("STREET_ADDRESS", "1109 Corardbrook Terr #1")]),
    ("Valentina Bexlow, SSN 911 252619, was away with family.", [("PERSON_NAME", "Valentina Bexlow"), ("ID_NUMBER", "911 252619")]),
    ("Staff swept Fern Wing and Oak Lounge before leaving. Invoice 640348 for Harbor Lock and Key filed.", []),
    ("Part no. 20259267-18 on back order. Monitoring account 2989 was in test until 9:40.", []),
    ("", []), (None, []), ("NA", []), ("   ", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_find(tagger, text, want):
    assert [(k, text[a:b]) for k, a, b in tagger.find(text)] == want


def test_redact(tagger):
    t = "Left message, (518) 555-0195. Signed: O. Yelez."
    assert pii.redact(t, tagger.find(t)) == "Left message, [PHONE]. Signed: [PERSON_NAME]."


PLAIN = [
    ("Deshawn Carter called Brian about the bus.", {"Deshawn Carter", "Brian"}),
    ("Spoke with Liam O'Connor at noon.", {"Liam O'Connor"}),
    ("Her passport X1234567 is in the safe.", {"X1234567"}),
    ("Ambulance came at 4:10 and left again.", set()),
]


@pytest.mark.parametrize(("text", "want"), PLAIN)
def test_plain_sentences(tagger, text, want):
    assert {text[a:b] for _, a, b in tagger.find(text)} == want


def test_held_out_patterns(tagger):
    assert not set(pii_train.split_patterns(pii_train.POSITIVE, True)) & set(pii_train.split_patterns(pii_train.POSITIVE, False))
    for kind, (right, found, there) in pii_train.score(tagger, pii_train.sample(600, 99, held_out=True)).items():
        assert right / there >= 0.9, kind
        assert right / found >= 0.85, kind


def test_training_learns():
    lexicon = pii.read_lexicon()
    crf = pii_train.train([pii_train.labelled(*x, lexicon) for x in pii_train.sample(300, 5)])
    _, found, there = pii_train.score(pii.Tagger(crf, lexicon), pii_train.sample(100, 6))["EMAIL"]
    assert 0 < found < 2 * there


def test_long_text_is_labelled_whole(tagger):
    t = "Horn sounded on 3 floors. " * 4000 + "Call 518-555-0102 if the panel beeps again."
    assert [(k, t[a:b]) for k, a, b in tagger.find(t)] == [("PHONE", "518-555-0102")]


def test_skip_edges_carry_labels():
    """A doubtful mention follows a sure one of the same name in another text of the form; without skip edges it doesn't."""
    n, name = pii.N, pii.LABELS.index("B-PERSON_NAME")
    bias, sure, doubtful = np.zeros(n), np.zeros(n), np.zeros(n)
    bias[0], sure[name], doubtful[name] = 1.0, 8.0, 0.8
    crf = pii.Crf({"b": bias, "w<?>": doubtful, "pmr": sure}, np.zeros((n, n)))
    texts = ["met mr Zorbekk", "Zorbekk left"]
    names = lambda skip: [[t[a:b] for _, a, b in spans] for t, spans in zip(texts, pii.Tagger(crf, {"mr": "l", "met": "l", "left": "l"}, skip).find_all(texts), strict=True)]
    assert names(0.0)[1] == []
    assert names(pii.SKIP)[1] == ["Zorbekk"]


def test_short_forms_are_one_mention(tagger):
    assert tagger._key("Gerry") == tagger._key("Gerald")
    assert tagger._key("Table") is None and tagger._key("and") is None


def test_marginals_sum_to_one(tagger):
    _, feats = pii.features("Mr. Marard held the door.", tagger.lexicon)
    assert np.allclose(tagger.crf.marginals(tagger.crf.unary(feats)).sum(1), 1.0)


def test_forms(make_forms):
    text, other = pii.TEXTS
    forms = make_forms({"form_id": 1, text: "ph 518-555-0103. Call 518-555-0103 if the panel beeps again.", pii.LIST: [None, "walked on own; Signed: H. Nimry.", "NA"]}, {"form_id": 2, other: "Nothing to fix this time."}, {"form_id": 3}).withColumn("span", F.lit(1))
    got = sorted(tuple(r) for r in pii.found(forms.unionByName(forms)).collect())
    assert got == [(1, text, 0, "PHONE", "518-555-0103"), (1, pii.LIST, 2, "PERSON_NAME", "H. Nimry")]
    clean = {r.form_id: r for r in pii.redacted(forms).collect()}
    assert clean[1][pii.LIST] == [None, "walked on own; Signed: [PERSON_NAME].", "NA"]
    assert clean[2][other] == "Nothing to fix this time."
    assert pii.found(forms.where("1 = 0")).count() == 0


@pytest.mark.parametrize("number", ["+15185550123", "15185550123", "1518-555-0123", "1518555-0123", "15550123", "1 518 555 0123", "518-555-0123", "0123456"])
def test_masked_digits_keep_features(number):
    text = f"call {number} now"
    assert pii.features(pii._NUMBER.sub(pii._mask, text), {}) == pii.features(text, {})
