import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drillmill.llm import tokenizer as T

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return T.read_ranks(open(T.VOCABULARY, "rb").read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return T.Encoder(ranks)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["ab", "the", "ing", " ", "  ", "\n", "é", "火", "🙂", "1", "23", "aaaa", "zxq", "____", "'s", "<|endoftext|>", "\t"]), max_size=40))
def test_mixed_pieces(encoder, reference, pieces):
    text = "".join(pieces)
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert "".join(T.decode_stream(encoder.machine.bytes, ids)) == text


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "=" * 2000, "abcab" * 2000, "0" * 1000])
def test_very_long_words(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


def test_states_are_dropped_and_made_again(ranks, reference, monkeypatch):
    monkeypatch.setattr(T, "MAX_STATES", 50)
    monkeypatch.setattr(T, "MAX_WORDS", 20)
    e = T.Encoder(ranks)
    text = " ".join(f"word{i} uncommon{i * 7}" for i in range(300))
    assert e.encode(text) == reference.encode_ordinary(text)


def test_utf8_machine():
    m = T.Utf8Machine()
    data = "aé火🙂".encode()
    assert "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.close() == "aé火🙂"
    assert m.feed(b"\xf0\x9f") == ""
    assert m.close() == "�"
    assert T.Utf8Machine().feed(b"\xffa") == "�a"


def test_documents(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (1, "Hello world")], "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("n_tokens", F.lit("x"))
    got = [(r.doc_id, r.ids) for r in T.encode_documents(docs).collect()]
    assert got == [(1, [15496, 995]), (2, []), (3, []), (1, [15496, 995])]
    assert all(r.restored for r in T.round_trip(docs).collect())
    assert T.encode_documents(docs.where("1 = 0")).count() == 0
