import pytest
from pyspark.sql import functions as F

from drillmill.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def docs(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("id") % 37 + 5).cast("int")), lambda i: F.concat(F.lit("word"), i.cast("string"), F.lit("x"), F.col("id").cast("string"))), " ")
    source = F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small")
    return spark.range(3000).select(F.col("id").alias("doc_id"), words.alias("text"), source.alias("source"))


def shares(df):
    return {r.source: r for r in df.collect()}


def test_shares_are_met(spark, docs):
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 2), ("small", 0.2, 4)], TARGETS)
    copies, report = mixing.mix(docs, targets)
    got = shares(report)
    assert all(r.met for r in got.values())
    assert all(abs(r.reached_share - r.target_share) < 0.003 for r in got.values())
    assert copies.join(targets, "source").where("copies > max_repeats").count() == 0
    rows = mixing.mixed_rows(docs, targets)
    assert rows.groupBy("doc_id", "copy_no").count().where("count > 1").count() == 0
    assert rows.agg(F.sum("n_tokens")).first()[0] == sum(r.tokens for r in got.values())


def test_unreachable_target_is_reported(spark, docs):
    targets = spark.createDataFrame([("big", 0.1, 1), ("small", 0.8, 2), ("absent", 0.1, 3)], TARGETS)
    got = shares(mixing.mix(docs, targets, total_tokens=100_000)[1])
    assert not got["small"].met
    assert got["small"].tokens == 2 * got["small"].available_tokens
    assert (got["absent"].tokens, got["absent"].met) == (0, False)
    assert abs(got["big"].tokens - 10_000) < 300


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "some words", "a"), (3, "some words", "a"), (4, "more words here", None), (5, "other", "b"), (None, "x", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("cap", F.lit(9)).withColumn("w", F.lit("x"))
    targets = spark.createDataFrame([("a", 1.0, 3)], TARGETS)
    assert [(r.doc_id, r.copies) for r in mixing.mix(docs, targets)[0].collect()] == [(3, 3)]
    copied = docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(2).cast("long")))
    assert [(r.doc_id, r.copies) for r in mixing.mix(copied, targets)[0].collect()] == [(2, 3)]  # one text under two ids
    assert mixing.mix(docs.where("1 = 0"), targets)[0].count() == 0
    assert shares(mixing.mix(docs.where("1 = 0"), targets)[1])["a"].tokens == 0
    assert mixing.mixed_rows(docs, targets.where("1 = 0")).count() == 0


def test_rates_prefer_short_texts_when_down(spark, docs):
    tokens = mixing.token_table(docs.where("source = 'big'"))
    have, n = tokens.agg(F.sum("n_tokens"), F.count("*")).first()
    plan = {"big": {"cap": 1, "have": have, "target": have / 2, "scale": have / n}}
    tilt = mixing.solve_rates(tokens, plan)
    rated = mixing._with(tokens, {"big": {"tilt": tilt["big"], "cap": 1, "scale": have / n}}).withColumn("w", mixing._rate())
    assert tilt["big"] < 0
    assert rated.agg(F.sum(F.col("w") * F.col("n_tokens"))).first()[0] == pytest.approx(have / 2, rel=1e-3)


def test_two_targets_of_a_source(spark, docs):
    targets = spark.createDataFrame([("big", 0.4, 1), ("big", 0.4, 2)], TARGETS)
    with pytest.raises(ValueError, match="two targets"):
        mixing.mix(docs, targets)


def test_unmet_targets_of_real_texts(spark, small):
    from drillmill.llm import queries

    met, all_ = (shares(queries.QUERIES[q](spark, small)) for q in ("p8_shares", "p8_shares_all"))
    scarce = [r for r in all_.values() if r.tokens and r.tokens == r.max_repeats * r.available_tokens]
    assert scarce and all(not r.met and r.reached_share < r.target_share for r in scarce)
    assert sum(r.tokens for r in all_.values()) > sum(r.tokens for r in met.values())
