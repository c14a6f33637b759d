"""The learned intent scorer: held-out figures, calibration, fallback."""

import pytest
from pyspark.sql import functions as F

from ticketflow import config as C
from ticketflow.operators import learned_intents as L
from ticketflow.operators.intents import rank_intents, score_intents
from ticketflow.plans.enrich import enrich_tickets
from ticketflow.plans.queries import REGISTRY
from ticketflow.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tickets(spark):
    return FX.tickets(spark, SF).select("ticket_id", "text", "true_intent", "true_language").cache()


@pytest.fixture(scope="module")
def model(tickets):
    return L.fit_intents(tickets, "text", "true_intent")


def test_unseen_texts_are_scored_as_well_as_by_the_lexicon_and_better_calibrated(spark):
    rows = REGISTRY["intent_model_eval"](spark, SF).collect()
    n = sum(r.n for r in rows)
    mean = lambda c: sum(r[c] * r.n for r in rows) / n
    assert n > 100 and len(rows) >= 4
    assert mean("accuracy") >= 0.85 and mean("accuracy") >= mean("lexicon_accuracy") - 0.02
    assert mean("calibration_error") <= 0.12 < mean("lexicon_calibration_error")


def test_texts_it_learned_from(model, tickets):
    seen = tickets.where(~L.fold(F.col("text")).isin([*L.HELD_OUT, *L.CALIBRATION]) & (F.trim("text") != ""))
    r = L.calibration_by(model.score(seen, "text").withColumn("g", F.lit(1)), "true_intent", "g").first()
    assert r.accuracy >= 0.97 and r.n == seen.count()


def test_scores_are_sorted_sum_to_one_and_fall_back(spark, model):
    df = spark.createDataFrame([(1, "my invoice and payment", 9), (2, None, 9), (3, "", 9), (4, "!!! ...", 9), (5, "zzzz", 9),
                                (6, "my invoice and payment", 9)], "i int, t string, _margins int")
    got = {r.i: r.s for r in model.score(df, "t", "s").collect()}
    assert [x.label for x in got[1]][0] == "billing" and got[1] == got[6]
    for i in (1, 5, 6):
        scores = [x.score for x in got[i]]
        assert scores == sorted(scores, reverse=True) and sum(scores) == pytest.approx(1)
        assert {x.label for x in got[i]} == set(C.INTENT_CATEGORIES)
    lexical = {r.i: r.s for r in score_intents(df, "t", "s").collect()}
    for i in (2, 3, 4):
        assert got[i] == lexical[i]
    ranked = rank_intents(model.score(df.where("i = 1"), "t")).first()
    assert ranked.primary_intent == "billing" and ranked.needs_human_review == (ranked.intent_scores[0].score < C.CONFIDENCE_THRESHOLD)
    assert model.score(df.limit(0), "t").count() == 0


def test_copies_share_a_fold_and_odd_labels_take_no_part(spark, tickets):
    folds = tickets.groupBy(F.lower("text").alias("t")).agg(F.count_distinct(L.fold(F.col("text"))).alias("n"))
    assert folds.where("n > 1").count() == 0
    odd = tickets.select("text", F.col("true_intent").alias("intent")).unionByName(
        spark.createDataFrame([("strange words here", "no such label"), (None, "billing"), ("x y", None)], "text string, intent string"))
    assert L.fit_intents(odd).labels == C.INTENT_CATEGORIES
    with pytest.raises(ValueError):
        L.fit_intents(odd.limit(0))


def test_a_softer_temperature_lowers_the_first_score(spark):
    df = spark.createDataFrame([([2.0, 1.0, -1.0],)], "m array<double>")
    tops = [df.select(L.softmax(F.col("m"), t)[0]).first()[0] for t in (0.25, 1.0, 4.0)]
    assert tops == sorted(tops, reverse=True) and tops[1] == pytest.approx(0.7054, abs=1e-4)


def test_enrichment_takes_the_model(spark, model):
    t = FX.tickets(spark, SF, with_customer=True).limit(50)
    out = enrich_tickets(t, intent_model=model)
    assert out.columns == enrich_tickets(t).columns and out.where("cleaned_text <> ''").where("primary_intent is null").count() == 0
