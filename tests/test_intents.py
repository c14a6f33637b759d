"""Ranking semantics and the plug-in model path."""

from ticketflow.operators.intents import (lexicon_model_factory, model_intent_scores, rank_intents,
                                          score_intents)


def test_rank_fields(spark):
    df = spark.createDataFrame([("1", "refund my invoice payment"), ("2", "nothing here")], "id string, t string")
    r = {x.id: x for x in rank_intents(score_intents(df, "t")).collect()}
    assert r["1"].primary_intent == "billing" and r["1"].primary_confidence == round(6 / 7, 4)
    assert r["1"].needs_human_review is False
    assert r["2"].primary_intent == "billing" and r["2"].primary_confidence == 0.0   # ties: label order
    assert r["2"].secondary_intent == "technical_support" and r["2"].secondary_confidence is None
    assert r["2"].needs_human_review is True


def test_single_label_sums_to_one(spark):
    df = spark.createDataFrame([("1", "refund and password")], "id string, t string")
    s = score_intents(df, "t", multi_label=False).first().intent_scores
    assert abs(sum(x.score for x in s) - 1.0) < 1e-12


def test_one_label_has_no_secondary(spark):
    df = spark.createDataFrame([("1", "refund")], "id string, t string")
    r = rank_intents(score_intents(df, "t", labels=["billing"])).first()
    assert r.primary_intent == "billing" and r.secondary_intent is None


def test_plugin_equals_builtin(spark):
    rows = [(str(i), t) for i, t in enumerate(["refund now", "server error", "great design, thanks", ""])]
    df = spark.createDataFrame(rows, "id string, t string")
    a = {r.id: [(x.label, x.score) for x in r.intent_scores] for r in score_intents(df, "t").collect()}
    b = {r.id: [(x.label, x.score) for x in r.intent_scores]
         for r in model_intent_scores(df, lexicon_model_factory(), "id", "t").collect()}
    assert a == b


def test_enrich_with_plugin_model_equals_builtin(spark):
    from ticketflow.plans.enrich import enrich_flat, enrich_tickets
    from ticketflow.sources.fixtures import tickets
    t = tickets(spark, "/root/testdata/sf0.001", with_customer=True)
    a = enrich_flat(enrich_tickets(t))
    b = enrich_flat(enrich_tickets(t, intent_model=lexicon_model_factory()))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
