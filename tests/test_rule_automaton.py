"""Large rule tables: the automaton against one substring test per rule."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ticketflow.functions import urgency as U
from ticketflow.operators import rule_automaton as A
from ticketflow.operators.urgency import score_urgency, urgency_rule_hits, urgency_rule_hits_join

LANGS = [None, None, "en", "fr"]


def rules_of(n, seed, alphabet="abcdé ", lengths=(1, 9)):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["critical", "high", "medium"]),
             "".join(rnd.choice(alphabet) for _ in range(rnd.randint(*lengths))), rnd.choice(LANGS)) for i in range(n)]


def texts_of(n, seed, alphabet="abcdé "):
    rnd = random.Random(seed)
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "fr", None])) for i in range(n)]
    return rows + [(n, None, "en"), (n + 1, "", None), (n + 2, "ABÉ cab", "fr"), (n + 2, "ABÉ cab", "fr")]


RULES = "rule_order int, level string, keyword string, language string"


def test_ten_thousand_rules_hit_like_contains(spark):
    rules, texts = rules_of(10_000, 1), texts_of(60, 2)
    r, t = spark.createDataFrame(rules + [(-1, "high", "", None)], RULES), spark.createDataFrame(texts, "ticket_id int, text string, language string")
    got = sorted(map(str, ((x.ticket_id, x.rule_order, x.level, x.keyword, x.rule_language, x.rule_id)
                           for x in urgency_rule_hits(t, r).collect())))
    want = sorted(str((i, o, level, k, lang, A.rule_id(level, k, lang))) for i, text, tl in texts if text is not None
                  for o, level, k, lang in rules if k in text.lower() and lang in (None, tl))
    assert len(want) > 10_000 and got == want


def test_rules_beyond_the_size_limit_take_the_join(spark, monkeypatch):
    rules, texts = rules_of(200, 3), texts_of(30, 4)
    r, t = spark.createDataFrame(rules, RULES), spark.createDataFrame(texts, "ticket_id int, text string, language string")
    small = sorted(map(str, urgency_rule_hits(t, r).select("ticket_id", "rule_order", "rule_id").collect()))
    monkeypatch.setattr(A, "RULE_BYTES", 10)
    assert sorted(map(str, urgency_rule_hits(t, r).select("ticket_id", "rule_order", "rule_id").collect())) == small
    assert sorted(map(str, urgency_rule_hits_join(t, r).select("ticket_id", "rule_order", "rule_id").collect())) == small


@pytest.mark.parametrize("n", [A.IN_ROW_RULES, A.IN_ROW_RULES + 1, 400])
def test_scores_are_the_same_on_both_ways(spark, n):
    rules = rules_of(n, n)
    t = spark.createDataFrame(texts_of(40, 5), "ticket_id int, text string, language string").withColumn("confidence", F.lit(0.4))
    got = score_urgency(t, rules=rules).select("ticket_id", "rules_triggered", "urgency_score", "urgency").collect()
    one_by_one = t.select("ticket_id", U.urgency_score("text", "language", F.col("confidence"), rules=rules).alias("u")).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(ticket_id=x.ticket_id, rules_triggered=x.u.rules_triggered,
                                                            urgency_score=x.u.score, urgency=x.u.level)) for x in one_by_one)


def test_no_rules_and_no_rows(spark):
    t = spark.createDataFrame(texts_of(5, 6), "ticket_id int, text string, language string")
    assert urgency_rule_hits(t, spark.createDataFrame([], RULES)).count() == 0
    assert urgency_rule_hits(t.limit(0), spark.createDataFrame(rules_of(5, 1), RULES)).count() == 0
    with pytest.raises(ValueError):
        A.matched_rules(spark, F.lit("a"), F.lit("en"), [("", None)])


def test_cost_does_not_follow_the_number_of_rules():
    """Texts without a hit: 100 times the rules must not cost several times as much."""
    import ahocorasick

    text = "abcdefgh " * 20_000
    times = []
    for n in (200, 20_000):
        a = ahocorasick.Automaton()
        for _, _, k, _ in rules_of(n, n, "klmnopqrst", (6, 12)):
            a.add_word(k, k)
        a.make_automaton()
        best = 9.0
        for _ in range(5):
            t0 = time.perf_counter()
            assert not list(a.iter(text))
            best = min(best, time.perf_counter() - t0)
        times.append(best)
    assert times[1] < 5 * times[0]
