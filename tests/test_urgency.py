"""Urgency arithmetic edges, rule order and reasons."""

from ticketflow.operators.urgency import score_urgency


def score(spark, rows):
    df = spark.createDataFrame(rows, "id int, text string, language string, conf double")
    out = score_urgency(df, "text", "language", "conf")
    return {r.id: r for r in out.collect()}


def test_critical_is_unreachable_with_default_weights(spark):
    r = score(spark, [(1, "URGENT: system is down", "en", 0.0)])[1]
    assert r.urgency == "high"          # 0.8999999999999999 < 0.9
    assert r.should_escalate is True
    assert r.urgency_score == 0.9       # rounded for display only


def test_edges_in_double_arithmetic(spark):
    got = score(spark, [(1, "URGENT", "en", 1.0), (2, "important", "en", 0.4), (3, "thanks", "en", 0.0)])
    assert got[1].should_escalate is False          # 0.7999999999999999
    assert got[2].urgency == "medium"               # 0.6499999999999999
    assert got[3].urgency == "low" and got[3].urgency_reason == "standard priority"


def test_rule_order_and_language_rules(spark):
    r = score(spark, [(1, "C'est important, besoin d'aide", "fr", 0.5)])[1]
    assert list(r.rules_triggered) == ["high:important", "high:important:fr", "high:aide:fr"]
    assert r.urgency_reason == "keywords matched: 3"


def test_substring_match(spark):
    r = score(spark, [(1, "please download the file", "en", 0.5)])[1]
    assert "critical:down" in r.rules_triggered


def test_reason_with_escalation(spark):
    r = score(spark, [(1, "emergency", "en", 0.0)])[1]
    assert r.urgency_reason == "keywords matched: 1; auto-escalated due to high urgency"


def test_null_confidence_counts_as_zero(spark):
    r = score(spark, [(1, "emergency", "en", None)])[1]
    assert r.should_escalate is True


def test_builtin_fallback_for_missing_level():
    from ticketflow.config import BUILTIN_KEYWORDS, keyword_rules
    rules = keyword_rules({"critical": ["fire"]})
    medium = [kw for _, lvl, kw, lang in rules if lvl == "medium" and lang is None]
    high = [kw for _, lvl, kw, lang in rules if lvl == "high" and lang is None]
    assert medium == BUILTIN_KEYWORDS["medium"] and high == BUILTIN_KEYWORDS["high"]
