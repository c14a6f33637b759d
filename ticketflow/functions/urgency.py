"""Urgency scoring as column expressions.

The rule set is small and fixed, so it is a literal array of structs and the
match is a per-row ``filter`` (no join, no shuffle).  ``operators.urgency``
keeps the long (join) form for large user rule tables.

Arithmetic is in IEEE doubles in exactly this order:
``0.7*rule + 0.2*ml + 0.1*(1 - confidence)``, so the best possible score with
a confidence in [0, 1] is 0.8999999999999999 and level ``critical`` is not
reachable with the default cut points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketflow import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def urgency_rules(text, language, rules: list[tuple] | None = None,
                  lowered: bool = False) -> Column:
    """Ordered array of triggered rule ids ``level:kw`` / ``level:kw:lang``.

    Lower-case substring match; a rule with a language applies only when it
    equals the ticket language.  Pass an already lower-cased column with
    ``lowered=True`` to avoid lower-casing once per rule.
    """
    low = _col(text) if lowered else F.lower(_col(text))
    lang = _col(language)
    rows = rules if rules is not None else C.keyword_rules()
    none = F.array().cast("array<string>")
    items = []
    for _, level, kw, rlang in rows:
        cond = low.contains(F.lit(kw))
        if rlang is not None:
            cond = (lang == F.lit(rlang)) & cond
            rid = f"{level}:{kw}:{rlang}"
        else:
            rid = f"{level}:{kw}"
        items.append(F.when(cond, F.array(F.lit(rid))).otherwise(none))
    # one CASE per rule, joined: code-generated, no lambda over the rules
    return F.concat(none, *items)


def urgency_rule_score(triggered) -> Column:
    """critical 1.0, high 0.7, medium 0.4, none 0.2 (from the trigger ids)."""
    t = _col(triggered)

    def has(level):
        return F.exists(t, lambda x: x.startswith(level + ":"))

    return (
        F.when(has("critical"), F.lit(C.RULE_SCORES["critical"]))
        .when(has("high"), F.lit(C.RULE_SCORES["high"]))
        .when(has("medium"), F.lit(C.RULE_SCORES["medium"]))
        .otherwise(F.lit(C.RULE_SCORES["none"]))
    )


def urgency_ml_score(text=None, model: Column | None = None) -> Column:
    """Placeholder ML signal: a caller's column, else the constant 0.5."""
    return model if model is not None else F.lit(C.DEFAULT_ML_SCORE)


def combined_score(rule_score, ml_score, confidence) -> Column:
    raw = (
        F.lit(C.RULE_WEIGHT) * _col(rule_score)
        + F.lit(C.ML_WEIGHT) * _col(ml_score)
        + F.lit(C.CONFIDENCE_WEIGHT) * (F.lit(1.0) - _col(confidence))
    )
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def urgency_level(score, critical: float = C.LEVEL_CRITICAL, high: float = C.LEVEL_HIGH,
                  medium: float = C.LEVEL_MEDIUM) -> Column:
    s = _col(score)
    return (
        F.when(s >= F.lit(critical), F.lit("critical"))
        .when(s >= F.lit(high), F.lit("high"))
        .when(s >= F.lit(medium), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def urgency_reason(n_triggered, should_escalate) -> Column:
    kw = F.when(_col(n_triggered) > 0, F.concat(F.lit("keywords matched: "),
                                                _col(n_triggered).cast("string")))
    esc = F.when(_col(should_escalate), F.lit(C.REASON_ESCALATED))
    joined = F.concat_ws("; ", kw, esc)
    return F.when(joined == "", F.lit(C.REASON_STANDARD)).otherwise(joined)


def urgency_score(text, language, confidence, ml_score: Column | None = None,
                  rules: list[tuple] | None = None,
                  escalation_threshold: float = C.ESCALATION_THRESHOLD) -> Column:
    """Struct(level, score, rules_triggered, should_escalate, reason).

    Level and escalation come from the unrounded score; ``score`` is rounded
    to 4 places.  A null confidence counts as 0.0 (the default argument).
    """
    trig = urgency_rules(text, language, rules)
    conf = F.coalesce(_col(confidence).cast("double"), F.lit(0.0))
    raw = combined_score(urgency_rule_score(trig), urgency_ml_score(text, ml_score), conf)
    esc = raw >= F.lit(escalation_threshold)
    return F.struct(
        urgency_level(raw).alias("level"),
        F.round(raw, 4).alias("score"),
        trig.alias("rules_triggered"),
        esc.alias("should_escalate"),
        urgency_reason(F.size(trig), esc).alias("reason"),
    )
