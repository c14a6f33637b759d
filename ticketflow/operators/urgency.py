"""Urgency scoring over DataFrames.

``score_urgency`` evaluates a small rule set in-row (literal array), a longer
one with an Aho-Corasick automaton (``rule_automaton``); neither needs a join
or a shuffle.  ``urgency_rule_hits`` is the long form of the same match for
user rule tables: the automaton's hits, exploded, up to its size limit, and an
equi-join on keyword prefixes beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow import config as C
from ticketflow.functions import urgency as U
from ticketflow.operators import rule_automaton as A


def score_urgency(df: DataFrame, text_col: str = "text", language_col: str = "language",
                  confidence_col: str | None = "confidence", ml_score=None,
                  rules: list[tuple] | None = None,
                  escalation_threshold: float = C.ESCALATION_THRESHOLD) -> DataFrame:
    """Adds urgency, urgency_score, rules_triggered, should_escalate, urgency_reason."""
    conf = F.col(confidence_col) if confidence_col else F.lit(0.0)
    out = df.withColumn("_low", F.lower(F.col(text_col)))
    if rules is not None and len(rules) > A.IN_ROW_RULES:
        hits = A.triggered_rules(df.sparkSession, F.col("_low"), F.col(language_col), rules)
    else:
        hits = U.urgency_rules("_low", language_col, rules, lowered=True)
    out = out.withColumn("rules_triggered", hits)
    out = out.withColumn("_rule", U.urgency_rule_score("rules_triggered"))
    out = out.withColumn("_raw", U.combined_score(
        "_rule", U.urgency_ml_score(text_col, ml_score),
        F.coalesce(conf.cast("double"), F.lit(0.0))))
    esc = F.col("_raw") >= F.lit(escalation_threshold)
    return (
        out.withColumn("urgency", U.urgency_level("_raw"))
        .withColumn("urgency_score", F.round("_raw", 4))
        .withColumn("should_escalate", esc)
        .withColumn("urgency_reason", U.urgency_reason(F.size("rules_triggered"), esc))
        .drop("_rule", "_raw", "_low")
    )


PREFIX = 3      # characters of a keyword that pick its candidate texts


def urgency_rule_hits(df: DataFrame, rules: DataFrame, id_col: str = "ticket_id",
                      text_col: str = "text", language_col: str = "language") -> DataFrame:
    """Long form: one row per (ticket, rule) hit.

    ``rules`` has columns (rule_order, level, keyword, language); a null rule
    language applies to every ticket.  The match is a substring test: one pass
    of the automaton per text, and one row per hit.
    """
    r = rules.where(F.length("keyword") > 0)
    if not A.small_enough(r):
        return urgency_rule_hits_join(df, rules, id_col, text_col, language_col)
    rows = [tuple(x) for x in r.select("rule_order", "level", "keyword", "language").collect()]
    places = A.matched_rules(df.sparkSession, F.lower(F.col(text_col)), F.col(language_col), [(x[2], x[3]) for x in rows])
    order = dict(r.dtypes)["rule_order"]
    table = df.sparkSession.createDataFrame(
        [(i, x[0], x[1], x[2], x[3], A.rule_id(*x[1:])) for i, x in enumerate(rows)],
        f"_place int, rule_order {order}, level string, keyword string, rule_language string, rule_id string")
    hit = df.select(id_col, F.explode(places).alias("_place"))
    # the same rules were just sent to the workers: their size is checked
    return hit.join(F.broadcast(table), "_place").drop("_place")


def urgency_rule_hits_join(df: DataFrame, rules: DataFrame, id_col: str = "ticket_id",
                           text_col: str = "text", language_col: str = "language") -> DataFrame:
    """``urgency_rule_hits`` for rule tables too large for every worker.

    Candidates are an equi-join: the distinct substrings of a text that are as
    long as a keyword's prefix (``PREFIX`` characters, fewer for shorter
    keywords) meet the keywords with that prefix, and only those are tested.
    """
    r = rules.where(F.length("keyword") > 0).select(
        "rule_order", "level", "keyword", F.col("language").alias("rule_language"),
        F.substring("keyword", 1, PREFIX).alias("_gram"))
    sizes = [x[0] for x in r.select(F.length("_gram")).distinct().collect()]     # at most PREFIX numbers
    t = df.select(id_col, F.lower(F.col(text_col)).alias("_low"), F.col(language_col).alias("_lang"))
    grams = [F.regexp_extract_all("_low", F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in sizes or [PREFIX]]
    t = t.withColumn("_gram", F.explode(F.array_distinct(F.concat(*grams))))
    cond = F.col("_low").contains(F.col("keyword")) & (
        F.col("rule_language").isNull() | (F.col("rule_language") == F.col("_lang")))
    hit = t.join(r, "_gram").where(cond)
    rule_id = F.when(F.col("rule_language").isNull(), F.concat_ws(":", "level", "keyword")) \
        .otherwise(F.concat_ws(":", "level", "keyword", "rule_language"))
    return hit.select(id_col, "rule_order", "level", "keyword", "rule_language",
                      rule_id.alias("rule_id"))


def urgency_level_counts(scored: DataFrame, language_col: str = "language") -> DataFrame:
    """Tickets per (language, urgency level) with the escalation count."""
    return scored.groupBy(language_col, "urgency").agg(
        F.count(F.lit(1)).alias("n_tickets"),
        F.count_if(F.col("should_escalate")).alias("n_escalated"),
    )
