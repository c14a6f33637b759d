"""Substring rules as an Aho-Corasick automaton: one pass per text, however many rules.

The automaton holds every keyword once; its value lists the rules of that
keyword.  The rules go to the workers as a broadcast whose size is checked
(``RULE_BYTES``), and a worker builds the automaton once.  A text is read from
left to right once; what it costs depends on its length and its hits, not on
the number of rules.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.session import ship_package

RULE_BYTES = 64 << 20       # characters of keywords (and 100 a rule) that may be sent to the workers
IN_ROW_RULES = 64           # rule lists up to this size are tested one by one in the JVM


@lru_cache(maxsize=2)
def _built(number: int, sent):
    """Automaton of a broadcast, built once per worker (``number``: the broadcast's own)."""
    import ahocorasick

    rules = sent.value
    by_keyword: dict[str, list[int]] = {}
    for place, (keyword, _) in enumerate(rules):
        by_keyword.setdefault(keyword, []).append(place)
    automaton = ahocorasick.Automaton()
    for keyword, places in by_keyword.items():
        automaton.add_word(keyword, tuple((p, rules[p][1]) for p in places))
    if by_keyword:
        automaton.make_automaton()
    return automaton if by_keyword else None


def matched_rules(spark: SparkSession, lowered: Column, language: Column, rules: list[tuple[str, str | None]]) -> Column:
    """array<int>: ascending places in ``rules`` ((keyword, language or None)) that occur in a
    lower-cased text; a rule with a language needs the same language.  Empty keywords never match."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast([(k, lang) for k, lang in rules])
    number = sent._jbroadcast.id()
    empty = {i for i, (k, _) in enumerate(rules) if not k}
    if empty:
        raise ValueError("a rule without a keyword")

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series, languages: pd.Series) -> pd.Series:
        automaton = _built(number, sent)
        out = []
        for text, lang in zip(texts, languages):
            if text is None:
                out.append(None)
                continue
            found = set()
            if automaton is not None:
                for _, hits in automaton.iter(text):
                    found.update(p for p, need in hits if need is None or need == lang)
            out.append(sorted(found))
        return pd.Series(out)

    return places(lowered, language)


def small_enough(rules: DataFrame) -> bool:
    """Whether a rule table may be sent to every worker."""
    n, chars = rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("keyword")), F.lit(0))).first()
    return chars + 100 * n <= RULE_BYTES


def rule_id(level: str, keyword: str, language: str | None) -> str:
    return f"{level}:{keyword}" + (f":{language}" if language is not None else "")


def triggered_rules(spark: SparkSession, lowered: Column, language: Column, rules: list[tuple]) -> Column:
    """``functions.urgency.urgency_rules`` for long lists of (order, level, keyword, language)."""
    places = matched_rules(spark, lowered, language, [(r[2], r[3]) for r in rules])
    ids = [rule_id(*r[1:]) for r in rules]
    sent = spark.sparkContext.broadcast(ids)

    @F.pandas_udf("array<string>")
    def named(found: pd.Series) -> pd.Series:
        names = sent.value
        return pd.Series([None if x is None else [names[i] for i in x] for x in found])

    return F.coalesce(named(places), F.array().cast("array<string>"))
