"""Property tests: laws that cleaning, urgency and the lexical scorers keep."""

import regex
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketflow import config as C
from ticketflow.functions import text as TX
from ticketflow.operators.urgency import score_urgency

FRAGMENTS = ["urgent", "URGENT", "down", "download", "help", "how to", "would like", "need",
             "ayuda", "panne", "cassé", "fora do ar", "emergência", "important", "question",
             "http://x.io/a", "https://e.com/p?q=1", "www.site.org", "a@b.co", "me@x.io,",
             "@", ".", "  ", "\t", "\n", " ", "\u2003", "\u3000", "\x1c", "\x85", "ｕｒｇｅｎｔ",
             "ﬁ", "é", "e\u0301", "日本", "100%", "{x}", "word", "x", ""]
texts = st.lists(st.sampled_from(FRAGMENTS), min_size=0, max_size=12).map(" ".join) | \
    st.lists(st.sampled_from(FRAGMENTS), min_size=0, max_size=12).map("".join)
batches = st.lists(texts, min_size=1, max_size=25)


def cleaned(spark, batch, n=512):
    df = spark.createDataFrame(list(enumerate(batch)), "i int, t string")
    return [r.c for r in df.select("i", TX.clean_text("t", max_length=n).alias("c")).orderBy("i").collect()]


@settings(max_examples=15, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(batches)
def test_cleaned_text_is_short_single_spaced_and_masked(spark, batch):
    for text, c in zip(batch, cleaned(spark, batch, 40)):
        assert len(c) <= 40 and not c.startswith(" ")
        assert not regex.search(r"[\s\x1c-\x1f]{2}|[^\S ]", c), repr(text)
        assert "http://" not in c and "https://" not in c
        assert not regex.search(r"\S@\S+\.\S", c), repr(text)


@settings(max_examples=15, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(batches)
def test_cleaning_again_changes_nothing(spark, batch):
    once = cleaned(spark, batch)
    assert cleaned(spark, once) == once


def test_cleaning_cases(spark):
    cases = {
        None: "", "": "", " \t\u3000": "", "a  b\n c": "a b c", "ｕｒｇｅｎｔ ﬁx": "urgent fix",
        "see https://e.com/p?q=1 or www.site.org now": "see [URL] or [URL] now",
        "mail me@x.io, please": "mail [EMAIL] please", "e\u0301te\u0301": "été", "x" * 600: "x" * 512,
    }
    assert cleaned(spark, list(cases)) == list(cases.values())


def scored(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, language string, conf double")
    return score_urgency(df, "text", "language", "conf").orderBy("i").collect()


LEVEL = {name: i for i, name in enumerate(["low", "medium", "high", "critical"])}


@settings(max_examples=15, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.tuples(texts, st.sampled_from(["en", "es", "fr", "de", "pt", "it"])), min_size=1, max_size=25))
def test_urgency_laws(spark, batch):
    sure = scored(spark, [(t, lang, 1.0) for t, lang in batch])
    unsure = scored(spark, [(t, lang, 0.0) for t, lang in batch])
    doubled = scored(spark, [(t + " " + t, lang, 1.0) for t, lang in batch])
    for (text, lang), a, b, c in zip(batch, sure, unsure, doubled):
        # a surer classification never makes a ticket more urgent
        assert a.urgency_score <= b.urgency_score and LEVEL[a.urgency] <= LEVEL[b.urgency]
        # every rule that fires is found in the text and belongs to its language
        for rule in a.rules_triggered:
            level, keyword, *of = rule.split(":")
            assert level in LEVEL and keyword in text.lower() and of in ([], [lang])
        # saying it twice fires the same rules at least
        assert set(a.rules_triggered) <= set(c.rules_triggered)


def test_urgency_cases(spark):
    rows = [("all quiet", "en", 1.0), ("URGENT!", "en", 1.0), ("ayuda", "es", 0.5), ("ayuda", "it", 0.5), ("", "en", 0.0)]
    got = scored(spark, rows)
    assert got[0].rules_triggered == [] and got[0].urgency == "low"
    assert any(r.startswith("critical:urgent") for r in got[1].rules_triggered) and got[1].urgency == "high"
    assert len(got[2].rules_triggered) > len(got[3].rules_triggered)
    assert [r.urgency_score for r in got[:2]] == [0.24, 0.8]


LEX_FRAGMENTS = ["refund", "Refund", "refunds", "invoice,", "error", "erreur!", "app", "l'application",
                 "mot de passe", "passe-partout", "the", "The", "und", "é", "est", "c'est", "thanks",
                 "ótimo", "conexão", "x1", "-", ",", "  ", "¿", "öffnungszeiten", ""]
lex_texts = st.lists(st.sampled_from(LEX_FRAGMENTS), min_size=0, max_size=15).map(" ".join)


@settings(max_examples=10, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(lex_texts, min_size=1, max_size=25))
def test_lexical_hits_add_up_over_concatenation(spark, batch):
    from ticketflow.operators.intents import intent_hits
    from ticketflow.operators.language import function_word_hits

    def hits(rows):
        df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
        low = F.lower(F.col("t"))
        got = df.select("i", intent_hits(low).alias("a"), function_word_hits(low).alias("b")).orderBy("i").collect()
        return [(list(r.a), list(r.b)) for r in got]

    one = hits(batch)
    # a separator keeps the tokens of both halves whole
    two = hits([f"{x} | {x}" for x in batch])
    for (a, b), (a2, b2) in zip(one, two):
        assert a2 == [2 * x for x in a] and b2 == [2 * x for x in b]


def test_lexical_cases(spark):
    from ticketflow.operators.intents import intent_hits
    from ticketflow.operators.language import function_word_hits
    from ticketflow.sources import fixture_data as D

    weights = {(lab, tok): w for lab, tok, w in D.INTENT_LEXICON}
    df = spark.createDataFrame([("refund, refund!",), ("refunds",), ("und the the",)], "t string")
    got = df.select(intent_hits(F.col("t")).alias("a"), function_word_hits(F.col("t")).alias("b")).collect()
    billing = C.INTENT_CATEGORIES.index("billing")
    assert got[0].a[billing] == 2 * weights["billing", "refund"] and sum(got[1].a) == 0
    languages = list(D.FUNCTION_WORDS)
    assert (got[2].b[languages.index("en")], got[2].b[languages.index("de")]) == (2, 1)
