"""Operators whose plan must not depend on the size or shape of a side table."""

from ticketflow.operators import augment as A
from ticketflow.operators.evaluation import evaluate
from ticketflow.operators.intents import _MODELS, _worker_model
from ticketflow.operators.urgency import urgency_rule_hits
from ticketflow.session import ensure_checkpoint_dir


def test_rule_hits_equal_a_plain_substring_test(spark):
    from ticketflow.config import keyword_rules as rows
    from ticketflow.sources.fixtures import keyword_rules

    tickets = [("1", "URGENT: down, need help", "es"), ("2", "ayuda por favor", "es"), ("3", "nothing", "en"), ("4", None, "en"),
               ("5", "", "en")]
    extra = [(900, "low", "x", None), (901, "low", "", None), (902, "low", "ab", "es")]
    t = spark.createDataFrame([*tickets, ("6", "xab", "es"), ("7", "xab", "fr")], "ticket_id string, text string, language string")
    rules = keyword_rules(spark).unionByName(spark.createDataFrame(extra, keyword_rules(spark).schema))
    got = sorted((r.ticket_id, r.rule_order) for r in urgency_rule_hits(t, rules).collect())
    want = sorted((i, order) for i, text, lang in [*tickets, ("6", "xab", "es"), ("7", "xab", "fr")]
                  for order, _, keyword, of in [*rows(), *extra]
                  if text and keyword and keyword in text.lower() and of in (None, lang))
    assert got == want and len(got) > 6
    plan = urgency_rule_hits(t, rules)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_evaluate_without_confidences_has_no_low_confidence_section(spark):
    rows = [("a", "a", "en"), ("a", "b", "es")]
    sections = {r.section for r in evaluate(spark.createDataFrame(rows, "y_true string, y_pred string, language string")).collect()}
    assert "low_confidence_analysis" not in sections and "overall" in sections
    both = spark.createDataFrame([(*r, 0.5) for r in rows], "y_true string, y_pred string, language string, confidence double")
    assert "low_confidence_analysis" in {r.section for r in evaluate(both).collect()}


TICKETS = [(1, "hello", "en"), (2, "bye", "en"), (3, "hola", "es")]


def test_untranslated_rows_are_left_out_and_counted(spark):
    df = spark.createDataFrame(TICKETS, "id long, text string, language string")
    tr = spark.createDataFrame([("hello", "fr", "salut"), ("hello", "de", "hallo"), ("bye", "fr", None)],
                               "source_text string, target_language string, text string")
    got = sorted((r.id, r.language, r.text, r.translated) for r in A.augment_languages(df, tr, "id", targets=["fr", "de"]).collect())
    assert got == [(1, "de", "hallo", True), (1, "fr", "salut", True)]
    gaps = {r.language: r.missing for r in A.translation_gaps(df, tr, "id", targets=["fr", "de"]).collect()}
    assert gaps == {"fr": 1, "de": 1}


def test_model_translation_marks_unchanged_and_failed_rows(spark):
    df = spark.createDataFrame(TICKETS, "id long, text string, language string")
    factory = A.dictionary_translator_factory([("hello", "fr", "salut")])
    got = sorted((r.id, r.language, r.text, r.translated)
                 for r in A.augment_with_model(df, factory, "id", targets=["fr", "xx"]).collect())
    # no model for xx: the rows stay English and say so
    assert got == [(1, "en", "hello", False), (1, "fr", "salut", True), (2, "en", "bye", False), (2, "fr", "bye", False)]


def test_worker_model_is_known_by_its_content():
    built = []

    def factory(name):
        return lambda labels: built.append(name) or name

    assert _worker_model("k1", factory("one"), ["a"]) == "one"
    assert _worker_model("k1", factory("one"), ["a"]) == "one"
    assert _worker_model("k2", factory("two"), ["a"]) == "two"
    assert built == ["one", "two"] and list(_MODELS) == ["k2"]


def test_checkpoint_dir_must_be_shared_off_a_local_master():
    import pytest

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_second_backend_decides_where_the_vote_does_not(spark):
    from ticketflow.operators.language import detect_language

    texts = ["the and of to", "bildschirm zeigt fehler", "zzqx 77", "", None, "tormenta"]
    rows = detect_language(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()
    assert (rows[0].language, rows[0].language_confidence) == ("en", 1.0)
    # no function word: trigrams alone decide
    assert rows[1].language == "de" and 0 < rows[1].language_confidence <= 1 and rows[5].language == "es"
    # neither backend knows anything
    assert [(r.language, r.language_confidence) for r in rows[3:5]] == [("en", 0.0)] * 2
