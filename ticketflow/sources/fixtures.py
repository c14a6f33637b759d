"""Fixture views derived from the driver's tables.

``events`` drives everything: one ticket / log row / prediction per event,
so the work grows with the data.  Small fixed dimension tables (phrases,
rules, words, lexicon, templates) are bounded by this module's constants and
are the only broadcast sides.

* ``tickets``: events joined to the phrase table on ``event_id % n`` and left
  joined to ``customer`` for the name; the name is null when
  ``user_id % 10 = 0`` and empty when ``user_id % 10 = 1`` so both default
  paths of reply rendering occur.
* ``classification_log``: language by ``user_id % 5``, intent = event type,
  confidence = k/100, latency = value.
* ``escalations``: escalated log rows plus rows pointing at no log id.
* ``predictions``: y_true = event type, y_pred shifted to the next class when
  k >= 75.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow import config as C
from ticketflow.sources import fixture_data as D
from ticketflow.sources.tables import read_table

LOG_LANGUAGES = ["en", "es", "fr", "de", "pt"]
EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]
UNMATCHED_ESCALATION_OFFSET = 1_000_000_000


def phrases(spark: SparkSession) -> DataFrame:
    schema = "phrase_id int, concept_id int, text string, intent string, urgency string, language string"
    return spark.createDataFrame(D.phrase_rows(), schema)


def translations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        D.translation_rows(), "source_text string, target_language string, text string")


def keyword_rules(spark: SparkSession, config_keywords: dict | None = None) -> DataFrame:
    return spark.createDataFrame(
        C.keyword_rules(config_keywords),
        "rule_order int, level string, keyword string, language string")


def function_words(spark: SparkSession) -> DataFrame:
    rows = [(lang, w) for lang, ws in D.FUNCTION_WORDS.items() for w in ws]
    return spark.createDataFrame(rows, "language string, word string")


def intent_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(D.INTENT_LEXICON, "label string, token string, weight int")


def _k(props: str = "props"):
    return F.get_json_object(F.col(props), "$.k").cast("int")


def _log_language(user_col: str = "user_id"):
    return F.element_at(F.array(*[F.lit(x) for x in LOG_LANGUAGES]),
                        (F.col(user_col) % len(LOG_LANGUAGES) + 1).cast("int"))


def tickets(spark: SparkSession, sf_dir: str, with_customer: bool = False) -> DataFrame:
    """One ticket per event; the customer is only joined where the name is used."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    ph = phrases(spark)
    n = len(D.phrase_rows())
    # Phrase table: fixed size (constants) -> broadcast hash join on an
    # expression key.  Customer: a dimension that grows with the data; the
    # planner/AQE pick broadcast or sort-merge from its measured size.
    t = ev.join(F.broadcast(ph), (F.col("event_id") % n) == F.col("phrase_id"))
    names = []
    if with_customer:
        cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
        t = t.join(cust, F.col("user_id") == F.col("c_custkey"), "left")
        r = F.col("user_id") % 10
        names = [F.when(r == 0, F.lit(None).cast("string")).when(r == 1, F.lit("")).otherwise(F.col("c_name"))
                 .alias("customer_name")]
    return t.select(
        F.concat(F.lit("T-"), F.col("event_id").cast("string")).alias("ticket_id"),
        "event_id",
        "ts",
        "text",
        F.col("value").alias("handling_ms"),
        *names,
        F.col("intent").alias("true_intent"),
        F.col("urgency").alias("true_urgency"),
        F.col("language").alias("true_language"),
    )


def classification_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    k = _k()
    conf = k / F.lit(100)
    return ev.select(
        F.col("event_id").alias("id"),
        "ts",
        F.substring(F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.col("event_type")), 256), 1, 16)
        .alias("text_hash"),
        _log_language().alias("language"),
        F.col("event_type").alias("primary_intent"),
        conf.cast("double").alias("confidence"),
        F.when(k >= 90, "critical").when(k >= 60, "high").when(k >= 30, "medium")
        .otherwise("low").alias("urgency"),
        (k >= 80).alias("was_escalated"),
        (conf < F.lit(C.CONFIDENCE_THRESHOLD)).alias("needs_review"),
        F.col("value").alias("processing_time_ms"),
    )


def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = classification_log(spark, sf_dir).filter(F.col("was_escalated"))
    unmatched = (F.col("id") % 7) == 0
    resolved = (F.col("id") % 3) == 0
    return log.select(
        F.col("id"),
        (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("ts"),
        F.when(unmatched, F.col("id") + UNMATCHED_ESCALATION_OFFSET).otherwise(F.col("id"))
        .alias("classification_id"),
        F.concat(F.lit("urgency "), F.col("urgency")).alias("reason"),
        resolved.alias("resolved"),
        F.when(resolved, F.lit("closed by agent")).alias("resolution_notes"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    k = _k()
    nxt = F.create_map(*[x for i, c in enumerate(EVENT_CLASSES)
                         for x in (F.lit(c), F.lit(EVENT_CLASSES[(i + 1) % len(EVENT_CLASSES)]))])
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("y_true"),
        F.when(k >= 75, nxt[F.col("event_type")]).otherwise(F.col("event_type")).alias("y_pred"),
        _log_language().alias("language"),
        (k / F.lit(100)).cast("double").alias("confidence"),
    )
