"""Readers, corpora, sinks, the nested metrics report and streaming."""

import json

from pyspark.sql import functions as F

from ticketflow.operators.metrics import metrics_report
from ticketflow.sources import sinks as S
from ticketflow.sources.corpora import load_language_corpora
from ticketflow.sources.tickets import read_tickets

SF = "/root/testdata/sf0.001"


def test_read_tickets_json_array(spark, tmp_path):
    rows = [{"text": "I need help", "intent": "account", "urgency": "medium", "language": "en"},
            {"text": "Hola", "intent": "general_inquiry", "urgency": "low", "language": "es"}]
    p = tmp_path / "sample.json"
    p.write_text(json.dumps(rows))
    got = read_tickets(spark, str(p)).collect()
    assert [r.asDict() for r in got] == rows


def test_corpora_skips_languages_without_rows(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", "en"), (3, "c", "fr")], "doc_id long, text string, lang string")
    c = load_language_corpora(docs, ["en", "pt", "fr"], samples_per_lang=1)
    assert sorted((r.language, r.doc_id) for r in c.collect()) == [("en", 1), ("fr", 3)]
    empty = load_language_corpora(docs, ["pt"])
    assert empty.count() == 0 and "source" in empty.columns


def test_store_roundtrip_and_idempotent_create(spark, tmp_path):
    base = str(tmp_path / "store")
    S.create_tables(spark, base)
    S.create_tables(spark, base)
    enriched = spark.createDataFrame(
        [(7, "2024-01-02 03:04:05", "urgent!", "en", "billing", 0.5, "high", True, True)],
        "event_id long, ts string, text string, language string, primary_intent string, "
        "primary_confidence double, urgency string, should_escalate boolean, needs_human_review boolean"
    ).withColumn("ts", F.to_timestamp("ts"))
    rows = S.classification_rows(enriched, id_col="event_id")
    S.log_classifications(rows, base)
    S.log_escalations(S.escalation_rows(rows), base)
    c = S.read_store(spark, base, "classifications").first()
    assert c.id == 7 and len(c.text_hash) == 16 and "text" not in S.read_store(spark, base, "classifications").columns
    e = S.read_store(spark, base, "escalations").first()
    assert e.classification_id == 7 and e.resolved is False


def test_metrics_report_nested_row(spark):
    from ticketflow.sources.fixtures import classification_log
    log = classification_log(spark, SF)
    r = metrics_report(log).first()
    assert r.total_classifications == log.count()
    assert [x.language for x in r.per_language] == sorted(x.language for x in r.per_language)
    assert r.latency.p50_ms is not None and r.model_info.model_name


def test_stream_equals_batch(spark):
    from ticketflow.plans.queries import REGISTRY
    a = REGISTRY["stream_enrich"](spark, SF)
    b = REGISTRY["enrich_tickets"](spark, SF)
    assert a.count() == b.count() and a.exceptAll(b.select(*a.columns)).count() == 0
