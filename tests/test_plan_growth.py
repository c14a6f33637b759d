"""Steps whose cost must not be paid again per mention: what the optimizer moves, and what it may not."""

import datetime as dt
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from ticketflow.functions import text as TX
from ticketflow.functions.urgency import urgency_rules
from ticketflow.operators import gram_vectors as GV
from ticketflow.operators import language as L
from ticketflow.operators.intents import intent_hits, rank_intents, score_intents, sort_scores
from ticketflow.operators.language import add_function_word_vote, fit_ngram_profile, function_word_vote, score_ngram_profile
from ticketflow.plans.enrich import enrich_tickets
from ticketflow.plans.queries import REGISTRY
from ticketflow.sources import sinks
from ticketflow.sources.sinks import classification_rows, escalation_rows
from ticketflow.streaming.enrich import stream_enrich

TEXTS = ["refund my invoice now", "the app crashes", "El precio no es claro", "", None, "ÉTÉ à la plage",
         "invoice Invoice,invoice; refunds", "the the the no"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").repartition(2)


def test_sort_scores_scans_each_text_once(spark):
    for multi in (True, False):
        s = score_intents(texts(spark), "t", multi_label=multi)
        for out in (sort_scores(s, "id"), sort_scores(rank_intents(s), "id", "all_scores")):
            assert plan(out).count("regexp_extract_all") == plan(s).count("regexp_extract_all")
            assert out.count() == 6 * len(TEXTS)


def test_sort_scores_gives_no_row_for_an_empty_or_null_array(spark):
    rows = [(1, [("a", 0.5), ("b", 0.5)]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id long, intent_scores array<struct<label:string,score:double>>")
    assert sorted(map(tuple, sort_scores(df, "id").collect())) == [(1, 1, "a", 0.5), (1, 2, "b", 0.5)]


def test_intent_hits_scan_a_text_once(spark):
    lexicon = [("x", "ab", 2), ("x", "cd", 1), ("y", "ab", 5), ("y", "a-b", 7), ("x", "ab", 1)]
    df = spark.createDataFrame([(1, "ab cd,ab abc"), (2, ""), (3, None)], "id long, t string")
    out = df.select("id", intent_hits("t", lexicon, ["x", "y", "z"]).alias("h"))
    assert {r.id: r.h for r in out.collect()} == {1: [7, 10, 0], 2: [0, 0, 0], 3: [None, None, 0]}
    assert plan(df.repartition(2).select(intent_hits("t", lexicon, ["x", "y", "z"]).alias("h"))).count("regexp_extract_all") == 1


def test_escalation_rows_run_the_enrichment_once(spark):
    df = texts(spark).select(F.col("id").alias("event_id"), F.concat(F.lit("T-"), "id").alias("ticket_id"), F.col("t").alias("text"),
                             F.lit("Ann").alias("customer_name"), F.current_timestamp().alias("ts"))
    log = classification_rows(enrich_tickets(df), id_col="event_id")
    out = escalation_rows(log)
    assert plan(out).count("ArrowEvalPython") == 1
    assert plan(out).count("regexp_extract_all") <= plan(log).count("regexp_extract_all")


def test_escalation_rows_take_only_escalated_rows(spark):
    log = spark.createDataFrame([(1, True), (2, False), (3, None), (1, True)], "id long, was_escalated boolean").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp"))
    rows = escalation_rows(log).collect()
    assert [r.classification_id for r in rows] == [1, 1] and {r.resolved for r in rows} == {False}
    assert escalation_rows(log).columns == ["id", "ts", "classification_id", "reason", "resolved", "resolution_notes"]


def test_ngram_scores_each_text_once(spark):
    df = texts(spark).withColumn("lang", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    out = score_ngram_profile(df, fit_ngram_profile(df, "t"), "id", "t")
    assert plan(out).count("ArrowEvalPython") == 1
    assert {r.id for r in out.collect()} == {i for i, t in enumerate(TEXTS) if t}


def test_text_blocks_hold_few_texts(monkeypatch):
    monkeypatch.setattr(GV, "BLOCK_CHARS", 20)
    column = pa.array(["x" * 5, None, "é" * 9, "y" * 50, "", "z"])
    blocks = list(GV.text_blocks(column.slice(1)))
    assert [t for b in blocks for t in b] == column.to_pylist()[1:] and len(blocks) >= 3
    assert list(GV.text_blocks(pa.array([], pa.string()))) == []


def test_function_word_vote_counts_in_one_pass(spark):
    df = texts(spark)
    out = add_function_word_vote(df, "t")
    assert "regexp" not in plan(out)
    want = df.select("id", function_word_vote("t").alias("vote"))
    assert sorted(map(tuple, out.select("id", "vote").collect())) == sorted(map(tuple, want.collect()))


def test_a_micro_batch_of_few_files_is_dealt_out(spark, tmp_path):
    src = spark.range(400).select(F.concat(F.lit("T-"), "id").alias("ticket_id"), F.lit("the app crashes").alias("text"),
                                  F.lit("Ann").alias("customer_name"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream_enrich(spark, str(tmp_path / "in"), src.schema, str(tmp_path / "out"), str(tmp_path / "ck"), max_files_per_trigger=1)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 400
    # one file per task that had rows; the file read was one task
    assert len(out.inputFiles()) == min(400, spark.sparkContext.defaultParallelism)


def test_log_classifications_enriches_once(spark, tmp_path, monkeypatch):
    events = [(i, dt.datetime(2024, 1, 1 + i % 3, 5), None if i == 4 else i % 7, "view", None if i == 2 else float(i), "{}")
              for i in range(140)] + [(5, dt.datetime(2024, 1, 2), 3, "view", 1.0, "{}")]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    spark.createDataFrame([(k, f"c{k}") for k in (0, 1, 2, 3, 3)], "c_custkey long, c_name string").write.parquet(
        str(tmp_path / "customer.parquet"))
    logged, real = [], sinks.log_classifications
    monkeypatch.setattr(sinks, "log_classifications", lambda rows, *a, **kw: (logged.append(rows), real(rows, *a, **kw))[1])
    out = REGISTRY["log_classifications"](spark, str(tmp_path))
    assert len(logged) == 2 and not any("ArrowEvalPython" in plan(rows) for rows in logged)
    # a customer that is there twice gives its events twice
    assert out.count() == 141 + sum(e[2] == 3 for e in events)


def test_urgency_rules_run_no_lambda(spark):
    rules = [(1, "high", "crash", None), (2, "low", "prix", "fr"), (3, "low", "crash", None), (4, "high", "app", "fr")]
    df = spark.createDataFrame([(1, "the app crashes", "en"), (2, None, "en"), (3, "le prix", "fr"), (4, "app crash", None)],
                               "id long, t string, l string").repartition(2)
    out = df.select("id", urgency_rules("t", "l", rules).alias("r"))
    assert "lambda" not in plan(out)
    assert {r.id: r.r for r in out.collect()} == {1: ["high:crash", "low:crash"], 2: [], 3: ["low:prix:fr"], 4: ["high:crash", "low:crash"]}
    assert df.select(urgency_rules("t", "l", []).alias("r")).first().r == []


def test_a_latin_text_is_not_scanned_for_scripts(spark):
    assert L.BEYOND_LATIN in plan(texts(spark).select(L.script_language("t")))
    chars = spark.range(1, 0x3000).where(~F.col("id").between(0xD800, 0xDFFF)).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    anywhere = F.col("c").rlike("[" + L.KANA + "".join(L.SCRIPTS.values()) + "]")
    assert chars.where(anywhere).count() > 500
    assert chars.where(anywhere & ~F.col("c").rlike(L.BEYOND_LATIN)).count() == 0


def test_addresses_are_sought_where_an_at_sign_can_be(spark):
    ats = {c for c in map(chr, range(0x110000)) if "@" in unicodedata.normalize("NFKC", c)}
    assert ats == set(TX.AT_SIGNS[1:-1])
    df = spark.createDataFrame([(f"x a{c}b.co y",) for c in sorted(ats)] + [("x a b.co y",), (None,)], "t string").repartition(2)
    out = df.select("t", TX.clean_text("t").alias("c"))
    assert "RLIKE(t" in plan(out) and TX.AT_SIGNS in plan(out)
    assert sorted(r.c for r in out.collect()) == ["", "x [EMAIL] y", "x [EMAIL] y", "x [EMAIL] y", "x a b.co y"]


def test_word_alternation_groups_words_by_their_first_character(spark):
    words = ["app", "application", "a", "apps", "bé", "b", "bx", "a-b", ""]
    pattern = TX.word_alternation(words)
    assert pattern.count("a(?:") == 1 and pattern.count("b(?:") == 1
    text = "a app apps application applications bé bx by b,app a-b é"
    got = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(pattern), 0), TX.tokens("t")).first()
    assert got[0] == [t for t in got[1] if t in words]
