"""Streaming metrics: windows per language, late rows, timers and replays."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from ticketflow.session import scratch_dir
from ticketflow.streaming import metrics as M

SCHEMA = ("id long, ts timestamp_ntz, language string, primary_intent string, confidence double, "
          "needs_review boolean, was_escalated boolean, processing_time_ms double")
T0 = dt.datetime(2024, 1, 1, 0, 10)


def rows(ts_list, lang="en"):
    return [(i, ts, lang, "billing", 0.5, True, False, 10.0) for i, ts in enumerate(ts_list)]


def run(spark, parts, **kw):
    src, sink, ck = (scratch_dir(spark, f"st-{x}") for x in ("src", "out", "ck"))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)         # files are read in the order of their times
    M.stream_metrics(spark, src, spark.createDataFrame([], SCHEMA).schema, sink, ck, **kw)
    return src, sink, ck


def hours(n, minutes=0):
    return T0 + dt.timedelta(hours=n, minutes=minutes)


def test_late_rows_correct_their_window_at_once(spark):
    late = rows([hours(0, 20)]) + rows([hours(0)] * 2, None) + rows([hours(1)], "fr") + rows([None])
    src, sink, _ = run(spark, [rows([hours(0), hours(5)]), rows([hours(5, 5)]), late, rows([hours(5, 7)])])
    got = {(r.window_start.hour, r.language): (r.total, r.n_late, r.is_final) for r in M.latest_windows(spark, sink).collect()}
    assert got == {(0, "en"): (2, 1, True), (0, None): (2, 2, True), (1, "fr"): (1, 1, True), (5, "en"): (3, 0, False)}
    kept = {(r.window_start.hour, r.language): (r.batch_id, r.n_late) for r in M.late_rows(spark, sink).collect()}
    assert kept == {(0, "en"): (2, 1), (0, None): (2, 2), (1, "fr"): (2, 1)}


def test_rows_later_than_the_retention_are_added_on_reading(spark):
    src, sink, _ = run(spark, [rows([hours(0), hours(0, 5)]), rows([hours(200)]), rows([hours(201)]),
                               rows([hours(0, 9)] * 3), rows([hours(0, 1)]), rows([hours(1)], "de")], retention="1 day")
    got = {(r.window_start.day, r.window_start.hour, r.language): (r.total, r.n_late)
           for r in M.latest_windows(spark, sink).collect()}
    assert got[(1, 0, "en")] == (6, 4) and got[(1, 1, "de")] == (1, 1)
    # the state goes one batch after the watermark passed its release; rows after that are differences
    assert M._read(spark, sink, "difference").agg(F.sum("total")).first()[0] == 2


def test_any_order_and_a_second_run_equal_the_batch_result(spark):
    rnd = random.Random(3)
    data = [(i, hours(rnd.randrange(30), rnd.randrange(50)), rnd.choice(["en", "fr", None]), "x",
             rnd.choice([None, 0.1, 0.25, 1 / 3]), rnd.choice([None, True, False]), rnd.random() < 0.3,
             rnd.choice([None, 0.0, 5.0, rnd.expovariate(0.01)])) for i in range(400)]
    src, sink, ck = run(spark, [data[i::4] for i in range(4)], watermark="1 hour", retention="5 hours")
    extra = rows([hours(2)] * 7, "fr")
    spark.createDataFrame(extra, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    M.stream_metrics(spark, src, spark.createDataFrame([], SCHEMA).schema, sink, ck, watermark="1 hour", retention="5 hours")
    got = {(r.window_start, r.language): r for r in M.latest_windows(spark, sink).collect()}
    want = {}
    for r in data + extra:
        want.setdefault((r[1].replace(minute=0), r[2]), []).append(r)
    assert got.keys() == want.keys()
    for key, group in want.items():
        r = got[key]
        assert (r.total, r.review_count, r.escalation_count) == (
            len(group), sum(bool(x[5]) for x in group), sum(bool(x[6]) for x in group))
        assert r.avg_confidence == pytest.approx(sum(x[4] or 0 for x in group) / len(group), abs=1e-4)
        ms = sorted(x[7] for x in group if x[7] is not None)
        exact = ms[min(int(len(ms) * 0.95), len(ms) - 1)] if ms else None
        assert r.p95_ms_approx == (None if exact is None else pytest.approx(exact, rel=0.0101, abs=1e-12))


def test_intervals():
    assert [M.seconds(x) for x in ("1 hour", "30 minutes", "2 days", "1 week", "5 seconds")] == [3600, 1800, 172800, 604800, 5]
