"""The metrics store: whole batches replaced, rollups, sketches."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ticketflow.operators import metrics as M
from ticketflow.operators import rollups as R
from ticketflow.session import scratch_dir
from ticketflow.sources import sinks as S


def log_rows(n, days=5, seed=1):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 3, 1)
    out = []
    for i in range(n):
        ts = t0 + dt.timedelta(days=rnd.randrange(days), seconds=rnd.randrange(86400))
        out.append((i, ts, "h", rnd.choice(["en", "fr", None]), rnd.choice(["billing", "account", None]),
                    rnd.choice([None, 0.1, 0.25, 0.333]), "low", rnd.choice([None, True, False]), rnd.random() < 0.5,
                    rnd.choice([None, 0.0, float(rnd.randrange(1000)), rnd.expovariate(0.01)]), ts.date()))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, S.CLASSIFICATIONS)


def test_a_rerun_with_fewer_dates_leaves_no_old_row(spark):
    base = scratch_dir(spark, "store-rerun")
    S.log_classifications(frame(spark, log_rows(50, seed=2)), base, "other/one: x")
    S.log_classifications(frame(spark, log_rows(5, days=5)), base, "nightly")
    S.log_classifications(frame(spark, log_rows(2, days=1)), base, "nightly")
    got = S.read_store(spark, base, "classifications")
    assert got.count() == 52
    assert S.read_rollup(spark, base, "rollups").agg(F.sum("n")).first()[0] == 52
    S.log_classifications(frame(spark, []), base, "nightly")
    assert S.read_store(spark, base, "classifications").count() == 50
    S.log_classifications(frame(spark, log_rows(3)), base)
    S.log_classifications(frame(spark, log_rows(3)), base)
    assert S.read_store(spark, base, "classifications").count() == 56


def test_uncommitted_writes_are_not_seen_and_vacuum_keeps_live_rows(spark, monkeypatch):
    base = scratch_dir(spark, "store-fail")
    S.log_classifications(frame(spark, log_rows(20)), base, "a")
    monkeypatch.setattr(R, "latency_rows", lambda log: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        S.log_classifications(frame(spark, log_rows(7)), base, "a")
    monkeypatch.undo()
    assert S.read_store(spark, base, "classifications").count() == 20
    S.log_classifications(frame(spark, log_rows(9)), base, "a")
    for k in (3, 4):
        S.log_escalations(S.escalation_rows(frame(spark, log_rows(40, seed=k))), base, "e")
    before = [S.read_store(spark, base, n).count() for n in ("classifications", "escalations")]
    assert S.vacuum_store(spark, base) > 0 and S.vacuum_store(spark, base) == 0
    assert [S.read_store(spark, base, n).count() for n in ("classifications", "escalations")] == before
    assert before[0] == 9 and before[1] == sum(r[7] is True for r in log_rows(40, seed=4))
    assert not any("_temporary" in p for p, _, _ in os.walk(base))


def test_report_from_rollups_equals_the_full_scan(spark):
    base = scratch_dir(spark, "store-report")
    S.log_classifications(frame(spark, log_rows(300, seed=5)), base, "x")
    S.log_classifications(frame(spark, log_rows(200, seed=6)), base, "y")
    S.log_classifications(frame(spark, log_rows(150, days=2, seed=7)), base, "x")
    log = S.read_store(spark, base, "classifications")
    assert log.count() == 350
    a = R.report(S.read_rollup(spark, base, "rollups"), S.read_rollup(spark, base, "latencies"), as_of="t").first().asDict(True)
    b = M.metrics_report(log, as_of="t").first().asDict(True)
    assert a["per_language"] == b["per_language"] and a["per_intent"] == b["per_intent"]
    assert (a["total_classifications"], a["model_info"]) == (b["total_classifications"], b["model_info"])
    assert [a["latency"][k] for k in ("mean_ms", "min_ms", "max_ms")] == [b["latency"][k] for k in ("mean_ms", "min_ms", "max_ms")]
    assert sorted(map(str, R.stats_by_language(S.read_rollup(spark, base, "rollups")).collect())) == sorted(
        map(str, M.stats_by_language(log).collect()))


def test_report_of_an_empty_store(spark):
    base = scratch_dir(spark, "store-empty")
    S.create_tables(spark, base)
    a = R.report(S.read_rollup(spark, base, "rollups"), S.read_rollup(spark, base, "latencies"), as_of="t").first()
    assert a.total_classifications == 0 and a.per_language == [] and a.per_intent == []
    assert a.latency.mean_ms == 0 and a.latency.p95_ms is None


def test_merged_sketches_stay_within_their_rank_error(spark):
    rnd = random.Random(9)
    rows = [(dt.datetime(2024, 1, 1, rnd.randrange(24)), "en" if i % 3 else "fr", rnd.lognormvariate(3, 2)) for i in range(60_000)]
    log = spark.createDataFrame(rows, "ts timestamp, language string, processing_time_ms double")
    found = {r.language: r for r in R.latency_quantiles(R.latency_rows(log), "language").collect()}
    for lang in ("en", "fr"):
        ms = sorted(r[2] for r in rows if r[1] == lang)
        for q, p in R.QUANTILES.items():
            value = found[lang][f"{q}_ms"]
            rank = sum(x <= value for x in ms) / len(ms)
            assert abs(rank - p) <= 3 * R.RANK_ERROR
    few = R.latency_quantiles(R.latency_rows(log.limit(300))).first()
    ms = sorted(r["processing_time_ms"] for r in log.limit(300).collect())
    assert few.p50_ms in (ms[149], ms[150])
