"""Exact global ranks, first rows and the percentile rule vs brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import ticketflow.operators.ranking as ranking
from ticketflow.operators.augment import english_head
from ticketflow.operators.metrics import latency_stats
from ticketflow.operators.ranking import first_per_group, kth_smallest, range_rank
from ticketflow.operators.splits import head_per_group
from ticketflow.sources.corpora import prepare_combined_dataset


def ordered(rows, key):
    """Rows sorted with nulls first."""
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in key(r)))


def test_rank_with_hot_group_null_group_and_null_keys(spark):
    rnd = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{i % 7}", rnd.choice([None, *range(50)]))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, k long")
    got = {r.id: r.rank0 for r in range_rank(df, ["k", "id"], ["g"]).collect()}
    for g in {r[1] for r in rows}:
        for pos, r in enumerate(ordered((r for r in rows if r[1] == g), lambda r: (r[2], r[0]))):
            assert got[r[0]] == pos


def test_rank_of_one_hot_key_and_of_strings(spark):
    rows = [(f"id{i:05d}", "same") for i in range(2000)]
    got = {r.id: r.rank0 for r in range_rank(spark.createDataFrame(rows, "id string, k string"), ["k", "id"]).collect()}
    assert [got[f"id{i:05d}"] for i in range(2000)] == list(range(2000))
    assert range_rank(spark.createDataFrame([], "id string, k string"), ["k"]).count() == 0


@pytest.mark.parametrize("n", [1000, 1001])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_first_rows_keep_null_groups_at_any_n(spark, n, kind):
    rows = [(i, ["a", "b", None][i % 3]) for i in range(3600)]
    df = spark.createDataFrame(rows, "id long, g string").selectExpr(
        "id" if kind == "long" else "lpad(cast(id as string), 6, '0') AS id", "g")
    got = {}
    for r in head_per_group(df, "g", ["id"], n).collect():
        got.setdefault(r.g, set()).add(int(r.id))
    assert {g: len(v) for g, v in got.items()} == {"a": n, "b": n, None: n}
    assert got[None] == {i for i, g in rows if g is None and i < 3 * n}


def test_first_rows_use_every_slice_of_a_hot_group(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(5000)], "id long, g string")
    assert {r.id for r in first_per_group(df, ["g"], ["id"], 7).collect()} == set(range(7))


def test_english_head_of_string_keys(spark):
    df = spark.createDataFrame([(f"k{i:04d}", "en" if i % 2 else "es") for i in range(300)], "id string, language string")
    assert sorted(r.id for r in english_head(df, 50, "id").collect()) == [f"k{i:04d}" for i in range(1, 100, 2)]


def test_combined_dataset_numbers_languages_before_large_ids(spark):
    rows = [(2**41 + i, f"english {i}", "en") for i in range(3)] + [(i, f"spanish {i}", "es") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = prepare_combined_dataset(df, ["en", "es"]).orderBy("row_index").collect()
    assert [r.language for r in got] == ["en"] * 3 + ["es"] * 3
    assert [r.row_index for r in got] == list(range(6))


def reference_latency(values):
    if not values:
        return (0.0, 0.0, 0.0, None, None, None)
    s = sorted(values)
    n = len(s)
    return (round(sum(s) / n, 2), round(s[0], 2), round(s[-1], 2), round(s[n // 2], 2),
            round(s[int(n * 0.95)], 2) if n > 1 else None, round(s[int(n * 0.99)], 2) if n > 1 else None)


def test_percentile_rule_examples(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 9)], "processing_time_ms double")
    r = latency_stats(df).first()
    assert r.p50_ms == 5.0                       # sorted[int(8 * 0.5)], not percentile_disc's 4
    one = latency_stats(spark.createDataFrame([(3.0,)], "processing_time_ms double")).first()
    assert one.p50_ms == 3.0 and one.p95_ms is None and one.p99_ms is None
    empty = latency_stats(spark.createDataFrame([], "processing_time_ms double")).first()
    assert (empty.mean_ms, empty.p50_ms) == (0.0, None)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=40), min_size=1, max_size=300))
def test_kth_smallest_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    n = len(values)
    ranks = {"a": 0, "b": n // 2, "c": n - 1, "d": int(n * 0.95)}
    got = kth_smallest(df, "v", ranks).first()
    s = sorted(values)
    for name, r in ranks.items():
        assert got[name] == pytest.approx(float(s[r]))


def test_percentiles_leave_nulls_out(spark):
    rows = [(float(v),) for v in range(1, 101)] + [(None,)] * 50
    r = latency_stats(spark.createDataFrame(rows, "processing_time_ms double")).first()
    assert (r.p50_ms, r.p95_ms, r.p99_ms) == (51.0, 96.0, 100.0)
    nulls = latency_stats(spark.createDataFrame(rows[100:], "processing_time_ms double")).first()
    assert (nulls.mean_ms, nulls.p50_ms) == (0.0, None)


def test_large_brackets_are_narrowed(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BRACKET_ROWS", 3)
    monkeypatch.setattr(ranking, "ACCURACY", 20)
    rnd = random.Random(3)
    values = [rnd.choice([7.0, rnd.random() * 100]) for _ in range(4000)]
    ranks = {"a": 0, "b": 1999, "c": 2600, "d": 3999, "e": None}
    got = kth_smallest(spark.createDataFrame([(v,) for v in values], "v double"), "v", ranks).first()
    s = sorted(values)
    assert [got[k] for k in "abcd"] == [s[ranks[k]] for k in "abcd"] and got["e"] is None


def test_one_hot_value(spark):
    df = spark.createDataFrame([(5.0,)] * 900 + [(1.0,), (9.0,)], "v double")
    got = kth_smallest(df, "v", {"first": 0, "mid": 450, "last": 901}).first()
    assert (got["first"], got["mid"], got["last"]) == (1.0, 5.0, 9.0)
