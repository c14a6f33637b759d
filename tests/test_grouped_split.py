"""Splits of whole groups: no shared group, shares within the bound, seeded."""

import random

import pytest
from pyspark.sql import functions as F

from ticketflow.operators.splits import grouped_split, near_text_key


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, text string, intent string, split string")


def texts(n, seed, hot=0):
    rnd = random.Random(seed)
    rows = [(i, f"text {rnd.choice('abcdefgh')} {chr(97 + rnd.randrange(26)) * 3} {chr(97 + rnd.randrange(26)) * 2}",
             rnd.choice(["x", "x", "y", None]), "old") for i in range(n)]
    return rows + [(n + i, "the hot text", "x", "old") for i in range(hot)]


@pytest.mark.parametrize("hot", [0, 700])
@pytest.mark.parametrize("ratios", [(0.7, 0.15, 0.15), (0.5, 0.5, 0.0), (1.0, 0.0, 0.0), (0.0, 0.5, 0.5)])
def test_groups_stay_whole_and_shares_hold(spark, hot, ratios):
    df = frame(spark, texts(3000, 4, hot))
    out = grouped_split(df, near_text_key(F.col("text")), *ratios).withColumn("k", near_text_key(F.col("text"))).cache()
    assert out.count() == 3000 + hot and out.columns.count("split") == 1
    assert out.groupBy("k").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    # strata: a group's most frequent class
    cls = out.groupBy("k", "intent").count().groupBy("k").agg(
        F.min(F.struct((-F.col("count")).alias("c"), F.col("intent").isNull().alias("z"), "intent"))["intent"].alias("cls"))
    rows = out.join(cls, "k").groupBy("cls", "split").count().collect()
    least = min(r for r in ratios if r)
    for c in {r.cls for r in rows}:
        n = sum(r["count"] for r in rows if r.cls == c)
        got = {r.split: r["count"] for r in rows if r.cls == c}
        big = hot if c == "x" and hot > 0.5 * least * n else 0
        for name, ratio in zip(("train", "val", "test"), ratios):
            if big <= ratios[0] * n:
                assert abs(got.get(name, 0) - ratio * n) <= 0.5 * least * n + 1
        if big:
            assert got["train"] >= big


def test_seeded_and_independent_of_the_partitions(spark):
    df = frame(spark, texts(800, 6))
    run = lambda d, seed: sorted((r.id, r.split) for r in grouped_split(d, near_text_key(F.col("text")), random_state=seed).collect())
    assert run(df, 1) == run(df.repartition(7), 1) != run(df, 2)


def test_near_equal_texts_share_a_key(spark):
    same = ["Order 17, please!", "order 923 please", "  ORDER 0\nplease?? "]
    other = ["order please", "orders 1 please", None, "", "!!"]
    df = spark.createDataFrame([(t,) for t in same + other], "t string").select(near_text_key(F.col("t")).alias("k"))
    keys = [r.k for r in df.collect()]
    assert len(set(keys[:3])) == 1 and len(set(keys)) == 4 and len(set(keys[5:])) == 1


def test_few_rows_and_bad_shares(spark):
    df = frame(spark, [(1, "a", "x", ""), (2, None, None, ""), (3, "A!", "y", "")])
    got = {r.id: r.split for r in grouped_split(df, near_text_key(F.col("text"))).collect()}
    assert got[1] == got[3] and len(got) == 3
    assert grouped_split(df.limit(0), near_text_key(F.col("text"))).count() == 0
    assert grouped_split(df.drop("intent"), F.col("id")).count() == 3
    with pytest.raises(ValueError):
        grouped_split(df, F.col("id"), 0.5, 0.1, 0.1)
