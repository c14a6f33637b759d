"""Stratified train / validation / test split (of rows or of whole groups), class counts, first-n per group.

The ratios must sum to one within a hundredth.  The split is stratified on
``stratify_col`` unless that column is missing or one of its classes has fewer
than two rows; the second stage (rest -> val / test) checks again on the rest.
Membership is a seeded hash rank: each row gets ``md5(id|seed)`` as a 60-bit key
and is ranked inside its stratum; a stratum of n rows sends the ceil(n * (val +
test)) highest ranks to the rest, and the rest sends ceil(n_rest * test /
(val + test)) highest to test.  Shares, coverage and reproducibility are the
contract; row membership is not the same as any other library's generator.

Ranks come from ``ranking.range_rank``, so a class that holds a third of all
rows is spread over many tasks; the driver sees two numbers (the number of
classes' rows at least and at most), never a list of strata.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.operators.ranking import first_per_group, range_rank

SPLITS = ("train", "val", "test")
RATIO_TOLERANCE = 0.01


def hash_key(id_col: str, seed: int) -> Column:
    """60-bit integer from md5(id|seed) (first 15 hex digits)."""
    h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def class_counts(df: DataFrame, stratify_col: str) -> DataFrame:
    return df.groupBy(stratify_col).agg(F.count(F.lit(1)).alias("n"))


def _sized(ranked: DataFrame, df: DataFrame, strat: str | None) -> DataFrame:
    """Adds ``_n``, the rows of the row's stratum (of the table without one)."""
    if strat is None:
        return ranked.withColumn("_n", F.lit(df.count()))
    sizes = class_counts(df, strat).select(F.col(strat).alias("_g"), F.col("n").alias("_n"))
    return ranked.join(sizes, F.col(strat).eqNullSafe(F.col("_g"))).drop("_g")


def stratified_split(df: DataFrame, id_col: str, train_ratio: float = 0.7, val_ratio: float = 0.15,
                     test_ratio: float = 0.15, stratify_col: str | None = "intent",
                     random_state: int = 42) -> DataFrame:
    """Adds ``split`` in (train, val, test).

    Inside a stratum the rest is the top of the rank order, so a row's rank
    within the rest is its rank minus the stratum's train count.  Only when
    the first stage is stratified and the second is not (a class left with
    fewer than two rest rows) is the rest ranked again.
    """
    shares = {"train": train_ratio, "val": val_ratio, "test": test_ratio}
    if not math.isclose(sum(shares.values()), 1.0, abs_tol=RATIO_TOLERANCE):
        raise ValueError(f"the shares {shares} do not add up to one")
    rest_ratio = val_ratio + test_ratio
    rel_test = test_ratio / rest_ratio if rest_ratio else 0.0
    strat = stratify_col if stratify_col in df.columns else None
    least = class_counts(df, strat).agg(F.min("n")).first()[0] if strat else None
    if least is None or least < 2:
        strat = None
    keyed = df.withColumn("_key", hash_key(id_col, random_state))
    r = _sized(range_rank(keyed, ["_key", id_col], [strat] if strat else None, "_r"), df, strat)
    n_rest = F.ceil(F.col("_n") * F.lit(rest_ratio))
    n_train = F.col("_n") - n_rest
    is_train = F.col("_r") < n_train
    out_cols = [*df.columns, "split"]
    if strat is None or math.ceil(least * rest_ratio) >= 2:
        n_test = F.ceil(n_rest * F.lit(rel_test))
        split = F.when(is_train, F.lit("train")).when(
            F.col("_r") - n_train < n_rest - n_test, F.lit("val")).otherwise(F.lit("test"))
        return r.withColumn("split", split).select(*out_cols)
    rest = r.filter(~is_train).drop("_r", "_n")
    again = _sized(range_rank(rest, ["_key", id_col], None, "_r"), rest, None)
    is_val = F.col("_r") < F.col("_n") - F.ceil(F.col("_n") * F.lit(rel_test))
    again = again.withColumn("split", F.when(is_val, F.lit("val")).otherwise(F.lit("test")))
    train = r.filter(is_train).withColumn("split", F.lit("train"))
    return train.select(*out_cols).unionByName(again.select(*out_cols))


def head_per_group(df: DataFrame, group_col: str, order_cols: list[str], n: int) -> DataFrame:
    """First ``n`` rows per group by an explicit order; a null group is a group."""
    return first_per_group(df, [group_col], order_cols, n)


# ---------------------------------------------------------------- whole groups

BUCKET_BITS = 12        # a stratum's running sums are split over this many hash buckets


def near_text_key(text: Column) -> Column:
    """Key that texts share which differ only in case, punctuation, white space or numbers."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.md5(F.trim(F.regexp_replace(words, "[0-9]+", "0")))


def grouped_split(df: DataFrame, group: Column, train_ratio: float = 0.7, val_ratio: float = 0.15,
                  test_ratio: float = 0.15, stratify_col: str | None = "intent", random_state: int = 42) -> DataFrame:
    """Adds ``split`` in (train, val, test); rows of one group are always on one side.

    A group's stratum is its most frequent class (ties: the smallest, null last).  Inside a stratum
    groups lie on a line in the order of a seeded hash, each as long as its rows, and go where
    their middle falls.  A group longer than half of the smallest share cannot hit a target; such
    groups go to train and the line holds the others, cut so that train has its share with them.

    Bound: in every stratum val and test, and train if its large groups do not exceed
    its share, differ from their share by at most half of the smallest share (that of the longest
    group on the line); large groups beyond train's share leave val and test the rest in proportion.

    The line's running sums go through hash buckets, so a stratum of many groups is many tasks; rows meet
    their group's split in a join that adaptive execution splits where one group holds many rows.
    Null ``stratify_col`` values are a class; null groups are one group.
    """
    shares = {"train": train_ratio, "val": val_ratio, "test": test_ratio}
    if not math.isclose(sum(shares.values()), 1.0, abs_tol=RATIO_TOLERANCE):
        raise ValueError(f"the shares {shares} do not add up to one")
    strat = F.col(stratify_col) if stratify_col in df.columns else F.lit(None).cast("string")
    per_class = df.select(group.alias("_key"), strat.alias("_class")).groupBy("_key", "_class").agg(
        F.count(F.lit(1)).alias("_n"))
    first = F.struct((-F.col("_n")).alias("n"), F.col("_class").isNull().alias("none"), F.col("_class").alias("class"))
    groups = per_class.groupBy("_key").agg(F.sum("_n").alias("_rows"), F.min(first)["class"].alias("_class"))
    text = F.concat_ws("|", F.coalesce(F.col("_key").cast("string"), F.lit("\0")), F.lit(str(random_state)))
    groups = groups.withColumn("_h", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))
    groups = _written(groups.withColumn("_bucket", F.shiftright("_h", 60 - BUCKET_BITS)), "split-groups")
    totals = groups.groupBy("_class").agg(F.sum("_rows").alias("_total"))
    least = min((r for r in shares.values() if r > 0), default=1.0)
    sized = groups.join(totals.withColumnRenamed("_class", "_c"), F.col("_class").eqNullSafe(F.col("_c"))).drop("_c")
    large = F.col("_rows") > F.lit(0.5 * least) * F.col("_total")
    sized = sized.withColumn("_large", large).withColumn("_line", F.when(large, 0).otherwise(F.col("_rows")))
    buckets = sized.groupBy("_class", "_bucket", "_total").agg(F.sum("_line").alias("_sum"))
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        F.col("_class").alias("_c"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
        F.sum("_sum").over(Window.partitionBy("_class")).alias("_length"))
    placed = sized.join(buckets, F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    here = Window.partitionBy("_class", "_bucket").orderBy("_h", "_key")
    middle = F.col("_start") + F.sum("_line").over(here) - F.col("_line") / 2
    train = F.greatest(F.lit(train_ratio) * F.col("_total") - (F.col("_total") - F.col("_length")), F.lit(0.0))
    rest = val_ratio + test_ratio
    val = train + (F.col("_length") - train) * F.lit(val_ratio / rest if rest else 0.0)
    split = F.when(F.col("_large"), F.lit("train")).when(F.col("_middle") < train, F.lit("train")).when(
        F.col("_middle") < val, F.lit("val")).otherwise(F.lit("test" if test_ratio > 0 else "val" if val_ratio > 0 else "train"))
    sides = placed.withColumn("_middle", middle).select(F.col("_key").alias("_side_key"), split.alias("split"))
    rows = df.drop("split").withColumn("_key", group)
    return rows.join(sides, F.col("_key").eqNullSafe(F.col("_side_key"))).drop("_key", "_side_key")


def _written(df: DataFrame, name: str) -> DataFrame:
    from ticketflow.session import scratch_dir

    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
