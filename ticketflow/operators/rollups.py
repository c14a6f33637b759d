"""Rollups of the metrics store: small tables that reports read instead of the log.

Two rollups are made from every batch of classifications when it is logged:

* ``rollups``: counts and exact sums per (date, language, intent);
* ``latencies``: per (hour, language) the count, sum, extremes and a mergeable
  KLL quantile sketch of the processing times.

They belong to the batch's version (see ``sources.sinks``): when a batch is
replaced, the rows of the version before stop counting, and nothing has to be
subtracted.  Sketches of any hours, languages and batches merge on reading; a
quantile's rank is within ``RANK_ERROR`` of the asked one (99 % confidence for
the sketch's size), as close after merging as before.  Up to about ``SKETCH_K``
values a sketch holds all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow import config as C

SKETCH_K = 800
RANK_ERROR = 2.296 / SKETCH_K ** 0.9723      # published bound of the sketch, 0.35 % here
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
MONEY = "decimal(38,10)"                     # exact sums: no dependence on the order of rows


def rollup_rows(log: DataFrame) -> DataFrame:
    """(date, language, intent) -> counts and the exact sum of confidences."""
    return log.groupBy(F.to_date("ts").alias("date"), "language", F.col("primary_intent").alias("intent")).agg(
        F.count(F.lit(1)).alias("n"), F.count("confidence").alias("n_confidence"),
        F.sum(F.col("confidence").cast(MONEY)).cast(MONEY).alias("sum_confidence"),
        F.count_if(F.col("needs_review")).alias("review_count"),
        F.count_if(F.col("was_escalated")).alias("escalation_count"))


def latency_rows(log: DataFrame, col: str = "processing_time_ms") -> DataFrame:
    """(hour, language) -> count, sum, extremes and quantile sketch of the non-null values."""
    ms = F.col(col)
    return log.where(ms.isNotNull() & ~F.isnan(ms)).groupBy(F.date_trunc("hour", "ts").alias("hour"), "language").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ms.cast(MONEY)).cast(MONEY).alias("sum_ms"),
        F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.kll_sketch_agg_double(ms, SKETCH_K).alias("sketch"))


def _mean(total: str, n: str, digits: int):
    return F.round(F.col(total) / F.col(n), digits).cast("double")


def stats_by_language(rollups: DataFrame) -> DataFrame:
    """``metrics.stats_by_language`` from rollups."""
    return _sums(rollups, "language").select(
        "language", "total", _mean("sum_confidence", "n_confidence", 4).alias("avg_confidence"),
        "review_count", "escalation_count")


def intent_distribution(rollups: DataFrame) -> DataFrame:
    """``metrics.intent_distribution`` from rollups."""
    return _sums(rollups, "intent").select(
        "intent", F.col("total").alias("count"), _mean("sum_confidence", "n_confidence", 4).alias("avg_confidence"))


def _sums(rollups: DataFrame, *by: str) -> DataFrame:
    return rollups.groupBy(*by).agg(
        F.sum("n").alias("total"), F.nullif(F.sum("n_confidence"), F.lit(0)).alias("n_confidence"),
        F.sum("sum_confidence").alias("sum_confidence"), F.sum("review_count").alias("review_count"),
        F.sum("escalation_count").alias("escalation_count"))


def latency_quantiles(latencies: DataFrame, *by: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """``by`` columns, n, mean/min/max and one column per quantile, from merged sketches."""
    quantiles = quantiles or QUANTILES
    merged = latencies.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("sum_ms").alias("sum_ms"), F.min("min_ms").alias("min_ms"),
        F.max("max_ms").alias("max_ms"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    some = F.col("n") > 0
    return merged.select(
        *by, F.coalesce("n", F.lit(0)).alias("n"), F.when(some, _mean("sum_ms", "n", 2)).alias("mean_ms"),
        F.round("min_ms", 2).alias("min_ms"), F.round("max_ms", 2).alias("max_ms"),
        *(F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(f"{name}_ms")
          for name, q in quantiles.items()))


def report(rollups: DataFrame, latencies: DataFrame, as_of=None, model_name: str = C.MODEL_NAME,
           intent_categories: list | None = None) -> DataFrame:
    """``metrics.metrics_report`` from rollups: the same nested row, percentiles from sketches."""
    stats = stats_by_language(rollups)
    rate = lambda c: F.col(c) / F.greatest(F.col("total"), F.lit(1))
    languages = stats.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_classifications"),
        F.array_sort(F.collect_list(F.struct(
            "language", F.col("total").alias("total_classifications"), "avg_confidence",
            rate("review_count").alias("review_rate"), rate("escalation_count").alias("escalation_rate")))).alias("per_language"))
    intents = intent_distribution(rollups).agg(
        F.array_sort(F.collect_list(F.struct("intent", "count", "avg_confidence"))).alias("per_intent"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    latency = latency_quantiles(latencies).select(F.struct(
        zero("mean_ms"), zero("min_ms"), zero("max_ms"), *(F.col(f"{q}_ms") for q in QUANTILES)).alias("latency"))
    # one row each: folded with first(), not joined
    parts = languages.unionByName(intents, allowMissingColumns=True).unionByName(latency, allowMissingColumns=True)
    both = parts.agg(*(F.first(c, ignorenulls=True).alias(c) for c in
                       ("total_classifications", "per_language", "per_intent", "latency")))
    ts = F.current_timestamp() if as_of is None else F.lit(as_of)
    return both.select(
        ts.alias("timestamp"), "total_classifications", "per_language", "per_intent", "latency",
        F.struct(F.lit(model_name).alias("model_name"),
                 F.array(*[F.lit(c) for c in intent_categories or C.INTENT_CATEGORIES]).alias("intent_categories"))
        .alias("model_info"))
