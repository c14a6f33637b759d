"""Aggregates over the classification log (the metrics store read side).

Log rows: id, ts, text_hash, language, primary_intent, confidence, urgency,
was_escalated, needs_review, processing_time_ms.  All aggregates are partial
(map-side) aggregations; per-language / per-intent outputs are bounded by
the number of languages and intents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow import config as C
from ticketflow.operators.ranking import kth_smallest


def stats_by_language(log: DataFrame) -> DataFrame:
    return log.groupBy("language").agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.count_if(F.col("needs_review")).alias("review_count"),
        F.count_if(F.col("was_escalated")).alias("escalation_count"),
    )


def language_rates(stats: DataFrame) -> DataFrame:
    """Rates = count / max(total, 1), unrounded."""
    denom = F.greatest(F.col("total"), F.lit(1))
    return stats.select(
        "language",
        F.col("total").alias("total_classifications"),
        "avg_confidence",
        (F.col("review_count") / denom).alias("review_rate"),
        (F.col("escalation_count") / denom).alias("escalation_rate"),
    )


def intent_distribution(log: DataFrame) -> DataFrame:
    return log.groupBy(F.col("primary_intent").alias("intent")).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
    )


def total_classifications(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total_classifications"))


LATENCY_SCHEMA = "mean_ms double, min_ms double, max_ms double, p50_ms double, p95_ms double, p99_ms double"


def latency_stats(log: DataFrame, col: str = "processing_time_ms",
                  stats: tuple | None = None) -> DataFrame:
    """mean/min/max and p50/p95/p99, 2 dp, of the non-null values.

    Percentile p is the value at 0-based position int(n*p) of the n sorted
    non-null values (p50 at n//2).  No value: zeros and null percentiles; one
    value: p50 only.  Positions are found by ``ranking.kth_smallest``, never
    by sorting all rows in one task.
    ``stats`` = (count, mean, min, max) when the caller already has them.
    """
    spark = log.sparkSession
    if stats is None:
        stats = tuple(log.agg(F.count(col), F.avg(col), F.min(col), F.max(col)).first())
    n, mean, mn, mx = stats
    if not n:
        return spark.createDataFrame([(0.0, 0.0, 0.0, None, None, None)], LATENCY_SCHEMA)
    ranks = {
        "p50": n // 2,
        "p95": int(n * 0.95) if n > 1 else None,
        "p99": int(n * 0.99) if n > 1 else None,
    }
    pct = kth_smallest(log.select(col), col, ranks)
    return pct.select(
        F.round(F.lit(float(mean)), 2).alias("mean_ms"),
        F.round(F.lit(float(mn)), 2).alias("min_ms"),
        F.round(F.lit(float(mx)), 2).alias("max_ms"),
        F.round("p50", 2).alias("p50_ms"),
        F.round("p95", 2).alias("p95_ms"),
        F.round("p99", 2).alias("p99_ms"),
    )


def recent_escalations(escalations: DataFrame, log: DataFrame, limit: int = 50) -> DataFrame:
    """Newest escalations (ts desc, id desc as tie-breaker) with log details.

    The limit is applied before the join: a left join on the unique log id
    keeps escalation rows one to one, so this is the same result, and the
    large log is only streamed once against a broadcast of ``limit`` keys.
    """
    from ticketflow.session import materialize

    # ``limit`` rows, read three times below
    top = materialize(escalations.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit))
    details = log.select(F.col("id").alias("_cid"), "language", "primary_intent", "confidence")
    keys = top.select(F.col("classification_id").alias("_cid")).distinct()
    matched = details.join(F.broadcast(keys), "_cid", "left_semi")
    return top.join(matched, top["classification_id"] == matched["_cid"], "left").drop("_cid")


def metrics_report(log: DataFrame, as_of=None, model_name: str = C.MODEL_NAME,
                   intent_categories: list | None = None) -> DataFrame:
    """One nested row: timestamp, total, per_language[], per_intent[], latency{}, model_info{}.

    Everything but the percentiles comes from one pass (``log_summary``); the
    summary's few rows are folded into one.
    """
    from ticketflow.session import materialize

    cats = intent_categories or C.INTENT_CATEGORIES
    summ = materialize(log_summary(log))
    kind = lambda k: F.col("kind") == k
    denom = F.greatest(F.col("total"), F.lit(1))
    lang = F.struct(F.col("key").alias("language"), F.col("total").alias("total_classifications"), "avg_confidence",
                    (F.col("review_count") / denom).alias("review_rate"),
                    (F.col("escalation_count") / denom).alias("escalation_rate"))
    intent = F.struct(F.col("key").alias("intent"), F.col("total").alias("count"), "avg_confidence")
    t = summ.filter(kind("total")).select("lat_n", "lat_mean", "lat_min", "lat_max").first()
    lat = latency_stats(log, stats=tuple(t) if t is not None else (0, None, None, None))
    folded = summ.agg(
        F.coalesce(F.max(F.when(kind("total"), F.col("total"))), F.lit(0)).alias("total_classifications"),
        F.array_sort(F.collect_list(F.when(kind("language"), lang))).alias("per_language"),
        F.array_sort(F.collect_list(F.when(kind("intent"), intent))).alias("per_intent"))
    ts = F.current_timestamp() if as_of is None else F.lit(as_of)
    both = folded.unionByName(lat.select(F.struct("*").alias("latency")), allowMissingColumns=True).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in
          ["total_classifications", "per_language", "per_intent", "latency"]])
    return both.select(
        ts.alias("timestamp"), "total_classifications", "per_language", "per_intent", "latency",
        F.struct(F.lit(model_name).alias("model_name"),
                 F.array(*[F.lit(c) for c in cats]).alias("intent_categories")).alias("model_info"),
    )


def log_summary(log: DataFrame) -> DataFrame:
    """One pass over the log: GROUPING SETS ((language), (primary_intent), ()).

    Columns: kind (language / intent / total), key, total, sum_confidence is
    kept as avg, review_count, escalation_count.  Per-language stats, the
    intent distribution and the total all come from this one aggregate.
    """
    g = log.groupingSets([[F.col("language")], [F.col("primary_intent")], []],
                         "language", "primary_intent").agg(
        F.count(F.lit(1)).alias("total"),
        F.avg("confidence").alias("_avg"),
        F.count_if(F.col("needs_review")).alias("review_count"),
        F.count_if(F.col("was_escalated")).alias("escalation_count"),
        F.count("processing_time_ms").alias("lat_n"), F.avg("processing_time_ms").alias("lat_mean"),
        F.min("processing_time_ms").alias("lat_min"), F.max("processing_time_ms").alias("lat_max"),
        F.grouping_id().alias("_gid"))
    kind = F.when(F.col("_gid") == 1, F.lit("language")).when(F.col("_gid") == 2, F.lit("intent")) \
        .otherwise(F.lit("total"))
    key = F.when(F.col("_gid") == 1, F.col("language")).when(F.col("_gid") == 2, F.col("primary_intent"))
    return g.select(kind.alias("kind"), key.alias("key"), "total",
                    F.round("_avg", 4).alias("avg_confidence"), "review_count", "escalation_count",
                    "lat_n", "lat_mean", "lat_min", "lat_max")


def metrics_report_long(log: DataFrame) -> DataFrame:
    """The report as (section, key, metric, value) rows, for comparison/export.

    Counts and averages come from the single ``log_summary`` pass (a tiny,
    checkpointed table); latency from the histogram path.
    """
    from ticketflow.session import materialize

    summ = materialize(log_summary(log))  # one row per language / intent + total
    denom = F.greatest(F.col("total"), F.lit(1))
    lang_long = summ.filter(F.col("kind") == "language").select(
        F.lit("per_language").alias("section"), "key",
        F.explode(F.create_map(
            F.lit("total_classifications"), F.col("total").cast("double"),
            F.lit("avg_confidence"), F.col("avg_confidence"),
            F.lit("review_rate"), F.col("review_count") / denom,
            F.lit("escalation_rate"), F.col("escalation_count") / denom)).alias("metric", "value"))
    intent_long = summ.filter(F.col("kind") == "intent").select(
        F.lit("per_intent").alias("section"), "key",
        F.explode(F.create_map(
            F.lit("count"), F.col("total").cast("double"),
            F.lit("avg_confidence"), F.col("avg_confidence"))).alias("metric", "value"))
    t = summ.filter(F.col("kind") == "total").select("lat_n", "lat_mean", "lat_min", "lat_max").first()
    lat = latency_stats(log, stats=tuple(t) if t is not None else (0, None, None, None))
    lat_long = lat.select(
        F.lit("latency").alias("section"), F.lit(None).cast("string").alias("key"),
        F.explode(F.create_map(*[x for c in lat.columns for x in (F.lit(c), F.col(c))]))
        .alias("metric", "value"))
    tot = summ.filter(F.col("kind") == "total").select(
        F.lit("total").alias("section"), F.lit(None).cast("string").alias("key"),
        F.lit("total_classifications").alias("metric"), F.col("total").cast("double").alias("value"))
    return lang_long.unionByName(intent_long).unionByName(lat_long).unionByName(tot)
