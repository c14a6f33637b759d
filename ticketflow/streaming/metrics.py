"""Streaming metrics: windows per language over the classification log, late rows included.

A micro-batch is first summed per task (window, language, latency bucket), so
a hot language is a few rows per task.  ``transformWithState`` keeps one keyed
state per (window, language): totals and a latency histogram.  Event time has
a watermark (default 2 hours behind the greatest event time seen).

* Every batch emits the windows it changed; when the watermark passes a
  window's end, a timer emits it once more as final.
* A row of a window that the watermark has passed is late.  It is not dropped:
  its window is corrected and emitted at once, and the late part is written to
  a sink of its own.  (Spark's own rule would drop it; the event-time column
  itself does not reach the stateful operator, only numbers made from it.)
* A second timer releases the state ``retention`` after the window's end.
  Rows later than that are emitted as differences and added on reading, so no
  row is lost however late it comes, and the state stays bounded.

Each batch writes its own folders with overwrite; a batch replayed after a
failure starts from the same state and replaces its output.  ``latest_windows``
is the last version of every window plus its differences and equals the batch
aggregate of all rows; the source is never read again.  The latency percentile
comes from buckets of relative width ``GAMMA``: its value is within 1 % of the
exact one.  Rows without ``ts`` belong to no window.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ticketflow.session import ship_package

GAMMA = 1.02                # width of a latency bucket: values within 1 % of its middle
NO_LATENCY, ZERO = -(1 << 30), -(1 << 29)
UNIT = 10 ** 10             # confidences are summed as integers of 1 / UNIT
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

PARTS = "start long, lang string, bucket int, n long, units decimal(38,0), review long, escalated long"
OUT = ("kind string, start long, lang string, total long, sum_confidence decimal(38,10), review_count long, "
       "escalation_count long, p95_ms_approx double, n_late long, is_final boolean, buckets array<int>, counts array<long>")
STATE = ("total long, units decimal(38,0), review long, escalated long, n_late long, buckets array<int>, "
         "counts array<long>, is_final boolean")


def seconds(interval: str) -> int:
    """Seconds of "2 hours", "30 minutes", "1 day" ..."""
    count, unit = interval.split()
    sizes = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    return int(count) * sizes[unit.rstrip("s")]


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each batch per (start, lang, bucket)."""
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch]).group_by(["start", "lang", "bucket"]).aggregate(
                [("n", "sum"), ("units", "sum"), ("review", "sum"), ("escalated", "sum")])
            t = t.select(["start", "lang", "bucket", "n_sum", "units_sum", "review_sum", "escalated_sum"])
            t = t.rename_columns(["start", "lang", "bucket", "n", "units", "review", "escalated"])
            yield from t.set_column(4, "units", t.column("units").cast(pa.decimal128(38, 0))).to_batches()


def log_parts(log: DataFrame, window: str = "1 hour") -> DataFrame:
    """Partial sums of the log per task: start (seconds), lang ('' null, '=' + language), bucket."""
    width = seconds(window)
    ms = F.col("processing_time_ms")
    bucket = F.when(ms.isNull() | F.isnan(ms), F.lit(NO_LATENCY)).when(ms <= 0, F.lit(ZERO)).otherwise(
        F.ceil(F.log(ms) / math.log(GAMMA))).cast("int")
    ts = F.col("ts").cast("timestamp")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    rows = log.where(F.col("ts").isNotNull()).select(
        (F.floor(F.unix_timestamp(ts) / width) * width).alias("start"),
        F.coalesce(F.concat(F.lit("="), F.col("language")), F.lit("")).alias("lang"), bucket.alias("bucket"),
        F.lit(1).cast("long").alias("n"),
        (F.coalesce(F.col("confidence"), F.lit(0.0)).cast("decimal(38,10)") * UNIT).cast("long").alias("units"),
        flag("needs_review").alias("review"), flag("was_escalated").alias("escalated"))
    return rows.mapInArrow(_sum_parts, PARTS)


def bucket_quantile(buckets: list[int], counts: list[int], q: float) -> float | None:
    """Middle of the bucket that holds the value at 0-based position int(n * q)."""
    known = sorted((b, c) for b, c in zip(buckets, counts) if b != NO_LATENCY)
    n = sum(c for _, c in known)
    if not n:
        return None
    at = min(int(n * q), n - 1)
    for b, c in known:
        at -= c
        if at < 0:
            return 0.0 if b == ZERO else 2 * GAMMA ** b / (GAMMA + 1)
    return None


class WindowTotals(StatefulProcessor):
    """Totals of one (start, lang); timers at the window's end and at its release."""

    def __init__(self, width: int, retention: int):
        self.width, self.retention = width, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", STATE)

    def _row(self, key, kind, state, sums=None) -> dict:
        total, units, review, escalated, n_late, buckets, counts, final = state if sums is None else sums
        return {"kind": kind, "start": int(key[0]), "lang": key[1], "total": int(total),
                "sum_confidence": Decimal(int(units)).scaleb(-10), "review_count": int(review),
                "escalation_count": int(escalated), "p95_ms_approx": bucket_quantile(list(buckets), list(counts), 0.95),
                "n_late": int(n_late), "is_final": bool(final),
                "buckets": [int(b) for b in buckets], "counts": [int(c) for c in counts]}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = int(key[0]) + self.width
        passed = timerValues.getCurrentWatermarkInMs()
        late = end * 1000 <= passed
        n = units = review = escalated = 0
        hist: dict[int, int] = {}
        for part in rows:
            n += int(part["n"].sum())
            units += sum(int(u) for u in part["units"])
            review += int(part["review"].sum())
            escalated += int(part["escalated"].sum())
            for b, c in zip(part["bucket"], part["n"]):
                hist[int(b)] = hist.get(int(b), 0) + int(c)
        delta = (n, units, review, escalated, n if late else 0, list(hist), list(hist.values()), late)
        out = [self._row(key, "late", delta)] if late else []
        if not self.totals.exists() and late and (end + self.retention) * 1000 <= passed:
            # the state is released: a difference that is added on reading
            out.append(self._row(key, "difference", delta))
        else:
            if self.totals.exists():
                old = self.totals.get()
                for b, c in zip(old[5], old[6]):
                    hist[int(b)] = hist.get(int(b), 0) + int(c)
                n, units = n + int(old[0]), units + int(old[1])
                review, escalated = review + int(old[2]), escalated + int(old[3])
                n_late = delta[4] + int(old[4])
            else:
                n_late = delta[4]
                self.handle.registerTimer(((end + self.retention) if late else end) * 1000)
            state = (n, Decimal(units), review, escalated, n_late, list(hist), list(hist.values()), late)
            self.totals.update(state)
            out.append(self._row(key, "window", state))
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = int(key[0]) + self.width
        if expiredTimerInfo.getExpiryTimeInMs() >= (end + self.retention) * 1000:
            self.totals.clear()
            return
        self.handle.registerTimer((end + self.retention) * 1000)
        if self.totals.exists():
            state = (*self.totals.get()[:7], True)
            self.totals.update(state)
            yield pd.DataFrame([self._row(key, "window", state)])

    def close(self) -> None:
        pass


def stream_metrics(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                   window: str = "1 hour", watermark: str = "2 hours", retention: str = "7 days",
                   max_files_per_trigger: int | None = 1):
    """Read all files that are there and write window versions, late parts and differences."""
    ship_package(spark)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    log = reader.parquet(source_dir).withColumn("__event", F.col("ts").cast("timestamp")).withWatermark("__event", watermark)
    windows = log_parts(log, window).groupBy("start", "lang").transformWithStateInPandas(
        WindowTotals(seconds(window), seconds(retention)), OUT, "Update", "EventTime")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch_id", F.lit(batch_id)).persist()
        for kind in ("window", "late", "difference"):
            batch.where(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(
                os.path.join(sink_dir, kind, f"batch={batch_id}"))
        batch.unpersist()

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)       # keyed state with timers needs this store
    try:
        q = (windows.writeStream.outputMode("update").foreachBatch(per_batch)
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return q


def _read(spark: SparkSession, sink_dir: str, kind: str) -> DataFrame:
    schema = OUT.replace("kind string, ", "") + ", batch_id int, batch int"
    return spark.read.schema(schema).parquet(os.path.join(sink_dir, kind)).drop("batch")


def latest_windows(spark: SparkSession, sink_dir: str, window: str = "1 hour") -> DataFrame:
    """Every (window, language) with all its rows, rates, ``n_late`` and ``is_final``."""
    newest = Window.partitionBy("start", "lang").orderBy(F.col("batch_id").desc(), F.col("total").desc(),
                                                         F.col("is_final").desc())
    last = _read(spark, sink_dir, "window").withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")
    both = last.unionByName(_read(spark, sink_dir, "difference"))
    sums = both.groupBy("start", "lang").agg(
        *(F.sum(c).alias(c) for c in ("total", "sum_confidence", "review_count", "escalation_count", "n_late")),
        F.bool_or("is_final").alias("is_final"),
        F.flatten(F.collect_list(F.arrays_zip("buckets", "counts"))).alias("hist"))

    @F.pandas_udf("double")
    def p95(hist: pd.Series) -> pd.Series:
        return pd.Series([bucket_quantile([h["buckets"] for h in x], [h["counts"] for h in x], 0.95) for x in hist], dtype="float64")

    width = seconds(window)
    at = lambda s: F.timestamp_seconds(s).cast("timestamp_ntz")
    return _with_rates(sums.select(
        at(F.col("start")).alias("window_start"), at(F.col("start") + width).alias("window_end"),
        F.when(F.col("lang") != "", F.expr("substring(lang, 2)")).alias("language"), "total", "sum_confidence",
        "review_count", "escalation_count", p95("hist").alias("p95_ms_approx"), "n_late", "is_final"))


def late_rows(spark: SparkSession, sink_dir: str, window: str = "1 hour") -> DataFrame:
    """The late part of every batch that had one: (batch_id, window_start, language, n_late, ...)."""
    return _read(spark, sink_dir, "late").select(
        "batch_id", F.timestamp_seconds("start").cast("timestamp_ntz").alias("window_start"),
        F.when(F.col("lang") != "", F.expr("substring(lang, 2)")).alias("language"), "n_late",
        "sum_confidence", "review_count", "escalation_count")


def _with_rates(windows: DataFrame) -> DataFrame:
    denom = F.greatest(F.col("total"), F.lit(1))
    return windows.select(
        "window_start", "window_end", "language", "total",
        F.round(F.col("sum_confidence") / F.col("total"), 4).cast("double").alias("avg_confidence"),
        "review_count", "escalation_count",
        (F.col("review_count") / denom).alias("review_rate"),
        (F.col("escalation_count") / denom).alias("escalation_rate"),
        "p95_ms_approx", "n_late", "is_final")
