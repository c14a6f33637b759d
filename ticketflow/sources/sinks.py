"""Sinks: metrics store tables, datasets, splits and evaluation history.

The metrics store is three Parquet tables under one base folder (a shared
path on a cluster).  ``classifications`` is partitioned by date and has no
raw text column (only a 16-hex SHA-256 prefix).  Ids come
from a stable key of the input (``xxhash64`` of a string id, or the numeric
id itself), never from insertion order, so a retried task writes the same
rows.

A batch is replaced as a whole.  Every write goes to a new version of its
batch (folders ``batch=.../version=...``) and counts only once one row is added to the
``commits`` table; readers take the newest committed version of every batch.
A rerun with fewer dates therefore leaves no old row, a write that failed
half-way is never seen, and readers keep a whole version meanwhile.  A batch
has one writer at a time.  ``vacuum_store`` deletes replaced versions.  The
rollups of a batch of classifications (``operators.rollups``) are written
under the same version before it counts.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow.functions.text import text_hash
from ticketflow.operators import rollups as R

CLASSIFICATIONS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("text_hash", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("primary_intent", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("urgency", T.StringType()), T.StructField("was_escalated", T.BooleanType()),
    T.StructField("needs_review", T.BooleanType()), T.StructField("processing_time_ms", T.DoubleType()),
    T.StructField("date", T.DateType()),
])
ESCALATIONS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("classification_id", T.LongType()), T.StructField("reason", T.StringType()),
    T.StructField("resolved", T.BooleanType()), T.StructField("resolution_notes", T.StringType()),
])
ACCURACY = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("language", T.StringType()), T.StructField("intent", T.StringType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("f1_score", T.DoubleType()),
    T.StructField("sample_count", T.LongType()),
])
STORE = {"classifications": (CLASSIFICATIONS, ["date"]), "escalations": (ESCALATIONS, []),
         "accuracy_metrics": (ACCURACY, [])}
ROLLUPS = {"rollups": "date date, language string, intent string, n long, n_confidence long, sum_confidence decimal(38,10), "
                      "review_count long, escalation_count long",
           "latencies": "hour timestamp, language string, n long, sum_ms decimal(38,10), min_ms double, max_ms double, "
                        "sketch binary"}
COMMITS = "table string, batch string, version string, seq long"
VERSION = "batch string, version string"


def table_dir(base_dir: str, name: str) -> str:
    return os.path.join(base_dir, name)


def create_tables(spark: SparkSession, base_dir: str) -> dict[str, str]:
    """Create the three store tables (and those that belong to them) if missing (idempotent)."""
    paths = {}
    for name, (schema, parts) in STORE.items():
        paths[name] = table_dir(base_dir, name)
        _create(spark, schema, paths[name], *parts)
    for name, ddl in ROLLUPS.items():
        _create(spark, f"{ddl}, {VERSION}", table_dir(base_dir, name), "batch", "version")
    _create(spark, COMMITS, table_dir(base_dir, "commits"))
    return paths


def _create(spark: SparkSession, schema, path: str, *parts: str) -> None:
    w = spark.createDataFrame([], schema).write.mode("ignore")
    (w.partitionBy(*parts) if parts else w).parquet(path)


def _commits(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COMMITS).parquet(table_dir(base_dir, "commits")).where(F.col("table") == name)


def live_versions(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """(batch, version): the newest committed version of every batch."""
    return _commits(spark, base_dir, name).groupBy("batch").agg(
        F.max_by("version", F.struct("seq", "version")).alias("version"))


def _read_versions(spark: SparkSession, base_dir: str, folder: str, schema, table: str) -> DataFrame:
    """Rows of live versions; batch and version are partitions, so replaced files are pruned."""
    full = T.StructType([*(schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields,
                         *T.StructType.fromDDL(VERSION).fields])
    rows = spark.read.schema(full).parquet(table_dir(base_dir, folder))
    return rows.join(live_versions(spark, base_dir, table), ["batch", "version"], "left_semi")


def read_store(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    schema, _ = STORE[name]
    return _read_versions(spark, base_dir, name, schema, name).select(*[f.name for f in schema])


def read_rollup(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """``rollups`` or ``latencies`` of the live batches of classifications."""
    return _read_versions(spark, base_dir, name, ROLLUPS[name], "classifications").drop("batch", "version")


def write_batch(rows: DataFrame, base_dir: str, name: str, batch_id: str | None = None) -> str:
    """Write ``rows`` as the whole of a batch and commit it; returns the version.

    The same ``batch_id`` replaces the batch, without one every call adds a batch.
    """
    spark = rows.sparkSession
    schema, parts = STORE[name]
    batch, version = batch_id or uuid.uuid4().hex, uuid.uuid4().hex
    create_tables(spark, base_dir)
    out = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema), F.lit(batch).alias("batch"),
                      F.lit(version).alias("version"))
    if parts:
        # a date is one file unless it is large; a hot date is split over several tasks
        out = out.hint("rebalance", *(F.col(p) for p in parts)).sortWithinPartitions(*parts, "language")
    out.write.mode("append").partitionBy(*parts, "batch", "version").parquet(table_dir(base_dir, name))
    if name == "classifications":
        full = T.StructType([*schema.fields, *T.StructType.fromDDL(VERSION).fields])
        written = spark.read.schema(full).parquet(table_dir(base_dir, name)).where(
            (F.col("batch") == batch) & (F.col("version") == version))
        for folder, made in (("rollups", R.rollup_rows(written)), ("latencies", R.latency_rows(written))):
            made.withColumn("batch", F.lit(batch)).withColumn("version", F.lit(version)).write.mode("append").partitionBy(
                "batch", "version").parquet(table_dir(base_dir, folder))
    before = _commits(spark, base_dir, name).where(F.col("batch") == batch).agg(F.max("seq")).first()[0]
    commit = spark.createDataFrame([(name, batch, version, (before or 0) + 1)], COMMITS)
    commit.coalesce(1).write.mode("append").parquet(table_dir(base_dir, "commits"))
    return version


def vacuum_store(spark: SparkSession, base_dir: str) -> int:
    """Delete the folders of replaced versions; returns their number.  Versions that are
    not committed (yet) stay.  Not while a reader still uses a replaced version."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    deleted = 0
    for name, (_, parts) in STORE.items():
        live = live_versions(spark, base_dir, name)
        old = _commits(spark, base_dir, name).join(live, ["batch", "version"], "left_anti").select("version").distinct()
        folders = {name: len(parts)} | ({r: 0 for r in ROLLUPS} if name == "classifications" else {})
        for row in old.toLocalIterator():
            for folder, depth in folders.items():
                pattern = fs_path("/".join([table_dir(base_dir, folder), *["*"] * depth, "batch=*", f"version={row['version']}"]))
                fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
                for status in fs.globStatus(pattern):
                    deleted += bool(fs.delete(status.getPath(), True))
    return deleted


def stable_id(col: str, dtype: str):
    return F.col(col).cast("long") if dtype in ("bigint", "int", "smallint") else F.xxhash64(F.col(col))


def classification_rows(enriched: DataFrame, id_col: str = "ticket_id", text_col: str = "text",
                        ts_col: str | None = "ts", processing_time_col: str | None = None) -> DataFrame:
    """Project enrichment output to the classifications schema (text hashed)."""
    dt = dict(enriched.dtypes)[id_col]
    ts = F.col(ts_col) if ts_col else F.current_timestamp()
    pt = F.col(processing_time_col).cast("double") if processing_time_col else F.lit(None).cast("double")
    return enriched.select(
        stable_id(id_col, dt).alias("id"), ts.cast("timestamp").alias("ts"),
        text_hash(text_col).alias("text_hash"), F.col("language"),
        F.col("primary_intent"), F.col("primary_confidence").cast("double").alias("confidence"),
        F.col("urgency"), F.col("should_escalate").alias("was_escalated"),
        F.col("needs_human_review").alias("needs_review"), pt.alias("processing_time_ms"),
        F.to_date(ts).alias("date"))


def log_classifications(rows: DataFrame, base_dir: str, batch_id: str | None = None) -> str:
    """Log a batch of classifications by date, with its rollups; ``write_batch``."""
    return write_batch(rows, base_dir, "classifications", batch_id)


def escalation_rows(log_rows: DataFrame, reason_col: str | None = None) -> DataFrame:
    """Escalated classifications -> escalation rows (resolved = false).

    None or one row out of each log row: a filter would be moved below the
    enrichment, which would then run again inside the condition.
    """
    reason = F.col(reason_col) if reason_col else F.lit("auto-escalated due to high urgency")
    row = F.struct(
        F.xxhash64(F.lit("escalation"), F.col("id")).alias("id"), F.col("ts").alias("ts"),
        F.col("id").alias("classification_id"), reason.alias("reason"),
        F.lit(False).alias("resolved"), F.lit(None).cast("string").alias("resolution_notes"))
    return log_rows.select(F.inline(F.when(F.col("was_escalated"), F.array(row))))


def log_escalations(rows: DataFrame, base_dir: str, batch_id: str | None = None) -> str:
    return write_batch(rows, base_dir, "escalations", batch_id)


def accuracy_rows(per_language: DataFrame, ts=None, intent_col: str | None = None) -> DataFrame:
    """From ``eval_per_language`` output: one row per language (intent optional)."""
    t = F.current_timestamp() if ts is None else F.lit(ts).cast("timestamp")
    intent = F.col(intent_col) if intent_col else F.lit(None).cast("string")
    return per_language.select(
        F.xxhash64(F.col("language"), intent, t).alias("id"), t.alias("ts"), F.col("language"),
        intent.alias("intent"), F.col("accuracy"), F.col("f1_macro").alias("f1_score"),
        F.col("sample_count").cast("long"))


def log_accuracy_metrics(rows: DataFrame, base_dir: str, batch_id: str | None = None) -> str:
    return write_batch(rows, base_dir, "accuracy_metrics", batch_id)


def save_dataset(df: DataFrame, data_dir: str, filename: str) -> str:
    path = os.path.join(data_dir, f"{filename}.parquet")
    df.write.mode("overwrite").parquet(path)
    return path


def save_splits(split_df: DataFrame, output_dir: str) -> dict[str, str]:
    """One folder per split (``split=train`` ...), written in one job."""
    split_df.write.mode("overwrite").partitionBy("split").parquet(output_dir)
    return {s: os.path.join(output_dir, f"split={s}") for s in ("train", "val", "test")}


def save_evaluation(report_long: DataFrame, path: str, run_ts=None) -> str:
    """Append the evaluation (long form) as JSON lines tagged with the run time."""
    t = F.current_timestamp() if run_ts is None else F.lit(run_ts).cast("timestamp")
    report_long.withColumn("run_ts", t).write.mode("append").json(path)
    return path


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    schema = "section string, scope string, label string, metric string, value double, run_ts timestamp"
    return spark.read.schema(schema).json(path)
