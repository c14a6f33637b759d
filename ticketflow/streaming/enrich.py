"""Structured Streaming enrichment: new ticket files -> enriched Parquet.

``foreachBatch`` runs the batch ``enrich_tickets`` plan on each micro-batch
(ranking, explode + aggregate and the broadcast joins are batch operators).
Each batch is written to its own ``batch_id=<n>`` folder with overwrite, so
a batch replayed after a failure replaces its own output instead of
duplicating it (idempotent sink; the checkpoint records progress).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ticketflow.plans.enrich import enrich_flat, enrich_tickets


def stream_enrich(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                  max_files_per_trigger: int | None = None, flat: bool = True, **enrich_kw):
    """Start the query with ``availableNow`` and wait for it to finish."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    cores = spark.sparkContext.defaultParallelism

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # a file is as few tasks as it has row groups: a batch of fewer files than cores is dealt out
        if max_files_per_trigger and max_files_per_trigger < cores:
            batch = batch.repartition(cores)
        out = enrich_tickets(batch, **enrich_kw)
        out = enrich_flat(out) if flat else out
        out.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={batch_id}"))

    q = (src.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_enriched(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir).drop("batch_id")

