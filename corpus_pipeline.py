"""Corpus pipeline: quality rules -> near-dedup -> secret scan -> source mix -> encoding.

Each stage takes (spark, docs, sf_dir), works on every document that the
stage before it kept, and returns the columns of ``documents`` (the last one
returns the encoded texts).  Between stages the documents are written as
Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.llm.mixing import mix_sources, word_count
from ticketflow.llm.near_dup import near_duplicates
from ticketflow.llm.pieces import encode_texts
from ticketflow.llm.quality import quality_rules
from ticketflow.llm.secret_scan import secret_spans
from ticketflow.llm.tables import table
from ticketflow.session import scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SECRET_MARK = "[SECRET]"
SIMILAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return quality_rules(docs).where("quality.kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id in each group of near-duplicates.

    The similarity asked here (``SIMILAR_PERCENT``) is the one of near-duplicate stages on
    five-word shingles; ``op5_near_dup`` has a stricter one by its own contract.  Rows that
    share a doc_id (or have none) and the whole text are one document and leave one row.
    """
    kept = near_duplicates(docs, percent=SIMILAR_PERCENT).where("dedup.kept").select(*COLUMNS)
    repeated = scratch_dir(spark, "pipeline-repeated-ids")
    docs.groupBy(F.col("doc_id").alias("__id")).count().where("count > 1").select("__id").write.parquet(repeated)
    twice = spark.read.parquet(repeated)
    if twice.isEmpty():
        return kept
    # other rows keep a number of their own, so that only rows of repeated ids can meet
    marked = kept.join(twice.withColumn("__twice", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    own = F.when(F.col("__twice"), F.md5(F.coalesce("text", F.lit("")))).otherwise(
        F.monotonically_increasing_id().cast("string"))
    return marked.withColumn("__one", own).dropDuplicates(["doc_id", "__one"]).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret span of a text by a mark; all documents stay."""
    found = secret_spans(docs, redact=SECRET_MARK)
    return found.withColumn("text", F.col("secrets.text")).withColumn(
        "n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights."""
    mixed = mix_sources(docs, word_count("text"))
    copies = F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int")))
    return mixed.where("mix.copies > 0").select(*COLUMNS, copies.alias("__copy")).drop("__copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix, with the end id."""
    return encode_texts(docs, keep=("doc_id", "source"), outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("encode", encode)]

# the last stages' tokenizer and the repeat rules have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
