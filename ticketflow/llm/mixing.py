"""Mixing sources to target weights by capped water-filling.

Sizes are word counts.  Every source gets a share of the total by its weight;
a source whose share exceeds ``max_epochs`` times its size is clamped there
and its excess is shared again by weight among the others, until no source is
above its limit.  Each source then takes whole repetitions of all of its
documents and, for the fractional rest, a seeded subset of them.

The subset needs no sort: documents hash into ``BUCKETS`` buckets, the words
per (source, bucket) are summed map-side, whole buckets are taken in order
until the rest is met, and the one bucket that crosses it is sampled document
by document with a second hash.  A source that holds a third of all rows is
only ever seen as at most ``BUCKETS`` sums.  The number of sources is not
bounded: source ranks and the water level come from distributed aggregates,
the driver sees three numbers per round, and the plan (one row per source) is
broadcast only up to ``BROADCAST_SOURCES`` rows.

Defined results: a null text has size 0; a null source is a source of its
own, ranked last; a source without words has target 0; rows that repeat a
doc_id within a source are taken or left together; an empty table gives an
empty table; reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.operators.ranking import range_rank
from ticketflow.session import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096
SEED = 17
BROADCAST_SOURCES = 50_000   # rows of the per-source plan (under 5 MB) that may be broadcast
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with ``weight`` and ``target`` (double).

    ``weights`` repeat over the sources in code-point order, null last.
    """
    ranked = range_rank(sizes.withColumn("__null", F.col("source").isNull()), ["__null", "source"], out="__rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    base = materialize(ranked.select("source", "source_size", weight.cast("long").alias("weight")))
    total = base.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * max_epochs
    level, clamped = None, -1
    while True:
        # water level of the sources that are not clamped at the last level
        above = F.lit(False) if level is None else limit.cast("double") < F.lit(level) * F.col("weight")
        n, held, free = base.agg(
            F.sum(above.cast("long")), F.sum(F.when(above, limit).otherwise(0)),
            F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if n is None or n == clamped or not free:
            break
        level, clamped = float(total - held) / float(free), n
    if level is None:
        return base.withColumn("target", F.lit(0.0))
    share = F.lit(level) * F.col("weight")
    return base.withColumn("target", F.least(share, limit.cast("double")))


def word_count(text: str) -> Column:
    """Number of words of a text; a null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _hash32(part: int, seed: int) -> Column:
    """32 bits of a seeded digest of doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 8 * part + 1, 8), 16, 10).cast("long")


def mix_sources(df: DataFrame, size: str | Column = "size", weights: tuple[int, ...] = WEIGHTS,
                max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``df`` (with doc_id and source) plus a struct column ``mix``: ``size``,
    ``source_size``, ``target`` and ``copies`` (how often the mix takes the
    whole document).  An input column named ``mix`` is replaced.
    """
    size = F.col(size) if isinstance(size, str) else size
    bucket, coin = F.shiftright(_hash32(0, seed), 20), _hash32(1, seed)
    by_bucket = materialize(df.select("source", size.alias("__size"), bucket.alias("__bucket"))
                            .groupBy("source", "__bucket").agg(F.sum("__size").alias("__words")))
    targets = source_targets(by_bucket.groupBy("source").agg(F.sum("__words").alias("source_size")),
                             weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("__whole", whole.cast("long")).withColumn(
        "__rest", F.col("target") - (F.col("__whole") * F.col("source_size")).cast("double"))
    # the bucket that crosses the rest: at most BUCKETS rows per source
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = by_bucket.withColumn("__from", F.coalesce(F.sum("__words").over(before), F.lit(0)))
    t = targets.select(F.col("source").alias("__source"), "source_size", "target", "__whole", "__rest")
    # a bucket of documents without words cannot cross the rest
    crossing = (F.col("__words") > 0) & (F.col("__from") + F.col("__words") > F.col("__rest"))
    share = (F.col("__rest") - F.col("__from")) / F.col("__words")
    plan = materialize(
        spans.join(t, F.col("source").eqNullSafe(F.col("__source")))
        .groupBy("__source", "source_size", "target", "__whole")
        .agg(F.min(F.when(crossing, F.struct("__bucket", share.alias("__share")))).alias("__cross"))
        .select("__source", "source_size", "target", "__whole",
                F.coalesce(F.col("__cross.__bucket"), F.lit(BUCKETS)).alias("__at"),
                F.coalesce(F.col("__cross.__share"), F.lit(0.0)).alias("__share")))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != "mix"]
    source = df.select(*columns, size.alias("__size"), bucket.cast("long").alias("__bucket"), coin.alias("__coin"))
    joined = source.join(plan, F.col("source").eqNullSafe(F.col("__source")))
    part = (F.col("__bucket") < F.col("__at")) | (
        (F.col("__bucket") == F.col("__at")) & (F.col("__coin") / F.lit(4294967296.0) < F.col("__share")))
    return joined.select(*columns, F.struct(
        F.col("__size").alias("size"), F.col("source_size").alias("source_size"), F.col("target").alias("target"),
        (F.col("__whole") + part.cast("long")).alias("copies")).alias("mix"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.tables import table

    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    # the texts are read once; everything after works on three narrow columns
    sized = materialize(docs.select("doc_id", "source", word_count("text").alias("size")))
    m = mix_sources(sized)
    return m.select("doc_id", "mix.size", "mix.source_size", "mix.target",
                    (F.col("mix.size") * F.col("mix.copies")).alias("taken"))
