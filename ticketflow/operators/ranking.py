"""Exact ranks and order statistics without a single-task window.

A window with no partition key, or one keyed by a handful of classes, puts
everything into one or a few tasks.  ``range_rank`` range-partitions instead
and adds offsets; ``kth_smallest`` narrows the value range that holds a rank
until few rows are left in it.  Neither has a cap on rows, groups or keys, and
neither brings more than a few numbers to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000           # of the approximate quantiles that bracket a rank
BRACKET_ROWS = 200_000      # rows of a bracket that are sorted for the exact value


def range_rank(df: DataFrame, order: list, group_cols: list[str] | None = None, out: str = "rank0") -> DataFrame:
    """0-based exact rank by ``order`` inside each group, for any orderable keys.

    The rows are range-partitioned and sorted by (groups, order) and written
    to the shared checkpoint folder with their partition number and position;
    a small aggregate of counts per (group, partition) gives each partition's
    offset.  No window ever sees more than the partitions of one group, no key
    reaches the driver, null groups and null keys rank like any other (nulls
    first).  Rows whose ``order`` values are all equal share a range; give
    enough tie breakers to tell rows apart.
    """
    from ticketflow.session import materialize

    groups = [F.col(f"`{g}`") for g in group_cols or []]
    keys = [*groups, *(F.col(f"`{o}`") if isinstance(o, str) else o for o in order)]
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # checkpointed: a recomputed range partitioning could place rows elsewhere
    placed = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .withColumns({"__part": F.spark_partition_id(), "__pos": position}))
    runs = placed.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__first"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[g.alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"),
                       F.col("__first"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same = same & g.eqNullSafe(F.col(f"__g{i}"))
    rank = F.col("__offset") + F.col("__pos") - F.col("__first")
    return placed.join(runs, same).select(*[F.col(f"`{c}`") for c in df.columns], rank.alias(out))


def first_per_group(df: DataFrame, group_cols: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows of each group by ``order`` (any orderable keys, null groups too).

    Two trims with the same rule: inside hash slices of a group, then over
    what the slices kept.  A group is spread over as many slices as there are
    shuffle partitions, so no task sorts a whole group, whatever n is.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = [F.col(f"`{g}`") for g in group_cols]
    keys = [F.col(f"`{o}`") if isinstance(o, str) else o for o in order]
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*keys), F.lit(slices)))
    local = Window.partitionBy(*groups, "__slice").orderBy(*keys)
    kept = sliced.withColumn("__rn", F.row_number().over(local)).where(F.col("__rn") <= n).drop("__rn", "__slice")
    over = Window.partitionBy(*groups).orderBy(*keys)
    return kept.withColumn("__rn", F.row_number().over(over)).where(F.col("__rn") <= n).drop("__rn")


def kth_smallest(df: DataFrame, key: str, ranks: dict[str, int | None]) -> DataFrame:
    """One row: for each name, the value at 0-based position ``rank`` among the
    non-null sorted values of ``key`` (None, or a rank beyond them: null).

    Approximate quantiles bracket each rank, one pass counts what lies below
    and inside the brackets, and brackets with many rows are narrowed again
    (about ``ACCURACY`` times smaller each time); only the rows of the last
    brackets are grouped and sorted.  A hot value is a bracket of its own.
    """
    values = df.where(F.col(key).isNotNull()).select(F.col(key).alias("v"))
    names = [n for n, r in ranks.items() if r is not None]
    inside = {n: F.lit(True) for n in names}        # rows that may hold the rank
    below = dict.fromkeys(names, 0)                 # rows smaller than all of these
    size = dict.fromkeys(names, None)
    open_names = list(names)
    while open_names:
        if size[open_names[0]] is None:
            counts = values.agg(F.count(F.lit(1))).first()[0]
            size = dict.fromkeys(names, counts)
        quantiles = []
        for n in open_names:
            at = (ranks[n] - below[n]) / max(size[n], 1)
            width = 2.0 / ACCURACY
            quantiles.append(F.percentile_approx(
                F.when(inside[n], F.col("v")), [max(0.0, at - width), min(1.0, at + width)], ACCURACY).alias(n))
        edges = values.agg(*quantiles).first()
        conditions = {}
        for n in open_names:
            if edges[n] is not None:
                low, high = edges[n]
                conditions[n] = inside[n] & F.col("v").between(F.lit(low), F.lit(high))
        counted = [n for n in open_names if n in conditions]
        if not counted:
            break
        aggs = []
        for n in counted:
            aggs += [F.count_if(inside[n] & (F.col("v") < F.lit(edges[n][0]))), F.count_if(conditions[n])]
        found = values.agg(*aggs).first()
        still = []
        for i, n in enumerate(counted):
            under, within = found[2 * i], found[2 * i + 1]
            if below[n] + under <= ranks[n] < below[n] + under + within:
                narrower = within < size[n]
                below[n], size[n], inside[n] = below[n] + under, within, conditions[n]
                if within > BRACKET_ROWS and edges[n][0] != edges[n][1] and narrower:
                    still.append(n)
        open_names = still
    if not names:
        return values.agg(*[F.max(F.lit(None).cast("double")).alias(n) for n in ranks])
    brackets = F.explode(F.array(*[F.when(inside[n], F.lit(n)) for n in names]))
    counts = values.select("v", brackets.alias("name")).where(F.col("name").isNotNull()).groupBy("name", "v").agg(
        F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy("name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("cum", F.sum("c").over(run))
    aggs = []
    for n, r in ranks.items():
        hit = (F.lit(None).cast("boolean") if r is None else
               (F.col("name") == n) & (F.col("cum") - F.col("c") <= F.lit(r - below[n])) & (F.col("cum") > F.lit(r - below[n])))
        aggs.append(F.min(F.when(hit, F.col("v"))).alias(n))
    return counts.agg(*aggs)
