"""Classification evaluation from confusion counts.

Predictions (y_true, y_pred, language, confidence) are reduced once, by a
GROUPING SETS aggregate over (language, y_true, y_pred) and (y_true, y_pred),
to at most labels^2 x (languages + 1) rows; every metric is arithmetic on
that small table.  The overall scope is named ``ALL_SCOPE``.

Conventions (zero division gives 0): precision = tp / predicted,
recall = tp / support, F1 = 2 tp / (support + predicted).  Labels of a scope
are the union of its true and predicted labels.  Macro and weighted means
sum per-label values in label order, so the result is bit-reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow import config as C

ALL_SCOPE = "__all__"


def low_confidence_filter(preds: DataFrame, confidence_col: str = "confidence",
                          cutoff: float = C.LOW_CONFIDENCE_CUTOFF) -> DataFrame:
    return preds.filter(F.col(confidence_col) < F.lit(float(cutoff)))


def base_counts(preds: DataFrame, cutoff: float = C.LOW_CONFIDENCE_CUTOFF) -> DataFrame:
    """The one pass over predictions: (language, y_true, y_pred, low, n).

    At most languages x labels^2 x 2 rows; every section of ``evaluate`` is
    derived from it, so the predictions are scanned once.
    """
    low = F.coalesce(F.col("confidence") < F.lit(float(cutoff)), F.lit(False)) \
        if "confidence" in preds.columns else F.lit(False)
    return preds.groupBy("language", "y_true", "y_pred", low.alias("low")).agg(
        F.count(F.lit(1)).alias("n"))


def counts_from_base(base: DataFrame) -> DataFrame:
    """(scope, y_true, y_pred, n) for every language and ALL_SCOPE."""
    per = base.groupBy(F.col("language").alias("scope"), "y_true", "y_pred").agg(F.sum("n").alias("n"))
    overall = base.groupBy("y_true", "y_pred").agg(F.sum("n").alias("n")).select(
        F.lit(ALL_SCOPE).alias("scope"), "y_true", "y_pred", "n")
    return per.unionByName(overall)


def confusion_counts(preds: DataFrame, by_language: bool = True) -> DataFrame:
    """(scope, y_true, y_pred, n); scope = language or ALL_SCOPE."""
    if by_language:
        g = preds.groupingSets(
            [[F.col("language"), F.col("y_true"), F.col("y_pred")], [F.col("y_true"), F.col("y_pred")]],
            "language", "y_true", "y_pred",
        ).agg(F.count(F.lit(1)).alias("n"), F.grouping("language").alias("_gl"))
        scope = F.when(F.col("_gl") == 1, F.lit(ALL_SCOPE)).otherwise(F.col("language"))
        return g.select(scope.alias("scope"), "y_true", "y_pred", "n")
    return preds.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(ALL_SCOPE).alias("scope"), "y_true", "y_pred", "n")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def per_label(counts: DataFrame) -> DataFrame:
    """(scope, label, tp, support, predicted, precision, recall, f1)."""
    both = counts.select(
        "scope",
        F.explode(F.array(
            F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"),
                     F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"),
                     F.lit(0).cast("long").alias("predicted")),
            F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"),
                     F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted")),
        )).alias("x"))
    g = both.groupBy("scope", F.col("x.label").alias("label")).agg(
        F.sum("x.tp").alias("tp"), F.sum("x.support").alias("support"),
        F.sum("x.predicted").alias("predicted"))
    return g.select(
        "scope", "label", "tp", "support", "predicted",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def _ordered_sum(field: str) -> Column:
    """Sum of ``field`` over the scope's labels, added in label order."""
    items = F.array_sort(F.collect_list(F.struct(F.col("label"), F.col(field).alias("v"))))
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x["v"])


def scope_metrics(labels: DataFrame) -> DataFrame:
    """(scope, accuracy, f1_macro, f1_weighted, precision_macro, recall_macro,
    precision_weighted, recall_weighted, sample_count)."""
    lab = labels.withColumn("_wf1", F.col("f1") * F.col("support")) \
        .withColumn("_wp", F.col("precision") * F.col("support")) \
        .withColumn("_wr", F.col("recall") * F.col("support"))
    g = lab.groupBy("scope").agg(
        F.sum("tp").alias("_tp"), F.sum("support").alias("sample_count"),
        F.count(F.lit(1)).alias("_nl"),
        _ordered_sum("f1").alias("_sf1"), _ordered_sum("precision").alias("_sp"),
        _ordered_sum("recall").alias("_sr"), _ordered_sum("_wf1").alias("_swf1"),
        _ordered_sum("_wp").alias("_swp"), _ordered_sum("_wr").alias("_swr"))
    nl = F.col("_nl").cast("double")
    return g.select(
        "scope",
        _ratio(F.col("_tp"), F.col("sample_count")).alias("accuracy"),
        (F.col("_sf1") / nl).alias("f1_macro"),
        _ratio(F.col("_swf1"), F.col("sample_count")).alias("f1_weighted"),
        (F.col("_sp") / nl).alias("precision_macro"),
        (F.col("_sr") / nl).alias("recall_macro"),
        _ratio(F.col("_swp"), F.col("sample_count")).alias("precision_weighted"),
        _ratio(F.col("_swr"), F.col("sample_count")).alias("recall_weighted"),
        "sample_count",
    )


METRIC_COLS = ["accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro"]


def eval_overall(preds: DataFrame) -> DataFrame:
    m = scope_metrics(per_label(confusion_counts(preds, by_language=False)))
    return m.select(*METRIC_COLS)


def eval_per_language(preds: DataFrame) -> DataFrame:
    m = scope_metrics(per_label(confusion_counts(preds)))
    return m.filter(F.col("scope") != ALL_SCOPE).select(
        F.col("scope").alias("language"), *METRIC_COLS, "sample_count")


def eval_report(preds: DataFrame) -> DataFrame:
    """Per-label rows plus 'accuracy', 'macro avg', 'weighted avg' (overall)."""
    lab = per_label(confusion_counts(preds, by_language=False))
    rows = lab.select("label", "precision", "recall", F.col("f1").alias("f1_score"), "support")
    m = scope_metrics(lab)
    summary = m.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1_score"),
                 F.col("sample_count").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("precision_macro").alias("precision"),
                 F.col("recall_macro").alias("recall"), F.col("f1_macro").alias("f1_score"),
                 F.col("sample_count").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("precision_weighted").alias("precision"),
                 F.col("recall_weighted").alias("recall"), F.col("f1_weighted").alias("f1_score"),
                 F.col("sample_count").alias("support")),
    )).alias("s")).select("s.*")
    return rows.unionByName(summary)


def confusion_matrix(preds: DataFrame) -> DataFrame:
    """Long form (y_true, y_pred, n) over labels x labels, zeros filled.

    Labels = sorted union of true and predicted labels.  The grid is built by
    exploding the (bounded) label array twice, then left-joined to the counts.
    """
    return _matrix_from_counts(confusion_counts(preds, by_language=False).drop("scope"))


def _matrix_from_counts(counts: DataFrame) -> DataFrame:
    labels = counts.agg(F.array_sort(F.array_union(
        F.collect_set("y_true"), F.collect_set("y_pred"))).alias("labels"))
    grid = labels.select(F.explode("labels").alias("y_true"), "labels") \
        .select("y_true", F.explode("labels").alias("y_pred"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def confusion_matrix_wide(preds: DataFrame) -> DataFrame:
    """Square matrix: one row per true label, one column per predicted label."""
    long = confusion_matrix(preds)
    labels = [r[0] for r in long.select("y_pred").distinct().orderBy("y_pred").collect()]
    return long.groupBy("y_true").pivot("y_pred", labels).agg(F.sum("n")).orderBy("y_true")


def transfer_gaps(preds: DataFrame) -> DataFrame:
    """(language, accuracy_gap, overall_accuracy), both 4 dp; empty -> empty."""
    return _gaps_from_metrics(scope_metrics(per_label(confusion_counts(preds))))


def _gaps_from_metrics(m: DataFrame) -> DataFrame:
    # window over one row per scope (languages + 1): a tiny table
    overall = F.max(F.when(F.col("scope") == ALL_SCOPE, F.col("accuracy"))).over(Window.partitionBy())
    return m.withColumn("_overall", overall).filter(F.col("scope") != ALL_SCOPE).select(
        F.col("scope").alias("language"),
        F.round(F.col("accuracy") - F.col("_overall"), 4).alias("accuracy_gap"),
        F.round("_overall", 4).alias("overall_accuracy"))


def low_confidence_analysis(preds: DataFrame, cutoff: float = C.LOW_CONFIDENCE_CUTOFF) -> DataFrame:
    """One row: count below the cutoff and their accuracy (null when none)."""
    low = F.col("confidence") < F.lit(float(cutoff))
    correct = F.col("y_true") == F.col("y_pred")
    g = preds.agg(F.count_if(low).alias("count"), F.count_if(low & correct).alias("_ok"))
    return g.select("count", F.when(F.col("count") > 0, F.col("_ok") / F.col("count"))
                    .alias("accuracy"))


def _low_from_base(base: DataFrame) -> DataFrame:
    low = base.filter(F.col("low"))
    g = low.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
                F.coalesce(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))), F.lit(0)).alias("_ok"))
    return g.select("count", F.when(F.col("count") > 0, F.col("_ok") / F.col("count")).alias("accuracy"))


def accuracy_heatmap(preds: DataFrame, labels: list[str]) -> DataFrame:
    """language x true-label accuracy matrix, one column per label given.

    Null where a language has no row of a class.
    """
    correct = F.when(F.col("y_true") == F.col("y_pred"), 1).otherwise(0)
    return preds.withColumn("_ok", correct).groupBy("language").pivot("y_true", labels) \
        .agg(F.sum("_ok") / F.count(F.lit(1)))


def evaluate(preds: DataFrame) -> DataFrame:
    """All sections as (section, scope, label, metric, value).

    Predictions without a ``confidence`` column have no low-confidence section.

    One scan: ``base_counts`` is the only aggregate over the predictions and
    is checkpointed (it is tiny); the confusion matrix, metrics, gaps and
    low-confidence section are all computed from that table.
    """
    from ticketflow.session import materialize

    base = materialize(base_counts(preds))  # tiny: languages x labels^2 x 2 rows
    counts = counts_from_base(base)
    lab = per_label(counts)
    m = scope_metrics(lab)
    metric_map = F.create_map(*[x for c in METRIC_COLS + ["sample_count"]
                                for x in (F.lit(c), F.col(c).cast("double"))])
    scopes = m.select(
        F.when(F.col("scope") == ALL_SCOPE, F.lit("overall")).otherwise(F.lit("per_language"))
        .alias("section"), "scope", F.lit(None).cast("string").alias("label"),
        F.explode(metric_map).alias("metric", "value"))
    rep = lab.filter(F.col("scope") == ALL_SCOPE).select(
        F.lit("classification_report").alias("section"), "scope", "label",
        F.explode(F.create_map(
            F.lit("precision"), F.col("precision"), F.lit("recall"), F.col("recall"),
            F.lit("f1_score"), F.col("f1"), F.lit("support"), F.col("support").cast("double")))
        .alias("metric", "value"))
    overall = counts.filter(F.col("scope") == ALL_SCOPE).drop("scope")
    cm = _matrix_from_counts(overall).select(
        F.lit("confusion_matrix").alias("section"), F.lit(ALL_SCOPE).alias("scope"),
        F.concat_ws("->", "y_true", "y_pred").alias("label"), F.lit("n").alias("metric"),
        F.col("n").cast("double").alias("value"))
    gaps = _gaps_from_metrics(m).select(
        F.lit("cross_lingual_transfer").alias("section"), F.col("language").alias("scope"),
        F.lit(None).cast("string").alias("label"), F.lit("accuracy_gap").alias("metric"),
        F.col("accuracy_gap").alias("value"))
    low = _low_from_base(base).select(
        F.lit("low_confidence_analysis").alias("section"), F.lit(ALL_SCOPE).alias("scope"),
        F.lit(None).cast("string").alias("label"),
        F.explode(F.create_map(F.lit("count"), F.col("count").cast("double"),
                               F.lit("accuracy"), F.col("accuracy"))).alias("metric", "value"))
    report = scopes.unionByName(rep).unionByName(cm).unionByName(gaps)
    return report.unionByName(low) if "confidence" in preds.columns else report
