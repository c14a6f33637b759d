"""A learned intent scorer: hashed features, multinomial regression, calibrated confidences.

Features are words, word beginnings, character trigrams and the lexicon's hits
per label of the lower-cased text, hashed into ``DIMENSIONS`` counts.  Equal labelled texts are summed first and weigh
by their number.  The regression is Spark ML's: every step is one pass over
the partitions whose gradients are added by treeAggregate, so the driver holds
one vector of coefficients and no rows.

``needs_review`` compares a confidence with a threshold, so confidences are
calibrated: a fold of texts that the regression has not seen picks the
temperature by which its margins are divided (least log loss over a fixed grid,
one aggregation for the whole grid).  Folds are taken by a hash of the
text, so copies of a text are never on two sides.

Texts without a word or letter have no evidence; they keep the lexicon's
scores (``operators.intents``), as does every text when there is no model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow import config as C
from ticketflow.operators.intents import SCORES_TYPE, intent_hits, score_intents
from ticketflow.operators.language import trigrams

DIMENSIONS = 1 << 15
HIT_WEIGHT = 2              # counts of a lexicon hit among the other features
REGULARIZATION = 0.02
STEPS = 60
FOLDS = 10
HELD_OUT, CALIBRATION = (0, 1), (2, 3)          # folds; the others train
TEMPERATURES = [round(0.25 * 1.15 ** k, 4) for k in range(30)]
BINS = 10


def fold(text: Column, seed: int = 11) -> Column:
    """Fold 0..9 of a text, the same for all its copies."""
    return F.pmod(F.xxhash64(F.lower(text), F.lit(seed)), F.lit(FOLDS)).cast("int")


def features(df: DataFrame, text_col: str, out: str = "features") -> DataFrame:
    """Adds the hashed counts and ``_evidence`` (whether the text has a letter or digit)."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), 0)
    terms = F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)),
                     F.transform(words, lambda w: F.concat(F.lit("b:"), F.substring(w, 1, 5))),
                     F.transform(trigrams(low), lambda g: F.concat(F.lit("g:"), g)),
                     *[F.array_repeat(F.lit(f"l:{k}"), HIT_WEIGHT * intent_hits(low)[i]) for i, k in enumerate(C.INTENT_CATEGORIES)])
    x = df.withColumn("_terms", terms).withColumn("_evidence", low.rlike(r"[\p{L}\p{N}]"))
    return HashingTF(numFeatures=DIMENSIONS, inputCol="_terms", outputCol=out).transform(x).drop("_terms")


@dataclass
class IntentModel:
    """Coefficients, the labels they stand for and the temperature of the margins."""

    regression: LogisticRegressionModel
    labels: list[str]
    temperature: float

    def margins(self, df: DataFrame, text_col: str) -> DataFrame:
        """Adds ``_margins`` (array<double>, one per label) and ``_evidence``."""
        x = self.regression.transform(features(df, text_col, "_features"))
        return x.withColumn("_margins", vector_to_array("_raw")).drop("_features", "_raw", "_probability", "_prediction")

    def score(self, df: DataFrame, text_col: str = "cleaned_text", out_col: str = "intent_scores",
              lexicon: list[tuple] | None = None) -> DataFrame:
        """Adds the sorted array<struct<label, score>> of ``score_intents``, scores summing to one."""
        x = score_intents(self.margins(df, text_col), text_col, "_lexical", lexicon, self.labels)
        order = [C.INTENT_CATEGORIES.index(k) if k in C.INTENT_CATEGORIES else i for i, k in enumerate(self.labels)]
        p = softmax(F.col("_margins"), self.temperature)
        rows = F.array(*[F.struct((-p[i]).alias("worse"), F.lit(order[i]).alias("order"), F.lit(k).alias("label"), p[i].alias("score"))
                         for i, k in enumerate(self.labels)])
        ranked = F.transform(F.array_sort(rows), lambda r: F.struct(r["label"].alias("label"), r["score"].alias("score")))
        return x.withColumn(out_col, F.when(F.col("_evidence"), ranked.cast(SCORES_TYPE)).otherwise(
            F.col("_lexical").cast(SCORES_TYPE))).drop("_margins", "_lexical", "_evidence")


def softmax(margins: Column, temperature: float) -> Column:
    scaled = F.transform(margins, lambda m: (m - F.array_max(margins)) / F.lit(temperature))
    e = F.transform(scaled, lambda m: F.exp(m))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def fit_intents(labelled: DataFrame, text_col: str = "text", label_col: str = "intent",
                labels: list[str] | None = None, held_out: tuple[int, ...] = HELD_OUT,
                calibration: tuple[int, ...] = CALIBRATION) -> IntentModel:
    """Model of the labelled texts whose fold is not in ``held_out``.

    Rows with a null or empty text or a label outside of ``labels`` take no part.  Without a text in
    the ``calibration`` folds the temperature is 1.
    """
    labels = list(labels or C.INTENT_CATEGORIES)
    place = F.array_position(F.array(*[F.lit(k) for k in labels]), F.col(label_col)).cast("double") - 1
    rows = (labelled.where(F.col(text_col).rlike(r"[\p{L}\p{N}]"))
            .select(F.col(text_col).alias("text"), place.alias("label")).where("label >= 0")
            .groupBy("text", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
            .withColumn("fold", fold(F.col("text"))).where(~F.col("fold").isin(list(held_out))))
    ready = features(rows, "text").persist()
    trained = ready.where(~F.col("fold").isin(list(calibration)))
    if trained.isEmpty():
        ready.unpersist()
        raise ValueError("no labelled text outside of the held-out and calibration folds")
    regression = LogisticRegression(
        family="multinomial", regParam=REGULARIZATION, maxIter=STEPS, standardization=False, weightCol="weight",
        rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction").fit(trained)
    regression.setFeaturesCol("_features")
    # a label without a training text has no coefficients of its own
    model = IntentModel(regression, labels[:regression.numClasses], 1.0)
    seen = model.margins(ready.where(F.col("fold").isin(list(calibration))).drop("features"), "text")
    ready_loss = seen.select("weight", *[
        (-F.log(F.greatest(softmax(F.col("_margins"), t)[F.col("label").cast("int")], F.lit(1e-12))) * F.col("weight")).alias(f"t{i}")
        for i, t in enumerate(TEMPERATURES)])
    losses = ready_loss.agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(len(TEMPERATURES))]).first()
    ready.unpersist()
    if losses[0] is not None:
        model.temperature = min(zip(losses, TEMPERATURES), key=lambda x: (x[0] if math.isfinite(x[0]) else math.inf, x[1]))[1]
    return model


def calibration_by(scored: DataFrame, label_col: str, group_col: str, scores_col: str = "intent_scores") -> DataFrame:
    """Per group: n, accuracy, mean confidence and expected calibration error over ``BINS`` bins."""
    first = F.element_at(F.col(scores_col), 1)
    rows = scored.select(F.col(group_col), (first["label"] == F.col(label_col)).cast("double").alias("right"),
                         first["score"].alias("confidence"))
    bins = rows.withColumn("bin", F.least(F.floor(F.col("confidence") * BINS), F.lit(BINS - 1))).groupBy(group_col, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("right").alias("right"), F.sum("confidence").alias("confidence"))
    return bins.groupBy(group_col).agg(
        F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"),
        (F.sum("confidence") / F.sum("n")).alias("mean_confidence"),
        (F.sum(F.abs(F.col("right") - F.col("confidence"))) / F.sum("n")).alias("calibration_error"))
