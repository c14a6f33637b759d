"""Intent scoring and ranking.

Default scorer (a lexical stand-in for a zero-shot model): every token of the
cleaned text adds the lexicon weight it has for a label, giving a hit sum h
per label.  ``multi_label=True`` scores labels independently, h / (h + 1);
otherwise labels compete, h / sum(h) (uniform when nothing hits).  The result
is an array<struct<label, score>> sorted by score descending, ties in label
order.

For the small built-in lexicon the sums are computed in-row from literal
maps (no join, no shuffle).  ``score_intents_join`` is the long form for
lexicons of any size.  ``model_intent_scores`` plugs in a user's model
through ``mapInPandas``; the model sees Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow import config as C
from ticketflow.functions.text import tokens, word_alternation
from ticketflow.session import ship_package
from ticketflow.sources import fixture_data as D

SCORES_TYPE = "array<struct<label:string,score:double>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def needs_review(confidence, threshold: float = C.CONFIDENCE_THRESHOLD) -> Column:
    """Unrounded primary confidence below the threshold."""
    return _c(confidence) < F.lit(float(threshold))


def _lexicon_maps(lexicon: list[tuple], labels: list[str]) -> dict[str, dict[str, int]]:
    maps: dict[str, dict[str, int]] = {lab: {} for lab in labels}
    for lab, tok, w in lexicon:
        if lab in maps:
            maps[lab][tok] = maps[lab].get(tok, 0) + int(w)
    return maps


def _sort_scores(arr: Column) -> Column:
    """Sort struct(score, before, label) by score desc, then before desc (Spark's
    own order of structs, no lambda per comparison); keep label and score."""
    srt = F.sort_array(arr, asc=False)
    return F.arrays_zip(srt["label"].alias("label"), srt["score"].alias("score"))


def _to_scores(hits: Column, labels: list[str], multi_label: bool) -> Column:
    """Sorted scores from an array<int> hits column (referenced by name)."""
    h = [F.element_at(hits, i + 1) for i in range(len(labels))]
    if multi_label:
        scores = [x.cast("double") / (x + F.lit(1)).cast("double") for x in h]
    else:
        total = F.aggregate(hits, F.lit(0), lambda a, x: a + x)
        scores = [F.when(total == 0, F.lit(1.0 / len(labels)))
                  .otherwise(x.cast("double") / total.cast("double")) for x in h]
    return _sort_scores(F.array(*[
        F.struct(s.alias("score"), F.lit(-i).alias("before"), F.lit(lab).alias("label"))
        for i, (lab, s) in enumerate(zip(labels, scores))]))


def intent_hits(lowered, lexicon: list[tuple] | None = None, labels: list[str] | None = None) -> Column:
    """array<int>: lexicon hit sum per label (labels order) from lower-cased
    text: one token-bounded regex scan finds the lexicon's tokens, whose
    weights are then added per label."""
    labels = labels or C.INTENT_CATEGORIES
    maps = _lexicon_maps(lexicon or D.INTENT_LEXICON, labels)
    found = F.regexp_extract_all(_c(lowered), F.lit(word_alternation(tok for m in maps.values() for tok in m)), 0)

    def label_sum(toks: Column, weights: dict[str, int]) -> Column:
        if not weights:
            return F.lit(0)
        table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
        return F.aggregate(toks, F.lit(0), lambda acc, t: acc + F.coalesce(F.try_element_at(table, t), F.lit(0)))

    # one element: the scan is evaluated once for all labels
    return F.element_at(F.transform(F.array(found), lambda toks: F.array(*[label_sum(toks, maps[lab]) for lab in labels])), 1)


def score_intents(df: DataFrame, text_col: str = "cleaned_text", out_col: str = "intent_scores",
                  lexicon: list[tuple] | None = None, labels: list[str] | None = None,
                  multi_label: bool = True, lowered_col: str | None = None) -> DataFrame:
    """Adds the sorted array<struct<label, score>> from in-row lexicon hits.

    Hits are a separate projection so each is computed once.
    """
    labels = labels or C.INTENT_CATEGORIES
    x = df if lowered_col else df.withColumn("_in_low", F.lower(F.col(text_col)))
    x = x.withColumn("_in_hits", intent_hits(F.col(lowered_col or "_in_low"), lexicon, labels))
    x = x.withColumn(out_col, _to_scores(F.col("_in_hits"), labels, multi_label))
    return x.drop("_in_hits") if lowered_col else x.drop("_in_hits", "_in_low")


def score_intents_join(df: DataFrame, lexicon: DataFrame, id_col: str, text_col: str,
                       labels: list[str] | None = None, multi_label: bool = True) -> DataFrame:
    """Long form for big lexicons: (id, intent_scores).

    Tokens are exploded and joined to the lexicon (its size decides the join),
    then reduced by a partial aggregate per (id, label); the shuffle carries
    at most (texts x labels) rows.
    """
    labels = labels or C.INTENT_CATEGORIES
    lex = lexicon.select(F.col("label"), F.col("token"), F.col("weight"))
    tok = df.select(id_col, F.explode(tokens(F.col(text_col))).alias("token"))
    sums = tok.join(lex, "token").groupBy(id_col).pivot("label", labels).agg(F.sum("weight"))
    base = df.select(id_col).join(sums, id_col, "left")
    hits = F.array(*[F.coalesce(F.col(f"`{lab}`"), F.lit(0)) for lab in labels])
    base = base.select(id_col, hits.alias("_hits"))
    return base.select(id_col, _to_scores(F.col("_hits"), labels, multi_label).alias("intent_scores"))


def rank_intents(df: DataFrame, scores_col: str = "intent_scores",
                 threshold: float = C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """primary/secondary intent and confidence (4 dp), review flag, all_scores.

    With one label the secondary fields are null; a secondary score of
    exactly 0 gives a null secondary confidence (the label is still set).
    The review flag uses the unrounded primary score.
    """
    s = F.col(scores_col)
    df = df.withColumn("_r1", F.element_at(s, 1)).withColumn("_r2", F.try_element_at(s, F.lit(2)))
    first, second = F.col("_r1"), F.col("_r2")
    return (df.withColumn("primary_intent", first["label"])
            .withColumn("primary_confidence", F.round(first["score"], 4))
            .withColumn("secondary_intent", second["label"])
            .withColumn("secondary_confidence",
                        F.when(second["score"] != 0, F.round(second["score"], 4)))
            .withColumn("needs_human_review", needs_review(first["score"], threshold))
            .withColumn("all_scores", F.transform(s, lambda x: F.struct(
                x["label"].alias("label"), F.round(x["score"], 4).alias("score"))))
            .drop("_r1", "_r2"))


def sort_scores(df: DataFrame, id_col: str, scores_col: str = "intent_scores") -> DataFrame:
    """Long form (id, rank, label, score), rank 1 = highest.

    Exploded with ``outer``: for an inner explode Spark infers a filter on the
    array's size and moves it below the scorer, which would then run again for
    every mention of its hits.  The row of an empty or null array goes after it.
    """
    return df.select(id_col, F.posexplode_outer(scores_col).alias("pos", "s")).where(F.col("pos").isNotNull()).select(
        id_col, (F.col("pos") + 1).alias("rank"), F.col("s.label").alias("label"),
        F.col("s.score").alias("score"))


# ---------------------------------------------------------------- plug-in model

ModelFactory = Callable[[list], Callable[[list], list]]


def model_intent_scores(df: DataFrame, factory: ModelFactory, id_col: str, text_col: str,
                        labels: list[str] | None = None, batch_size: int = 8,
                        keep_columns: bool = False) -> DataFrame:
    """(id, intent_scores) from a user's model; with ``keep_columns`` every
    input column passes through and ``intent_scores`` is appended (no join
    back to the input is needed).

    ``factory(labels)`` returns ``predict(texts) -> list[list[float]]`` (one
    score per label).  A Python worker keeps the last model it built, known by
    a digest of the pickled factory and labels, so its later tasks do not load
    it again; texts are fed in batches of ``batch_size`` rows.
    """
    labels = list(labels or C.INTENT_CATEGORIES)
    order = {lab: i for i, lab in enumerate(labels)}
    ship_package(df.sparkSession)
    key = hashlib.sha256(cloudpickle.dumps((factory, labels))).hexdigest()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = _worker_model(key, factory, labels)
        for pdf in it:
            texts = pdf[text_col].fillna("").tolist()
            out = []
            for i in range(0, len(texts), batch_size):
                out.extend(predict(texts[i:i + batch_size]))
            rows = []
            for sc in out:
                pairs = sorted(zip(labels, (float(x) for x in sc)), key=lambda p: (-p[1], order[p[0]]))
                rows.append([{"label": lab, "score": v} for lab, v in pairs])
            if keep_columns:
                yield pdf.assign(intent_scores=rows)
            else:
                yield pd.DataFrame({id_col: pdf[id_col].values, "intent_scores": rows})

    if keep_columns:
        from pyspark.sql.types import StructField, StructType, _parse_datatype_string
        schema = StructType(df.schema.fields + [StructField("intent_scores", _parse_datatype_string(SCORES_TYPE))])
        return df.mapInPandas(run, schema)
    id_type = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, intent_scores {SCORES_TYPE}")


_MODELS: dict = {}


def _worker_model(key: str, factory, labels: list):
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = factory(list(labels))
    return _MODELS[key]


def lexicon_model_factory(lexicon: list[tuple] | None = None, multi_label: bool = True) -> ModelFactory:
    """A small pure-Python model with the default scorer's semantics, for the
    plug-in path (and to test it against the built-in scorer)."""
    import regex

    lex = lexicon or D.INTENT_LEXICON
    split = regex.compile(r"[^\p{L}\p{N}]+")

    def factory(labels):
        maps = _lexicon_maps(lex, labels)

        def predict(texts):
            res = []
            for t in texts:
                toks = [x for x in split.split(t.lower()) if x]
                hits = [sum(maps[lab].get(x, 0) for x in toks) for lab in labels]
                if multi_label:
                    res.append([h / (h + 1) for h in hits])
                else:
                    tot = sum(hits)
                    res.append([h / tot if tot else 1.0 / len(labels) for h in hits])
            return res
        return predict
    return factory
