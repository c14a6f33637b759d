"""Multilingual augmentation: first n English tickets x target languages.

The head is the first ``samples_per_lang`` rows (that is the feature), trimmed
map-side.  Each head row is repeated once per target language by exploding a
literal array (no join).  Text is translated by a phrase table (an equi-join on
source text and target language) or by a user's model via ``mapInPandas``.
A row without a translation yields no row: source text under another
language's label would be wrong training data.  ``translation_gaps`` reports
what was left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.operators.ranking import first_per_group
from ticketflow.session import ship_package

DEFAULT_TARGETS = ["es", "fr", "de", "pt"]

def english_head(df: DataFrame, n: int, order_col: str, language_col: str = "language",
                 source_language: str = "en") -> DataFrame:
    """First n source-language rows by ``order_col`` (any orderable key)."""
    return first_per_group(df.filter(F.col(language_col) == source_language), [language_col], [order_col], n)


def _expand(head: DataFrame, targets: list[str], language_col: str) -> DataFrame:
    return head.withColumn("_src_lang", F.col(language_col)).withColumn(
        language_col, F.explode(F.array(*[F.lit(t) for t in targets])))


def augment_languages(df: DataFrame, translations: DataFrame, order_col: str,
                      samples_per_lang: int = 200, targets: list[str] | None = None,
                      text_col: str = "text", language_col: str = "language") -> DataFrame:
    """``translations`` has (source_text, target_language, text)."""
    targets = list(targets or DEFAULT_TARGETS)
    head = english_head(df, samples_per_lang, order_col, language_col)
    x = _expand(head, targets, language_col)
    tr = translations.where(F.col("text").isNotNull()).select(
        F.col("source_text").alias("_st"), F.col("target_language").alias("_tl"), F.col("text").alias("_tt"))
    x = x.join(tr, (F.col(text_col) == F.col("_st")) & (F.col(language_col) == F.col("_tl")))
    return x.withColumn("translated", F.lit(True)).withColumn(text_col, F.col("_tt")).drop(
        "_st", "_tl", "_tt", "_src_lang")


def translation_gaps(df: DataFrame, translations: DataFrame, order_col: str, samples_per_lang: int = 200,
                     targets: list[str] | None = None, text_col: str = "text",
                     language_col: str = "language") -> DataFrame:
    """(target language, missing): head rows that ``augment_languages`` has no translation for."""
    x = _expand(english_head(df, samples_per_lang, order_col, language_col), list(targets or DEFAULT_TARGETS),
                language_col)
    tr = translations.where(F.col("text").isNotNull()).select(
        F.col("source_text").alias("_st"), F.col("target_language").alias("_tl"))
    missing = x.join(tr, (F.col(text_col) == F.col("_st")) & (F.col(language_col) == F.col("_tl")), "left_anti")
    return missing.groupBy(language_col).agg(F.count(F.lit(1)).alias("missing"))


TranslatorFactory = Callable[[str, str], Callable[[list], list]]


def augment_with_model(df: DataFrame, factory: TranslatorFactory, order_col: str,
                       samples_per_lang: int = 200, targets: list[str] | None = None,
                       text_col: str = "text", language_col: str = "language",
                       batch_size: int = 16) -> DataFrame:
    """Same contract with a user's translator: ``factory(src, tgt)`` returns
    ``translate(texts) -> texts``; one model per language pair and worker,
    texts sent ``batch_size`` at a time.  A pair whose factory raises is not
    translated: its rows stay, under their own language and with
    ``translated = false``, so a failing pair can be seen and counted.
    ``translated`` is also false where the model gave the text back unchanged."""
    targets = list(targets or DEFAULT_TARGETS)
    head = english_head(df, samples_per_lang, order_col, language_col)
    x = _expand(head, targets, language_col)
    schema = x.drop("_src_lang").schema.add("translated", "boolean")
    ship_package(df.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for pdf in it:
            outs = []
            for (src, tgt), grp in pdf.groupby(["_src_lang", language_col], sort=False):
                if (src, tgt) not in cache:
                    try:
                        cache[(src, tgt)] = factory(src, tgt)
                    except Exception:  # noqa: BLE001 - skip the language pair
                        cache[(src, tgt)] = None
                fn = cache[(src, tgt)]
                texts = grp[text_col].fillna("").tolist()
                if fn is None:
                    g = grp.copy()
                    g[language_col] = src
                    g["translated"] = False
                    outs.append(g.drop(columns=["_src_lang"]))
                    continue
                res = []
                for i in range(0, len(texts), batch_size):
                    res.extend(fn(texts[i:i + batch_size]))
                g = grp.copy()
                g[text_col] = res
                g["translated"] = [a != b for a, b in zip(texts, res)]
                outs.append(g.drop(columns=["_src_lang"]))
            if outs:
                yield pd.concat(outs, ignore_index=True)

    return x.mapInPandas(run, schema)


def dictionary_translator_factory(pairs: list[tuple]) -> TranslatorFactory:
    """A phrase-dictionary translator (source_text, target_language, text)."""
    table: dict = {}
    for src, tgt, txt in pairs:
        table.setdefault(tgt, {})[src] = txt

    def factory(src_lang, tgt_lang):
        m = table.get(tgt_lang)
        if m is None:
            raise LookupError(f"no model for {src_lang}->{tgt_lang}")
        return lambda texts: [m.get(t, t) for t in texts]
    return factory
