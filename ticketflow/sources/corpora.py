"""Multilingual corpora: first-n per language, labelled by round robin.

``load_language_corpora`` takes, for every requested language, the first
``samples_per_lang`` rows of a corpus table (explicit order key), tags
language and source, and unions them; languages with no rows contribute
nothing (the skip of a failing language), and no rows at all give an empty
frame with the schema.  It is one scan with a language filter and a
group-limited window, not one read per language.

``prepare_combined_dataset`` numbers the concatenation (languages in the
requested order, rows in order) with an exact global index (``range_rank`` on
language position and id), then labels row i with intents[i % 6] and
levels[i % 4].
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow import config as C
from ticketflow.operators.ranking import range_rank
from ticketflow.operators.splits import head_per_group

DEFAULT_LANGUAGES = C.SUPPORTED_LANGUAGES[:5]


def load_language_corpora(corpus: DataFrame, languages: list[str] | None = None,
                          samples_per_lang: int = 500, text_col: str = "text",
                          lang_col: str = "lang", id_col: str = "doc_id",
                          source: str = "documents") -> DataFrame:
    langs = list(languages or DEFAULT_LANGUAGES)
    sel = corpus.filter(F.col(lang_col).isin(langs)).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.col(lang_col).alias("language"), F.lit(source).alias("source"))
    return head_per_group(sel, "language", ["doc_id"], samples_per_lang)


def round_robin_label(df: DataFrame, order: list | str, labels: list[str], out: str,
                      index_col: str = "row_index") -> DataFrame:
    """labels[i % len(labels)] by the 0-based global index i in the order of ``order``."""
    order = [order] if isinstance(order, str) else order
    x = df if index_col in df.columns else range_rank(df, order, None, out=index_col)
    arr = F.array(*[F.lit(v) for v in labels])
    return x.withColumn(out, F.element_at(arr, (F.col(index_col) % len(labels) + 1).cast("int")))


def prepare_combined_dataset(corpus: DataFrame, target_languages: list[str] | None = None,
                             samples_per_lang: int = 500, **kw) -> DataFrame:
    """text, intent, urgency, language (+ doc_id, row_index) with round-robin labels."""
    langs = list(target_languages or DEFAULT_LANGUAGES)
    raw = load_language_corpora(corpus, langs, samples_per_lang, **kw)
    position = F.array_position(F.array(*map(F.lit, langs)), F.col("language"))
    x = range_rank(raw.withColumn("_position", position), ["_position", "doc_id", "text"], None, out="row_index")
    x = round_robin_label(x, [], C.INTENT_CATEGORIES, "intent")
    x = round_robin_label(x, [], C.URGENCY_LEVELS, "urgency")
    return x.select("doc_id", "row_index", "text", "intent", "urgency", "language")
