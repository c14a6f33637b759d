"""Translation by phrases: a trie of known phrases, a lattice over the text, protected slots.

A text is cut into words and what stands between them.  Masks ([URL],
[EMAIL]), words with a digit and names (capitals inside a sentence) are
protected and copied.  From every word the trie finds all known phrases that
begin there; the lattice of these phrases, copied slots and single unknown
words is solved from right to left for the fewest unknown words, then the fewest
pieces, then the longer first piece.  So the longest match wins unless a shorter one
saves an unknown word later.

Nothing is dropped in silence: the result names the unknown words of every
text, and ``phrase_gaps`` counts them over a table.

The phrase table goes to the workers as a broadcast whose size is checked
(``TABLE_BYTES``).  A larger table is first cut down to the phrases whose words
all occur in the texts (two joins on words); if it is still larger, the caller
has to translate in parts and an error says so.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.operators.augment import DEFAULT_TARGETS, _expand, english_head
from ticketflow.session import ship_package

TABLE_BYTES = 64 << 20
MAX_GAP_SHARE = 0.34        # texts with a larger share of unknown words are gaps, not translations
RESULT = "text string, n_words int, n_gaps int, gaps array<string>"
TOKEN = re.compile(r"\[[A-Z]+\]|[^\W_]+(?:['’][^\W_]+)*|\s+|[^\w\s]|_", re.UNICODE)
WORDS = r"\[[A-Z]+\]|[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"


def tokens(text: str) -> list[str]:
    """Words, masks, runs of white space and single other characters; they add up to the text."""
    return TOKEN.findall(text)


def is_word(token: str) -> bool:
    return token[0].isalnum() or (token[0] == "[" and len(token) > 1)


def protected(words: list[str], starts: list[bool]) -> list[bool]:
    """Masks, words with a digit, and capitalised words inside a sentence (not all of a shouted text)."""
    shouted = sum(w.isupper() for w in words) * 2 > len(words)
    return [w[0] == "[" or any(c.isdigit() for c in w)
            or (not start and not shouted and len(w) > 1 and w[0].isupper()) for w, start in zip(words, starts)]


def build_trie(phrases: dict[str, str]) -> dict:
    """Nested dictionaries by word; the empty key holds the translation."""
    root: dict = {}
    for source, target in phrases.items():
        node = root
        for w in (t.lower() for t in tokens(source) if is_word(t)):
            node = node.setdefault(w, {})
        if node is not root:
            node[""] = target
    return root


def best_path(words: list[str], copied: list[bool], trie: dict) -> list[tuple[int, int, str | None]]:
    """Pieces (from, to, translation or None) with the fewest unknown words, then the fewest
    pieces, then the longer first piece.  A copied word is a piece of its own, translated by itself,
    unless a phrase covers it."""
    n = len(words)
    low = [w.lower() for w in words]
    cost: list[tuple] = [(0, 0)] * (n + 1)
    choice: list[tuple] = [()] * n
    for i in range(n - 1, -1, -1):
        options = [((cost[i + 1][0] + (not copied[i]), cost[i + 1][1] + 1), -1, i + 1, words[i] if copied[i] else None)]
        node, j = trie, i
        while j < n and low[j] in node:
            node = node[low[j]]
            j += 1
            if "" in node:
                options.append(((cost[j][0], cost[j][1] + 1), -(j - i) - 1, j, node[""]))
        cost[i], _, to, target = min(options, key=lambda o: o[:2])
        choice[i] = (i, to, target)
    path, i = [], 0
    while i < n:
        path.append(choice[i])
        i = choice[i][1]
    return path


def translate(text: str, trie: dict) -> tuple[str, int, list[str]]:
    """(translation, number of words, unknown words); unknown words stay as they are."""
    parts = tokens(text)
    at = [k for k, t in enumerate(parts) if is_word(t)]
    words = [parts[k] for k in at]
    starts, fresh = [], True
    for t in parts:
        if is_word(t):
            starts.append(fresh)
            fresh = False
        elif t in ".!?:\n" or "\n" in t:
            fresh = True
    out, gaps, end = [], [], 0
    for i, j, target in best_path(words, protected(words, starts), trie):
        out.append("".join(parts[end:at[i]]))
        end = at[j - 1] + 1
        if target is None:
            gaps.append(words[i].lower())
            out.append(words[i])
        else:
            capital = words[i][0].isupper() and target[:1].islower()
            out.append(target[:1].upper() + target[1:] if capital else target)
    return "".join(out) + "".join(parts[end:]), len(words), gaps


@lru_cache(maxsize=2)
def _tries(number: int, sent) -> dict[str, dict]:
    by_language: dict[str, dict[str, str]] = {}
    for source, language, target in sent.value:
        by_language.setdefault(language, {})[source] = target
    return {language: build_trie(p) for language, p in by_language.items()}


def _small(phrases: DataFrame) -> bool:
    n, chars = phrases.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("source_text") + F.length("text")), F.lit(0))).first()
    return chars + 300 * n <= TABLE_BYTES


def known_phrases(phrases: DataFrame, texts: DataFrame, text_col: str) -> list[tuple[str, str, str]]:
    """Rows (source, language, translation) for the workers; equal sources: the smallest translation."""
    p = phrases.where(F.col("text").isNotNull() & F.col("source_text").isNotNull()).groupBy(
        "source_text", "target_language").agg(F.min("text").alias("text"))
    if not _small(p):
        words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORDS.replace("A-Z", "a-z")), 0))
        seen = texts.select(F.explode(words(F.col(text_col))).alias("word")).distinct()
        needed = p.withColumn("_words", words(F.col("source_text")))
        met = needed.select("source_text", "target_language", F.size("_words").alias("_n"), F.explode("_words").alias("word")).join(
            seen, "word").groupBy("source_text", "target_language", "_n").count().where("count = _n")
        p = p.join(met.select("source_text", "target_language"), ["source_text", "target_language"], "left_semi")
        if not _small(p):
            raise ValueError("the phrases that occur in these texts are too many for a worker: translate in parts")
    return sorted(tuple(r) for r in p.select("source_text", "target_language", "text").collect())


def phrase_translation(df: DataFrame, phrases: DataFrame, text_col: str = "text", language_col: str = "language") -> Column:
    """struct(text, n_words, n_gaps, gaps): ``text_col`` translated into each row's ``language_col``.

    Null texts give null; a language without phrases has every word as a gap.
    """
    spark = df.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(known_phrases(phrases, df, text_col))
    number = sent._jbroadcast.id()

    @F.pandas_udf(RESULT)
    def translated(texts: pd.Series, languages: pd.Series) -> pd.DataFrame:
        tries = _tries(number, sent)
        rows = []
        for text, language in zip(texts, languages):
            if text is None:
                rows.append((None, None, None, None))
                continue
            out, n, gaps = translate(text, tries.get(language, {}))
            rows.append((out, n, len(gaps), gaps))
        return pd.DataFrame(rows, columns=["text", "n_words", "n_gaps", "gaps"]).astype({"n_words": "Int32", "n_gaps": "Int32"})

    return translated(F.col(text_col), F.col(language_col))


def augment_with_phrases(df: DataFrame, phrases: DataFrame, order_col: str, samples_per_lang: int = 200,
                         targets: list[str] | None = None, text_col: str = "text", language_col: str = "language",
                         max_gap_share: float = MAX_GAP_SHARE) -> DataFrame:
    """The English head in every target language: translated text, ``n_gaps``, ``gaps`` and ``translated``.

    A row with a larger share of unknown words keeps its text under its own language with
    ``translated = false``, so that nothing carries a wrong label and every gap can be counted.
    """
    x = _expand(english_head(df, samples_per_lang, order_col, language_col), list(targets or DEFAULT_TARGETS), language_col)
    x = x.withColumn("_t", phrase_translation(x, phrases, text_col, language_col))
    good = F.coalesce((F.col("_t.n_words") > 0) & (F.col("_t.n_gaps") <= F.lit(max_gap_share) * F.col("_t.n_words")), F.lit(False))
    return (x.withColumn("translated", good).withColumn("target_language", F.col(language_col))
            .withColumn(text_col, F.when(good, F.col("_t.text")).otherwise(F.col(text_col)))
            .withColumn(language_col, F.when(good, F.col(language_col)).otherwise(F.col("_src_lang")))
            .withColumn("n_gaps", F.col("_t.n_gaps")).withColumn("gaps", F.col("_t.gaps")).drop("_t", "_src_lang"))


def phrase_gaps(augmented: DataFrame) -> DataFrame:
    """(target_language, word, n, n_texts): unknown words of ``augment_with_phrases``, most frequent first by n."""
    words = augmented.select("target_language", F.monotonically_increasing_id().alias("_row"), F.explode("gaps").alias("word"))
    return words.groupBy("target_language", "word", "_row").agg(F.count(F.lit(1)).alias("k")).groupBy(
        "target_language", "word").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_texts"))
