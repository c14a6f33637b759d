"""Quality rules: base word counts and suffix-array repetition per document.

For each text the words are sorted as suffixes (prefix doubling over equality
classes, whole texts of a block at once); the longest common prefix of
neighbours in that order gives, for every word, the longest repeated word
sequence that starts there.  The spans of all maximal repeats of at least
``min_repeat`` words are united; a document is rejected when the united spans
cover more than ``max_covered`` of its words, or when its longest repeat is
longer than ``max_longest`` words and also more than ``longest_share`` of them.

Memory follows one block of whole texts (or one very long text); there is no
shuffle, every row is judged alone.

Defined results: a null or blank text has zero words and fails the base rule
(fewer than ``MIN_WORDS`` words); repeated rows are judged alike; an empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow.llm.blocks import U64, mix, text_blocks, window_hashes, worker_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WHITE_CHARS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class RepeatRules:
    min_repeat: int = 20        # words a repeat needs to count as covered text (a repeated line is fine)
    max_covered: float = 0.3    # share of words inside united repeats
    max_longest: int = 100      # words of the longest repeat ...
    longest_share: float = 0.2  # ... that must also exceed this share of the text


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "covered_words", "longest_repeat"]


def suffix_order(classes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Suffix array of several word sequences at once.

    ``classes`` holds one equality class per word, disjoint between texts; a
    suffix ends with its text.  Prefix doubling: only classes that still hold
    several suffixes are sorted again.
    """
    n = len(classes)
    order = np.argsort(classes, kind="stable")
    new = np.ones(n, bool)
    new[1:] = classes[order][1:] != classes[order][:-1]
    rank = np.empty(n, np.int64)
    begins = np.flatnonzero(new)
    rank[order] = begins[np.cumsum(new) - 1]
    step = 1
    while True:
        # open classes: runs of several suffixes with one rank
        ranks = rank[order]
        tied = np.zeros(n, bool)
        same = ranks[1:] == ranks[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        suffix = order[at]
        after = suffix + step
        inside = after < n
        inside[inside] &= text[after[inside]] == text[suffix[inside]]
        second = np.full(len(at), -1, np.int64)
        second[inside] = rank[after[inside]]
        head = ranks[at]
        by = np.lexsort((second, head))
        suffix, head, second = suffix[by], head[by], second[by]
        order[at] = suffix
        new = np.ones(len(at), bool)
        new[1:] = (head[1:] != head[:-1]) | (second[1:] != second[:-1])
        rank[suffix] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        step *= 2


def neighbour_lcp(order: np.ndarray, words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Common prefix length (words) of each suffix and the next one in ``order``.

    ``last[p]`` is the end of p's text.  Binary search on prefix hashes.
    """
    n = len(order)
    if n < 2:
        return np.zeros(0, np.int64)
    base = 0x9E3779B97F4A7C15
    power = np.full(n + 1, base, U64)
    power[0] = 1
    power = np.cumprod(power, dtype=U64)
    inverse = np.full(n + 1, pow(base, -1, 1 << 64), U64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=U64)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(words * power[:n], out=prefix[1:])
    lcp = np.zeros(n - 1, np.int64)
    pair = np.flatnonzero((words[order[1:]] == words[order[:-1]]) & (last[order[1:]] == last[order[:-1]]))
    a, b = order[:-1][pair], order[1:][pair]
    low = np.ones(len(pair), np.int64)
    high = np.minimum(last[a] - a, last[b] - b)
    while len(pair) and (low < high).any():
        middle = (low + high + 1) // 2
        equal = ((prefix[a + middle] - prefix[a]) * inverse[a]
                 == (prefix[b + middle] - prefix[b]) * inverse[b])
        low = np.where(equal, middle, low)
        high = np.where(equal, high, middle - 1)
    lcp[pair] = low
    return lcp


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of positions inside any [start, start + length)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0


def repeats(words: np.ndarray, first: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(words inside maximal repeats of >= min_repeat words, longest repeat) per text."""
    n, n_texts = len(words), len(first) - 1
    covered = np.zeros(n_texts, np.int64)
    longest = np.zeros(n_texts, np.int64)
    if n < 2:
        return covered, longest
    text = np.repeat(np.arange(n_texts), np.diff(first))
    order = suffix_order(mix(words + mix(text.astype(U64) + U64(1))), text)
    lcp = neighbour_lcp(order, words, first[1:][text])
    length = np.zeros(n, np.int64)      # of the longest repeat that starts at a word
    length[order[:-1]] = lcp
    length[order[1:]] = np.maximum(length[order[1:]], lcp)
    np.maximum.at(longest, text, length)
    at = np.flatnonzero(length >= min_repeat)
    if len(at):
        covered += np.bincount(text[_covered(at, length[at], n)], minlength=n_texts)
    return covered, longest


def repeated_window_words(words: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """Words per text that lie in a ``size``-word window found at least twice in it."""
    n_texts = len(first) - 1
    h, at = window_hashes(words, first, size)
    if not len(h):
        return np.zeros(n_texts, np.int64)
    text = np.repeat(np.arange(n_texts), np.diff(first))
    key = mix(h + mix(text[at].astype(U64) + U64(1)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = at[twice]
    return np.bincount(text[_covered(starts, np.full(len(starts), size), len(words))], minlength=n_texts)


def _line_counts(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE_CHARS)]
    return len(lines) - len(set(lines))


def measure(column: pa.Array, rules: RepeatRules) -> dict[str, np.ndarray]:
    """All measures of a text column, in row order."""
    out = {m: np.zeros(len(column), np.int64) for m in MEASURES}
    for block in text_blocks(column):
        span = slice(block.lo, block.hi)
        words = block.word_hashes()
        out["n_words"][span] = block.n_words
        out["n_repeat_words"][span] = repeated_window_words(words, block.first)
        out["covered_words"][span], out["longest_repeat"][span] = repeats(words, block.first, rules.min_repeat)
        for i, text in enumerate(column.slice(block.lo, block.hi - block.lo).to_pylist(), block.lo):
            if text:
                out["word_chars"][i] = len(text) - sum(map(text.count, WHITE_CHARS))
                out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
                out["n_dup_lines"][i] = _line_counts(text)
    return out


def quality_rules(df: DataFrame, text: str = "text", rules: RepeatRules = RepeatRules()) -> DataFrame:
    """``df`` with a struct column ``quality``: the measures, ``base_failed`` and ``kept``.

    A struct keeps the new names apart from any column of the input; an input
    column named ``quality`` is replaced.
    """
    schema = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

    @F.arrow_udf(schema)
    def measured(texts: pa.Array) -> pa.Array:
        worker_of("quality")
        found = measure(texts, rules)
        return pa.StructArray.from_arrays([pa.array(found[m]) for m in MEASURES], names=MEASURES)

    q = F.col("__quality")
    failed = (q.n_words < MIN_WORDS) | (100 * q.n_repeat_words > MAX_REPEAT_PERCENT * q.n_words)
    repeated = ((q.covered_words > F.lit(rules.max_covered) * q.n_words)
                | ((q.longest_repeat > rules.max_longest)
                   & (q.longest_repeat > F.lit(rules.longest_share) * q.n_words)))
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != "quality"]
    return (df.withColumn("__quality", measured(F.col(text)))
            .select(*columns, F.struct(*(q[m].alias(m) for m in MEASURES), failed.alias("base_failed"),
                                       (~failed & ~repeated).alias("kept")).alias("quality")))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.tables import table

    q = quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"))
    return q.select("doc_id", *(F.col(f"quality.{m}") for m in
                                ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                 "covered_words", "base_failed", "kept")))
