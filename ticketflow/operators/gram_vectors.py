"""Trigram profiles as dense vectors: one row per gram, scored in Arrow blocks.

A profile (language, gram, log_prob, unseen_log_prob) becomes one table: the
grams' 64-bit hashes in sorted order with a directory over their top bits, and
per gram a dense vector of what each language gains over its unseen score.
The table goes to the workers once, as a broadcast whose size is checked
(``TABLE_BYTES``); larger profiles use the join of ``operators.language``.

A block of texts is scored without an exploded row: code points in one array,
grams as integers, one probe of the hash array per gram, and the hit vectors
summed per text.  Scores are integers (units of 1 / ``SCALE``), so sums do not
depend on any order.  Nothing is shuffled.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.session import ship_package
from ticketflow.sources import fixture_data as D

SCALE = 1_000_000           # log probabilities are integers of this unit
TABLE_BYTES = 64 << 20      # larger tables are not sent to the workers
BLOCK_CHARS = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)   # odd: the hash is one to one
_EDGE = "\n"


class GramTable:
    """Sorted hash array of grams with one vector per gram."""

    def __init__(self, languages: list[str], unseen: list[int], gains: dict[str, dict[str, int]]):
        """``gains``: gram -> {language: log_prob - unseen}."""
        place = {lang: i for i, lang in enumerate(languages)}
        grams = list(gains)
        codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, 3)
        hashes = gram_hash(codes[:, 0], codes[:, 1], codes[:, 2])
        order = np.argsort(hashes)
        vectors = np.zeros((len(grams), len(languages)), np.int64)
        for row, gram in enumerate(grams):
            for lang, gain in gains[gram].items():
                vectors[row, place[lang]] = gain
        self.languages = np.array(languages, object)
        self.unseen = np.array(unseen, np.int64)
        self.hashes, self.vectors = hashes[order], vectors[order]
        bits = max(1, (4 * len(grams)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.directory = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each gram, -1 if the profile does not have it."""
        out = np.full(len(hashes), -1)
        cell = (hashes >> self.shift).astype(np.int64)
        at, end = self.directory[cell], self.directory[cell + 1]
        open_ = np.flatnonzero(at < end)
        at = at[open_]
        while len(open_):
            hit = self.hashes[at] == hashes[open_]
            out[open_[hit]] = at[hit]
            go = ~hit & (at + 1 < end[open_])
            open_, at = open_[go], at[go] + 1
        return out


def gram_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One-to-one 64-bit hash of three code points (21 bits each)."""
    return ((a << np.uint64(42)) | (b << np.uint64(21)) | c) * _MULTIPLIER


class _Kinds:
    """1 letter, 2 number, 0 other, per code point; categories are looked up once per process."""

    def __init__(self):
        self.kind = np.full(0x110000, -1, np.int8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        kind = self.kind[codes]
        if (kind < 0).any():
            for c in np.unique(codes[kind < 0]).tolist():
                self.kind[c] = {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 0)
            kind = self.kind[codes]
        return kind


_kinds = _Kinds()


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the texts, one edge character before and after each; sizes with edges)."""
    codes = np.frombuffer("".join(_EDGE + t + _EDGE for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes, np.array([len(t) + 2 for t in texts])


class WordTable:
    """Function words with the languages that list them."""

    def __init__(self, words: dict[str, list[str]]):
        self.names = list(words)
        distinct = sorted({w for ws in words.values() for w in ws if w})
        self.size = np.array([len(w) for w in distinct], np.int64)
        self.longest = int(self.size.max(initial=0))
        self.codes = np.zeros((len(distinct), max(self.longest, 1)), np.int64)
        for i, w in enumerate(distinct):
            self.codes[i, :len(w)] = [ord(c) for c in w]
        votes = np.array([[w in ws for ws in map(set, words.values())] for w in distinct], np.int64)
        self.votes = votes.reshape(len(distinct), len(self.names))
        keys = self._keys(self.codes, self.size)
        order = np.argsort(keys)
        self.keys, self.size, self.codes, self.votes = keys[order], self.size[order], self.codes[order], self.votes[order]

    def _keys(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64-bit keys of words given as rows of code points."""
        key = size.astype(np.uint64)
        for j in range(codes.shape[1]):
            key = np.where(j < size, key * _MULTIPLIER + codes[:, j].astype(np.uint64), key)
        return key

    def count(self, texts: list[str]) -> np.ndarray:
        """(texts x languages) number of words (runs of letters and numbers) that a language lists."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        if not len(self.keys):
            return out
        codes, size = _code_points(texts)
        inside = _kinds(codes) > 0
        start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        short = end - start <= self.longest
        start, end = start[short], end[short]
        # edges follow every text, so places past a word's end exist
        rows = codes[np.minimum(start[:, None] + np.arange(self.longest), len(codes) - 1)]
        length = end - start
        key = self._keys(rows, length)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == key)
        at, length, rows = at[hit], length[hit], rows[hit]
        # equal keys are compared letter by letter
        inside = np.arange(self.longest) < length[:, None]
        same = (self.size[at] == length) & ((rows == self.codes[at]) | ~inside).all(1)
        hit, at = hit[same], at[same]
        if len(hit):
            text = np.searchsorted(np.cumsum(size), start[hit], "right")
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            out[text[first]] = np.add.reduceat(self.votes[at], first)
        return out


def block_scores(texts: list[str], table: GramTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts x languages scores, which languages know a gram, grams per text) of lower-cased texts.

    Grams are those of ``operators.language.trigrams``: every run of characters
    that are not letters is one space, and a text begins and ends with one.
    """
    codes, size = _code_points(texts)
    letter = _kinds(codes) == 1
    # of a run of others the last one before a word stays, and the last one of the text
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    ends = np.cumsum(size) - 1
    keep[ends] = True
    owner = np.repeat(np.arange(len(texts)), size)[keep]
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    inside = np.flatnonzero(owner[2:] == owner[:-2])
    text = owner[inside]
    n_grams = np.bincount(text, minlength=len(texts))
    row = table.find(gram_hash(codes[inside], codes[inside + 1], codes[inside + 2]))
    hit = row >= 0
    text, row = text[hit], row[hit]
    gain = np.zeros((len(texts), len(table.languages)), np.int64)
    if len(text):
        start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        gain[text[start]] = np.add.reduceat(table.vectors[row], start)
    # a known gram gains at least log(2)
    return n_grams[:, None] * table.unseen + gain, gain > 0, n_grams


def _best(scores: np.ndarray, known: np.ndarray, table: GramTable) -> tuple[np.ndarray, np.ndarray]:
    """Best known language (first of equals) and its softmax share; None without one."""
    low = np.iinfo(np.int64).min
    masked = np.where(known, scores, low)
    best = masked.argmax(1)
    top = masked.max(1)
    share = np.where(known, (scores - top[:, None]) / SCALE, -np.inf)
    # added from the smallest on
    total = np.cumsum(np.exp(np.sort(share, 1)), 1)[:, -1]
    some = known.any(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(some, table.languages[best], None), np.where(some, 1.0 / total, np.nan)


def score_texts(texts: list[str | None], table: GramTable) -> pd.DataFrame:
    """(language, confidence) of each lower-cased text; null text or no known gram: null."""
    language, confidence = np.full(len(texts), None, object), np.full(len(texts), np.nan)
    group, size = [], 0
    for i, t in enumerate([*texts, None]):
        if t is not None:
            group.append(i)
            size += len(t) + 2
        if group and (size >= BLOCK_CHARS or i == len(texts)):
            scores, known, _ = block_scores([texts[k] for k in group], table)
            language[group], confidence[group] = _best(scores, known, table)
            group, size = [], 0
    return pd.DataFrame({"language": language, "confidence": confidence})


def text_blocks(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an Arrow column in consecutive parts of about BLOCK_CHARS bytes (or one longer text).

    Only one part at a time is held as Python strings, however large the batch is.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 2)
    lo = 0
    while lo < len(column):
        before = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + BLOCK_CHARS, "right")))
        yield column.slice(lo, hi - lo).to_pylist()
        lo = hi


def gram_vote(spark: SparkSession, lowered: Column, table: GramTable) -> Column:
    """struct(language, confidence) of a lower-cased text column (language null without evidence)."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(table)

    @F.arrow_udf("language string, confidence double")
    def vote(texts: pa.Array) -> pa.Array:
        found = [score_texts(block, sent.value) for block in text_blocks(texts)]
        return pa.StructArray.from_arrays(
            [pa.array([x for f in found for x in f["language"]], pa.string()),
             pa.array(np.concatenate([[], *(f["confidence"] for f in found)]), pa.float64(), from_pandas=True)],
            ["language", "confidence"])

    return vote(lowered)


def word_hits(spark: SparkSession, lowered: Column, words: dict[str, list[str]]) -> Column:
    """array<int>: words of a lower-cased text column that each language lists (``words`` order);
    a null text has none.  One pass per text, whatever the number of languages."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(WordTable(words))

    @F.arrow_udf("array<int>")
    def count(texts: pa.Array) -> pa.Array:
        hits = [sent.value.count([t or "" for t in block]) for block in text_blocks(texts)]
        flat = np.concatenate([np.zeros(0, np.int64), *(h.ravel() for h in hits)]).astype(np.int32)
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(words)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return count(lowered)


def _groups(texts: list[str], rows: np.ndarray):
    """Parts of ``rows`` whose texts have about BLOCK_CHARS characters together."""
    group, size = [], 0
    for i in rows.tolist():
        group.append(i)
        size += len(texts[i]) + 2
        if size >= BLOCK_CHARS:
            yield np.array(group)
            group, size = [], 0
    if group:
        yield np.array(group)


def choose_languages(lowered: list[str | None], settled: list[str | None], share: list[float],
                     words: WordTable, table: GramTable, fallback: str) -> pd.DataFrame:
    """(language, confidence) of each text from its script, its function words and its trigrams.

    A settled script decides; else the language with most function words (first of equals), unless
    the trigrams are more confident; texts that are null or without any evidence get (fallback, 0).
    """
    n = len(lowered)
    language, confidence = np.full(n, fallback, object), np.zeros(n)
    script = np.array([x is not None for x in settled], bool)
    language[script] = np.array(settled, object)[script]
    confidence[script] = np.array(share, float)[script]
    names = np.array(words.names, object)
    for rows in _groups(lowered, np.flatnonzero(~script & np.array([t is not None for t in lowered], bool))):
        votes = words.count([lowered[i] for i in rows])
        total, most = votes.sum(1), votes.max(1, initial=0)
        voted = total > 0
        language[rows[voted]] = names[votes[voted].argmax(1)] if voted.any() else None
        confidence[rows[voted]] = most[voted] / total[voted]
        # the vote wins ties, so a unanimous one is not asked again
        ask = ~voted | (most < total)
        if not ask.any():
            continue
        open_ = rows[ask]
        scores, known, _ = block_scores([lowered[i] for i in open_], table)
        found, sure = _best(scores, known, table)
        better = known.any(1) & (~voted[ask] | (sure > confidence[open_]))
        language[open_[better]] = found[better]
        confidence[open_[better]] = sure[better]
    return pd.DataFrame({"language": language, "confidence": confidence})


def language_choice(spark: SparkSession, lowered: Column, script: Column, words: dict[str, list[str]],
                    table: GramTable, fallback: str) -> Column:
    """struct(language, confidence) of ``choose_languages``; each argument is referred to once,
    so plans that use the language often do not repeat the expressions behind it."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast((WordTable(words), table))

    @F.pandas_udf("language string, confidence double")
    def choose(lowered: pd.Series, script: pd.DataFrame) -> pd.DataFrame:
        texts = [None if pd.isna(t) else t for t in lowered]
        settled = [None if pd.isna(x) else x for x in script["language"]]
        return choose_languages(texts, settled, script["confidence"].tolist(), *sent.value, fallback)

    return choose(lowered, script)


# ---------------------------------------------------------------- tables

def profile_table(profile: DataFrame, table_bytes: int = TABLE_BYTES) -> GramTable | None:
    """Table of a fitted profile, None if it would be larger than ``table_bytes``."""
    profile = profile.select("language", "gram", "log_prob", "unseen_log_prob")
    unseen = {r["language"]: r["unseen"] for r in profile.groupBy("language").agg(
        F.max("unseen_log_prob").alias("unseen")).limit(table_bytes // 64).collect()}
    n_grams = profile.agg(F.count_distinct("gram")).first()[0]
    if n_grams * (16 + 8 * len(unseen)) > table_bytes:
        return None
    gains: dict[str, dict[str, int]] = {}
    for batch in profile.toArrow().to_batches():
        for lang, gram, lp, none in zip(*(batch.column(i).to_pylist() for i in range(4))):
            gains.setdefault(gram, {})[lang] = lp - none
    languages = sorted(unseen)
    return GramTable(languages, [unseen[x] for x in languages], gains)


def builtin_text(lang: str) -> str:
    return " ".join([*D.FUNCTION_WORDS[lang], D.OVERLAP_SAMPLES.get(lang, ""), D.PROFILE_SAMPLES.get(lang, "")])


@lru_cache(maxsize=1)
def builtin_rows() -> list[tuple[str, str, int, int]]:
    """Profile of the package's own word lists and sample sentences (constants)."""
    import regex

    counts = {}
    for lang in D.FUNCTION_WORDS:
        text = regex.sub(" +", " ", " " + regex.sub(r"[^\p{L}]+", " ", builtin_text(lang).lower()) + " ")
        counts[lang] = Counter(text[i:i + 3] for i in range(len(text) - 2))
    vocab = len({g for c in counts.values() for g in c})
    units = lambda x: round(math.log(x) * SCALE)
    return [(lang, gram, units((n + 1) / (sum(c.values()) + vocab)), units(1 / (sum(c.values()) + vocab)))
            for lang, c in counts.items() for gram, n in sorted(c.items())]


@lru_cache(maxsize=1)
def builtin_table() -> GramTable:
    gains: dict[str, dict[str, int]] = {}
    unseen = {}
    for lang, gram, lp, none in builtin_rows():
        gains.setdefault(gram, {})[lang] = lp - none
        unseen[lang] = none
    languages = sorted(unseen)
    return GramTable(languages, [unseen[x] for x in languages], gains)
