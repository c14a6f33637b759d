"""Language detection as Spark jobs.

Two deterministic backends stand in for per-row detector libraries; each
yields struct(language, confidence) or null when it has no evidence:

* ``function_word_vote``: tokens that are function words of a language are
  votes; the language with most votes wins (ties: list order), confidence =
  its votes / all votes.  For the small built-in lists the count happens
  in-row (no shuffle); ``function_word_vote_join`` is the long form for word
  tables of any size (explode -> join -> partial aggregate per text).
* ``ngram_profile``: character trigram profiles fitted from labelled text
  (``fit_ngram_profile``) and scored with add-one smoothed log
  probabilities and a softmax (``score_ngram_profile``): one dense vector per
  gram, sent to the workers, and no row per trigram (``gram_vectors``).

Before both, ``script_language`` settles texts most of whose letters belong to
the script of one supported language (Chinese, Japanese, Korean, Arabic, Hindi,
Thai, Russian).

``detect_language`` keeps the most confident backend (first backend wins ties)
and falls back to (fallback, 0.0) for blank text or when no backend has
evidence.  It is a chain of column expressions and one Arrow evaluation: no
shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow import config as C
from ticketflow.functions.text import WS_CLASS, count_words, is_blank, tokens
from ticketflow.operators import gram_vectors as GV
from ticketflow.operators.gram_vectors import SCALE
from ticketflow.sources import fixture_data as D


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lang_struct(lang: Column, conf: Column) -> Column:
    return F.struct(lang.alias("language"), conf.cast("double").alias("confidence"))


# ---------------------------------------------------------------- scripts

KANA = r"\p{IsHiragana}\p{IsKatakana}"
SCRIPTS = {"zh": r"\p{IsHan}", "ko": r"\p{IsHangul}", "ar": r"\p{IsArabic}", "hi": r"\p{IsDevanagari}",
           "th": r"\p{IsThai}", "ru": r"\p{IsCyrillic}"}
BEYOND_LATIN = r"[^\x00-\u03FF]"      # none of these scripts has a character below
KANA_SHARE = 0.1        # of the Han and kana characters, from which they are Japanese


def script_language(text) -> Column:
    """struct(language, confidence) if more than half of the letters (with their
    marks) belong to the script of one supported language, else null.

    Han characters are Chinese unless at least a tenth of them and the kana is
    kana; equal counts go to the first of zh/ja, ko, ar, hi, th, ru.  Confidence is the share.
    Texts without a character of these scripts cost one scan.
    """
    t = _c(text)
    count = lambda cls: F.regexp_count(t, F.lit(f"[{cls}]")).cast("double")
    counts = F.array(F.array(count(SCRIPTS["zh"]), count(KANA)),
                     F.array(*[count(SCRIPTS[x]) for x in ("ko", "ar", "hi", "th", "ru")]),
                     F.array(count(r"\p{L}\p{M}")))

    def settled(c: Column) -> Column:
        han, kana = c[0][0], c[0][1]
        east = F.when(kana >= KANA_SHARE * (han + kana), F.lit("ja")).otherwise(F.lit("zh"))
        most = F.greatest(han + kana, F.array_max(c[1]))
        lang = F.when(han + kana >= most, east).otherwise(F.element_at(
            F.array(*[F.lit(x) for x in ("ko", "ar", "hi", "th", "ru")]), F.array_position(c[1], most).cast("int")))
        return F.when(2 * most > c[2][0], lang_struct(lang, F.least(most / F.greatest(c[2][0], F.lit(1.0)), F.lit(1.0))))

    # the range is tested first: it costs a fraction of the classes by script
    any_script = t.rlike(BEYOND_LATIN) & t.rlike("[" + KANA + "".join(SCRIPTS.values()) + "]")
    # one element: the counts are evaluated once, and only for texts with such characters
    return F.when(any_script, F.element_at(F.transform(F.array(counts), settled), 1))


# ---------------------------------------------------------------- backend A


def function_word_hits(lowered, words: dict | None = None) -> Column:
    """array<int>: votes per language (in ``words`` order) from lower-cased
    text; each count is one token-bounded regex scan (codegen, no lambda)."""
    words = words or D.FUNCTION_WORDS
    return F.array(*[count_words(lowered, ws) for ws in words.values()])


def vote_from_hits(hits, words: dict | None = None) -> Column:
    """struct(language, confidence) or null from a hits column (reference it
    by name: it is used several times)."""
    words = words or D.FUNCTION_WORDS
    h = _c(hits)
    best = F.array_max(h)
    total = F.aggregate(h, F.lit(0), lambda a, x: a + x)
    lang = F.element_at(F.array(*[F.lit(x) for x in words]), F.array_position(h, best).cast("int"))
    return F.when(total > 0, lang_struct(lang, best / total))


def function_word_vote(text, words: dict | None = None) -> Column:
    """Single-expression form; DataFrame jobs use ``add_function_word_vote``."""
    return vote_from_hits(function_word_hits(F.lower(_c(text)), words), words)


def add_function_word_vote(df: DataFrame, text_col: str, out: str = "vote",
                           words: dict | None = None, lowered_col: str | None = None) -> DataFrame:
    """Adds ``out`` = struct(language, confidence) or null, counted in-row.

    The words are counted for all languages in one pass over Arrow blocks of
    texts (a regex scan per language costs several times as much); the hit
    counts are a separate projection so they are computed once.
    """
    words = words or D.FUNCTION_WORDS
    x = df if lowered_col else df.withColumn("_fw_low", F.lower(F.col(text_col)))
    x = x.withColumn("_fw_hits", GV.word_hits(df.sparkSession, F.col(lowered_col or "_fw_low"), words))
    x = x.withColumn(out, vote_from_hits("_fw_hits", words))
    return x.drop("_fw_hits") if lowered_col else x.drop("_fw_hits", "_fw_low")


def function_word_vote_join(df: DataFrame, words: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Long form: (id, vote struct) for every text with at least one hit.

    ``words`` has (language, word) and optionally ``lang_pos`` (tie order).
    Tokens of one text stay in one partition until the partial aggregate, so
    the shuffle carries at most (texts x languages) rows.
    """
    if "lang_pos" in words.columns:
        w = words.select("language", "word", "lang_pos")
    else:
        # ties go to the smaller language code
        w = words.select("language", "word", F.col("language").alias("lang_pos"))
    tok = df.select(id_col, F.explode(tokens(F.col(text_col))).alias("word"))
    votes = tok.join(w, "word").groupBy(id_col, "language", "lang_pos").agg(
        F.count(F.lit(1)).alias("votes"))
    per = votes.groupBy(id_col).agg(
        F.min_by(F.struct("language", "votes"),
                 F.struct((-F.col("votes")).alias("nv"), F.col("lang_pos"))).alias("best"),
        F.sum("votes").alias("total"))
    return per.select(id_col, lang_struct(F.col("best.language"),
                                          F.col("best.votes") / F.col("total")).alias("vote"))


# ---------------------------------------------------------------- backend B

def trigrams(text) -> Column:
    """Character trigrams of the lower-cased text; non-letters act as one space.

    One linear regex pass: an empty match at every position whose lookahead
    captures the next three characters (positional ``substring`` would be
    quadratic on long UTF-8 text).
    """
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(_c(text)), r"[^\p{L}]+", " "), F.lit(" "))
    t = F.regexp_replace(t, " +", " ")
    return F.regexp_extract_all(t, F.lit("(?=(.{3}))"), 1)


def fit_ngram_profile(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(language, gram, log_prob, unseen_log_prob) with add-one smoothing.

    Log probabilities are integers in units of 1 / SCALE: sums of them do not
    depend on the order of addition, so the argmax is reproducible anywhere.
    Counting is a partial aggregation by (language, gram): a frequent gram is
    combined map-side before the shuffle.  The counts are checkpointed to the
    shared checkpoint dir once, so the vocabulary size and the scoring read
    the same materialized table.
    """
    from ticketflow.session import materialize

    grams = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("language"), F.explode(trigrams(F.col(text_col))).alias("gram"))
    counts = materialize(grams.groupBy("language", "gram").agg(F.count(F.lit(1)).alias("cnt")))
    totals = counts.groupBy("language").agg(F.sum("cnt").alias("n_lang"))
    vocab = counts.select("gram").distinct().count()  # one scalar
    prof = counts.join(totals, "language")
    den = (F.col("n_lang") + F.lit(vocab)).cast("double")
    units = lambda x: F.round(F.log(x) * SCALE).cast("long")
    return prof.select("language", "gram", units((F.col("cnt") + 1) / den).alias("log_prob"),
                       units(F.lit(1.0) / den).alias("unseen_log_prob"))


def score_ngram_profile(df: DataFrame, profile: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ngram struct(language, confidence)); confidence = softmax share
    among the languages that know a trigram of the text.

    The profile goes to the workers as one vector per gram (up to
    ``gram_vectors.TABLE_BYTES``, else the join below) and texts are scored in
    Arrow blocks.  Ties go to the smaller language code.  Texts without any
    known gram have no row.
    """
    table = GV.profile_table(profile)
    if table is None:
        return score_ngram_profile_join(df, profile, id_col, text_col)
    vote = GV.gram_vote(df.sparkSession, F.lower(F.col(text_col)), table)
    # not a filter: it would be moved below and score every text a second time
    return df.select(id_col, vote.alias("_vote")).select(
        id_col, F.explode(F.when(F.col("_vote.language").isNotNull(), F.array("_vote"))).alias("ngram"))


def score_ngram_profile_join(df: DataFrame, profile: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``score_ngram_profile`` for profiles too large to be sent to every worker.

    One explode of the text's trigrams, a join to the profile (its size
    decides the join: the planner broadcasts it or AQE splits hot grams), and
    a partial aggregation per (text, language), then per text.
    """
    g = df.select(id_col, trigrams(F.col(text_col)).alias("_g")).select(
        id_col, F.size("_g").cast("long").alias("n_grams"), F.explode("_g").alias("gram"))
    hits = g.join(profile, "gram")
    # unknown grams count as unseen, so only the known ones need a row
    per = hits.groupBy(id_col, "n_grams", "language").agg(
        (F.col("n_grams") * F.max("unseen_log_prob") + F.sum(F.col("log_prob") - F.col("unseen_log_prob"))).alias("score"))
    best = per.groupBy(id_col).agg(
        F.max("score").alias("_mx"), F.sort_array(F.collect_list("score")).alias("_s"),
        F.min_by("language", F.struct((-F.col("score")).alias("worse"), F.col("language"))).alias("_best"))
    z = F.aggregate("_s", F.lit(0.0), lambda acc, x: acc + F.exp((x - F.col("_mx")) / SCALE))
    return best.select(id_col, lang_struct(F.col("_best"), F.lit(1.0) / z).alias("ngram"))


def builtin_profile(spark: SparkSession) -> DataFrame:
    """Trigram profile of the package's own word lists and sample sentences (constants)."""
    return spark.createDataFrame(GV.builtin_rows(),
                                 "language string, gram string, log_prob long, unseen_log_prob long")


# ---------------------------------------------------------------- ensemble

def best_language(first, second) -> Column:
    """Most confident of two struct(language, confidence); first wins ties."""
    a, b = _c(first), _c(second)
    return F.when(a.isNull(), b).when(b.isNull(), a) \
        .when(b["confidence"] > a["confidence"], b).otherwise(a)


def detect_language(df: DataFrame, text_col: str = "cleaned_text", profile: DataFrame | None = None,
                    fallback: str = "en", words: dict | None = None, lowered_col: str | None = None) -> DataFrame:
    """Adds ``language`` and ``language_confidence`` (unrounded): scripts first, then both backends.

    The trigram backend (the built-in table unless a ``profile`` is given) only
    looks at texts that no script settles and whose vote is not unanimous,
    since the first backend wins ties.
    """
    spark = df.sparkSession
    words = words or D.FUNCTION_WORDS
    out = df if lowered_col else df.withColumn("_low", F.lower(F.col(text_col)))
    low = F.col(lowered_col or "_low")
    out = out.withColumn("_script", script_language(text_col))
    table = GV.builtin_table() if profile is None else GV.profile_table(profile)
    if table is not None:
        # blank texts have no script and are not asked: they get the fallback
        found = out.withColumn("_lang", GV.language_choice(
            spark, F.when(~is_blank(F.col(text_col)), low), F.col("_script"), words, table, fallback))
    else:
        out = out.withColumn("_hits", function_word_hits(low, words))
        out = out.withColumn("_vote", vote_from_hits("_hits", words)).withColumn("_key", F.md5(F.col(text_col)))
        open_rows = (~is_blank(F.col(text_col)) & F.col("_script").isNull()
                     & F.coalesce(F.col("_vote.confidence") < 1.0, F.lit(True)))
        texts = out.where(open_rows).select("_key", F.col(text_col).alias("_text")).dropDuplicates(["_key"])
        found = out.join(score_ngram_profile_join(texts, profile, "_key", "_text"), "_key", "left").withColumn(
            "_lang", F.coalesce(F.col("_script"), best_language("_vote", "ngram"), lang_struct(F.lit(fallback), F.lit(0.0))))
    return (found.withColumn("language", F.col("_lang.language"))
            .withColumn("language_confidence", F.col("_lang.confidence"))
            .drop(*([] if lowered_col else ["_low"]), "_hits", "_script", "_lang", "_vote", "_key", "ngram"))


def detect_batch(df: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    return detect_language(df, text_col, **kw).drop("language_confidence")


def detect_batch_with_confidence(df: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    return detect_language(df, text_col, **kw)


# ---------------------------------------------------------------- helpers

def token_overlap_language(text, samples: dict | None = None, default: str = "en",
                           min_overlap: int = 3) -> Column:
    """First non-default language whose sample shares more than ``min_overlap``
    distinct whitespace tokens with the text, else ``default``."""
    samples = samples or D.OVERLAP_SAMPLES
    toks = F.array_distinct(F.filter(F.split(F.lower(_c(text)), WS_CLASS + "+"), lambda x: x != ""))
    expr = F.lit(default)
    for lang, sample in reversed(list(samples.items())):
        if lang == default:
            continue
        st = sorted(set(sample.lower().split()))
        shared = F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in st])))
        expr = F.when(shared > min_overlap, F.lit(lang)).otherwise(expr)
    return expr


def language_names(df: DataFrame, code_col: str = "language", names: dict | None = None) -> DataFrame:
    """Adds ``language_name``; unknown codes map to themselves (broadcast of
    the fixed name table)."""
    names = names or C.LANGUAGE_NAMES
    spark = df.sparkSession
    dim = spark.createDataFrame(list(names.items()), "_code string, _name string")
    out = df.join(F.broadcast(dim), F.col(code_col) == F.col("_code"), "left")
    return out.withColumn("language_name", F.coalesce(F.col("_name"), F.col(code_col))).drop("_code", "_name")

