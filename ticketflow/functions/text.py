"""Text cleaning and hashing as Spark column expressions.

Cleaning order (per ticket): blank -> '' ; NFKC ; mask URLs ; mask e-mails ;
collapse whitespace + strip ; cut to ``max_length`` code points.  Masking
happens before the cut, so a mask token can itself be cut.

Java's ``\\s`` is ASCII-only; the class below matches exactly the
characters Python's ``str`` whitespace class matches, and its complement is
used for ``\\S``.  Everything except NFKC runs JVM-side inside whole-stage
codegen; NFKC has no built-in, so an Arrow-batched pandas UDF handles it and
only rows holding a non-ASCII character are shipped to Python (ASCII text is
invariant under NFKC).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow.config import MAX_LENGTH, MAX_REQUEST_CHARS

# FIXED VALUES: whitespace class equal to Python's str whitespace, and the
# masking patterns and mask tokens.
WS_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"
NON_WS_CLASS = r"[^\s\x1c-\x1f\x85\p{Z}]"
URL_PATTERN = rf"https?://{NON_WS_CLASS}+|www\.{NON_WS_CLASS}+"
EMAIL_PATTERN = rf"{NON_WS_CLASS}+@{NON_WS_CLASS}+\.{NON_WS_CLASS}+"
URL_TOKEN = "[URL]"
EMAIL_TOKEN = "[EMAIL]"
# the at sign and the characters that NFKC turns into one
AT_SIGNS = "[@\ufe6b\uff20]"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if isinstance(x, str) else None)


NFKC_ENGINE = "jvm"


def normalize_unicode(text, engine: str | None = None) -> Column:
    """NFKC for rows holding a non-ASCII character (ASCII is NFKC-invariant).

    ``engine="jvm"`` (default) calls ICU4J's static NFKC compose through
    Spark's ``reflect``: JVM-side, no Python round trip.  ICU4J in Spark 4.1
    implements Unicode 16; for every code point assigned in Python 3.13's
    Unicode 15.1 it gives the same result as ``unicodedata.normalize``
    (checked over all code points); only 36 code points added in Unicode 16
    differ.  ``engine="python"`` uses ``unicodedata`` in an Arrow-batched UDF,
    shipping only the non-ASCII rows (others are sent as null).
    """
    t = _col(text)
    non_ascii = t.rlike(r"[^\x00-\x7F]")
    if (engine or NFKC_ENGINE) == "python":
        return F.coalesce(_nfkc_udf(F.when(non_ascii, t)), t)
    icu = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    return F.when(non_ascii, icu).otherwise(t)


def mask_urls(text) -> Column:
    return F.regexp_replace(_col(text), URL_PATTERN, URL_TOKEN)


def mask_emails(text) -> Column:
    return F.regexp_replace(_col(text), EMAIL_PATTERN, EMAIL_TOKEN)


def collapse_whitespace(text) -> Column:
    """Runs of whitespace -> one space, then strip (after collapsing, a plain
    space trim is a full strip)."""
    return F.trim(F.regexp_replace(_col(text), WS_CLASS + "+", " "))


def truncate(text, max_length: int = MAX_LENGTH) -> Column:
    return F.substring(_col(text), 1, int(max_length))


def is_blank(text) -> Column:
    t = _col(text)
    return t.isNull() | t.rlike(r"^" + WS_CLASS + r"*$")


def clean_text(text, max_length: int = MAX_LENGTH, normalize: bool = True,
               nfkc_engine: str | None = None) -> Column:
    """All cleaning steps as one column expression."""
    t = _col(text)
    x = normalize_unicode(t, nfkc_engine) if normalize else t
    x = mask_urls(x)
    # most texts hold no address; the pattern costs more than the rest together
    x = F.when(t.rlike(AT_SIGNS), mask_emails(x)).otherwise(x)
    x = truncate(collapse_whitespace(x), max_length)
    return F.when(is_blank(t), F.lit("")).otherwise(x)


def preprocess_batch(df, text_col: str = "text", out_col: str = "cleaned_text",
                     max_length: int = MAX_LENGTH):
    """``clean_text`` over a DataFrame column."""
    return df.withColumn(out_col, clean_text(text_col, max_length))


def text_hash(text) -> Column:
    """First 16 hex characters of SHA-256 over the UTF-8 text."""
    return F.substring(F.sha2(_col(text), 256), 1, 16)


def tokens(text) -> Column:
    """Lower-cased word tokens (letters and digits), empty pieces removed."""
    parts = F.split(F.lower(_col(text)), TOKEN_SPLIT)
    return F.filter(parts, lambda x: x != F.lit(""))


def _java_literal(word: str) -> str:
    """Escape a word for a Java regex (backslash before every non-alphanumeric)."""
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in word)


def word_alternation(words) -> str:
    """Regex matching a whole token (``[^\\p{L}\\p{N}]`` bounded) equal to any
    of ``words``; counting its matches in lower-cased text equals counting
    the tokens produced by ``tokens`` that are in ``words``.

    Words are grouped by their first character, so a token is tried against few
    of them; at most one word ends where the token does, whatever their order."""
    ws = [w for w in set(words) if w and all(ch.isalnum() for ch in w)]  # others never form a token
    if not ws:
        return r"(?!)"
    groups: dict[str, list[str]] = {}
    for w in sorted(ws, key=lambda w: (-len(w), w)):
        groups.setdefault(w[0], []).append(_java_literal(w[1:]))
    alts = "|".join(_java_literal(first) + "(?:" + "|".join(rest) + ")" for first, rest in sorted(groups.items()))
    return r"(?<![\p{L}\p{N}])(?:" + alts + r")(?![\p{L}\p{N}])"


def count_words(lowered, words) -> Column:
    """Number of tokens of an already lower-cased text that are in ``words``."""
    if not words:
        return F.lit(0)
    return F.regexp_count(_col(lowered), F.lit(word_alternation(words)))


def validate_tickets(df, text_col: str = "text", min_chars: int = 1,
                     max_chars: int = MAX_REQUEST_CHARS):
    """Flag rows by the request rule (length 1..5000 code points; blank passes).

    Adds ``is_valid`` and ``reject_reason``; callers split accepted rows from
    a quarantine output with one filter each.
    """
    n = F.length(F.col(text_col))
    reason = (
        F.when(F.col(text_col).isNull(), F.lit("missing text"))
        .when(n < min_chars, F.lit("text too short"))
        .when(n > max_chars, F.lit("text too long"))
    )
    return df.withColumn("reject_reason", reason).withColumn(
        "is_valid", F.col("reject_reason").isNull()
    )


def split_valid(df, text_col: str = "text", min_chars: int = 1, max_chars: int = MAX_REQUEST_CHARS):
    """(accepted rows as they were, quarantined rows with ``reject_reason``)."""
    checked = validate_tickets(df, text_col, min_chars, max_chars)
    accepted = checked.where("is_valid").drop("is_valid", "reject_reason")
    return accepted, checked.where("not is_valid").drop("is_valid")


def display_label(label) -> Column:
    """``technical_support`` -> ``Technical Support``."""
    return F.initcap(F.replace(_col(label), F.lit("_"), F.lit(" ")))
