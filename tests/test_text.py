"""Cleaning, masking and hashing against the Python semantics they mirror."""

import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from ticketflow.functions import text as TX


def py_clean(text, max_length=512):
    if not text or not text.strip():
        return ""
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(r"https?://\S+|www\.\S+", "[URL]", text)
    text = re.sub(r"\S+@\S+\.\S+", "[EMAIL]", text)
    text = re.sub(r"\s+", " ", text).strip()
    return text[:max_length]


CASES = [
    "ｕｒｇｅｎｔ help",                      # full-width -> ASCII
    "Café is closed",                   # combining accent composes
    "tabs\tand\nnewlines\r\n  here ",
    "see https://example.com/a?b=1, now",
    "www.example.org/path and more",
    "mail me: a.b@example.co.uk!",
    "",
    "   \t \n",
    "x" * 600,
    "日本語のテキスト です",
    "nbsp and em sep\x1cfs\x85nel",
    "ﬁne ligature ① and ㎏",
    "100% sure {customer_name}",
    None,
]


def test_clean_text_matches_python(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", TX.clean_text("t").alias("c")).collect()}
    for i, c in enumerate(CASES):
        assert got[i] == py_clean(c), (i, c)


def test_whitespace_class_matches_python(spark):
    cps = [cp for cp in range(0x3100) if not (0xD800 <= cp <= 0xDFFF)]
    df = spark.createDataFrame([(cp, chr(cp)) for cp in cps], "cp int, ch string")
    got = {r.cp: r.ws for r in df.select("cp", F.col("ch").rlike("^" + TX.WS_CLASS + "$").alias("ws")).collect()}
    for cp in cps:
        assert got[cp] == bool(re.match(r"^\s$", chr(cp))), hex(cp)


def test_truncate_counts_code_points(spark):
    s = "é" * 10 + "😀" * 10
    r = spark.createDataFrame([(s,)], "t string").select(TX.truncate("t", 15).alias("x")).first()
    assert r.x == s[:15]


def test_text_hash(spark):
    s = "Héllo wörld"
    r = spark.createDataFrame([(s,)], "t string").select(TX.text_hash("t").alias("h")).first()
    assert r.h == hashlib.sha256(s.encode()).hexdigest()[:16]
    assert len(r.h) == 16


def test_validate_tickets(spark):
    df = spark.createDataFrame([(1, ""), (2, " "), (3, "a" * 5000), (4, "a" * 5001), (5, None)],
                               "id int, text string")
    got = {r.id: (r.is_valid, r.reject_reason) for r in TX.validate_tickets(df).collect()}
    assert got[1] == (False, "text too short")
    assert got[2] == (True, None)          # whitespace-only passes the length rule
    assert got[3] == (True, None)
    assert got[4] == (False, "text too long")
    assert got[5] == (False, "missing text")


def test_word_count_equals_token_count(spark):
    words = ["the", "é", "a.b", "naïve"]
    texts = ["The the, THE-the", "é é.é", "a.b a b", "naïve naïveté", "", "xthe thex"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = F.lower(F.col("t"))
    rows = df.select(TX.count_words(low, words).alias("n"),
                     F.size(F.filter(TX.tokens("t"), lambda x: x.isin(words))).alias("m")).collect()
    for r in rows:
        assert r.n == r.m


def test_display_label(spark):
    r = spark.createDataFrame([("technical_support",)], "l string").select(TX.display_label("l").alias("d")).first()
    assert r.d == "Technical Support"


def test_nfkc_engines_agree_on_assigned_code_points(spark):
    import unicodedata as ud
    cps = [cp for cp in range(0xA0, 0x30000, 7)
           if not (0xD800 <= cp <= 0xDFFF) and ud.category(chr(cp)) != "Cn"]
    df = spark.createDataFrame([(cp, "x" + chr(cp) + "ﬁ") for cp in cps], "cp int, s string")
    rows = df.select("cp", "s", TX.normalize_unicode("s", "jvm").alias("j"),
                     TX.normalize_unicode("s", "python").alias("p")).collect()
    for r in rows:
        assert r.j == r.p == ud.normalize("NFKC", r.s), hex(r.cp)
