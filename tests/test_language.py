"""Scripts, gram vectors and the language decision."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketflow import config as C
from ticketflow.operators import gram_vectors as GV
from ticketflow.operators.language import (builtin_profile, detect_language, fit_ngram_profile, function_word_hits,
                                           score_ngram_profile, score_ngram_profile_join, script_language, trigrams)
from ticketflow.sources import fixture_data as D

# one sentence per language, not in the package's word lists or samples
SENTENCES = {
    "en": "Where is the parcel that I ordered and what can you do for me?",
    "es": "El paquete que pedí no está en la oficina y se perdió por el camino",
    "fr": "Je n'ai pas reçu le colis et vous êtes les premiers avec qui je parle",
    "de": "Das Paket ist nicht bei mir angekommen und ich bitte um eine Antwort",
    "pt": "O pacote não chegou com a data da entrega e os dados não foram alterados",
    "it": "Il pacco che ho ordinato non è arrivato e sono molto deluso della consegna",
    "nl": "Het pakket dat ik heb besteld is niet aangekomen en wij wachten al een week",
    "pl": "Paczka nie dotarła, proszę sprawdzić, czy jest w drodze i kiedy się pojawi",
    "vi": "Gói hàng của tôi không được giao và tôi cần một câu trả lời cho vấn đề này",
    "id": "Paket yang saya pesan tidak sampai dan saya sudah menunggu dengan sabar untuk kabar",
    "tr": "Paket bana ulaşmadı ve bu konu için bir cevap bekliyorum, çok teşekkürler",
    "sv": "Paketet som jag har beställt är inte här och jag undrar när det kommer till oss",
    "da": "Pakken er ikke kommet, og jeg vil gerne have et svar fra jer i dag",
    "zh": "我上周订购的包裹还没有送到,请帮我查询一下",
    "ja": "先週注文した荷物がまだ届いていません。確認をお願いします",
    "ko": "지난주에 주문한 소포가 아직 도착하지 않았습니다",
    "ar": "لم يصل الطرد الذي طلبته الأسبوع الماضي",
    "hi": "पिछले हफ़्ते मँगाया हुआ पार्सल अभी तक नहीं आया",
    "th": "พัสดุที่ฉันสั่งเมื่อสัปดาห์ที่แล้วยังไม่มาถึง",
    "ru": "Посылка, которую я заказал на прошлой неделе, не пришла",
}


def test_every_supported_language_has_a_way(spark):
    assert sorted([*D.FUNCTION_WORDS, *D.SCRIPT_LANGUAGES]) == sorted(C.SUPPORTED_LANGUAGES)
    assert sorted(SENTENCES) == sorted(C.SUPPORTED_LANGUAGES)
    df = spark.createDataFrame(list(SENTENCES.items()), "want string, t string")
    got = {r["want"]: r["language"] for r in detect_language(df, "t").collect()}
    assert got == {x: x for x in SENTENCES}


@pytest.mark.parametrize("text, language", [
    ("hello 世界", None), ("订单 number 12", None), ("订单号码 A1", "zh"), ("カ漢漢漢漢漢漢漢漢漢漢漢漢", "zh"), ("カ漢漢漢漢漢漢漢", "ja"),
    ("привет hello", "ru"), ("привет worlds", None), ("한국어 中文", "ko"), ("中文字 한국", "zh"), ("12 !? 🙂", None), ("", None), (None, None),
    ("สวัสดี ok", "th"), ("é à ü ñ", None), ("[URL] Не работает [EMAIL]", "ru")])
def test_scripts_of_mixed_texts(spark, text, language):
    r = spark.createDataFrame([(text,)], "t string").select(script_language("t").alias("s")).first()["s"]
    assert (r["language"] if r else None) == language
    if r:
        assert 0.5 < r["confidence"] <= 1


def test_detection_of_blank_and_odd_texts(spark):
    rows = [(0, None), (1, ""), (2, " \t "), (3, "12345"), (4, "zzz qqq xxx"), (5, "x" * 300_000 + " the and is"),
            (6, "数据"), (7, "the and 数据库"), (8, "a"), (9, "the the the el")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "i int, t string, _vote int, hits string")
    got = {r["i"]: r for r in detect_language(df, "t", fallback="xx").collect()}
    assert [got[i]["language"] for i in (0, 1, 2, 3)] == ["xx"] * 4 and got[0]["language_confidence"] == 0
    assert [got[i]["language"] for i in (5, 6, 9)] == ["en", "zh", "en"]
    assert detect_language(df.limit(0), "t").count() == 0


def _texts(n):
    rnd = random.Random(n)
    words = "the der les ñandú Über ça straße ÉTÉ naïve 日本 x1y don't é İstanbul ß".split()
    return [None, "", " ", "a", "..."] + [
        "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", ", ", "-", ""]) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_block_grams_equal_the_column_expression(spark):
    texts = _texts(60)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", F.lower("t").alias("t"), trigrams("t").alias("g")).collect()
    grams = sorted({g for r in rows for g in r["g"] or []})
    table = GV.GramTable(["a"], [-7], {g: {"a": 1 + k} for k, g in enumerate(grams)})
    place = {g: 1 + k for k, g in enumerate(grams)}
    lowered = [r["t"] for r in rows if r["t"] is not None]
    scores, known, n = GV.block_scores(lowered, table)
    want = [r["g"] for r in rows if r["t"] is not None]
    assert n.tolist() == [len(g) for g in want]
    assert scores[:, 0].tolist() == [sum(place[x] - 7 for x in g) for g in want]
    assert known[:, 0].tolist() == [bool(g) for g in want]


def test_word_counts_equal_the_column_expression(spark):
    texts = [t for t in _texts(80) if t is not None] + list(SENTENCES.values()) + ["the", "the-the the1 1 the_x théâtre", "и the и"]
    words = {**D.FUNCTION_WORDS, "xx": ["the", "x1y", "tİx", "is"], "none": []}
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", F.lower("t").alias("t"), function_word_hits(F.lower("t"), words).alias("h")).orderBy("i").collect()
    assert GV.WordTable(words).count([r["t"] for r in rows]).tolist() == [list(r["h"]) for r in rows]
    assert GV.WordTable({"a": []}).count(["x"]).tolist() == [[0]]


def test_hash_array_finds_every_gram_and_no_other():
    rnd = np.random.default_rng(5)
    codes = np.unique(rnd.integers(32, 40_000, (20_000, 3)), axis=0).astype(np.uint64)
    known = {"".join(map(chr, c)): {"x": 1} for c in codes[::2].tolist() if not any(0xD800 <= k < 0xE000 for k in c)}
    table = GV.GramTable(["x"], [0], known)
    row = table.find(GV.gram_hash(codes[:, 0], codes[:, 1], codes[:, 2]))
    assert [r >= 0 for r in row] == [("".join(map(chr, c)) in known) for c in codes.tolist()]
    assert len(set(row[row >= 0].tolist())) == len(known)


def test_vectors_equal_the_join(spark, monkeypatch):
    texts = [t or "x" for t in _texts(80)] + list(SENTENCES.values())
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    labelled = spark.createDataFrame([(t, lang) for lang, t in SENTENCES.items()] + [("zz", None)], "text string, lang string")
    monkeypatch.setattr(GV, "BLOCK_CHARS", 200)
    for profile in (builtin_profile(spark), fit_ngram_profile(labelled)):
        a = {r["i"]: r["ngram"] for r in score_ngram_profile(df, profile, "i", "t").collect()}
        b = {r["i"]: r["ngram"] for r in score_ngram_profile_join(df, profile, "i", "t").collect()}
        assert a.keys() == b.keys()
        for i in a:
            assert a[i]["language"] == b[i]["language"] and a[i]["confidence"] == pytest.approx(b[i]["confidence"], rel=1e-9)


def test_large_profiles_take_the_join(spark, monkeypatch):
    profile = builtin_profile(spark)
    assert GV.profile_table(profile, table_bytes=1000) is None
    df = spark.createDataFrame(list(SENTENCES.items()), "want string, t string")
    small = {r["want"]: (r["language"], round(r["language_confidence"], 9)) for r in detect_language(df, "t", profile).collect()}
    monkeypatch.setattr(GV, "profile_table", lambda p: None)
    large = {r["want"]: (r["language"], round(r["language_confidence"], 9)) for r in detect_language(df, "t", profile).collect()}
    assert small == large


def test_detection_has_no_shuffle_and_no_explode(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = detect_language(df, "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
