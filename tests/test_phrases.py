"""Phrase translation: the lattice against all segmentations, protected slots, gaps."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketflow.operators import phrases as P
from ticketflow.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def all_paths(words, copied, table, i=0):
    """Every segmentation as (unknown words, pieces, lengths of the pieces, pieces themselves)."""
    if i == len(words):
        yield 0, 0, (), ()
        return
    options = [(i + 1, words[i] if copied[i] else None, not copied[i], 0)]
    options += [(j, table[" ".join(words[i:j]).lower()], 0, j - i + 1) for j in range(i + 1, len(words) + 1)
                if " ".join(words[i:j]).lower() in table]
    for j, target, unknown, rank in options:
        for u, n, lengths, rest in all_paths(words, copied, table, j):
            yield u + unknown, n + 1, (-rank, *lengths), ((i, j, target), *rest)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=8), st.sets(st.lists(st.sampled_from("abcd"), min_size=1, max_size=4).map(" ".join), max_size=8),
       st.randoms(use_true_random=False))
def test_best_path_equals_all_segmentations(words, sources, rnd):
    table = {s: s.upper() for s in sources}
    copied = [rnd.random() < 0.2 for _ in words]
    best = min(all_paths(words, copied, table), key=lambda x: x[:3])
    assert P.best_path(words, copied, P.build_trie(table)) == list(best[3])


def test_longest_match_unless_a_shorter_one_saves_a_word():
    trie = P.build_trie({"a b": "AB", "a b c": "ABC", "c d": "CD", "b": "B"})
    assert P.translate("a b c", trie) == ("ABC", 3, [])
    assert P.translate("a b c d", trie) == ("AB CD", 4, [])
    assert P.translate("b, x  c d!", trie) == ("B, x  CD!", 4, ["x"])


@pytest.mark.parametrize("text, out, gaps", [
    ("Please see [URL] and order A17", "Bitte see [URL] und order A17", ["see", "order"]),
    ("please ask Maria", "bitte ask Maria", ["ask"]),
    ("PLEASE HELP NOW", "Bitte Hilfe NOW", ["now"]),
    ("Help. Unknown word", "Hilfe. Unknown word", ["unknown", "word"]),
    ("  please\n\thelp…", "  bitte\n\tHilfe…", []), ("", "", []), ("?!", "?!", []), ("é_é", "é_é", ["é", "é"]),
    ("it's here", "it's hier", ["it's"])])
def test_slots_capitals_and_spacing(text, out, gaps):
    trie = P.build_trie({"please": "bitte", "and": "und", "help": "Hilfe", "here": "hier"})
    got = P.translate(text, trie)
    assert (got[0], got[2]) == (out, gaps)


@given(st.text(max_size=60))
def test_tokens_add_up_to_the_text(text):
    assert "".join(P.tokens(text)) == text and P.translate(text, {})[0] == text


def frames(spark):
    df = spark.createDataFrame([(1, "please help", "en"), (2, None, "en"), (3, "quite unknown words here", "en"), (4, "", "en"),
                                (5, "bitte", "de"), (1, "please help", "en")], "i int, text string, language string")
    pairs = spark.createDataFrame([("please", "de", "bitte"), ("help", "de", "Hilfe"), ("help", "de", "Hilfe!"), ("please help", "fr", "aidez-moi"),
                                   ("here", "de", None), (None, "de", "x"), ("", "de", "x")], "source_text string, target_language string, text string")
    return df, pairs


def test_rows_are_translated_or_counted(spark):
    df, pairs = frames(spark)
    out = P.augment_with_phrases(df, pairs, "i", targets=["de", "fr", "pt"])
    rows = {(r.i, r.target_language): r for r in out.collect()}
    assert out.count() == 15
    assert (rows[1, "de"].text, rows[1, "de"].language, rows[1, "de"].translated) == ("bitte Hilfe", "de", True)
    assert rows[1, "fr"].text == "aidez-moi" and not rows[1, "pt"].translated and rows[1, "pt"].language == "en"
    assert rows[3, "de"].text == "quite unknown words here" and rows[3, "de"].n_gaps == 4 and not rows[2, "de"].translated
    gaps = {(r.target_language, r.word): (r.n, r.n_texts) for r in P.phrase_gaps(out).collect()}
    assert gaps["pt", "please"] == (2, 2) and gaps["de", "unknown"] == (1, 1) and ("de", "please") not in gaps


def test_a_large_table_is_cut_down_to_the_words_of_the_texts(spark, monkeypatch):
    df, pairs = frames(spark)
    many = pairs.unionByName(spark.range(300).select(F.concat(F.lit("other "), F.col("id")).alias("source_text"), F.lit("de").alias("target_language"),
                                                     F.lit("x").alias("text")))
    monkeypatch.setattr(P, "TABLE_BYTES", 5000)
    assert {r[0] for r in P.known_phrases(many, df, "text")} - {""} == {"please", "help", "please help"}
    monkeypatch.setattr(P, "TABLE_BYTES", 10)
    with pytest.raises(ValueError):
        P.known_phrases(many, df, "text")


def test_tickets_outside_of_the_sentences_are_translated(spark):
    rows = REGISTRY["augment_phrases"](spark, SF).collect()
    assert len(rows) == 4 * len({r.event_id for r in rows})
    assert sum(r.translated for r in rows) >= 0.8 * len(rows)
    some = [r.text for r in rows if r.target_language == "de" and "example" not in r.text and "Exportknopf" in r.text]
    assert some and all(t.startswith("Meine Bestellübersicht ist langsam und der Exportknopf tut nichts") for t in some)
    gaps = REGISTRY["phrase_gaps"](spark, SF).collect()
    assert all(r.n >= r.n_texts >= 1 for r in gaps)
