"""Language identification and toxicity: exactness on small cases, held-out accuracy."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticketflow.llm import langid, toxicity
from ticketflow.llm.blocks import SpanHash, text_blocks
from ticketflow.llm.queries import REGISTRY

SF = "/root/testdata/sf0.01"


# ---- language -------------------------------------------------------------

def vocabulary():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=langid.default_vocabulary())
    out = {}
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)) and "▁" not in p[1:] \
                and len(p.removeprefix("▁").encode()) <= langid.PIECE_BYTES:
            out[p] = len(out)
    return out


def all_segmentations(word, vocab, p, unknown):
    """Sum over segmentations of a marked word, by recursion."""
    text = "▁" + word

    def total(at):
        if at == len(text):
            return 1.0
        s = sum(p[vocab[text[at:j]]] * total(j) for j in range(at + 1, len(text) + 1) if text[at:j] in vocab)
        if text[at] != "▁":
            s += unknown * total(at + 1)
        return s

    return total(0)


def lattice_of(words):
    block = next(text_blocks(pa.array([" ".join(words)])))
    span = SpanHash(block.data)
    _, start, end, marked, which, _ = langid._distinct(block, span)
    pieces = langid.pieces_of(langid.default_vocabulary())
    rows, lattice = next(langid._lattices(pieces, block.data, span, start, end, marked))
    return lattice, np.argsort(rows)[which]


def test_forward_sums_every_segmentation():
    vocab = vocabulary()
    pieces = langid.pieces_of(langid.default_vocabulary())
    assert pieces.n == len(vocab)
    rnd = np.random.default_rng(1)
    p = rnd.random((pieces.n + 1, 2))
    words = ["the", "a", "été", "日本", "x7", "ing", "😀q", "straße", "the"]
    lattice, which = lattice_of(words)
    got = lattice.totals(p)[which]
    for i, w in enumerate(words):
        for lang in (0, 1):
            assert got[i, lang] == pytest.approx(all_segmentations(w, vocab, p[:, lang], p[pieces.n, lang]))


def test_expected_counts_spend_every_character():
    pieces = langid.pieces_of(langid.default_vocabulary())
    vocab = list(vocabulary())
    words = ["the", "there", "été", "x"]
    lattice, which = lattice_of(words)
    p = np.random.default_rng(2).random((pieces.n + 1, 1))
    counts = lattice.expected(p, np.bincount(which, minlength=4)[:, None].astype(float))[:, 0]
    spent = sum(c * len(vocab[i].removeprefix("▁")) for i, c in enumerate(counts[:-1]) if c) + counts[-1]
    assert spent == pytest.approx(sum(map(len, words)))
    marks = sum(c for i, c in enumerate(counts[:-1]) if c and vocab[i].startswith("▁"))
    assert marks == pytest.approx(len(words))


def test_long_words_are_cut_at_characters():
    block = next(text_blocks(pa.array(["é" * 100 + " ab " + "日" * 31])))
    start, end, marked, _ = langid._parts(block)
    raw = block.data.tobytes()
    parts = [raw[s:e].decode() for s, e in zip(start, end)]
    assert "".join(parts) == "é" * 100 + "ab" + "日" * 31
    assert max(len(x.encode()) for x in parts) <= langid.PART_BYTES + 3 and marked.sum() == 3


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = REGISTRY["op2_langid"](spark, SF).join(docs, "doc_id").where("held_out")
    right, n, least, most = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"),
                                      F.min("score"), F.max("score")).first()
    assert n > 100 and right >= 0.97 and 0 <= least and most <= 1


def test_pool_remembers_words():
    pool = langid.Pool(value=np.zeros(0))
    rnd = np.random.default_rng(4)
    seen = {}
    for _ in range(30):
        key = np.unique(rnd.integers(0, 200, 40).astype(np.uint64))
        at, known = pool.find(key)
        assert known.tolist() == [int(k) in seen for k in key]
        assert pool["value"][at[known]].tolist() == [seen[int(k)] for k in key[known]]
        new = key[~known]
        pool.add(key=new, value=new * 2.0)
        seen.update({int(k): float(k) * 2 for k in new})
    assert len(pool) == len(seen)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", "fr"),
            (5, "123 !?", None), (6, "le chat", None), (7, "z" * 5000, None), (6, "le chat", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, language string")
    vocab = langid.default_vocabulary()
    model = langid.train(df, "text", "lang", vocab)
    assert model[0] == ["en", "fr"] and model[1].sum(axis=0) == pytest.approx([1, 1])
    got = [(r["doc_id"], r["language"]["lang"]) for r in langid.predict(df, model, vocab).collect()]
    assert got[:6] == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "fr")] and got[7] == (6, "fr")
    empty = df.limit(0)
    assert langid.predict(empty, langid.train(empty, "text", "lang", vocab), vocab).count() == 0
    untrained = langid.predict(df, langid.train(empty, "text", "lang", vocab), vocab).collect()
    assert {(r["language"]["lang"], r["language"]["score"]) for r in untrained} == {("und", 0.0)}


# ---- toxicity -------------------------------------------------------------

def plain_marginals(emission, transition):
    n, a = len(emission), np.exp(transition)
    total, hot = 0.0, np.zeros(n)
    for states in itertools.product((0, 1), repeat=n):
        # before its first token a text is in either state alike
        weight = 0.5 * (a[0, states[0]] + a[1, states[0]])
        for i, s in enumerate(states):
            weight *= np.exp(emission[i] * s) * (a[states[i - 1], s] if i else 1.0)
        total += weight
        hot += weight * np.array(states)
    return hot / total


@pytest.mark.parametrize("segment", [1, 2, 3, 100])
def test_marginals_equal_enumeration(segment):
    rnd = np.random.default_rng(3)
    lengths = [1, 9, 0, 4, 10, 2]
    first = np.concatenate([[0], np.cumsum(lengths)])
    emission = rnd.normal(size=first[-1]) * 3
    transition = rnd.normal(size=(2, 2))
    got = toxicity.marginals(emission, first, transition, segment)
    for lo, hi in zip(first, first[1:]):
        if hi > lo:
            assert got[lo:hi] == pytest.approx(plain_marginals(emission[lo:hi], transition))


def test_held_out_toxicity(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = REGISTRY["op6_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    hot = [r for r in found if r["toxic"] == 1]
    clean = [r for r in found if r["toxic"] == 0]
    assert len(hot) > 50
    # some texts labelled toxic hold only junk and no toxic word
    assert sum(r["predicted"] for r in hot) >= 0.9 * len(hot)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)


def test_spans_and_edges(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(120):
        w = [word() for _ in range(40)]
        if i % 3 == 0:
            w[rnd.randrange(40)] = "Vilest!"
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    schema = "doc_id long, text string, toxic int"
    df = spark.createDataFrame(rows, schema)
    field = toxicity.train(df.drop("toxic"), df.drop("text"))
    probe = spark.createDataFrame([(1, "é so vilest vilest end", "x"), (2, None, "x"), (3, "", "x"), (4, "!!", "x"),
                                   (5, "clean " * 3000 + "vilest", "x"), (1, "quiet words", "x")],
                                  "doc_id long, text string, toxicity string")
    got = [r["toxicity"] for r in toxicity.toxicity(probe, field).collect()]
    assert [(s["start"], s["end"]) for s in got[0]["spans"]] == [(5, 18)]
    assert got[0]["score"] > 0.5 and [g["score"] for g in got[1:4]] == [0, 0, 0]
    assert [(s["start"], s["end"]) for s in got[4]["spans"]] == [(18000, 18006)]
    assert got[5]["score"] < 0.3
    assert toxicity.toxicity(probe.limit(0), field).count() == 0
    clean = df.withColumn("toxic", F.lit(0))
    none = toxicity.train(clean.drop("toxic"), clean.drop("text"))
    assert none is None and toxicity.toxicity(probe, none).agg(F.max("toxicity.score")).first()[0] == 0
    assert toxicity.train(df.limit(0).drop("toxic"), df.limit(0).drop("text")) is None
