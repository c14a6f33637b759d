"""Token counts, spelling variants and vector codes against the library or brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import ticketflow.llm.spelling as spelling
import ticketflow.llm.vector_codes as vector_codes
from ticketflow.llm.queries import REGISTRY
from ticketflow.llm.token_counts import LONG, MergeTable, default_vocabulary, token_counts

SF = "/root/testdata/sf0.001"


# ---- token counts -----------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


@pytest.fixture(scope="module")
def merges():
    return MergeTable(default_vocabulary())


def plain_tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False))


ODD = ["a", "e", "st", "'s", "'S", "'ll", "''", "<|endoftext|>", "<|startoftext|>", "<|END", "|>", " ", "  ", "\x85", "\x1c",
       "\n", "日本", "é", "é", "Σ", "ΑΣ", "İ", "ﬁ", "١", "12", "½", "🙂", "👩‍👩‍👧", "-", "--", "!", "́", "ก็", "한국", "한", "\xa0", "ǅ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=8)), max_size=25))
def test_counts_equal_the_library(library, merges, parts):
    text = "".join(parts)
    assert merges.count([text]) == [plain_tokens(library, text)]


@pytest.mark.parametrize("text", [
    None, "", " \n\t ", "a" * 5000, "ab" * 3000, "日本語" * 2000, "!" * (LONG + 1), "x" * LONG, "x" * (LONG + 1),
    "".join(random.Random(4).choice("etaoin") for _ in range(9000))])
def test_counts_of_odd_and_long_texts(library, merges, text):
    assert merges.count([text, text]) == [plain_tokens(library, text)] * 2


def test_long_path_equals_the_rounds(merges):
    rnd = random.Random(8)
    for _ in range(60):
        word = "".join(rnd.choice("aabcde'é") for _ in range(rnd.randint(1, 40)))
        symbols, size = merges.symbols([p for p, _ in merges.cut(merges.normalise(word))])
        edges = np.cumsum(np.r_[0, size])
        assert merges.merge(symbols, size).tolist() == [
            merges.merge_long(symbols[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def test_the_table_starts_anew(library):
    small = MergeTable(default_vocabulary(), entries=3)
    texts = [f"word{i} again {'long' * 30}{i}" for i in range(20)]
    for t in texts:
        assert small.count([t]) == [plain_tokens(library, t)]
    assert len(small.counts) < 20 and all(len(c) <= 64 for c in small.counts)


def test_count_columns_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x", 5), (1, None, "x", 5), (None, "Hello, world!", None, 6)],
                               "doc_id long, text string, `a.b` string, N_TOKENS int")
    out = token_counts(df)
    assert out.columns == ["doc_id", "text", "a.b", "n_tokens"]
    assert sorted(r["n_tokens"] for r in out.collect()) == [0, 0, 4]
    assert token_counts(df.limit(0)).count() == 0


def test_token_query_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = REGISTRY["op11_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = plain_tokens(library, texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)


# ---- spelling variants --------------------------------------------------------

def plain_counts(rows, least=spelling.MIN_LENGTH):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = collections.Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    p = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def plain_variants(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-counts[x], x))
            if counts[best] >= 2 * counts[w]:
                form[w] = best
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form.get(w), counts.get(form.get(w)), root))
    return out


@pytest.mark.parametrize("group_words, alphabet, lengths, n", [
    (20_000, "abé", (1, 8), 700), (10, "abé", (1, 8), 700), (3, "ab", (1, 9), 400), (40, "abcdefÀ𝒳", (3, 6), 700)])
def test_variants_equal_brute_force(spark, group_words, alphabet, lengths, n):
    rnd = random.Random(n + group_words)
    counts = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(*lengths))): rnd.randint(1, 60) for _ in range(n)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.spelling_variants(df, group_words).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_variants(counts), key=str)


def test_long_chains_and_ties(spark):
    counts = {"aaaaa" + "b" * k: 2 ** k for k in range(12)} | {"xxxxx": 1, "yxxxx": 2, "xyxxx": 2}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: r for r in spelling.spelling_variants(df).collect()}
    assert {got[w]["root"] for w in got if w[0] == "a"} == {"aaaaa" + "b" * 11}
    assert (got["xxxxx"]["form"], got["xxxxx"]["n_near"]) == ("xyxxx", 2)


def test_word_counts_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    alphabet = "abcXYZ éÀ÷×ĀŸ日'1\n-"
    rows = [(rnd.choice([None, 1, 2, -7, 10 ** 15]), "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))))
            for _ in range(1500)]
    rows += [(3, None), (3, ""), (4, "word " * 400), (5, "Ab" * 5000), (5, "é" * 70 + "x" * 10), (6, "é"), (7, "z" * 65)]
    rows += [(i, "é" * 40 + " " + "q" * 70) for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    for size in (64, 8 << 20):
        monkeypatch.setattr(spelling, "BLOCK_BYTES", size)
        for least in (5, 1):
            assert {r["word"]: r["n"] for r in spelling.word_counts(df, least).collect()} == {
                w: n for w, n in plain_counts(rows, least).items() if w}
    assert spelling.word_counts(df.limit(0)).count() == 0


# ---- vector codes -------------------------------------------------------------

ROWS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=4, size=256, rounds=4):
    """Full integer search instead of pivots."""
    used = [(i, [max(-2**24, min(2**24, math.floor(1024 * x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    used.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max((len(v) for _, v, _ in used), default=0) // parts))
    x = np.zeros((len(used), parts * width), np.int64)
    for k, (_, v, _) in enumerate(used):
        x[k, :len(v)] = v
    x = x.reshape(len(used), parts, width)
    books = x[:size].transpose(1, 0, 2).copy()
    code, error = np.zeros((len(used), parts), int), np.zeros(len(used), int)
    for step in range(rounds + 1 if used else 0):
        error[:] = 0
        for p in range(parts):
            d = ((x[:, p, None] - books[p][None]) ** 2).sum(2)
            code[:, p] = d.argmin(1)
            error += d.min(1)
            for e in range(books.shape[1]) if step < rounds else ():
                if (code[:, p] == e).any():
                    books[p, e] = x[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    per = collections.Counter()
    for (*_, label), e in zip(used, error):
        per[label] += int(e)
    return collections.Counter((i, bytes(c.astype(np.uint8)).hex(), int(e), per[label], sha)
                               for (i, _, label), c, e in zip(used, code, error))


def run_codes(spark, rows, **sizes):
    df = spark.createDataFrame(rows, ROWS)
    coded = vector_codes.label_errors(vector_codes.compress_vectors(df, **sizes))
    return collections.Counter(tuple(r) for r in coded.select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def odd_vectors():
    rnd = random.Random(1)
    rows = [(rnd.choice([None, *range(700)]), [rnd.choice([0., .001, -.5, rnd.random()]) for _ in range(rnd.choice([0, 5, 7, 8]))],
             rnd.choice([None, 1, 2])) for _ in range(900)]
    return rows + [(5, None, 1), (6, [1., None], 1), (7, [float("nan")], 2), (8, [3e38, -3e38, 16384., 1.], 3)] + rows[:50]


def test_codes_equal_the_full_search(spark, monkeypatch):
    rows = odd_vectors()
    assert run_codes(spark, rows) == plain_codes(rows)
    assert run_codes(spark, rows, parts=3, size=9, rounds=2) == plain_codes(rows, 3, 9, 2)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert run_codes(spark, rows) == plain_codes(rows)


def test_few_vectors_and_empty_table(spark):
    rows = odd_vectors()[:3] + [(1, [1., 2.], None)]
    assert run_codes(spark, rows) == plain_codes(rows)
    assert run_codes(spark, [(1, None, 2)]) == run_codes(spark, []) == collections.Counter()


def test_bounds_prune_and_lose_nothing():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(-9000, 9000, (40, 8))
    x = centres[rnd.integers(0, 40, 3000)] + rnd.integers(-50, 50, (3000, 8))
    entries = np.r_[x[:150], x[:50], x[:1]]     # repeated entries: ties
    pivots = vector_codes.choose_pivots(entries)
    index, best, evaluated = vector_codes.nearest(
        x, vector_codes.distances(x, pivots).astype(np.float32), entries,
        vector_codes.distances(entries, pivots).T.astype(np.float32))
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    assert evaluated < 0.25 * d.size
