"""Top-k, near-duplicates, chat formatting and mixing against plain Python."""

import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import ticketflow.llm.near_dup as near_dup
from ticketflow.llm import chat
from ticketflow.llm.mixing import mix_sources, source_targets, word_count
from ticketflow.llm.near_dup import components, near_duplicates
from ticketflow.llm.topk import integer_vectors, top_k

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- top-k ----------------------------------------------------------------

def plain_top_k(rows, k):
    import math

    usable = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in usable if i % 100 == 0}):
        scores = [(sum(a * b for a, b in zip(v, w)), i) for p, v in usable if p == q for i, w in usable if i != q]
        scores.sort(key=lambda x: (-x[0], x[1]))
        out += [(q, r, i, s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def run_top_k(spark, rows, k=10, **blocks):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    found = top_k(integer_vectors(df), F.col("vec_id") % 100 == 0, k, **blocks)
    return sorted(tuple(r) for r in found.collect())


def test_top_k_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([0.0, 0.5, -0.25, 0.125, 1.0]) for _ in range(6)]) for i in range(230)]
    rows += [(100, rows[100][1]), (500, None), (600, [1.0, None]), (700, [float("nan")] * 6), (None, [1.0] * 6),
             (800, [float("inf")] * 6), (900, [0.0] * 6), (7, [3.0] * 6), (1000, [])]
    assert run_top_k(spark, rows, 10, query_block=2, candidate_block=40) == plain_top_k(rows, 10)


def test_top_k_of_few_rows_and_huge_components(spark):
    assert run_top_k(spark, []) == []
    assert run_top_k(spark, [(0, [1.0])]) == []
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.5]), (2, [-1e30, 0.5]), (3, [0.0, 0.5])]
    got = run_top_k(spark, rows, 10)
    assert [(r[2], r[3]) for r in got] == [(1, 2**63 - 1), (3, 1024 * 512), (2, -2**63)]


# ---- near-duplicates ------------------------------------------------------

def plain_groups(rows, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), d), d)
    return sorted((d, len(sets[i]), smallest[find(i)], d == smallest[find(i)]) for i, (d, _) in enumerate(rows))


def run_groups(spark, rows, percent=85, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, dedup string")
    found = near_duplicates(df, percent, **kw)
    return sorted((r["doc_id"], r["dedup"]["n_shingles"], r["dedup"]["component_id"], r["dedup"]["kept"])
                  for r in found.collect())


def family(rnd, n, words=80, edits=2):
    base = [f"w{rnd.randrange(10**9)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rnd.randint(0, edits)):
            copy[rnd.randrange(words)] = f"e{rnd.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_groups_equal_brute_force(spark):
    rnd = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = ["", None, " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f"]
    texts += [t for _ in range(6) for t in family(rnd, 6)] + family(rnd, 40, edits=1)
    texts += [f"{shared} " + " ".join(f"u{rnd.randrange(10**9)}" for _ in range(150)) for _ in range(25)]
    texts += [texts[10]] * 30
    rows = list(enumerate(texts, 5))
    rnd.shuffle(rows)
    want = plain_groups(rows, 85)
    assert len({w[2] for w in want}) < len(rows) - 60
    assert run_groups(spark, rows) == want
    assert run_groups(spark, rows, carry=False) == want


def test_large_regions_are_split_without_loss(spark, monkeypatch):
    # regions of more than 30 classes are split at the next depths
    monkeypatch.setattr(near_dup, "REGION", 30)
    rnd = random.Random(8)
    rows = list(enumerate(family(rnd, 120, words=120, edits=3) + [t for _ in range(5) for t in family(rnd, 4)]))
    got, want = run_groups(spark, rows), plain_groups(rows, 85)
    joined = lambda x: {r[0] for r in x if not r[3]}
    assert joined(got) <= joined(want) and len(joined(got)) >= 0.97 * len(joined(want))


def test_links_inside_a_template_crowd(spark, monkeypatch):
    # pages on one template are just below the threshold of each other; the planted copies are above it
    monkeypatch.setattr(near_dup, "REGION", 8)
    rnd = random.Random(15)
    base = [f"w{i}" for i in range(1000)]

    def edited(words, n):
        words = list(words)
        for at in rnd.sample(range(len(words)), n):
            words[at] = f"e{rnd.randrange(10**9)}"
        return words

    crowd = [edited(base, 9) for _ in range(200)]
    crowd += [edited(page, 15) for page in crowd[:100]]
    rows = list(enumerate(" ".join(page) for page in crowd))
    rnd.shuffle(rows)
    want = plain_groups(rows, 85)
    assert sum(not w[3] for w in want) >= 100
    assert run_groups(spark, rows) == want


def test_groups_of_given_documents(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert run_groups(spark, rows, 80) == plain_groups(rows, 80)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(3, text), (3, text), (None, text), (9, text.upper()), (9, "other words of another text altogether")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = sorted(((r["doc_id"] or -1), r["dedup"]["component_id"], r["dedup"]["kept"]) for r in got)
    assert seen == [(-1, 3, False), (3, 3, True), (3, 3, True), (9, 3, False), (9, 9, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    rnd = random.Random(1)
    edges = [e if rnd.random() < 0.5 else e[::-1] for e in edges]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}}


# ---- chat -----------------------------------------------------------------

CONTROLS = st.lists(st.sampled_from(["<", "|", "\\", "[", "/", "s>", "INST]", "<|turn|>", "<|end|>", "</s>", "[INST]",
                                     "<<SYS>>", "<</SYS>>", "\n", "a", "é", "\\n", "<|line|>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(CONTROLS, CONTROLS), max_size=4))
def test_formatting_reads_back(turns):
    turns = turns + [("assistant", "x")]
    text, loss = chat.format_turns(turns)
    assert chat.read_turns(text) == turns
    learned = [t for r, t in turns if r == "assistant"]
    assert [chat.unescape(text[s:e]) for s, e in loss] == learned


@settings(max_examples=300, deadline=None)
@given(CONTROLS)
def test_escaped_texts_hold_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not re.search(r"<\||</?s>|</?unk>|</?pad>|<</?SYS>>|\[/?INST\]", out)


def plain_paths(nodes):
    up = {(t, n): p for t, n, p, _ in nodes}
    score = {(t, n): s or 0.0 for t, n, _, s in nodes}
    inner = {(t, p) for (t, n), p in up.items() if (t, p) in up}
    paths = []
    for t, n in up:
        if (t, n) in inner:
            continue
        path = [n]
        while (t, up[t, path[-1]]) in up:
            path.append(up[t, path[-1]])
        paths.append((t, n, path[::-1], sum(score[t, x] for x in path)))
    return paths


def test_paths_of_trees(spark):
    rnd = random.Random(6)
    nodes = [(t, n, rnd.choice([None, *range(n)]) if n else None, float(rnd.randrange(9)))
             for t in (1, 2, None) for n in range(25)]
    nodes += [(5, n, n - 1 if n else None, 1.0) for n in range(40)] + [(6, 1, 77, None)]
    schema = "tree long, node long, parent long, score double"
    rows = chat.reply_paths(spark.createDataFrame(nodes, schema), branches=2).collect()
    got = {}
    for r in sorted(rows, key=lambda r: -r["steps"]):
        got.setdefault((r["tree"], r["branch"], r["leaf"]), []).append(r["node"])
    want = {}
    for tree in {n[0] for n in nodes}:
        ranked = sorted((p for p in plain_paths(nodes) if p[0] == tree), key=lambda p: (-p[3], p[1]))
        want.update({(tree, b, p[1]): p[2] for b, p in enumerate(ranked[:2], 1)})
    assert got == want
    with pytest.raises(ValueError):
        chat.reply_paths(spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0), (1, 3, 1, 0.0)], schema)).count()


def test_conversations_with_nulls_ties_and_gaps(spark):
    rows = [(1, 5, "assistant", None), (1, 2, None, "q"), (1, 2, None, "q"), (None, 0, "user", "</s>"), (2, None, "assistant", "x"),
            (2, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = {r["tree"]: r for r in chat.format_trees(chat.conversation_messages(df).cache()).collect()}
    assert chat.read_turns(chats[1]["formatted"]) == [("", "q"), ("", "q"), ("assistant", "")]
    assert chat.read_turns(chats[None]["formatted"]) == [("user", "</s>")]
    assert chat.read_turns(chats[2]["formatted"]) == [("assistant", "x"), ("assistant", "y")]
    assert [chats[2]["formatted"][s["start"]:s["end"]] for s in chats[2]["loss"]] == ["x", "y"]
    assert chat.format_trees(chat.conversation_messages(df.limit(0)).cache()).count() == 0


def test_one_conversation_of_thousands_of_turns(spark):
    said = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(5000)] + [(2, 0, "user", "short")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    messages = chat.conversation_messages(df).cache()
    paths = chat.reply_paths(messages)
    # a scan and the ranking, not a copy of every round before it
    assert paths._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3
    assert paths.count() == 5001
    chats = {r["tree"]: r for r in chat.format_trees(messages).collect()}
    assert chat.read_turns(chats[1]["formatted"]) == [r[2:] for r in said[:-1]]


# ---- mixing ---------------------------------------------------------------

def plain_targets(sizes, epochs=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in clamped]
        left = total - sum(epochs * sizes[s] for s in clamped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > epochs * sizes[s]}
        if not over:
            return {s: (epochs * sizes[s] if s in clamped else level * weight[s]) for s in names}
        clamped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 500, None: 3, "é": 70, "Z": 1}, {"a": 0, "b": 5}, {"x": 7}, {"a": 0}, {},
    {f"s{i:02d}": (i * 37) % 11 ** 3 + 1 for i in range(30)}])
def test_targets_equal_plain_water_filling(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_meets_targets_and_repeats_itself(spark):
    rnd = random.Random(9)
    rows = [(i, "big" if i % 3 else rnd.choice(["a", "b", "c", None]), "w " * rnd.randint(0, 40)) for i in range(3000)]
    rows += [(5000, None, None), (5001, "a", "x " * 20_000), (None, "b", "no id"), (None, "b", "no id")]
    df = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, source string, text string, mix string")
    mixed = mix_sources(df, word_count("text"))
    first = sorted(map(str, mixed.select("doc_id", "source", "mix").collect()))
    assert first == sorted(map(str, mix_sources(df.repartition(7), word_count("text")).select("doc_id", "source", "mix").collect()))
    assert len(first) == len(rows)
    per = mixed.groupBy("source").agg(
        F.sum(F.col("mix.size") * F.col("mix.copies")).alias("taken"), F.first("mix.target").alias("target"),
        F.max("mix.size").alias("largest"), F.max("mix.copies").alias("copies")).collect()
    for r in per:
        assert abs(r["taken"] - r["target"]) <= r["largest"] + 1 and r["copies"] <= 3
    assert mix_sources(df.limit(0), word_count("text")).count() == 0


def test_hot_source_is_near_its_target(spark):
    df = spark.createDataFrame([(i, "hot" if i < 4000 else f"s{i % 40}", "w " * (1 + i % 9)) for i in range(6000)],
                               "doc_id long, source string, text string")
    r = mix_sources(df, word_count("text")).where("source = 'hot'").agg(
        F.sum(F.col("mix.size") * F.col("mix.copies")), F.first("mix.target")).first()
    assert r[0] == pytest.approx(r[1], rel=0.01)


@pytest.mark.parametrize("texts", [[None, "", " \t"], ["", "", "a b c", None], ["x " * 500] + [""] * 40])
def test_sources_with_empty_texts(spark, texts):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", None]), texts[i % len(texts)]) for i in range(600)]
    df = spark.createDataFrame(rows + [(-1, "empty", ""), (-2, "empty", None)], "doc_id long, source string, text string")
    got = mix_sources(df, word_count("text")).groupBy("source").agg(
        F.sum(F.col("mix.size") * F.col("mix.copies")).alias("taken"), F.first("mix.target").alias("target"),
        F.max("mix.size").alias("largest"), F.max("mix.copies").alias("copies")).collect()
    assert sum(r["target"] for r in got) == pytest.approx(sum(len((t or "").split()) for *_, t in rows))
    for r in got:
        assert abs(r["taken"] - r["target"]) <= r["largest"] + 1 and r["copies"] <= 3
