"""Spelling variant grouping by dynamic programming over sorted lists.

Words.  Letter runs are found in blocks of whole texts with numpy, counted per
block and summed in Spark.  A run's checksum (crc32 of ``doc_id:run``) decides
whether one of its code points is left out; the checksum is linear, so it is
put together from the document's part, moved on by the run's length, and the
part of each distinct run of the block.

Near words.  Two words one edit apart share the first or the last half of the
shorter one, so every word goes, forward and reversed, into the groups of its
own length and of the length below, keyed by that half (``m // 2`` code points
of a shorter word of ``m``).  A group's words are a
sorted list.  All queries of a task walk their lists together: a state is a
query, a range of the list that shares a prefix, and the three cells of the
edit matrix's row for that prefix that one edit can reach.  One row is
computed per range, from its parent's row, and serves every word of the range;
adjacent common prefix lengths say where a range divides; a range whose row
has no cell of at most one edit is skipped with all of its words.

Hot groups.  A group of more than ``GROUP_WORDS`` words is replaced, for its
words only, by one group per place the edit can have, keyed by the word
without that place.  Such a group holds at most one word per letter of the
alphabet and length, and no pair is lost or found twice.

Nothing grows on the driver and nothing is broadcast by this module; roots are
found by pointer doubling over written tables (a form has at least twice its
word's count, so a chain has at most log2(n) steps).

Defined results: a null text has no words; a null doc_id reads as an empty
string; repeated rows count each time; an empty table gives an empty table;
columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.blocks import LOWER, _view
from ticketflow.session import scratch_dir, ship_package

BLOCK_BYTES = 8 << 20
DROP_ONE_IN = 97
MIN_LENGTH, MIN_COUNT = 5, 3
GROUP_WORDS = 20_000     # larger groups are keyed by the place of the edit
TASK_WORDS = 30_000      # words that one walk holds, whole groups
SHORT = 64               # bytes of a run whose checksum is put together from tables
CAP = 2                  # edits that are too many

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


# ---- words ----------------------------------------------------------------

def _moved_tables() -> np.ndarray:
    """[length][byte of the state][its value] -> state after ``length`` zero bytes."""
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    step = np.array([zlib.crc32(b"\0", b ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
    for n in range(1, SHORT + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & np.uint32(255)]
    return out


def block_words(ids: list, data: np.ndarray, edges: np.ndarray, moved: np.ndarray, least: int) -> Counter:
    """Counts of the words (of ``least`` code points or more) of whole texts.

    ``data[edges[i]:edges[i + 1]]`` are the UTF-8 bytes of the text of ``ids[i]``.
    """
    # U+00C0 to U+00FF are exactly the characters that begin with the byte C3
    lead = data == 0xC3
    word = LETTER[data] | lead
    word[1:] |= lead[:-1]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    starts[edges[:-1][edges[:-1] < len(data)]] = True
    starts &= word
    start = np.flatnonzero(starts)
    if not len(start):
        return Counter()
    flat = LOWER[data[word]]
    place = np.cumsum(word)          # 1-based place of each word byte in flat
    offsets = np.r_[place[start] - 1, len(flat)].astype(np.int64)
    runs = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(flat)).dictionary_encode()
    which, distinct = runs.indices.to_numpy(), runs.dictionary.to_pylist()
    raw = [w.encode() for w in distinct]
    own = np.array([zlib.crc32(w, 0xFFFFFFFF) for w in raw], np.uint32)
    size = np.diff(offsets)
    doc = np.searchsorted(edges, start, "right") - 1
    heads = [f"{'' if i is None else i}:".encode() for i in ids]
    state = np.array([zlib.crc32(h) ^ 0xFFFFFFFF for h in heads], np.uint32)[doc]
    short = np.minimum(size, SHORT)
    check = own[which]
    for k in range(4):
        check ^= moved[short, k, (state >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(size > SHORT):
        check[i] = zlib.crc32(heads[doc[i]] + raw[which[i]])
    hit = check % DROP_ONE_IN == 0
    counts = np.bincount(which[~hit], minlength=len(distinct))
    out = Counter({w: int(n) for w, n in zip(distinct, counts.tolist()) if n and len(w) >= least})
    for w, h in zip(which[hit].tolist(), check[hit].tolist()):
        text = distinct[w]
        at = h % len(text)
        if len(text) > least:
            out[text[:at] + text[at + 1:]] += 1
    return out


def _count_words(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = _moved_tables()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, off = _view(batch.column(1))
            lo = 0
            while lo < len(ids):
                hi = int(np.searchsorted(off, off[lo] + BLOCK_BYTES, "right")) - 1
                hi = min(max(hi, lo + 1), len(ids))
                found = block_words(ids[lo:hi], raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], moved, least)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()),
                                                  pa.array(list(found.values()), pa.int64())], names=["word", "n"])
                lo = hi
    return run


def word_counts(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """(word, n) of the letter runs of (doc_id, text), ``least`` code points or more."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(
        _count_words(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- near words -------------------------------------------------------------

class SortedLists:
    """Sorted word lists of several groups, one after another, with adjacent common prefixes."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.at = np.r_[0, np.cumsum(self.size)]
        # the last element stands for places after the last word
        self.chars = np.r_[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), -1]
        n = len(words)
        lcp = np.zeros(n, np.int64)
        open_ = np.arange(1, n)
        depth = 0
        while len(open_):
            open_ = open_[(self.size[open_] > depth) & (self.size[open_ - 1] > depth)]
            open_ = open_[self.chars[self.at[open_] + depth] == self.chars[self.at[open_ - 1] + depth]]
            depth += 1
            lcp[open_] = depth
        self.n = n
        self.divides = np.sort(lcp * n + np.arange(n))

    def char(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Code point of a word at a place, -1 outside of it."""
        inside = (place >= 0) & (place < self.size[word])
        return np.where(inside, self.chars[np.where(inside, self.at[word] + place, len(self.chars) - 1)], -1)


def near_pairs(lists: SortedLists, query: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) positions one edit apart, the word at least as long as the query.

    Query k is the word at ``query[k]``; its list is ``lo[k]..hi[k] - 1``, whose words
    share their first ``depth[k]`` code points with it.
    """
    found_q, found_w = [], []
    # cells of the row at columns depth - 1, depth, depth + 1: equal prefixes so far
    left, mid, right = np.ones(len(query), np.int8), np.zeros(len(query), np.int8), np.ones(len(query), np.int8)
    while len(query):
        # a word that ends at this depth is the first of its range
        length = lists.size[query]
        ends = lists.size[lo] == depth
        cell = np.where(depth == length, mid, left)      # the column of the whole query
        near = ends & (cell == 1) & (depth - length >= 0) & (depth - length <= 1)
        found_q.append(query[near])
        found_w.append(lo[near])
        lo = lo + ends
        # ranges that hold words beside the query itself
        go = (lo < hi) & ~((hi - lo == 1) & (lo == query))
        query, lo, hi, depth = query[go], lo[go], hi[go], depth[go]
        left, mid, right = left[go], mid[go], right[go]
        if not len(query):
            break
        # divide each range where neighbours part at this depth
        a = np.searchsorted(lists.divides, depth * lists.n + lo, "right")
        b = np.searchsorted(lists.divides, depth * lists.n + hi, "left")
        parts = 1 + b - a
        parent = np.repeat(np.arange(len(query)), parts)
        first = np.cumsum(parts) - parts
        step = np.arange(len(parent)) - first[parent]
        begin = np.where(step == 0, lo[parent],
                         lists.divides[np.maximum(a[parent] + step - 1, 0)] % lists.n)
        end = np.r_[begin[1:], 0]
        end[first + parts - 1] = hi
        query, depth = query[parent], depth[parent]
        c = lists.chars[lists.at[begin] + depth]
        up_left, up_mid, up_right = left[parent], mid[parent], right[parent]
        new_left = np.minimum(up_mid + 1, up_left + (lists.char(query, depth - 1) != c))
        new_mid = np.minimum(np.minimum(up_right + 1, new_left + 1), up_mid + (lists.char(query, depth) != c))
        new_right = np.minimum(new_mid + 1, up_right + (lists.char(query, depth + 1) != c))
        # columns beyond the query, or before its start, do not exist
        depth = depth + 1
        length = lists.size[query]
        new_left = np.where(depth - 1 > length, CAP, new_left)
        new_mid = np.where(depth > length, CAP, new_mid)
        new_right = np.where(depth + 1 > length, CAP, new_right)
        go = np.minimum(np.minimum(new_left, new_mid), new_right) < CAP
        query, lo, hi, depth = query[go], begin[go], end[go], depth[go]
        left, mid, right = (np.minimum(r[go], CAP).astype(np.int8) for r in (new_left, new_mid, new_right))
    return (np.concatenate(found_q), np.concatenate(found_w)) if found_q else (np.zeros(0, int), np.zeros(0, int))


def _walk(rows: pa.Table) -> pa.RecordBatch:
    """Near pairs of whole groups, sorted by (key, form): (word, near_n, near), both ways."""
    keys = rows.column("key").combine_chunks().dictionary_encode()
    group = keys.indices.to_numpy()
    back = rows.column("back").to_numpy()
    m, place = rows.column("m").to_numpy().astype(np.int64), rows.column("place").to_numpy().astype(np.int64)
    n = rows.column("n").to_numpy()
    forms = rows.column("form").to_pylist()
    lists = SortedLists(forms)
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lo = np.repeat(edge, np.diff(np.r_[edge, len(group)]))
    hi = np.repeat(np.r_[edge[1:], len(group)], np.diff(np.r_[edge, len(group)]))
    query = np.flatnonzero(lists.size == m)
    depth = np.where(place >= 0, place, m // 2)
    q, w = near_pairs(lists, query, lo[query], hi[query], depth[query])
    # a pair belongs to one group: forward if the first halves are equal, else
    # reversed; in a group of one place, only if the words part at that place
    parted = lists.char(q, depth[q]) != lists.char(w, depth[q])
    take = (place[q] < 0) | parted
    q, w = q[take], w[take]
    common = np.zeros(len(q), bool)
    turned = np.flatnonzero(back[q])
    same = np.ones(len(turned), bool)
    for k in range(int((m[q[turned]] // 2).max(initial=0))):
        x, y = q[turned], w[turned]
        inside = k < m[x] // 2
        same &= ~inside | (lists.char(x, lists.size[x] - 1 - k) == lists.char(y, lists.size[y] - 1 - k))
    common[turned] = same
    q, w = q[~common], w[~common]
    longer = lists.size[w] > lists.size[q]       # equal lengths are found from both sides
    word, near = np.r_[q, w[longer]], np.r_[w, q[longer]]
    text = [f[::-1] if b else f for f, b in zip(forms, back)]
    return pa.RecordBatch.from_arrays(
        [pa.array([text[i] for i in word], pa.string()), pa.array(n[near], pa.int64()),
         pa.array([text[i] for i in near], pa.string())], names=["word", "near_n", "near"])


def _walk_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= TASK_WORDS:
            rows = pa.Table.from_batches(held)
            key = rows.column("key")
            # up to the last group, which may go on in the next batch
            other = np.flatnonzero(~np.asarray(pc.equal(key, key[size - 1])))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield _walk(rows.slice(0, cut))
                held, size = rows.slice(cut).to_batches(), size - cut
    if size:
        yield _walk(pa.Table.from_batches(held))


def near_words(vocabulary: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, near_n, near) for all words of (word, n) that are one edit apart, both ways."""
    ship_package(vocabulary.sparkSession)
    length = F.char_length("word")
    # every word as the shorter and as the longer of a pair, forward and reversed
    rows = (vocabulary.where(length > 0)
            .withColumn("m", F.explode(F.array(length, length - 1)))
            .withColumn("back", F.explode(F.array(F.lit(False), F.lit(True))))
            .withColumn("form", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
            .select("form", "n", "m", "back", F.concat_ws(
                ":", F.col("back").cast("string"), F.col("m").cast("string"),
                F.expr("substring(form, 1, int(m div 2))")).alias("key"), F.lit(-1).alias("place")))
    hot = rows.groupBy("key").count().where(F.col("count") > group_words).select(F.col("key").alias("hot_key"))
    path = scratch_dir(vocabulary.sparkSession, "spelling-hot")
    hot.write.parquet(path)
    hot = vocabulary.sparkSession.read.parquet(path)
    if not hot.isEmpty():
        marked = rows.join(hot, F.col("key") == F.col("hot_key"), "left")
        # the word without one place from the shared half on; the shorter word also
        # stands for itself, as what remains of a longer one
        places = F.expr("sequence(int(m div 2), m)")
        placed = marked.where("hot_key is not null").withColumn("place", F.explode(places))
        rest = F.concat(F.expr("substring(form, 1, place)"), F.expr("substring(form, place + 2)"))
        own = placed.withColumn("rest", F.when(F.char_length("form") > F.col("m"), rest).otherwise(F.col("form")))
        swap = placed.where((F.char_length("form") == F.col("m")) & (F.col("place") < F.col("m"))).withColumn("rest", rest)
        by_place = own.withColumn("kind", F.lit("i")).unionByName(swap.withColumn("kind", F.lit("s"))).select(
            "form", "n", "m", "back", F.concat_ws(
                ":", "kind", F.col("back").cast("string"), F.col("m").cast("string"), F.col("place").cast("string"),
                "rest").alias("key"), "place")
        rows = marked.where("hot_key is null").drop("hot_key").unionByName(by_place)
    return rows.repartition("key").sortWithinPartitions("key", "form").mapInArrow(
        _walk_groups, "word string, near_n long, near string")


# ---- forms and roots --------------------------------------------------------

def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, f"spelling-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def roots(links: DataFrame) -> DataFrame:
    """(word, form) of words that have a form -> (word, root): the end of each chain."""
    to = _written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = to.select(F.col("word").alias("at"), F.col("root").alias("far"))
        to = _written(to.join(ahead, F.col("root") == F.col("at"), "left")
                      .select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")),
                      "roots")
        if to.where("moved").isEmpty():
            return to.select("word", "root")
        to = to.drop("moved")


def spelling_variants(vocabulary: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n) -> word, n, n_near, form, form_n, root."""
    near = near_words(vocabulary, group_words).select(
        "word", F.lit(None).cast("long").alias("n"), F.lit(1).cast("long").alias("one"),
        F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form")).alias("best"))
    own = vocabulary.select("word", "n", F.lit(0).cast("long").alias("one"),
                            F.lit(None).cast(near.schema["best"].dataType).alias("best"))
    # near words and the word's own count meet in one aggregation
    found = near.unionByName(own).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("one").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.order") >= 2 * F.col("n")
    found = _written(found.select("word", "n", "n_near", F.when(is_form, F.col("best.form")).alias("form"),
                                  F.when(is_form, -F.col("best.order")).alias("form_n")), "forms")
    ends = roots(found.where("form is not null")).select(F.col("word").alias("of"), "root")
    return found.join(ends, F.col("word") == F.col("of"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.tables import table

    counts = word_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
    vocabulary = _written(counts.where(F.col("n") >= MIN_COUNT), "vocabulary")
    return spelling_variants(vocabulary).select("word", "form", "root", "n", "n_near", "form_n")
