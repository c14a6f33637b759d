"""Near-duplicate groups: MinHash signatures in an LSH forest, links confirmed exactly.

1. Texts become sets of five-word shingles (64-bit hashes), each set a 128-bit
   class digest and a signature of ``SIGNATURE`` minima.  Texts of one class
   have equal sets: the class is handled once, its copies only join back at
   the end.
2. The forest orders the signatures ``TREES`` times, each order starting at
   another place of the signature.  Neighbours with a common prefix of at
   least ``DEPTHS[0]`` minima form a region of that order; a region of more
   than ``REGION`` classes is split at the next depth, and so on, so dense
   regions get longer prefixes and sparse ones short ones.  Classes that
   share a whole signature and still exceed ``REGION`` are dealt into blocks
   that all hold the region's smallest class.
3. Inside a region, classes whose signatures agree on enough minima are tied
   together; only spanning stars leave the task, centred on the smallest class.
4. All classes tied to one centre (by any order) form a group to confirm: the
   full shingle sets of its members meet once, and a breadth-first walk
   compares every class it reaches with all classes not yet reached, so no
   link inside the group is lost.  Connected components of the confirmed stars
   are the first result.
5. A longer prefix parts some linked classes, so the classes of every region
   that was split are joined a second time, without signatures: shingles are
   ordered by ascending (sketched) document frequency, and two sets above the
   threshold share a shingle of their prefixes in that order.  Buckets whose
   classes are already one component are left out; larger ones than ``REGION``
   meet block against block; pairs that the positions in the prefixes rule out
   are dropped; the others are confirmed as in step 4.

What moves between tasks in steps 1 to 4 is linear in the classes.  A region
holds at most ``REGION`` classes (plus one), a centre has one region per order,
so a group to confirm has at most ``TREES * REGION`` members.  Two texts at the
threshold fail to meet in a region with a probability below 1e-6 at depth 3
and 16 orders; the signature test of step 3 allows four standard deviations.
Step 5 is exact for the classes of split regions; it costs the prefixes of
their sets, and blocks against blocks where a shingle of many prefixes still
joins different components.  Recall against brute force is tested.

Defined results: words are runs of other characters than space and 0x09-0x0D,
A-Z lower-cased; a text with one to four words has its whole sequence as one
shingle; a null text or one without words has no shingles and is a group of
its own.  ``component_id`` is the smallest doc_id of the group; rows with a
null doc_id take part, rows that repeat a doc_id share its fate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.blocks import U64, Block, mix, text_blocks, window_hashes, worker_of
from ticketflow.session import materialize

SHINGLE = 5
SIGNATURE = 128
TREES = 16
DEPTHS = (3, 4, 6, 8, 12, 16, 24, 32, 48, 64, SIGNATURE)
REGION = 512
SLOTS = 1 << 20             # counters of the document frequencies that order shingles
BLOCK_SHINGLES = 1 << 22    # of a block of classes to confirm in step 5, on average
BROADCAST_ROWS = 200_000    # involved classes (about 60 bytes each) that may be broadcast
LOWEST = -(1 << 63)

_SEEDS = np.random.default_rng(20240607)
_FACTORS = _SEEDS.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * U64(2) + U64(1)
_OFFSETS = _SEEDS.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64)


# ---- shingle sets ---------------------------------------------------------

def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's texts, sorted per text, and their edges."""
    words = block.word_hashes(lower=True)
    h, at = window_hashes(words, block.first, SHINGLE)
    text = block.text_of_word()
    owner = text[at]
    n_words = block.n_words
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        whole = np.array([mix(np.array([reduce(lambda a, b: (a * 0x9E3779B97F4A7C15 + int(b)) % (1 << 64),
                                               words[block.first[i]:block.first[i + 1]], 1)], U64))[0]
                          for i in short], U64)
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(block.hi - block.lo + 1))


def _digests(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128-bit digest of each set (sums of two mixed hashes)."""
    return np.stack([np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), starts),
                     np.add.reduceat(mix(h ^ U64(0x14057B7EF767814F)), starts)], axis=1)


def _signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), SIGNATURE), np.uint32)
    for k in range(SIGNATURE):
        out[:, k] = np.minimum.reduceat((h ^ _OFFSETS[k]) * _FACTORS[k], starts) >> U64(32)
    return out


def _binary(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in rows]


def _mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, text_hash) -> (doc_id, text_hash, n_shingles, cls)."""
    worker_of("near_dup")
    for batch in batches:
        for block in text_blocks(batch.column(1)):
            h, edges = shingle_sets(block)
            n = np.diff(edges)
            full = np.flatnonzero(n)
            cls: list = [None] * len(n)
            if len(full):
                for i, c in zip(full, _binary(_digests(h, edges[:-1][full]))):
                    cls[i] = c
            size = block.hi - block.lo
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.lo, size), batch.column(2).slice(block.lo, size),
                 pa.array(n, pa.int64()), pa.array(cls, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "cls"])


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, text) -> (at, cls, sig, size) of the texts that have shingles."""
    worker_of("near_dup")
    for batch in batches:
        for block in text_blocks(batch.column(1)):
            h, edges = shingle_sets(block)
            full = np.flatnonzero(np.diff(edges))
            if len(full):
                starts = edges[:-1][full]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(block.lo + full)), pa.array(_binary(_digests(h, starts)), pa.binary()),
                     pa.array(_binary(_signatures(h, starts)), pa.binary()), pa.array(np.diff(edges)[full], pa.int64())],
                    names=["at", "cls", "sig", "size"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, node, keys) -> (key, node, shingles): the full set of a text of that class,
    once for each group to confirm."""
    for batch in batches:
        wanted = batch.column(1).to_pylist()
        groups = batch.column(2).to_pylist()
        for block in text_blocks(batch.column(0)):
            h, edges = shingle_sets(block)
            full = np.flatnonzero(np.diff(edges))
            if not len(full):
                continue
            digest = dict(zip(full.tolist(), _binary(_digests(h, edges[:-1][full]))))
            # a few texts a batch: a set leaves as often as it has groups
            for part in np.array_split(full, max(1, len(full) // 64)):
                keys, nodes, sets = [], [], []
                for i in part.tolist():
                    if wanted[block.lo + i].endswith(digest[i]):
                        keys += groups[block.lo + i]
                        nodes += [wanted[block.lo + i]] * len(groups[block.lo + i])
                        sets += [h[edges[i]:edges[i + 1]].tobytes()] * len(groups[block.lo + i])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.binary()),
                                                  pa.array(sets, pa.binary())], names=["key", "node", "shingles"])


def _class_sets(text: pa.Array, wanted: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of the texts that are of their wanted class."""
    for block in text_blocks(text):
        h, edges = shingle_sets(block)
        full = np.flatnonzero(np.diff(edges))
        if len(full):
            for i, digest in zip(full.tolist(), _binary(_digests(h, edges[:-1][full]))):
                if wanted[block.lo + i].endswith(digest):
                    yield block.lo + i, h[edges[i]:edges[i + 1]]


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, node) -> (slot, n): sketched document frequencies of the shingles."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, h in _class_sets(batch.column(0), batch.column(1).to_pylist()):
            np.add.at(total, (h % U64(SLOTS)).astype(np.int64), 1)
    slots = np.flatnonzero(total)
    for part in np.array_split(slots, max(1, len(slots) // 50_000)):
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())],
                                         names=["slot", "n"])


def _prefixes(frequency, percent: int):
    """(text, node, nid, root) -> (token, nid, root, size, at, short): the rarest shingles of each
    set, as many as a set above the threshold must share one of.

    ``short`` marks those that are enough to meet a set of the same size or larger.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = frequency.value
        for batch in batches:
            nid, root = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            for i, h in _class_sets(batch.column(0), batch.column(1).to_pylist()):
                n = len(h)
                longer = n + percent * n // -100 + 1                # n - ceil(n * percent / 100) + 1
                short = n + 2 * percent * n // -(100 + percent) + 1
                h = h[np.lexsort((h, count[(h % U64(SLOTS)).astype(np.int64)]))[:longer]]
                at = np.arange(longer)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.full(longer, nid[i])), pa.array(np.full(longer, root[i])),
                     pa.array(np.full(longer, n)), pa.array(at), pa.array(at < short)],
                    names=["token", "nid", "root", "size", "at", "short"])
    return run


# ---- the forest -----------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint32).reshape(len(column), SIGNATURE)


def _prefix_keys(sig: np.ndarray, tree: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the first ``depth`` minima in each row's own order."""
    step = SIGNATURE // TREES
    h = mix((tree.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(depth))
    rows = np.arange(len(sig))
    for d in range(depth):
        h = mix(h + sig[rows, (tree * step + d) % SIGNATURE].astype(U64) * U64(0xD6E8FEB86659FD93))
    return h.view(np.int64)


def _all_trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _matrix(batch.column(1))
        for t in range(TREES):
            tree = np.full(len(sig), t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tree, pa.int32()),
                 pa.array(_prefix_keys(sig, tree, DEPTHS[0]), pa.int64())], names=["nid", "tree", "key"])


def _deeper(depth: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(1).to_numpy(zero_copy_only=False)
            keys = _prefix_keys(_matrix(batch.column(2)), tree, depth)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())],
                                             names=["nid", "tree", "key"])
    return run


KEYED = "nid long, tree int, key long"


def forest_regions(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, nid): the regions of all orders, none of more than REGION + 1 classes;
    (nid): the classes of the regions that were split, None if there are none.

    Classes go by a 64-bit hash here; two that share one are in each other's
    regions, no more.
    """
    rows = classes.select("nid", "sig").mapInArrow(_all_trees, KEYED)
    regions, split = [], None
    for depth, deeper in zip(DEPTHS, [*DEPTHS[1:], None]):
        rows = materialize(rows)
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("least")).where("n > 1")
        sized = materialize(rows.join(sizes, "key"))
        regions.append(sized.where(F.col("n") <= REGION).select("key", "nid"))
        large = sized.where(F.col("n") > REGION)
        if deeper is None:
            # equal signatures: blocks that share the region's smallest class
            blocks = F.ceil(F.col("n") / REGION)
            dealt = large.select(F.xxhash64("key", F.pmod(F.xxhash64("nid"), blocks)).alias("key"), "nid", "least")
            regions += [dealt.select("key", "nid"), dealt.select("key", F.col("least").alias("nid")).distinct()]
            break
        if large.isEmpty():
            break
        if split is None:
            split = large.select("nid").distinct()
        rows = large.select("nid", "tree").join(classes.select("nid", "sig"), "nid").select(
            "nid", "tree", "sig").mapInArrow(_deeper(deeper), KEYED)
    return reduce(DataFrame.unionAll, regions), split


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal first column of a sorted stream, across batches."""
    carry: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if carry and key[a] != last:
                yield pa.Table.from_batches(carry)
                carry = []
            carry.append(batch.slice(a, b - a))
            last = key[a]
    if carry:
        yield pa.Table.from_batches(carry)


def _stars(n: int, linked) -> Iterator[tuple[int, int]]:
    """Spanning edges of the graph on 0..n-1; linked(i) is a mask of i's neighbours."""
    unseen = np.ones(n, bool)
    for seed in range(n):
        if not unseen[seed]:
            continue
        unseen[seed] = False
        front = [seed]
        while front and unseen.any():
            hit = np.flatnonzero(linked(front.pop()) & unseen)
            unseen[hit] = False
            front.extend(hit)
            yield from ((seed, int(j)) for j in hit)


def _edges(pairs: Iterable[tuple[bytes, bytes]], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    a: list[bytes] = []
    b: list[bytes] = []
    for x, y in pairs:
        a.append(x)
        b.append(y)
        if len(a) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _tie(least: int):
    """(key, node, sig) sorted by key -> spanning stars of the classes whose
    signatures agree on at least ``least`` minima."""
    def pairs(batches):
        worker_of("near_dup")
        for run in _runs(batches):
            if run.num_rows < 2:
                continue
            nodes = run.column(1).to_pylist()
            order = sorted(range(len(nodes)), key=nodes.__getitem__)     # the smallest is the centre
            sig = _matrix(run.column(2))[order]
            for i, j in _stars(len(nodes), lambda x: (sig == sig[x]).sum(axis=1) >= least):
                yield nodes[order[i]], nodes[order[j]]

    return lambda batches: _edges(pairs(batches))


def _confirm(percent: int):
    """(key, node, shingles) sorted by key -> spanning stars of the exact links."""
    def pairs(batches):
        worker_of("near_dup")
        for run in _runs(batches):
            if run.num_rows < 2:
                continue
            cls, sets = [], []
            seen = set()
            for c, s in zip(run.column(1).to_pylist(), run.column(2).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    cls.append(c)
                    sets.append(np.frombuffer(s, U64))
            size = np.array([len(s) for s in sets])
            _, ids = np.unique(np.concatenate(sets), return_inverse=True)
            edges = np.concatenate([[0], np.cumsum(size)])
            mark = np.zeros(ids.max() + 1, np.int64)

            def linked(x):
                own = ids[edges[x]:edges[x + 1]]
                mark[own] = 1
                common = np.add.reduceat(mark[ids], edges[:-1])
                mark[own] = 0
                return 100 * common >= percent * (size + size[x] - common)

            for i, j in _stars(len(cls), linked):
                yield cls[i], cls[j]

    return lambda batches: _edges(pairs(batches))


def _meet(percent: int):
    """(key, nid, root, size, at, short, block) sorted by key -> pairs of classes of different
    components whose sizes and places of the key in the prefixes allow the threshold."""
    def run(batches):
        for group in _runs(batches):
            nid, root, size, at, short, block = (group.column(k).to_numpy() for k in range(1, 7))
            across = (block != block[0]).any()
            a, b = [], []
            for i in np.flatnonzero(short):
                fits = (size >= size[i]) & (100 * size[i] >= percent * size) & (root != root[i])
                fits &= (100 + percent) * np.minimum(size[i] - at[i], size - at) >= percent * (size + size[i])
                if across:
                    fits &= block != block[i]
                other = nid[fits]
                a.append(np.minimum(other, nid[i]))
                b.append(np.maximum(other, nid[i]))
                if sum(map(len, a)) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))],
                                                     names=["a", "b"])
                    a, b = [], []
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))],
                                                 names=["a", "b"])
    return run


# ---- components -----------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, root): every node's smallest connected node.

    Alternates large-star and small-star steps (map-side combined minima and
    equi-joins, written to the shared folder) until the edges are stars around
    roots, after a logarithmic number of rounds.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # stars: no node hangs on two others, or on one that itself hangs
        uses = cur.select(F.col("a").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(
            cur.select(F.col("b").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        if uses.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where(
                "hangs + holds > 1").isEmpty():
            roots = cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        cur = materialize(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())


# ---- the operator ---------------------------------------------------------

def _sorted_runs(df: DataFrame) -> DataFrame:
    return df.repartition("key").sortWithinPartitions("key")


def _bytes8(column):
    return F.unhex(F.lpad(F.hex(column), 16, "0"))


def _from_bytes8(column):
    """The long of eight bytes, by its two halves (hexadecimal text has no sign)."""
    half = lambda at: F.conv(F.hex(F.substring(column, at, 4)), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(5))


def row_key(doc_id, text_hash):
    """17 bytes that order rows by doc_id (nulls last), then by the hash of the text."""
    flag = F.when(doc_id.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    return F.concat(flag, _bytes8(F.coalesce(doc_id, F.lit(0)).bitwiseXOR(F.lit(LOWEST))), _bytes8(text_hash))


def _key_id(node):
    """doc_id of a row key (null if it had none)."""
    value = _from_bytes8(F.substring(node, 2, 8)).bitwiseXOR(F.lit(LOWEST))
    return F.when(F.substring(node, 1, 1) == F.unhex(F.lit("00")), value)


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text of each class of ``nodes`` (node and other columns), with these columns."""
    nodes = materialize(nodes.select("*", _key_id(F.col("node")).alias("__id"),
                                     _from_bytes8(F.substring("node", 10, 8)).alias("__hash")))
    if nodes.count() <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)
    return texts.join(nodes, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))


def _confirmed(texts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) spanning stars of the exact links inside the groups (key, node)."""
    wanted = members.groupBy("node").agg(F.collect_set("key").alias("keys"))
    sets = _texts_of(texts, wanted).select("text", "node", "keys").mapInArrow(
        _sets, "key long, node binary, shingles binary")
    return _sorted_runs(sets).mapInArrow(_confirm(percent), "a binary, b binary")


def crowd_links(texts: DataFrame, crowd: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that join the components (root) of ``crowd`` (node, nid, root, size): a prefix-filter join."""
    held = _texts_of(texts, crowd)
    tally = held.select("text", "node").mapInArrow(_tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = tally.toArrow()
    count = np.zeros(SLOTS, np.int64)
    count[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    frequency = texts.sparkSession.sparkContext.broadcast(count)
    tokens = materialize(held.select("text", "node", "nid", "root").mapInArrow(
        _prefixes(frequency, percent), "token long, nid long, root long, size long, at long, short boolean"))
    buckets = tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most"),
        F.max("short").alias("any_short")).where("least <> most and any_short").select(
        "token", F.ceil(F.col("n") / REGION).alias("blocks"))
    blocked = tokens.join(buckets, "token").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = blocked.select("*", other.alias("other")).select(
        F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")).alias("key"),
        "nid", "root", "size", "at", "short", "block")
    pairs = materialize(_sorted_runs(met).mapInArrow(_meet(percent), "a long, b long").distinct())
    # classes dealt into blocks; a class goes to the blocks that hold a partner
    size = crowd.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    blocks = max(1, -(-size["n"] // REGION), -(-(size["size"] or 0) // BLOCK_SHINGLES))
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    key = F.xxhash64(F.least(deal("a"), deal("b")), F.greatest(deal("a"), deal("b")))
    members = pairs.select(key.alias("key"), F.explode(F.array("a", "b")).alias("nid")).distinct()
    return _confirmed(texts, members.join(crowd, "nid").select("key", "node"), percent)


def duplicate_classes(texts: DataFrame, percent: int) -> DataFrame:
    """(cls, group_id) of every class in ``texts`` (doc_id, text, text_hash)."""
    # a class is known by its first row and its digest, so the smallest node is the smallest doc_id
    signed = texts.select(row_key(F.col("doc_id"), F.col("text_hash")).alias("at"), "text").mapInArrow(
        _sign, "at binary, cls binary, sig binary, size long")
    node = F.concat("at", "cls")
    classes = materialize(signed.groupBy("cls").agg(F.min("at").alias("at"), F.first("sig").alias("sig"),
                                                    F.first("size").alias("size"))
                          .select(F.xxhash64(node).alias("nid"), node.alias("node"), "sig", "size"))
    p = percent / 100
    least = int((p - 4 * (p * (1 - p) / SIGNATURE) ** 0.5) * SIGNATURE)
    regions, split = forest_regions(classes)
    ties = materialize(_sorted_runs(regions.join(classes, "nid").select("key", "node", "sig"))
                       .mapInArrow(_tie(least), "a binary, b binary").distinct())
    # a is the centre of its star; a class has at most one centre per order
    members = ties.unionAll(ties.select("a", F.col("a").alias("b")).distinct()).select(
        F.xxhash64("a").alias("key"), F.col("b").alias("node"))
    roots = components(_confirmed(texts, members, percent))
    if split is not None:
        roots = materialize(roots)
        crowd = materialize(classes.join(split, "nid").join(roots, "node", "left").select(
            "node", "nid", "size", F.xxhash64(F.coalesce("root", "node")).alias("root")))
        links = crowd_links(texts, crowd, percent)
        roots = components(links.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    digest = lambda node: F.substring(node, 18, 16)
    own = classes.select(digest("node").alias("cls"), _key_id(F.col("node")).alias("id"))
    linked = roots.select(digest("node").alias("cls"), _key_id(F.col("root")).alias("id"))
    # a linked class appears twice; its group's id is the smaller one
    return own.unionAll(linked).groupBy("cls").agg(F.min("id").alias("group_id"))


def near_duplicates(df: DataFrame, percent: int = 85, carry: bool = True) -> DataFrame:
    """``df`` (with doc_id and text) plus a struct column ``dedup``: ``n_shingles``,
    ``component_id`` and ``kept``.  With ``carry=False`` only doc_id comes along.

    An input column named ``dedup`` is replaced.
    """
    base = df.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    # written: the join below then shuffles both sides for itself, and AQE can split a class of many copies
    found = materialize(duplicate_classes(base, percent))
    marks = base.mapInArrow(_mark, "doc_id long, text_hash long, n_shingles long, cls binary")
    narrow = marks.join(found, "cls", "left").select(
        "doc_id", "text_hash", F.struct(
            "n_shingles", F.coalesce("group_id", "doc_id").alias("component_id"),
            F.col("doc_id").eqNullSafe(F.coalesce("group_id", "doc_id")).alias("kept")).alias("dedup"))
    if not carry:
        return narrow.select("doc_id", "dedup")
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != "dedup"]
    result = narrow.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "dedup").dropDuplicates(
        ["__id", "__hash"])
    rows = df.select(*columns, F.xxhash64("text").alias("__text_hash"))
    return rows.join(result, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))).select(
        *columns, "dedup")


def op5_near_dup(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.tables import table

    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), carry=False)
    return found.select("doc_id", "dedup.n_shingles", "dedup.component_id", "dedup.kept")
