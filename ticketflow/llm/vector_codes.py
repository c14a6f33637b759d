"""Vector code compression: per-part codebooks with LAESA pivots.

Vectors become integers floor(1024 * x) and are cut into equal consecutive
parts; every part position has a codebook.  A few entries of the first
codebook, far from each other, are its fixed pivots.  The distances of every
vector's parts to the pivots are computed once and stored beside the vectors
in a table of the shared checkpoint folder.  In each round the pivots'
distances to the current entries give, by the triangle inequality, a lower
bound of every part-entry distance; entries are taken in waves in the order of
their bounds, exact integer squared distances are evaluated, and an entry
whose bound is above the best distance so far is never evaluated.  Bounds are
32-bit floats with a slack above their rounding error and are only compared
strictly, so ties and results are those of the full integer search.

A round is one scan of the written table with one aggregation: each task keeps
sums and counts of the entries (fixed size) and the driver sees one row per
entry.  Codebooks and pivots go to the tasks with the function.  A lost
executor repeats its own tasks of the round.

Sums per label are joined back; the table of labels is broadcast only up to
``BROADCAST_LABELS`` rows, beyond that a label's rows are salted.

Defined results: rows whose vector is null or holds null or non-finite
components are dropped; components beyond +-2^24 after scaling count as that
bound; a vector shorter than the table's longest, or than the next multiple of
the parts, is filled with zeros; repeated rows, and rows that share a vec_id,
are vectors each, ordered by vec_id (null last), then by components; equal
entries keep their places and the lower index wins; fewer vectors than entries
give a smaller codebook; an empty table gives an empty table; an input column
with a result's name is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow.session import scratch_dir, ship_package

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
PIVOTS = 16
PEAK = 1 << 24           # squared distances of up to 4,096 components fit 64 bits
BROADCAST_LABELS = 50_000
SALTS = 32
ROWS = 2048              # vectors searched at once
WAVES = (4, 28)          # entries per wave in the order of their bounds; the rest is the last wave
PAIRS = 1 << 13          # distances evaluated at once
SLACK = 4e-7             # above the relative rounding error of 32-bit distances and their difference


# ---- search ---------------------------------------------------------------

def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of integer rows, correctly rounded up to the last bits."""
    out = np.empty((len(x), len(y)))
    for k, row in enumerate(y):
        out[:, k] = np.sqrt(((x - row) ** 2).sum(1))
    return out


def choose_pivots(entries: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: each next one has the largest least distance to those before."""
    if not len(entries):
        return entries
    chosen, least = [0], distances(entries, entries[:1])[:, 0]
    while len(chosen) < pivots and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, distances(entries, entries[chosen[-1]:chosen[-1] + 1])[:, 0])
    return entries[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivot_entry: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, its squared distance, exact evaluations) of each row of ``x``.

    ``to_pivots`` holds the rows' distances to the pivots, ``pivot_entry`` the
    entries' (pivots x entries), both as 32-bit floats.
    """
    n, size = len(x), len(entries)
    bound, gap = np.zeros((n, size), np.float32), np.empty((n, size), np.float32)
    for p in range(pivot_entry.shape[0]):
        np.abs(np.subtract(to_pivots[:, p, None], pivot_entry[p], out=gap), out=gap)
        np.maximum(bound, gap, out=bound)
    slack = SLACK * (to_pivots.max(1, initial=0) + pivot_entry.max(initial=0) + 1)
    bound -= slack[:, None].astype(np.float32)
    # integers below 2^53 are exact as doubles, whose products are vectorised
    peak = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    exact = np.float64 if 4 * peak * peak * x.shape[1] < 1 << 53 else np.int64
    none = np.inf if exact is np.float64 else np.iinfo(np.int64).max
    x, entries = x.astype(exact), entries.astype(exact)
    best, index = np.full(n, none, exact), np.full(n, size, np.int64)
    evaluated = 0
    ends = [e for e in np.cumsum(WAVES).tolist() if e < size] + [size]
    order = np.argpartition(bound, [e - 1 for e in ends], axis=1)
    for begin, end in zip([0, *ends], ends):
        entry = order[:, begin:end]
        row, col = np.nonzero(np.take_along_axis(bound, entry, 1) <= np.sqrt(best.astype(float))[:, None])
        if not len(row):
            break
        found = np.full(entry.shape, none, exact)
        for lo in range(0, len(row), PAIRS):
            r, c = row[lo:lo + PAIRS], col[lo:lo + PAIRS]
            diff = x[r] - entries[entry[r, c]]
            found[r, c] = np.einsum("ij,ij->i", diff, diff)
        evaluated += len(row)
        least = found.min(1)
        # ties to the lower index, within the wave and against the waves before
        at = np.where(found == least[:, None], entry, size).min(1)
        better = (least < best) | ((least == best) & (at < index))
        best, index = np.where(better, least, best), np.where(better, at, index)
    return index, best.astype(np.int64), evaluated


@dataclass
class Codebooks:
    """Entries (parts x entries x width) and pivots (one array per part)."""

    entries: np.ndarray
    pivots: list[np.ndarray]

    def search(self, v: np.ndarray, to_pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, index, squared distance) of whole vectors ``v`` (rows x parts x width)."""
        at = 0
        for p, pivots in enumerate(self.pivots):
            near = distances(self.entries[p], pivots).T.astype(np.float32)
            index, best, _ = nearest(v[:, p], to_pivots[:, at:at + len(pivots)], self.entries[p], near)
            at += len(pivots)
            yield p, index, best

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """Rows of a list column as a matrix, shorter rows filled with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    size = np.diff(offsets)
    if (size == width).all():
        return flat.reshape(len(size), width).astype(kind)
    out = np.zeros((len(size), width), kind)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - (offsets[:-1] - offsets[0])[row]] = flat
    return out


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def _vectors(block: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    v = _matrix(block.column(block.schema.get_field_index("__v")), parts * width, np.int64)
    return v.reshape(len(v), parts, width)


def _pivot_distances(block: pa.RecordBatch) -> np.ndarray:
    column = block.column(block.schema.get_field_index("__d"))
    return _matrix(column, len(column[0]), np.float32)


# ---- jobs -----------------------------------------------------------------

def integer_parts(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``df`` without unusable vectors, with the integer components as array<int> ``__v``."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    value = lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(
        x.cast("double"), F.lit(-1e12)), F.lit(1e12)) * scale), F.lit(-PEAK)), F.lit(PEAK)).cast("int")
    return df.where(F.col(vector).isNotNull() & ~bad).withColumn("__v", F.transform(vector, value))


def _with_pivots(books: Codebooks, names: list[str]):
    parts, _, width = books.entries.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            v = _vectors(block, parts, width)
            d = np.concatenate([distances(v[:, p], books.pivots[p]) for p in range(parts)], 1).astype(np.float32)
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * d.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*block.columns, pa.ListArray.from_arrays(offsets, pa.array(d.ravel()))], names=names)
    return run


def _sums(books: Codebooks):
    parts, size, width = books.entries.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, size, width), np.int64)
        count = np.zeros((parts, size), np.int64)
        for block in _blocks(batches):
            v = _vectors(block, parts, width)
            for p, index, _ in books.search(v, _pivot_distances(block)):
                np.add.at(total[p], index, v[:, p])
                count[p] += np.bincount(index, minlength=size)
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]),
                 *(pa.array(total[part, entry, k]) for k in range(width))],
                names=["part", "entry", "n", *(f"s{k}" for k in range(width))])
    return run


def _codes(books: Codebooks, names: list[str]):
    parts, _, width = books.entries.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            v = _vectors(block, parts, width)
            code, error = np.zeros((len(v), parts), np.uint8), np.zeros(len(v), np.int64)
            for p, index, best in books.search(v, _pivot_distances(block)):
                code[:, p] = index
                error += best
            text = [c.hex() for c in (row.tobytes() for row in code)]
            kept = [c for c, name in zip(block.columns, block.schema.names) if name not in ("__v", "__d")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array(error)], names=names)
    return run


def train_codebooks(rows: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds over ``rows`` (written, with ``__v`` and ``__d``)."""
    books = Codebooks(first, [choose_pivots(part) for part in first])
    width = first.shape[2]
    sums = [f"s{k}" for k in range(width)]
    schema = "part int, entry int, n long" + "".join(f", {s} long" for s in sums)
    for _ in range(rounds):
        found = rows.select("__v", "__d").mapInArrow(_sums(books), schema).groupBy("part", "entry").agg(
            *(F.sum(c).alias(c) for c in ("n", *sums))).collect()   # one row per used entry
        entries = books.entries.copy()
        for r in found:
            entries[r["part"], r["entry"]] = [r[s] // r["n"] for s in sums]
        books = Codebooks(entries, books.pivots)
    return books


def compress_vectors(df: DataFrame, vector: str = "embedding", order: str = "vec_id", parts: int = PARTS,
                     size: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``df`` without unusable vectors, plus ``code``, ``error`` and ``codebooks_sha256``."""
    if not 1 <= size <= 256:
        raise ValueError("an entry's index has two hex digits")
    spark = df.sparkSession
    ship_package(spark)
    results = ("code", "error", "codebooks_sha256")
    kept = [c for c in df.columns if c.lower() not in results]
    used = integer_parts(df.select(*(F.col(f"`{c}`") for c in kept)), vector)
    start = used.select(F.col(f"`{order}`").alias("__order"), "__v").orderBy(
        F.col("__order").asc_nulls_last(), "__v").limit(size).select("__v").collect()
    longest = used.agg(F.max(F.size("__v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = np.zeros((len(start), parts * width), np.int64)
    for k, row in enumerate(start):
        first[k, :len(row[0])] = row[0]
    first = first.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    books = Codebooks(first, [choose_pivots(part) for part in first])
    stored = T.StructType([*used.schema.fields, T.StructField("__d", T.ArrayType(T.FloatType()))])
    path = scratch_dir(spark, "vector-codes")
    used.mapInArrow(_with_pivots(books, stored.fieldNames()), stored).write.parquet(path)
    rows = spark.read.schema(stored).parquet(path)
    books = train_codebooks(rows, first, rounds) if len(start) else books
    out = T.StructType([*(f for f in used.schema.fields if f.name != "__v"),
                        T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(_codes(books, out.fieldNames()), out).withColumn(
        "codebooks_sha256", F.lit(books.sha256()))


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` plus ``label_error``: the sum of ``error`` over rows of an equal label, nulls together."""
    path = scratch_dir(coded.sparkSession, "vector-errors")
    coded.write.parquet(path)
    rows = coded.sparkSession.read.schema(coded.schema).parquet(path).drop("label_error")
    per = rows.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error"))
    sums = scratch_dir(coded.sparkSession, "vector-labels")
    per.write.parquet(sums)
    per = coded.sparkSession.read.schema(per.schema).parquet(sums)
    same = F.col(label).eqNullSafe(F.col("__label"))
    if per.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(per), same).drop("__label")
    # a label may hold a third of all rows: its rows are dealt over SALTS copies of its sum
    per = per.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("code", "error"), F.lit(SALTS)).cast("int"))
    return salted.join(per, same & (F.col("__salt") == F.col("__copy"))).drop("__label", "__copy", "__salt")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.tables import table

    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    coded = compress_vectors(rows).select("vec_id", "label", "code", "error", "codebooks_sha256")
    return label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
