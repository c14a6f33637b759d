"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become integers floor(1024 * x).  Queries and candidates are dealt by
hash into blocks of about ``QUERY_BLOCK`` and ``CANDIDATE_BLOCK`` rows; every
(query block, candidate block) cell is one run of a sorted partition.  In a
cell the candidates become postings per dimension (position, weight); each
query row walks its non-zero dimensions and scatters weight * posting into a
dense array of scores, a partition selection keeps its best ``k``, and a
rank window (trimmed map-side) merges the cells.

A stated query set is compared with all rows in blocks: a cell never holds
more than its two blocks, and no side is broadcast.  Exact copies of a row
(same vec_id and vector) are collapsed before the blocks.

Defined results: vectors that are null, or hold null or non-finite
components, and rows with a null vec_id take no part; an empty vector scores
0; missing components of a shorter vector count as 0; exact copies of a row
count once; rows that share a vec_id with different vectors are candidates
each, never of a query with that vec_id, and a query_id ranks the pairs of all
its vectors; scores beyond 64 bits saturate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.llm.near_dup import _runs
from ticketflow.session import materialize

SCALE = 1024
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
LONG = 2**63 - 1


def integer_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): usable vectors as integers, exact copies once."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
            .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
            .dropDuplicates())


def _dense(column: pa.Array) -> np.ndarray:
    """Rows of a list<int64> column as a matrix, shorter rows filled with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    out = np.zeros((len(size), max(int(size.max(initial=0)), 1)), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(offsets[0], offsets[-1])
    out[row, at - offsets[:-1][row]] = flat[at]
    return out


def cell_top_k(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray, k: int
               ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vec_ids, scores) of each query's best k among the candidates."""
    dims = min(queries.shape[1], candidates.shape[1])
    peak = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (queries, candidates)]
    kind = np.int64 if dims * peak[0] * peak[1] < LONG else object
    candidates = candidates.astype(kind)
    postings = []
    for d in range(dims):
        at = np.flatnonzero(candidates[:, d])
        whole = len(at) == len(c_ids)
        postings.append((slice(None) if whole else at, np.ascontiguousarray(candidates[at, d])))
    for q, row in zip(q_ids, queries):
        scores = np.zeros(len(c_ids), kind)
        for d in np.flatnonzero(row[:dims]):
            at, weight = postings[d]
            scores[at] += weight * (int(row[d]) if kind is object else row[d])
        if kind is object:
            scores = np.array([max(-LONG - 1, min(LONG, int(s))) for s in scores], np.int64)
        other = np.flatnonzero(c_ids != q)
        scores, ids = scores[other], c_ids[other]
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            best = np.flatnonzero(scores >= least)
        else:
            best = np.arange(len(scores))
        # ~score orders like -score and cannot overflow
        best = best[np.lexsort((ids[best], ~scores[best]))][:k]
        yield int(q), ids[best], scores[best]


def _cells(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches):
            is_query = cell.column(1).to_numpy().astype(bool)
            ids = cell.column(2).to_numpy()
            vectors = _dense(pa.concat_arrays(cell.column(3).chunks))
            for q, vec_ids, scores in cell_top_k(ids[is_query], vectors[is_query],
                                                 ids[~is_query], vectors[~is_query], k):
                if len(vec_ids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(vec_ids), q), pa.int64()), pa.array(vec_ids, pa.int64()),
                         pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, query_block: int = QUERY_BLOCK,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, v): best ``k`` of every query row."""
    rows = materialize(vectors.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("q")))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.sum(F.col("q").cast("long"))).first()
    cand_blocks = max(1, -(-n // candidate_block))
    query_blocks = max(1, -(-(n_queries or 0) // query_block))
    spread = F.xxhash64("vec_id", "v")
    cands = rows.select(F.pmod(spread, F.lit(cand_blocks)).alias("cb"),
                        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "vec_id", "v",
                        F.lit(False).alias("q"))
    queries = rows.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(cand_blocks - 1))).alias("cb"),
                                     F.pmod(spread, F.lit(query_blocks)).alias("qb"), "vec_id", "v", "q")
    cells = (cands.unionByName(queries)
             .select((F.col("qb").cast("long") * cand_blocks + F.col("cb")).alias("cell"), "q", "vec_id", "v"))
    parts = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(
        _cells(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op4_topk(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.tables import table

    vectors = integer_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(vectors, F.col("vec_id") % 100 == 0, 10)
