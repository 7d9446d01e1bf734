"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors are quantised to integers, so that scores are exact. Candidates are
read in chunks and laid out vertically (one row per dimension). For a block of
queries, partial scores are accumulated over the first block of dimensions for
every candidate of the chunk; after each block, a candidate survives for a
query only if its partial score plus the Cauchy-Schwarz bound on the remaining
dimensions, |q_rest| * |c_rest|, can still reach the query's k-th best score so
far. Survivors are compacted, and only they see the next dimensions. Dimensions
are visited in the order of the queries' mass, largest first.

Queries are a stated set. They are read in blocks of at most QUERY_BLOCK
vectors, each block is broadcast (its size is thereby bounded), and each
partition of candidates returns at most k rows per query, which one more
aggregation merges.

Defined results: null vectors, empty ones, ones with null or non-finite
components and ones whose id is null take no part. A candidate of another
dimension than the query doesn't meet it. Repeated ids: rows with the query's
own id are never its candidates; other repeated rows count as one candidate each.
Ties go to the smaller id. Scores beyond the range of long are saturated.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024.0
QUERY_BLOCK = 2048
CHUNK = 4096
DIM_BLOCK = 16
EXACT = float(1 << 52)
SCHEMA = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id and the floored components as doubles, usable vectors only."""
    v = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("v")
    )


class Search:
    """The k best candidates so far of each query of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.k, self.ids = k, ids
        self.order = np.argsort(-(vectors**2).sum(axis=0), kind="stable")
        self.q = np.ascontiguousarray(vectors[:, self.order])
        self.cuts = [*range(0, vectors.shape[1], DIM_BLOCK), vectors.shape[1]]
        self.rest = [np.sqrt((self.q[:, c:] ** 2).sum(axis=1)) for c in self.cuts]
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # heaps of (score, -id)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        cols = np.ascontiguousarray(vectors[:, self.order].T)
        if max(abs(self.q).max(), 1) * max(abs(cols).max(), 1) * len(cols) >= EXACT:
            return self._slow(ids, vectors)
        rest = [np.sqrt((cols[c:] ** 2).sum(axis=0)) for c in self.cuts]
        first = self.q[:, : self.cuts[1]] @ cols[: self.cuts[1]]
        for j in range(len(self.ids)):
            heap = self.best[j]
            alive, score = np.flatnonzero(ids != self.ids[j]), None
            score = first[j, alive]
            for b in range(1, len(self.cuts)):
                if b > 1:
                    part = slice(self.cuts[b - 1], self.cuts[b])
                    score = score + self.q[j, part] @ cols[part][:, alive]
                if len(heap) == self.k:
                    keep = score + self.rest[b][j] * rest[b][alive] * (1 + 1e-9) + 1e-3 >= heap[0][0]
                    alive, score = alive[keep], score[keep]
                    if not len(alive):
                        break
            if len(alive) > self.k:
                top = np.lexsort((ids[alive], -score))[: self.k]
                alive, score = alive[top], score[top]
            self._take(j, zip(score.astype(np.int64).tolist(), (-ids[alive]).tolist()))

    def _slow(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Whole Python integers, where doubles could round."""
        whole = [[int(x) for x in v] for v in vectors]
        for j, q in enumerate(self.q):
            back = np.empty(len(q))
            back[self.order] = q
            mine = [int(x) for x in back]
            scores = (max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(mine, v)))) for v in whole)
            self._take(j, ((s, -int(i)) for s, i in zip(scores, ids) if i != self.ids[j]))

    def _take(self, j: int, found) -> None:
        heap = self.best[j]
        for pair in found:
            if len(heap) < self.k:
                heapq.heappush(heap, pair)
            elif pair > heap[0]:
                heapq.heapreplace(heap, pair)

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for j, heap in enumerate(self.best):
            for score, negative in heap:
                yield int(self.ids[j]), -negative, score


def _by_width(ids: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values)
    width = np.diff(offsets)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        yield ids[rows], flat[offsets[rows][:, None] + np.arange(w)]


def top_k(df: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """Each query's k best other rows: query_id, rank (from 1), vec_id, score."""
    vectors = quantised(df, id_col, vector_col, scale)
    wanted = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    found = None
    low = None
    while True:
        block = (wanted if low is None else wanted.where(F.col("vec_id") > low)).orderBy("vec_id").limit(QUERY_BLOCK).toPandas()
        if found is None or len(block):
            part = _against(vectors, block, k)
            found = part if found is None else found.unionByName(part)
        if len(block) < QUERY_BLOCK:
            break
        low = int(block["vec_id"].iloc[-1])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _against(vectors: DataFrame, block, k: int) -> DataFrame:
    ids = block["vec_id"].to_numpy(dtype=np.int64)
    queries = {}
    for w in {len(v) for v in block["v"]}:
        rows = [i for i, v in enumerate(block["v"]) if len(v) == w]
        queries[w] = (ids[rows], np.array([block["v"].iloc[i] for i in rows], dtype=np.float64))
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {w: Search(i, v, k) for w, (i, v) in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                column = pa.concat_arrays([part.column(1)]) if part.column(1).offset else part.column(1)
                for some, matrix in _by_width(np.asarray(part.column(0)), column):
                    if matrix.shape[1] in searches:
                        searches[matrix.shape[1]].offer(some, matrix)
        rows = [r for s in searches.values() for r in s.rows()]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, SCHEMA)
