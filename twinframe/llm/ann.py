"""Approximate nearest neighbours with a forest of hash prefixes.

A tree is a sorted array of long hash strings, one bit for the side of each of
its random planes.  A query descends in every tree to the rows that share its
longest prefix; then all trees go up together, one bit at a time, until enough
different rows have been met.  Those candidates are scored exactly.

Rows are dealt into blocks of bounded size by a hash of their id and every
block has a forest of its own; the queries pass through each block in batches.
So a task holds one block and one batch of queries, whatever the table's size,
and a query's result is the best of what its blocks return.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows in a block on average, trees in its forest, bits in a hash string.
BLOCK_ROWS = 8192
TREES = 64
BITS = 24
#: A query goes up until it has met this share of a block (or ``LEAST_ROWS`` rows, if more).
SHARE = 0.5
LEAST_ROWS = 400


class PrefixForest:
    """Sorted hash strings of one block's rows in every tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.trees, self.bits = trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * bits)).astype(np.float32)
        keys = self.strings(vectors)
        self.order = np.argsort(keys, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(keys, self.order, axis=0).T.copy()
        self.order = self.order.T.copy()
        self.rows = len(vectors)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """One integer of ``bits`` bits for each row and tree; only directions matter."""
        out = np.zeros((len(vectors), self.trees), dtype=np.int64)
        weights = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.int64)
        for at in range(0, len(vectors), 2048):
            v = vectors[at : at + 2048]
            v = (v / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300)).astype(np.float32)
            sides = (v @ self.planes > 0).reshape(len(v), self.trees, self.bits)
            out[at : at + 2048] = sides @ weights
        return out

    def candidates(self, keys: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query, rows met) for queries with hash strings ``keys``, once all trees have gone up far enough."""
        waiting = np.arange(len(keys))
        for level in range(self.bits, -1, -1):
            if not len(waiting):
                return
            low = (keys[waiting] >> (self.bits - level)) << (self.bits - level)
            start = np.stack([np.searchsorted(s, low[:, t]) for t, s in enumerate(self.sorted)])
            end = np.stack([np.searchsorted(s, low[:, t] + (1 << (self.bits - level))) for t, s in enumerate(self.sorted)])
            enough = (end - start).sum(axis=0) >= least  # if not, then not even with repeats
            left = [waiting[~enough]] if level else []
            for at in np.flatnonzero(enough) if level else range(len(waiting)):
                met = np.zeros(self.rows, dtype=bool)
                for tree in range(self.trees):
                    met[self.order[tree, start[tree, at] : end[tree, at]]] = True
                if level and int(np.count_nonzero(met)) < least:
                    left.append(waiting[at : at + 1])
                else:
                    yield int(waiting[at]), np.flatnonzero(met)
            waiting = np.concatenate(left) if left else waiting[:0]


def _search_block(ids, vectors, forest, query_ids, which, queries, k, share, least_rows):
    """(query id, query, row id, score) of each query's best candidates in one block."""
    least = min(len(ids), max(least_rows, math.ceil(share * len(ids))))
    keys = forest.strings(queries)
    out_q, out_w, out_v, out_s = [], [], [], []
    for at, rows in forest.candidates(keys, least):
        q, query = query_ids[at], queries[at]
        rows = rows[ids[rows] != q]
        if len(rows) > 4 * k:
            rough = vectors[rows] @ query
            bar = np.partition(rough, len(rough) - k)[len(rough) - k]
            rows = rows[rough >= bar - 1e-9 * max(1.0, abs(bar))]
        scores = (vectors[rows] * query).sum(axis=1)  # the same sum for equal vectors, wherever they lie
        best = np.lexsort((ids[rows], -scores))[:k]
        out_q.append(np.full(len(best), q, dtype=np.int64))
        out_w.append(np.full(len(best), which[at], dtype=np.int64))
        out_v.append(ids[rows][best])
        out_s.append(scores[best])
    return out_q, out_w, out_v, out_s


def usable(embedding: Column) -> Column:
    """Not null, not empty, all components finite, and not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    trees: int = TREES,
    bits: int = BITS,
    share: float = SHARE,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest rows found.

    Nearness is the largest inner product in double precision, ties to the
    smaller id; a query's own id is not among its candidates.  Vectors that are
    null, empty, zero or hold null or non-finite components take no part, as
    query or row; vectors meet only those of their own length.  With fewer than
    ``k`` candidates all are returned; empty tables give an empty result; extra
    columns are ignored.  Equal vectors share all hash strings, so ties of any
    number are met together.  An id that is asked with several vectors has a list
    of ranks for each of them; equal rows are asked once.  Candidates are rows, so an id may be
    met several times.
    """

    def good(df: DataFrame) -> DataFrame:
        v = F.col("v")
        picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return picked.where(usable(v) & F.col("id").isNotNull())

    blocks = max(1, math.ceil(rows.count() / block_rows))
    data = good(rows).select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("asked"), "v")
    asked = good(queries).dropDuplicates(["id", "v"]).select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", F.xxhash64("id", "v").alias("asked"), "v")
    dealt = data.union(asked).repartition(max(blocks, 1), "dim", "block").sortWithinPartitions("dim", "block", "kind", "id", "asked")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, forest, ids, vectors = None, [], None, None, None
        for batch in batches:
            dim, block, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            key = (dim.astype(np.int64) << 32 | block) * 2 + kind
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                own = batch.column(3)[a:b].to_numpy(zero_copy_only=False)
                which = batch.column(4)[a:b].to_numpy(zero_copy_only=False)
                v = batch.column(5)[a:b].flatten().to_numpy(zero_copy_only=False).reshape(b - a, int(dim[a]))
                if (dim[a], block[a]) != now:
                    now, held, forest = (dim[a], block[a]), [], None
                if kind[a] == 0:
                    held.append((own, v))
                    continue
                if not held:
                    continue
                if forest is None:
                    ids, vectors = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    forest = PrefixForest(vectors, trees, bits)
                q, w, r, s = _search_block(ids, vectors, forest, own, which, v, k, share, least_rows)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.concatenate(x), pa.int64()) for x in (q, w, r)), pa.array(np.concatenate(s), pa.float64())], names=["query_id", "asked", "vec_id", "score"]
                )

    found = cut(dealt.mapInArrow(work, "query_id bigint, asked bigint, vec_id bigint, score double"))
    best = Window.partitionBy("query_id", "asked").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
