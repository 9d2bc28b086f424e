"""Exact top-k search by inner product, with no-random-access aggregation over sorted lists.

A vector's score is a sum over dimensions; each dimension of a block of vectors is a list sorted by value,
read from the top where the query's component is positive and from the bottom where it is negative. After a
depth every vector has a lower bound (what was read, plus the list's last value for each list it was not met in)
and an upper bound (the value the list has come to). Once the k-th lower bound is above the upper bounds of
the rest, only the others can qualify, and reading on settles their scores. For a block of queries the
bounds of one depth are matrix products, in which unread values are replaced by those limits.

Queries and vectors meet block by block: pairs of blocks are the tasks, and blocks travel as one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm.common import map_batches, stored

BLOCK = 4096
QUERIES = 1024
#: Depths at which bounds are compared, as shares of a list. At the last one all is read.
DEPTHS = (0.25, 0.5, 1.0)
#: Reading on for single vectors, not for all, once at most this share can still qualify.
FEW = 0.02


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """A number type that holds all products and sums exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def block_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(query id, ids, scores) of each query's k best in a block; more where scores tie with the k-th."""
    kind = exact_type(q, x)
    own = q_ids[:, None] == ids[None, :]
    if kind is object:  # beyond double precision: whole numbers of any size, read to the end
        q, x = q.astype(int).astype(object), x.astype(int).astype(object)
        scores = q @ x.T
        for i in range(len(q)):
            at = np.flatnonzero(~own[i])
            at = at[np.lexsort((ids[at], np.asarray([-v for v in scores[i][at]], dtype=object).astype(float)))] if len(at) > k else at
            best = sorted(at.tolist(), key=lambda j: (-scores[i][j], ids[j]))[:k]
            yield q_ids[i], ids[best], [int(scores[i][j]) for j in best]
        return
    q, x = q.astype(kind), x.astype(kind)
    n = len(x)
    lists = np.sort(x, axis=0)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    for depth in DEPTHS:
        read = max(1, min(n, int(np.ceil(depth * n))))
        top, bottom = lists[n - read], lists[read - 1]
        upper = up @ np.maximum(x, top).T + down @ np.minimum(x, bottom).T
        if read == n:
            lower = upper
        else:
            lower = up @ np.where(x >= top, x, lists[0]).T + down @ np.where(x <= bottom, x, lists[-1]).T
        lower[own] = -np.inf
        upper[own] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf, kind)
        open_ = (upper >= kth[:, None]) & ~own
        if read == n or open_.mean() <= FEW:
            break
    for i in range(len(q)):
        at = np.flatnonzero(open_[i])
        scores = x[at] @ q[i]
        best = np.lexsort((ids[at], -scores))[:k]
        yield q_ids[i], ids[at[best]], scores[best].astype(np.int64).tolist()


def blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """(dims, block, ids, values): rows of at most ``size`` vectors (_id, _v) of one length; blocks are numbered once written."""
    count = vectors.count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(dims: int) -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held[dims]])
            values = np.concatenate([h[1] for h in held[dims]])
            held[dims] = [(ids[size:], values[size:])] if len(ids) > size else []
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([ids[:size].tobytes()]), pa.array([values[:size].tobytes()])], names=["dims", "ids", "values"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                values = np.floor(256 * flat[starts[at][:, None] + np.arange(dims)].astype(np.float64)).reshape(len(at), dims)
                held.setdefault(dims, []).append((ids[at], values))
                while sum(len(h[0]) for h in held[dims]) >= size:
                    yield row(dims)
        for dims in held:
            if sum(len(h[0]) for h in held[dims]):
                yield row(dims)

    rows = map_batches(vectors.repartition(max(1, -(-count // size))), pack, "dims int, ids binary, values binary")
    return stored(rows.withColumn("block", F.monotonically_increasing_id()), name)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score of each query's ``k`` highest integer inner products.

    A component x counts as floor(256 * x). Candidates are all rows but those with the query's id; all, if fewer than
    ``k``; ties go to the smaller id. Vectors that are null, or hold a null or a value that isn't finite, and rows with a null id take no part.
    Only vectors of equal length are compared. A repeated candidate row counts each time; a repeated query id
    asks once, with its least vector. A score beyond 64 bits is an error. No queries, or an empty table, give an empty result.
    """
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(F.coalesce(F.col(vector_col), F.array()), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), is_query.alias("_q"))
    asked = rows.where("_q").groupBy("_id").agg(F.min("_v").alias("_v"))
    data = blocks(rows.select("_id", "_v"), BLOCK, "vector_blocks")
    asks = blocks(asked.select("_id", "_v"), QUERIES, "query_blocks").select(F.col("dims").alias("q_dims"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))

    # the numbers of all pairs of blocks of equal length; then each pair fetches its two blocks
    pairs = data.select("dims", "block").join(asks.select(F.col("q_dims").alias("dims"), "q_block"), "dims").select("block", "q_block")
    tasks = pairs.join(data, "block").join(asks.drop("q_dims"), "q_block").select("dims", "ids", "values", "q_ids", "q_values")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, ids, values, q_ids, q_values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                x, q = np.frombuffer(values).reshape(len(ids), dims), np.frombuffer(q_values).reshape(len(q_ids), dims)
                found = [(np.full(len(got), who), got, score) for who, got, score in block_top(q_ids, q, ids, x, k)]
                columns = [np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.asarray([s for f in found for s in f[2]], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "id", "score"])

    best = map_batches(tasks.repartition(F.xxhash64("ids", "q_ids")), search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
