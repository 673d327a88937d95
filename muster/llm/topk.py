"""Exact top-k by integer inner product with multi-resolution segment statistics.

A component x becomes floor(scale * x).  A vector is cut into 1, then 4, then 16 segments; of each segment the mean
and the length of the deviation from it are kept.  For a segment of n components the inner product is at most
``n * mean * mean' + deviation * deviation'`` (Cauchy-Schwarz on the deviations), which bounds the squared distance
from below through ``|x|² + |y|² - 2 <x, y>``.  The bounds are tried coarse to fine against the k-th best exact score
known so far, which each level raises by scoring the k rows it puts first, and only what survives them all is scored exactly,
in integers.  Where more than ``DENSE`` of a block's pairs are left, a level or the scores are worked out for the whole block as a
matrix product, which is faster than picking the pairs; what has been dropped stays dropped.

Queries and rows are cut into tiles by hash: a query tile meets every slice of rows, so a task holds one tile and one
slice, whatever the sizes of the tables, and hands on k rows per query.

Null ids, null or empty vectors and vectors with null or non-finite components take no part; a query meets the vectors
of its own length only.  Rows with the query's id are its own.  Ties go to the smaller id, and repeated rows each take
a place.  Scores beyond 64 bits are an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = (1, 4, 16)
CHUNK = 256
DENSE = 1 / 16


def usable(vector: Column) -> Column:
    """Neither null nor empty, and every component a finite number."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")).cast("double"))
    )
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, scale: int) -> np.ndarray:
    """The scaled vectors as float64 of whole numbers; all have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def segments(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means times the root of the segment's length, and lengths of the deviations, for n segments or fewer."""
    means, spread = [], []
    for part in np.array_split(rows, min(n, rows.shape[1]), axis=1):
        mean = part.mean(axis=1)
        means.append(mean * math.sqrt(part.shape[1]))
        spread.append(np.sqrt(np.maximum(0, ((part - mean[:, None]) ** 2).sum(axis=1))))
    return np.stack(means, 1), np.stack(spread, 1)


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row, exact: in float64 while every partial sum is below 2**53, else in Python integers."""
    most = left.shape[-1] * (np.abs(left).max(initial=0)) * (np.abs(right).max(initial=0))
    if most < 2**53:
        return np.einsum("ij,ij->i", left, right).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(left, right, strict=True)]
    return np.array(whole, dtype=np.int64)  # raises OverflowError beyond 64 bits


def whole_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """All inner products as float64 of whole numbers; None if they might not be exact."""
    most = left.shape[-1] * np.abs(left).max(initial=0) * np.abs(right).max(initial=0)
    return left @ right.T if most < 2**53 else None


def tile_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """(query position, candidate position, score) of the k best of each query within one tile."""
    stats = [segments(c, n) for n in LEVELS]
    norms = np.sqrt((c**2).sum(1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(q), CHUNK):
        part, ids = q[start : start + CHUNK], q_ids[start : start + CHUNK]
        alive = ids[:, None] != c_ids[None, :]
        length = np.sqrt((part**2).sum(1))
        floor = np.full(len(part), -np.inf)
        for n, (mean, spread) in zip(LEVELS, stats, strict=True):
            my_mean, my_spread = segments(part, n)
            if alive.mean() > DENSE:
                upper = my_mean @ mean.T
                upper += my_spread @ spread.T
                upper += 1e-9 * (1 + length)[:, None] * (1 + norms)[None, :]  # rounding of the bounds
                upper[~alive] = -np.inf
            else:
                left, right = np.nonzero(alive)
                upper = np.full(alive.shape, -np.inf)
                upper[left, right] = (
                    np.einsum("ij,ij->i", my_mean[left], mean[right]) + np.einsum("ij,ij->i", my_spread[left], spread[right])
                    + 1e-9 * (1 + length)[left] * (1 + norms)[right]
                )
            floor = np.maximum(floor, kth_of_first(part, c, upper, k))
            alive &= upper >= floor[:, None]
        out.append(best_alive(part, c, c_ids, alive, k, start))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def kth_of_first(part: np.ndarray, c: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
    """The least exact score of the k rows with the highest bounds, of each query; -inf where there are fewer."""
    if upper.shape[1] < k:
        return np.full(len(part), -np.inf)
    first = np.argpartition(upper, -k, axis=1)[:, -k:]
    rows = np.repeat(np.arange(len(part)), k)
    scores = exact(part[rows], c[first.ravel()]).astype(np.float64).reshape(len(part), k)
    scores[np.take_along_axis(upper, first, 1) == -np.inf] = -np.inf
    return scores.min(axis=1)


def best_alive(part: np.ndarray, c: np.ndarray, c_ids: np.ndarray, alive: np.ndarray, k: int, start: int):
    """The k best of the pairs that are left, ties by id."""
    whole = whole_scores(part, c) if alive.mean() > DENSE else None
    if whole is not None:
        whole[~alive] = -np.inf
        if whole.shape[1] > k:
            alive = alive & (whole >= np.partition(whole, -k, axis=1)[:, -k, None])
        left, right = np.nonzero(alive)
        score = whole[left, right].astype(np.int64)
    else:
        left, right = np.nonzero(alive)
        score = np.concatenate(
            [exact(part[left[i : i + 65536]], c[right[i : i + 65536]]) for i in range(0, len(left), 65536)] or [np.empty(0, np.int64)]
        )
    order = np.lexsort((c_ids[right], -score, left))
    left, right, score = left[order], right[order], score[order]
    keep = np.arange(len(left)) - np.searchsorted(left, left) < k
    return left[keep] + start, right[keep], score[keep]


def top_k(
    queries: DataFrame, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
    scale: int = 256, tile_queries: int = 2048, slice_rows: int = 8192, least_slices: int = 48,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows.

    ``tile_queries`` and ``slice_rows`` bound what one task holds; ``least_slices`` only spreads small tables.
    """

    def clean(df: DataFrame) -> DataFrame:
        vector = F.col(vec_col).cast("array<double>")
        kept = df.where(F.col(id_col).isNotNull() & usable(vector))
        return kept.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("v"), F.size(vector).alias("dim"))

    found, asked = clean(rows), clean(queries)
    n_rows, n_queries = found.count(), asked.count()
    slices = max(least_slices, math.ceil(n_rows / slice_rows))
    tiles = max(1, math.ceil(n_queries / tile_queries))

    def spread(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        dealt = F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
        return df.select("*", dealt.alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    left = spread(asked, "tile", tiles, "slice", slices).withColumn("uid", F.xxhash64("id", "v"))
    right = spread(found, "slice", slices, "tile", tiles)

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        names = ["query_id", "uid", "vec_id", "score"]
        if not len(q) or not len(c):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        q_ids, c_ids = q["id"].to_numpy(), c["id"].to_numpy()
        a, b, score = tile_top(q_ids, matrix(q["v"], scale), c_ids, matrix(c["v"], scale), k)
        return pa.table(dict(zip(names, [q_ids[a], q["uid"].to_numpy()[a], c_ids[b], score], strict=True)))

    keys = ["tile", "slice", "dim"]
    near = left.dropDuplicates(["id", "uid", "slice"]).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        best, "query_id bigint, uid bigint, vec_id bigint, score bigint"
    )
    order = W.partitionBy("query_id", "uid").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
