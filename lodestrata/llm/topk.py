"""Exact top-k search by inner product with vector-approximation files.

Vectors are taken as integers, ``floor(scale * x)``.  A vector's approximation
is the cell that it lies in on each axis (``CELLS`` equal cells between the
block's least and greatest component).  For a query, the inner product with a
cell's centre, plus and minus the query's absolute components times half the
cell's width, bounds the exact score.  A search of a block of candidates scans
the approximations only, then reads exact vectors in the order of their upper
bounds until the k-th best exact score found is above every bound not read:
the result is then certain.

Blocks of candidates meet blocks of queries in tasks of bounded size; each
returns its own k best of every query, and the last step keeps the k best of
those.  No vector is broadcast.

Defined results: a vector that is null or empty, or that holds a null or
non-finite component, takes no part; vectors are compared with those of equal
length only; a null vec_id takes no part; rows of the query's own vec_id are
never its results (so repeated rows aren't); ties go to the smaller vec_id,
and a repeated candidate row is a result of its own; an empty table gives an
empty result.  Scores beyond 64 bits aren't defined: components times ``scale``
must stay below 2^63 over the square root of a vector's length, as products and
their sums are 64-bit integers.  Only vec_id and embedding are read, whatever other columns are
named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE, K = 64, 20
#: Cells on each axis, and rows of a block of candidates and of queries.
CELLS = 16
#: Rows whose cells are scanned at a time.
SCANNED = 1_024
BLOCK_ROWS, QUERY_ROWS = 8_192, 1_024


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """(dim, block, ids, data): rows dealt to n blocks by their ids, as arrays of integers."""
    salt = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(n)).cast("int")
    return rows.select("vec_id", "v", F.size("v").alias("dim"), salt.alias("block"))


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that take part; v is an array of longs."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    some = vectors.select("vec_id", x.alias("x"), whole.alias("whole")).filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.col("whole"))
    return some.select("vec_id", F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v"))


class Approximation:
    """Cells of a block of integer vectors: one byte an axis, which is all that a scan reads."""

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors
        self.low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.width = np.maximum((high - self.low + 1) / CELLS, 1e-9)
        self.cells = np.minimum((vectors - self.low) / self.width, CELLS - 1).astype(np.uint8)

    def scan(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of the cells' centres, how far the exact score may be from them)."""
        q = queries.astype(np.float64)
        steps = (q * self.width).astype(np.float32)  # what a cell further on an axis adds
        first = q @ (self.low + self.width / 2)
        middle = np.empty((len(q), len(self.cells)), np.float32)
        for at in range(0, len(self.cells), SCANNED):
            middle[:, at : at + SCANNED] = steps @ self.cells[at : at + SCANNED].astype(np.float32).T
        middle += first.astype(np.float32)[:, None]
        size = np.abs(first) + np.abs(q) @ (self.width * CELLS)
        return middle, np.abs(q) @ (self.width / 2) + 2e-5 * size + 1  # with the rounding of the scan

    def top(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores) of the k best rows whose id isn't the query's own."""
        middle, slack = self.scan(queries)
        middle[own[:, None] == ids[None, :]] = -np.inf
        n = middle.shape[1]
        for i in range(len(queries)):
            if n > 4 * k:  # rows that can still be among the best k
                kth = np.partition(middle[i], n - k)[n - k]
                maybe = np.flatnonzero(middle[i] >= kth - np.float32(2 * slack[i] * 1.0001)) if np.isfinite(kth) else np.arange(n)
            else:
                maybe = np.arange(n)
            maybe = maybe[np.isfinite(middle[i][maybe])]
            maybe = maybe[np.argsort(-middle[i][maybe], kind="stable")]
            rows, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * k
            while at < len(maybe):  # exact vectors, best bound first
                if len(scores) >= k and middle[i][maybe[at]] + slack[i] < scores[k - 1]:
                    break
                part = maybe[at : at + step]
                rows = np.concatenate([rows, part])
                scores = np.concatenate([scores, self.exact[part] @ queries[i]])
                best = np.lexsort((ids[rows], -scores))[:k]
                rows, scores, at = rows[best], scores[best], at + step
            if len(rows):
                yield i, rows, scores


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each row of ``is_query``."""
    rows = integers(vectors, scale)
    n_rows = rows.count()
    n_blocks = max(1, -(-n_rows // BLOCK_ROWS))
    n_query_blocks = max(1, -(-rows.filter(is_query).count() // QUERY_ROWS))
    queries = _blocks(rows.filter(is_query).distinct(), n_query_blocks)
    cells = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    left = queries.select("dim", "block", "vec_id", "v").select("dim", F.col("block").alias("q"), cells.alias("c"), F.lit(True).alias("is_query"), "vec_id", "v")
    cells = F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))
    right = _blocks(rows, n_blocks).select("dim", "block", "vec_id", "v").select("dim", cells.alias("q"), F.col("block").alias("c"), F.lit(False).alias("is_query"), "vec_id", "v")
    both = left.unionByName(right)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
        for b in batches:
            flag = b.column("is_query").to_numpy(zero_copy_only=False)
            ids = b.column("vec_id").to_numpy()
            values = b.column("v").flatten().to_numpy().reshape(len(ids), -1)
            for side in sides:
                sides[side].append((ids[flag == side], values[flag == side]))
        (own, asked), (ids, there) = (tuple(np.concatenate(x) for x in zip(*sides[side], strict=True)) for side in (True, False))
        if not len(own) or not len(ids):
            return
        file = Approximation(there)
        order = np.argsort(own, kind="stable")
        own, asked = own[order], asked[order]
        for at in range(0, len(own), 256):
            found = list(file.top(asked[at : at + 256], own[at : at + 256], ids, k))
            if found:
                size = [len(r) for _, r, _ in found]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat(own[[at + i for i, _, _ in found]], size)),
                    "vec_id": pa.array(ids[np.concatenate([r for _, r, _ in found])]),
                    "score": pa.array(np.concatenate([s for _, _, s in found])),
                })

    near = both.groupBy("dim", "q", "c").applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = K, scale: int = SCALE, every: int = 20) -> str:
    """DuckDB's SQL for it, over ``embeddings``."""
    return f"""
with e as (select vec_id, list_transform(embedding, lambda c: cast(floor({scale} * cast(c as double)) as bigint)) v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) score
  from (select distinct * from e where vec_id % {every} = 0) q join e c on len(q.v) = len(c.v) and q.vec_id <> c.vec_id)
select query_id, cast(rank as integer) rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= {k}
"""
