"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, then exact products.

Vectors are dealt into blocks. Every block of queries meets every block of candidates once, in a tile of its own; the
tiles are even, however the vectors lie, so no key is hot. In a tile each vector is quantised to int8 codes with a
scale of its own. The product of two code matrices gives every inner product up to a proven error:

    |<x, y> - sx sy <cx, cy>|  <=  |ex| |y| + |xq| |ey|        with x = xq + ex, xq = sx cx, y = yq + ey

A pair whose upper bound is below ``k`` lower bounds, or below the k-th exact score so far, cannot be among the
nearest. What survives is computed again from the original vectors, in double precision, component after component.
Each tile hands on the ``k`` best of each query, and heaps merge the tiles. So the result is exact, not only near:
no index is fitted, no candidate is left out, and recall is 1.

Cost: the vectors are sent once for each block on the other side, and products grow with queries times candidates,
as a search by blocks must. A task holds one query block and one candidate block, both of bounded size, and works in
chunks of ``CHUNK`` candidates and ``PAIRS`` surviving pairs; many equal vectors survive together and are computed chunk by chunk.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without an
id, take no part. Rows that repeat an id are candidates and queries of their own; a query is not its own candidate,
its repetitions are. Vectors of different lengths do not meet. Ties go to the smaller id. Fewer than ``k`` candidates give
all. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.plans.scratch import stored

NEAREST = 20
QUERY_BLOCK, CANDIDATE_BLOCK = 4_096, 16_384
#: A block is not made smaller than this to keep all cores busy.
LEAST_BLOCK = 512
CHUNK, PAIRS = 2_048, 262_144
#: Sums of products of int8 codes stay whole numbers in float32 up to here.
EXACT_DIMENSIONS = 1_024


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and the norms of the vectors, of what the codes stand for and of the errors."""
    # As values near the smallest double lose their precision in a division, a scale has a floor.
    scales = np.maximum(np.abs(vectors).max(axis=1) / 127.0, 1e-300)
    codes = np.rint(vectors / scales[:, None]).astype(np.int8)
    meant = codes * scales[:, None]
    norm = lambda m: np.linalg.norm(m, axis=1)
    return codes, scales, norm(vectors), norm(meant), norm(vectors - meant)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of two code matrices, exactly: partial sums of few enough terms in float32."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMENSIONS):
        part = slice(at, at + EXACT_DIMENSIONS)
        total += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return total


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, added from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class Best:
    """The ``k`` best candidates of each query of a block: by score, then by smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ids = k, np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def worst(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Pairs in any order."""
        touched = np.unique(query)
        all_query = np.concatenate([query, np.repeat(touched, self.k)])
        all_ids = np.concatenate([ids, self.ids[touched].ravel()])
        all_scores = np.concatenate([scores, self.scores[touched].ravel()])
        order = np.lexsort((all_ids, -all_scores, all_query))
        all_query = all_query[order]
        rank = np.arange(len(order)) - np.searchsorted(all_query, all_query)
        top = order[rank < self.k]
        rows, rank = all_query[rank < self.k], rank[rank < self.k]
        self.scores[rows, rank], self.ids[rows, rank] = all_scores[top], all_ids[top]


def search_tile(queries: tuple, candidates: tuple, k: int) -> Best:
    """(row, id, vector) arrays of both sides to the best of each query."""
    q_row, _, q = queries
    c_row, c_id, c = candidates
    q_codes, q_scale, _, q_meant, q_error = quantise(q)
    best = Best(len(q), k)
    for at in range(0, len(c), CHUNK):
        part = slice(at, at + CHUNK)
        codes, scale, norm, _, error = quantise(c[part])
        near = code_products(q_codes, codes) * q_scale[:, None] * scale[None, :]
        # The slack covers the rounding of all these sums, which is far below the quantisation error.
        bound = q_error[:, None] * norm[None, :] + q_meant[:, None] * error[None, :]
        bound += 1e-12 * (np.abs(near) + bound) + 1e-290
        own = q_row[:, None] == c_row[None, part]
        need = best.worst()
        low = np.where(own, -np.inf, near - bound)
        if low.shape[1] > k:
            need = np.maximum(need, np.partition(low, -k, axis=1)[:, -k])
        i, j = np.nonzero((near + bound >= need[:, None]) & ~own)
        for p in range(0, len(i), PAIRS):
            i_, j_ = i[p : p + PAIRS], j[p : p + PAIRS] + at
            best.add(i_, c_id[j_], exact_products(q[i_], c[j_]))
    return best


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = table.column("vector").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return table.column("row").to_numpy(), table.column("id").to_numpy(), flat.reshape(table.num_rows, -1)


def _tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        queries = _side(left)
        best = search_tile(queries, _side(right), k)
        there = best.scores > -np.inf
        return pa.table({"row": np.repeat(queries[0], there.sum(axis=1)), "query_id": np.repeat(queries[1], there.sum(axis=1)), "vec_id": best.ids[there], "score": best.scores[there]})

    return run


def _merged(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A heap of ``k`` for each query of the partition, the worst on top."""
        heaps: dict[int, list] = {}
        ids: dict[int, int] = {}
        for batch in batches:
            for row, query_id, vec_id, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heap = heaps.setdefault(row, [])
                ids[row] = query_id
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec_id))
                elif (score, -vec_id) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec_id))
        rows = [(ids[row], rank, -negative, score) for row, heap in heaps.items() for rank, (score, negative) in enumerate(sorted(heap, reverse=True), 1)]
        schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def blocks_of(rows: int, most: int, cores: int) -> int:
    """Blocks of at most about ``most`` rows; more of them while there are fewer than two for each core and they are not small."""
    return max(math.ceil(rows / most), min(math.ceil(rows / LEAST_BLOCK), 2 * cores), 1)


def nearest(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product with each query, among all others.

    ``is_query`` chooses the query rows from the id, named ``id``.
    """
    element = vectors.schema[vector_column].dataType.elementType
    vector = F.col(f"`{vector_column}`")
    vector = vector if isinstance(element, (T.FloatType, T.DoubleType)) else vector.cast("array<double>")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), vector.alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.size("vector").alias("dimensions"), "vector", F.coalesce(is_query, F.lit(False)).alias("asks")), "neighbours-vectors")
    n, q = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    across, down = blocks_of(n, CANDIDATE_BLOCK, cores), max(math.ceil(q / QUERY_BLOCK), 1)
    block = lambda count, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = rows.filter("asks").select("row", "id", "dimensions", "vector", block(down, 1).alias("down"), every(across).alias("across"))
    known = rows.select("row", "id", "dimensions", "vector", block(across, 2).alias("across"), every(down).alias("down"))
    key = ["dimensions", "down", "across"]
    tiles = asked.groupBy(*key).cogroup(known.groupBy(*key)).applyInArrow(_tile(k), "row long, query_id long, vec_id long, score double")
    # Queries are dealt to tasks by their rows; a task's heaps hold its queries alone.
    return tiles.repartition("row").mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")


def op13_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS row, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
