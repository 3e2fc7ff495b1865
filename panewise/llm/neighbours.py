"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Rows and queries are quantised to 8 bits with a scale of their own. The product of two
quantised blocks gives every inner product of a tile up to a bound that follows from the
scales. Pairs whose upper bound lies below the k-th best lower bound of their query go;
the others are computed again in double precision and merged by heaps. Nothing near is
lost, so recall is 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panewise.llm.tiles import best_hits, search_tiles, usable_vectors

#: Queries of one product, and pairs computed again at once: both bound a task's memory.
QUERIES_AT_ONCE, PAIRS_AT_ONCE = 128, 32768


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 rows and their scales."""
    scale = np.abs(m).max(axis=1) / 127
    return np.rint(m / scale[:, None]).astype(np.int8), scale


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed in the order of components."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * x[:, j]
    return total


def search(ids, x, query_ids, q, k: int) -> Iterator[tuple]:
    x8, x_scale = quantised(x)
    x_tile, x_sum = x8.T.astype(np.float32), np.abs(x).sum(axis=1)
    for at in range(0, len(q), QUERIES_AT_ONCE):
        part, part_ids = q[at : at + QUERIES_AT_ONCE], query_ids[at : at + QUERIES_AT_ONCE]
        p8, p_scale = quantised(part)
        # sums of products of int8 are exact in float32 up to 1,040 components, in float64 beyond
        kind = np.float32 if x.shape[1] <= 1000 else np.float64
        near = (p8.astype(kind) @ x_tile.astype(kind)).astype(np.float64) * p_scale[:, None] * x_scale
        p_sum = np.abs(part).sum(axis=1)
        error = p_sum[:, None] * x_scale / 2 + p_scale[:, None] / 2 * (x_sum + x.shape[1] * x_scale / 2)
        error += 1e-9 * p_sum[:, None] * x_sum  # rounding
        own = part_ids[:, None] == ids
        lower = np.where(own, -np.inf, near - error)
        bar = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.full(len(part), -np.inf)
        pair_query, pair_row = np.nonzero(~own & (near + error >= bar[:, None]))
        scores = np.concatenate(
            [np.zeros(0)]
            + [
                exact(part[pair_query[i : i + PAIRS_AT_ONCE]], x[pair_row[i : i + PAIRS_AT_ONCE]])
                for i in range(0, len(pair_row), PAIRS_AT_ONCE)
            ]
        )
        ends = np.searchsorted(pair_query, np.arange(len(part) + 1))
        for i, query_id in enumerate(part_ids):
            found = ids[pair_row[ends[i] : ends[i + 1]]]
            own_scores = scores[ends[i] : ends[i + 1]]
            best = best_hits(found, own_scores, k)
            yield query_id, found[best], own_scores[best]


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block_rows: int = 8192,
    batch_rows: int = 4096,
) -> DataFrame:
    """The ``k`` nearest rows of each query by inner product: query_id, rank, vec_id, score.

    Ties go to the smaller id; a query's own id is no candidate; a query with fewer
    candidates returns them all. Null ids, vectors that are null, empty, zero or hold null
    or non-finite components take no part; repeated ids count once, with the smallest
    vector; of vectors of unequal length the common components count. Empty tables give no
    rows.
    """
    rows = usable_vectors(df, id_column, vector_column, zero=False)
    asked = usable_vectors(queries, id_column, vector_column, zero=False)

    def tile(ids, x, query_ids, q):
        return search(ids, x, query_ids, q, k)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, row, score in zip(*(c.to_pylist() for c in batch.columns)):
                heap, item = heaps.setdefault(query, []), (score, -row)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        out = [
            (query, rank, -row, score)
            for query, heap in heaps.items()
            for rank, (score, row) in enumerate(sorted(heap, reverse=True), 1)
        ]
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))],
            names=["query_id", "rank", "vec_id", "score"],
        )

    hits = search_tiles(rows, asked, tile, "double", block_rows, batch_rows)
    schema = "query_id long, rank int, vec_id long, score double"
    return hits.repartition(F.col("query_id")).mapInArrow(merge, schema)
