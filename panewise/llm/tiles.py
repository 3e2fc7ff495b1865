"""Queries against all rows in blocks: one tile for each block of rows and batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panewise.llm.tables import is_finite_vector

HITS = "query_id long, vec_id long, score {}"


def usable_vectors(df: DataFrame, id_column: str, vector_column: str, zero: bool) -> DataFrame:
    """``vec_id`` and ``vector`` (array of double) of the rows that take part.

    Rows without an id and vectors that are null, empty or hold null or non-finite
    components are left out; so are zero vectors unless ``zero``. Rows that repeat an id
    count once, with the smallest of their vectors.
    """
    rows = df.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"),
        F.col(f"`{vector_column}`").cast("array<double>").alias("vector"),
    ).where(F.col("vec_id").isNotNull() & is_finite_vector("vector"))
    if not zero:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors in ascending order of id; shorter vectors are filled up with zeros."""
    ids = table["vec_id"].to_numpy()
    lists = table["vector"].combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ids), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with the columns of the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def best_hits(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search_tiles(
    rows: DataFrame,
    queries: DataFrame,
    search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]],
    score_type: str,
    block_rows: int,
    batch_rows: int,
) -> DataFrame:
    """Hits of every (block, batch) tile: ``query_id``, ``vec_id``, ``score``.

    ``search(ids, rows, query_ids, queries)`` yields (query id, row ids, scores). Every
    row goes once to each batch and every query once to each block, so a task holds one
    block and one batch whatever the size of the tables.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    batches = max(1, -(-queries.count() // batch_rows))
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "vector", spread(blocks).alias("block"), every(batches).alias("batch"))
    right = queries.select("vec_id", "vector", spread(batches).alias("batch"), every(blocks).alias("block"))
    kind = {"long": pa.int64(), "double": pa.float64()}[score_type]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])

    def tile(block: pa.Table, batch: pa.Table) -> pa.Table:
        if not block.num_rows or not batch.num_rows:
            return schema.empty_table()
        (ids, x), (query_ids, q) = matrix(block), matrix(batch)
        x, q = same_width(x, q)
        out = [(np.full(len(found), query), found, scores) for query, found, scores in search(ids, x, query_ids, q)]
        if not out:
            return schema.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema)

    keys = ("block", "batch")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, HITS.format(score_type))
