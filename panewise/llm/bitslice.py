"""Exact top-k inner products over a bit-sliced index.

The rows of a block are kept as bitmaps: one for each bit of each quantised attribute. A
query adds slices with bitmap full adders, 64 rows to a machine word, weighted by the bits
of its own components. From the bitmaps of the sums the top rows are chosen from the most
significant slice downward. Only the upper bits of the attributes are sliced; what the
lower ones can add is bounded, and every row within that bound of the boundary is scored
exactly. The result is exact for every choice of parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panewise.llm.tiles import best_hits, search_tiles, usable_vectors

#: Lower bits of each attribute that are not sliced.
DROPPED_BITS = 2


def pack(rows: np.ndarray) -> np.ndarray:
    """Boolean columns as bitmaps of 64-bit words, filled up with zeros."""
    bits = np.packbits(rows, axis=-1, bitorder="little")
    filled = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, -bits.shape[-1] % 8)])
    return np.ascontiguousarray(filled).view(np.uint64)


def unpack(bitmap: np.ndarray, n: int) -> np.ndarray:
    """Places of the set bits among the first ``n``."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), count=n, bitorder="little"))


class Index:
    """Slices of one block of integer rows."""

    def __init__(self, rows: np.ndarray, dropped: int = DROPPED_BITS):
        self.n = len(rows)
        self.low = rows.min(axis=0)
        raised = rows - self.low
        width = int(raised.max(initial=0)).bit_length()
        self.dropped = min(dropped, max(0, width - 1))
        self.width = max(1, width - self.dropped)
        kept = (raised >> self.dropped).T
        #: slices[bit, attribute] is a bitmap over the rows.
        self.slices = np.stack([pack((kept >> b) & 1 == 1) for b in range(self.width)])
        self.all = pack(np.ones(self.n, bool))

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the weighted sum of the kept bits.

        Attributes of negative weight are taken as their complement, which moves every
        sum by the same amount.
        """
        weight = np.abs(query)
        slices = np.where((query < 0)[None, :, None], ~self.slices, self.slices)
        columns: list[list[np.ndarray]] = []
        for bit in range(int(weight.max(initial=0)).bit_length()):
            used = np.flatnonzero((weight >> bit) & 1)
            for b in range(self.width):
                while len(columns) <= bit + b:
                    columns.append([])
                columns[bit + b].append(slices[b, used])
        out, place = [], 0
        while place < len(columns):
            stack = np.concatenate(columns[place]) if columns[place] else np.zeros((0, len(self.all)), np.uint64)
            while len(stack) > 1:  # full adders turn three bitmaps into a sum and a carry
                if len(stack) == 2:
                    stack = np.concatenate([stack, np.zeros_like(stack[:1])])
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                if place + 1 == len(columns):
                    columns.append([])
                columns[place + 1].append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third :]])
            out.append(stack[0] & self.all if len(stack) else np.zeros_like(self.all))
            place += 1
        return out

    def candidates(self, query: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        """Places of every allowed row that can be among the ``k`` highest."""
        if int(np.bitwise_count(allowed).sum()) <= k:
            return unpack(allowed, self.n)
        slices = self.sums(query)
        sure, open_rows, boundary = np.zeros_like(allowed), allowed, 0
        for place in range(len(slices) - 1, -1, -1):
            above = open_rows & slices[place]
            if int(np.bitwise_count(sure).sum() + np.bitwise_count(above).sum()) >= k:
                open_rows, boundary = above, boundary | 1 << place
            else:
                sure, open_rows = sure | above, open_rows & ~slices[place]
        # the k-th highest sum is the boundary; lower bits can lift a row by so much
        step = 1 << self.dropped
        least = max(0, boundary - (step - 1) * int(np.abs(query).sum()) // step)
        more, equal = np.zeros_like(allowed), allowed
        for place in range(len(slices) - 1, -1, -1):
            if least >> place & 1:
                equal = equal & slices[place]
            else:
                more, equal = more | (equal & slices[place]), equal & ~slices[place]
        return unpack(more | equal, self.n)


def top_k(
    df: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block_rows: int = 16384,
    batch_rows: int = 4096,
) -> DataFrame:
    """``k`` highest integer inner products of each query: query_id, rank, vec_id, score.

    A component x counts as floor(``scale`` * x). Ties go to the smaller id; a query's own
    id is no candidate; a query with fewer candidates returns them all. Null ids, null or
    empty vectors and vectors with null or non-finite components take no part; repeated
    ids count once, with the smallest vector; of vectors of unequal length the common
    components count. Scores must fit 64 bits. Empty tables give no rows.
    """
    rows = usable_vectors(df, id_column, vector_column, zero=True)
    asked = usable_vectors(queries, id_column, vector_column, zero=True)

    def search(ids, x, query_ids, q) -> Iterator[tuple]:
        x, q = (np.floor(scale * m).astype(np.int64) for m in (x, q))
        index = Index(x)
        for query_id, query in zip(query_ids, q):
            found = index.candidates(query, pack(ids != query_id), k)
            scores = x[found] @ query
            best = best_hits(ids[found], scores, k)
            yield query_id, ids[found][best], scores[best]

    hits = search_tiles(rows, asked, search, "long", block_rows, batch_rows)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
