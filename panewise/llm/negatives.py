"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

Rows meet anchors in tiles, one block of rows by one batch of anchors. Within a tile the
dimensions are put in one order, the heaviest first, and a row is indexed only up to the
dimension from which its remaining norm times the longest anchor's norm cannot reach the
threshold. Rows are sorted by how many dimensions they index, so the list of a dimension
is the front of the block. Partial scores are added list by list, and pairs whose partial
score plus the product of the remaining norms stays below the threshold go. What an anchor
still lacks is sought again with a lower threshold, down to the end of its window; the
last threshold leaves nothing out, so results are exact for every choice of parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panewise.llm.tables import is_finite_vector, staged
from panewise.llm.tiles import best_hits, matrix, same_width

#: Dimensions whose lists are added before pairs are pruned.
LISTS_AT_ONCE = 8
#: Thresholds tried on the way from the top of a window to its end.
STEPS = 4
#: Anchors sought at once: with the rows of a block this bounds a task's memory.
ANCHORS_AT_ONCE = 128
#: Share of the product of two norms that covers rounding in bounds.
SLACK = 1e-9


def suffix_norms(m: np.ndarray) -> np.ndarray:
    """out[i, d]: norm of row i without its first d dimensions."""
    squares = np.square(m)[:, ::-1].cumsum(axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(m), 1))], axis=1))


class Block:
    """Integer rows of one tile; an index is built for each threshold."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.whole = ids, labels, rows
        self.order = np.argsort(-np.square(rows.astype(np.float64)).sum(axis=0), kind="stable")
        self.rows = rows[:, self.order].astype(np.float64)
        self.rest = suffix_norms(self.rows)

    def depths(self, reach: float, longest: float) -> np.ndarray:
        """How many dimensions of each row are indexed: from there on the row cannot reach
        ``reach`` with an anchor of norm ``longest`` by what is left of it."""
        return (self.rest[:, :-1] * longest * (1 + SLACK) >= reach).sum(axis=1)

    def at_least(self, anchor_ids, anchor_labels, anchors, reach, same: bool):
        """(anchor, row, score) of the pairs of other ids, with equal labels or with
        different ones, that score at least the anchor's ``reach``."""
        q = anchors[:, self.order].astype(np.float64)
        q_rest = suffix_norms(q)
        depth = self.depths(float(reach.min()), float(q_rest[:, 0].max()))
        front = np.argsort(-depth, kind="stable")[: int((depth > 0).sum())]
        left_at = np.minimum(depth[front], LISTS_AT_ONCE)
        partial = np.zeros((len(q), len(front)))
        for d in range(min(LISTS_AT_ONCE, self.rows.shape[1])):
            listed = int((depth > d).sum())
            partial[:, :listed] += q[:, d, None] * self.rows[front[:listed], d]
        partial += q_rest[:, left_at] * self.rest[front, left_at]
        partial += SLACK * q_rest[:, :1] * self.rest[front, 0]
        possible = partial >= reach[:, None]
        possible &= (anchor_labels[:, None] == self.labels[front]) == same
        possible &= anchor_ids[:, None] != self.ids[front]
        a, r = np.nonzero(possible)
        del partial, possible
        r, at = front[r], LISTS_AT_ONCE
        sums = np.einsum("pd,pd->p", q[a, :at], self.rows[r, :at])
        while at < self.rows.shape[1]:  # the dimensions that follow, for pairs that still can
            upto = min(at + LISTS_AT_ONCE, self.rows.shape[1])
            sums = sums + np.einsum("pd,pd->p", q[a, at:upto], self.rows[r, at:upto])
            at = upto
            bound = sums + q_rest[a, at] * self.rest[r, at] + SLACK * q_rest[a, 0] * self.rest[r, 0]
            near = bound >= reach[a]
            a, r, sums = a[near], r[near], sums[near]
        scores = np.einsum("pd,pd->p", anchors[a], self.whole[r])
        good = scores >= reach[a]
        return a[good], r[good], scores[good]


def best_of_label(block: Block, anchor_ids, anchor_labels, anchors, k: int) -> Iterator[tuple]:
    """(anchor id, row ids, scores) of each anchor's ``k`` highest rows of its label."""
    norms = np.sqrt(np.square(anchors.astype(np.float64)).sum(axis=1))
    top = norms * block.rest[:, 0].max()
    left = np.arange(len(anchors))
    for step in range(1, STEPS + 2):
        reach = np.ceil(top * (1 - step / STEPS)) if step <= STEPS else np.full(len(top), -np.inf)
        a, r, scores = block.at_least(
            anchor_ids[left], anchor_labels[left], anchors[left], reach[left], same=True
        )
        ends, open_anchors = np.searchsorted(a, np.arange(len(left) + 1)), []
        for i, anchor in enumerate(left):
            rows, own = r[ends[i] : ends[i + 1]], scores[ends[i] : ends[i + 1]]
            if len(rows) < k and step <= STEPS:
                open_anchors.append(anchor)
                continue
            best = best_hits(block.ids[rows], own, k)
            yield anchor_ids[anchor], block.ids[rows[best]], own[best]
        left = np.array(open_anchors, np.int64)
        if not len(left):
            return


def best_in_windows(block: Block, anchor_ids, anchor_labels, anchors, windows, k: int) -> Iterator[tuple]:
    """(anchor, window, row ids, scores): the ``k`` highest rows of other labels in each window.

    ``windows[i]`` holds (lowest, highest) score for each window of anchor i, none empty.
    """
    low = np.array([min(lo for lo, _ in w) for w in windows], np.float64)
    high = np.array([min(hi for _, hi in w) for w in windows], np.float64)
    left = np.arange(len(anchors))
    for step in range(1, STEPS + 1):
        reach = np.ceil(high - (high - low) * step / STEPS) if step < STEPS else low
        a, r, scores = block.at_least(
            anchor_ids[left], anchor_labels[left], anchors[left], reach[left], same=False
        )
        ends, open_anchors = np.searchsorted(a, np.arange(len(left) + 1)), []
        for i, anchor in enumerate(left):
            rows, own = r[ends[i] : ends[i + 1]], scores[ends[i] : ends[i + 1]]
            inside = [(own >= lo) & (own <= hi) for lo, hi in windows[anchor]]
            full = [m.sum() >= k or reach[anchor] <= lo for m, (lo, _) in zip(inside, windows[anchor])]
            if not all(full):
                open_anchors.append(anchor)
                continue
            for w, m in enumerate(inside):
                best = best_hits(block.ids[rows[m]], own[m], k)
                yield anchor, w, block.ids[rows[m][best]], own[m][best]
        left = np.array(open_anchors, np.int64)
        if not len(left):
            return


def labelled_vectors(df: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """``vec_id``, ``vector`` and ``label`` of the rows that take part, one for each id."""
    rows = df.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"),
        F.col(f"`{vector_column}`").cast("array<double>").alias("vector"),
        F.col(f"`{label_column}`").cast("long").alias("label"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite_vector("vector"))
    least = F.min(F.struct("vector", "label")).alias("least")
    return rows.groupBy("vec_id").agg(least).select("vec_id", "least.*")


def integer_rows(table: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and integer vectors in ascending order of id."""
    ids, vectors = matrix(table)
    order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
    return ids, table["label"].to_numpy()[order], np.floor(scale * vectors).astype(np.int64)


def parts_of(n: int) -> list[slice]:
    return [slice(i, i + ANCHORS_AT_ONCE) for i in range(0, n, ANCHORS_AT_ONCE)]


def mine(
    df: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    block_rows: int = 8192,
    batch_rows: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A component x counts as floor(``scale`` * x) and a score is the integer inner product
    with the anchor; higher scores come first, ties by smaller id. An anchor's positives are
    its first ``positives`` other rows of its label. For each of them the first ``negatives``
    rows of other labels are returned whose score lies between ``low_percent`` and
    ``high_percent`` of the positive's; all, if fewer, and none for a positive below zero.

    ``anchors`` are rows like those of ``df``. Rows without an id or label and vectors that
    are null, empty or hold null or non-finite components take no part; repeated ids count
    once, with the smallest vector and label; of vectors of unequal length the common
    components count. Scores must fit 64 bits. Empty tables give no rows.
    """
    columns = (id_column, vector_column, label_column)
    rows = staged(labelled_vectors(df, *columns), "negatives")
    asked = staged(labelled_vectors(anchors, *columns), "negatives")
    blocks = max(1, -(-rows.count() // block_rows))
    batches = max(1, -(-asked.count() // batch_rows))
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = rows.select("vec_id", "vector", "label", spread(blocks).alias("block"), every(batches).alias("batch"))
    sought = asked.select("vec_id", "vector", "label", spread(batches).alias("batch"))
    hit = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    found = pa.schema([*hit, ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def gathered(parts: list[list[np.ndarray]], schema: pa.Schema) -> pa.Table:
        if not parts:
            return schema.empty_table()
        return pa.table([np.concatenate(c).astype(np.int64) for c in zip(*parts)], schema=schema)

    def sides(block: pa.Table, batch: pa.Table):
        ids, labels, x = integer_rows(block, scale)
        anchor_ids, anchor_labels, q = integer_rows(batch, scale)
        x, q = same_width(x, q)
        return Block(ids, labels, x), anchor_ids, anchor_labels, q

    def positive_tile(block: pa.Table, batch: pa.Table) -> pa.Table:
        if not block.num_rows or not batch.num_rows:
            return hit.empty_table()
        index, ids, labels, q = sides(block, batch)
        out = []
        for some in parts_of(len(ids)):
            for anchor, near, scores in best_of_label(index, ids[some], labels[some], q[some], positives):
                out.append([np.full(len(near), anchor), near, scores])
        return gathered(out, hit)

    def negative_tile(block: pa.Table, batch: pa.Table) -> pa.Table:
        if not block.num_rows or not batch.num_rows:
            return found.empty_table()
        index, ids, labels, q = sides(block, batch)
        by_id = {r["vec_id"]: r["positives"] for r in batch.select(["vec_id", "positives"]).to_pylist()}
        mine_of, windows = [], []
        for anchor in ids.tolist():
            spans = [
                (p, -(-low_percent * p["score"] // 100), high_percent * p["score"] // 100) for p in by_id[anchor]
            ]
            spans = [s for s in spans if s[1] <= s[2]]
            mine_of.append([s[0] for s in spans])
            windows.append([s[1:] for s in spans])
        wanted, out = np.flatnonzero([len(w) > 0 for w in windows]), []
        for some in parts_of(len(wanted)):
            part = wanted[some]
            hits = best_in_windows(
                index, ids[part], labels[part], q[part], [windows[i] for i in part], negatives
            )
            for i, w, near, scores in hits:
                positive = mine_of[part[i]][w]
                fixed = [np.full(len(near), v) for v in (ids[part[i]], positive["vec_id"], positive["score"])]
                out.append([*fixed, near, scores])
        return gathered(out, found)

    def ddl(schema: pa.Schema) -> str:
        return ", ".join(f"{name} long" for name in schema.names)

    # a label's rows meet its anchors only; a hot label still lies in all blocks
    keys = ("label", "block", "batch")
    right = sought.select("*", every(blocks).alias("block"))
    hits = placed.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(positive_tile, ddl(hit))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    pairs = F.collect_list(F.struct(F.col("positive_id").alias("vec_id"), F.col("positive_score").alias("score")))
    pairs = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(pairs.alias("positives"))
    right = staged(sought.join(pairs, "vec_id"), "negatives").select("*", every(blocks).alias("block"))
    keys = ("block", "batch")
    hits = placed.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(negative_tile, ddl(found))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
