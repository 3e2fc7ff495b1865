"""Ranked lexical search over impact vectors in buckets of descending length.

A document is the vector of its impacts, one for each term of the queries, and a query the
vector of its terms' weights. Documents are ordered by the length of their vectors and cut
into buckets. By Cauchy-Schwarz a bucket goes as a whole where the longest vector in it
cannot reach a query's threshold, and so it does where the largest value of each coordinate
cannot. Inside a bucket the heaviest coordinates are added exactly and the others bounded;
survivors are scored in integers. Thresholds come first from a share of the documents and
then from what a task has found, so nothing is lost: every document is ordered, bounded
and, where it can matter, scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panewise.llm.tables import staged

#: The constants of the impact, thousandths and hundredths made whole.
UNIT, TF_SCALE, LENGTH_SCALE, FLAT, SLOPE = 1_000_000_000, 1000, 20, 50, 50
#: Bytes of a term are ASCII letters and digits and all bytes beyond ASCII; A-Z count as a-z.
TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
#: Bytes of text split into words at once.
TEXT_BYTES = 1 << 20
#: Bytes of query text whose terms go to every task at once: the bound of what is broadcast.
QUERY_BYTES = 1 << 20
#: Documents of a bucket at most, and cells (documents times terms) of its dense form.
BUCKET_ROWS, BUCKET_CELLS = 512, 1 << 20
#: Heaviest coordinates of a query that are added before the rest is bounded.
FOCUS = 6
#: One document in so many gives the first thresholds.
SAMPLE = 32


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in stretches of about ``TEXT_BYTES``, cut between terms, with blanks between them."""
    at = 0
    while at < len(text):
        end = min(len(text), at + TEXT_BYTES)
        folded = text[at:end].translate(TERM_BYTES)
        if end < len(text):
            cut = folded.rfind(b" ")
            while cut < 0 and end < len(text):  # a term longer than a stretch
                more = text[end : end + TEXT_BYTES].translate(TERM_BYTES)
                stop = more.find(b" ")
                folded += more if stop < 0 else more[: stop + 1]
                end += len(more) if stop < 0 else stop + 1
                cut = len(folded) - 1 if stop >= 0 else -1
            if cut >= 0:
                end -= len(folded) - cut - 1
                folded = folded[: cut + 1]
        yield folded
        at = end


def term_counts(text: bytes | None, get) -> tuple[int, Counter]:
    """Terms of a text with repeats, and how often each known one occurs (``get`` gives its
    number, or None)."""
    total, counts = 0, Counter()
    for piece in pieces(text or b""):
        words = piece.split()
        total += len(words)
        counts.update(map(get, words))
    counts.pop(None, None)
    return total, counts


def bytes_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


@dataclass
class Queries:
    """Items and their terms: ``weights[i]`` belong to the numbers ``terms[i]``."""

    ids: list
    terms: list[np.ndarray]
    weights: list[np.ndarray]

    def __post_init__(self):
        self.norms = np.array([math.sqrt(float(np.square(w.astype(np.float64)).sum())) for w in self.weights])
        heavy = [np.argsort(-w, kind="stable") for w in self.weights]
        self.terms = [t[o] for t, o in zip(self.terms, heavy)]
        self.weights = [w[o] for w, o in zip(self.weights, heavy)]
        rest = [np.square(w[FOCUS:].astype(np.float64)).sum() for w in self.weights]
        self.rest_norms = np.sqrt(np.array(rest, np.float64))


class Best:
    """The ``k`` best documents of every query among those a task has seen."""

    def __init__(self, queries: Queries, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.scores = [np.zeros(0, np.int64)] * len(queries.ids)
        self.docs = [np.zeros(0, np.int64)] * len(queries.ids)
        self.nulls = [np.zeros(0, bool)] * len(queries.ids)

    def add(self, query: int, scores: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
        scores, docs, nulls = (
            np.concatenate(pair)
            for pair in ((self.scores[query], scores), (self.docs[query], docs), (self.nulls[query], nulls))
        )
        best = np.lexsort((docs, nulls, -scores))[: self.k]
        self.scores[query], self.docs[query], self.nulls[query] = scores[best], docs[best], nulls[best]
        if len(best) == self.k:
            self.least[query] = max(self.least[query], int(scores[best[-1]]))


def search_batch(batch: pa.RecordBatch, queries: Queries, width: int, n_docs: int, n_terms: int, best: Best) -> None:
    """Offer every document of a batch to every query, bucket by bucket."""
    terms, counts = batch["terms"], batch["counts"]
    sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
    flat, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
    n = batch["n"].to_numpy()
    m = 100 - FLAT + (SLOPE * n * n_docs) // max(1, n_terms)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    impact = (UNIT * tf) // (TF_SCALE * tf + LENGTH_SCALE * m[owner])
    squares = np.bincount(owner, weights=np.square(impact.astype(np.float64)), minlength=len(sizes))
    squares = squares * (1 + 1e-12)  # covers rounding
    norms = np.sqrt(squares)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-norms, kind="stable")
    order = order[: int((norms > 0).sum())]
    docs = batch["doc_id"].fill_null(0).to_numpy()
    nulls = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
    rows = max(16, min(BUCKET_ROWS, BUCKET_CELLS // max(1, width)))
    for at in range(0, len(order), rows):
        some = order[at : at + rows]
        alive = np.flatnonzero(queries.norms * norms[some[0]] * (1 + 1e-9) >= best.least)
        if not len(alive):
            return  # the vectors that follow are shorter still
        dense = np.zeros((len(some), width), np.int32)
        lengths = sizes[some]
        row = np.repeat(np.arange(len(some)), lengths)
        cell = np.repeat(starts[some] - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(row))
        dense[row, flat[cell]] = impact[cell]
        most = dense.max(axis=0).astype(np.int64)
        whole = squares[some]
        for query in alive:
            t, w, least = queries.terms[query], queries.weights[query], best.least[query]
            tops = most[t] * w
            if int(tops.sum()) < least:
                continue
            heavy = dense[:, t[:FOCUS]].astype(np.float64)
            left = np.sqrt(np.maximum(whole - np.square(heavy).sum(axis=1), 0)) * queries.rest_norms[query]
            bound = heavy @ w[:FOCUS].astype(np.float64) + np.minimum(left, float(tops[FOCUS:].sum()))
            near = np.flatnonzero(bound * (1 + 1e-9) + 1 >= least)
            if len(near):
                scores = dense[np.ix_(near, t)].astype(np.int64) @ w
                good = scores >= least
                near, scores = some[near[good]], scores[good]
                if len(near):
                    best.add(query, scores, docs[near], nulls[near])


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n and the numbers and counts of the query terms of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            n, sizes, terms, counts = [], [0], [], []
            for text in bytes_of(batch["text"]):
                total, own = term_counts(text, get)
                n.append(total)
                terms.extend(own)
                counts.extend(own.values())
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            yield pa.record_batch(
                [
                    batch["doc_id"],
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def hits_of(rows: DataFrame, queries: Queries, width: int, totals: tuple[int, int], k: int, least: np.ndarray) -> DataFrame:
    """Each task's best documents of every item that reach the item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries, k, least)
        for batch in batches:
            search_batch(batch, queries, width, *totals, best)
        items = np.repeat(np.array(queries.ids, np.int64), [len(s) for s in best.scores])
        docs = pa.array(np.concatenate(best.docs), pa.int64(), mask=np.concatenate(best.nulls))
        columns = [pa.array(items, pa.int64()), docs, pa.array(np.concatenate(best.scores), pa.int64())]
        yield pa.record_batch(columns, names=["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def in_order(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: list[tuple[int, bytes]], k: int) -> DataFrame:
    """The ranking for a group of items: ``docs`` has ``doc_id`` and ``text``."""
    own_terms = [sorted(term_counts(text, lambda word: word)[1]) for _, text in items]
    vocabulary = {term: i for i, term in enumerate(sorted({t for terms in own_terms for t in terms}))}
    rows = staged(counted(docs, vocabulary), "ranking")
    sums = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    # one count for each term of the items
    frequencies = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    holders = np.zeros(len(vocabulary), np.int64)
    for r in frequencies:
        holders[r["term"]] = r["count"]
    weight = [math.floor(1000 * math.log((2 * sums.docs + 2) / (2 * h + 1))) for h in holders.tolist()]
    numbers = [np.array([vocabulary[t] for t in terms], np.int64) for terms in own_terms]
    queries = Queries([i for i, _ in items], numbers, [np.array(weight, np.int64)[t] for t in numbers])
    place = {item: i for i, (item, _) in enumerate(items)}
    least, totals = np.ones(len(items), np.int64), (sums.docs, sums.terms)
    some = rows.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SAMPLE)) == 0)
    start = in_order(hits_of(some, queries, len(vocabulary), totals, k, least), k)
    for r in start.where(F.col("rank") == k).select("item_id", "score").collect():  # one for each item
        least[place[r.item_id]] = r.score
    return in_order(hits_of(rows, queries, len(vocabulary), totals, k, least), k)


def top_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of any characters beyond ASCII, with A-Z
    lower-cased. Null and empty texts have no terms: such documents are not counted and
    never found, such items find nothing. Only scores above 0 count; equal scores go by
    ascending id, null ids last. Each row of ``docs`` is a document, repeated ones too;
    items with a null id are left out and repeated ids count once, with the smallest text.
    Empty tables give no rows.

    Items are taken in groups of about ``QUERY_BYTES`` of text (a single longer item alone);
    the terms of one group go to all tasks, and ``docs`` is read once for each group.
    """
    asked = items.select(
        F.col(f"`{item_column}`").cast("long").alias("item_id"),
        F.col(f"`{item_text_column}`").cast("string").alias("text"),
    )
    asked = asked.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    asked = staged(asked.groupBy("item_id").agg(F.min("text").alias("text")), "ranking")
    texts = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    )
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, found = max(1, -(-size // QUERY_BYTES)), None
    for group in range(groups):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group)
        own = [(r.item_id, r.text.encode()) for r in part.orderBy("item_id").collect()]
        if own:
            hits = search(texts, own, k)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.select("item_id", "rank", "doc_id", "score")
