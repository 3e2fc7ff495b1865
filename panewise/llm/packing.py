"""Packing documents into windows by deficit round-robin over source queues.

Every source is a queue of its documents, one after the other. In each window, each queue
earns its share of the tokens and sends as many whole tokens as its deficit covers; what is
left is carried on to the next window, so that a queue is never more than one token from
its share. How much a queue has sent by the end of a window follows from the number of the
window alone, in exact integers. So the deficits carry across windows and partitions without
any task seeing a whole queue, and a document, whose place in its queue is a running sum,
is cut where the shares of windows end. When a queue is used up, the others share its part.
No window but the last is padded.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panewise.llm.tables import staged
from panewise.llm.tokens import encoder, packed, unpacked

#: Documents of a queue that one range of keys holds on average.
RANGE_ROWS = 1_000
#: Documents encoded or cut before their rows go back to Spark.
ROWS_AT_ONCE = 512
#: Bits of a digit in exact divisions: totals and windows must lie below 2**45.
DIGIT = 17
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass
class Phase:
    """Windows in a row in which the same queues send in the same proportions.

    ``before[q]`` tokens of queue q were sent earlier. In a phase of proportions ``upto[q]``
    holds the weights of the queues up to q, those used up counting 0; in a single window
    with ``amounts`` each queue sends so many tokens. Every queue but the last one that sends
    must earn a token or more in each window, or rounding could take one back.
    """

    first: int
    count: int
    before: list[int]
    upto: list[int]
    amounts: list[int] | None = None


def plan(sizes: list[int], weights: list[int], window: int) -> list[Phase]:
    """The phases in which queues of these sizes are sent, in exact integers.

    Proportions hold as long as no queue runs out. The window in which one does takes all of
    it and fills up from the others by their weights. Queues of weight 0 come last, in the
    proportions of their sizes. There are at most two phases for each queue.
    """
    left, sent, phases, at = list(sizes), [0] * len(sizes), [], 0
    while sum(left):
        rates = [w if n else 0 for w, n in zip(weights, left)]
        if not sum(rates):
            rates = list(left)
        total, upto, run = sum(rates), [], 0
        for r in rates:
            run += r
            upto.append(run)
        count = min(n * total // (window * r) for n, r in zip(left, rates) if r)
        while count:  # rounding may ask for one token more than a queue has
            marks = [count * window * u // total for u in upto]
            amounts = [b - a for a, b in zip([0, *marks], marks)]
            if all(x <= n for x, n in zip(amounts, left)):
                break
            count -= 1
        if count:
            phases.append(Phase(at, count, list(sent), upto))
        else:
            amounts, count = last_window(left, rates, window), 1
            phases.append(Phase(at, 1, list(sent), upto, amounts))
        left = [n - x for n, x in zip(left, amounts)]
        sent = [s + x for s, x in zip(sent, amounts)]
        at += count
    return phases


def last_window(left: list[int], rates: list[int], window: int) -> list[int]:
    """What each queue sends in a window in which some run out: shares, or all that is left."""
    amounts, room, open_queues = [0] * len(left), min(window, sum(left)), [i for i, r in enumerate(rates) if r]
    while room and open_queues:
        total = sum(rates[i] for i in open_queues)
        short = [i for i in open_queues if left[i] * total <= room * rates[i]]
        for i in short or open_queues:
            amounts[i] = left[i] if short else room * rates[i] // total
        if not short:
            for i in sorted(open_queues, key=lambda i: (-(room * rates[i] % total), i))[: room - sum(amounts[j] for j in open_queues)]:
                amounts[i] += 1
            return amounts
        room -= sum(left[i] for i in short)
        open_queues = [i for i in open_queues if i not in short]
    for i in range(len(left)):  # queues of weight 0 fill what is left of the window
        if room and not rates[i]:
            amounts[i] = min(room, left[i])
            room -= amounts[i]
    return amounts


def scaled(k: np.ndarray, a: int, b: int) -> np.ndarray:
    """floor(k * a / b) in exact integers, for k and b below 2**45."""
    whole, a = divmod(a, b)
    out, rest, mask = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), (1 << DIGIT) - 1
    for shift in range(2 * DIGIT, -1, -DIGIT):
        value = (rest << DIGIT) + ((k >> shift) & mask) * a
        out = (out << DIGIT) + value // b
        rest = value % b
    return out + whole * k


class Cutter:
    """Where the tokens of one queue lie, by their places in it."""

    def __init__(self, phases: list[Phase], queue: int, window: int):
        self.phases, self.queue, self.window = phases, queue, window
        self.starts = np.array([p.before[queue] for p in phases], np.int64)

    def marks(self, phase: Phase, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that the queues before this one, and those up to it, send in j windows."""
        q, total = self.queue, phase.upto[-1]
        before = scaled(j, self.window * phase.upto[q - 1], total) if q else np.zeros(len(j), np.int64)
        return before, scaled(j, self.window * phase.upto[q], total)

    def sent(self, phase: Phase, j: np.ndarray) -> np.ndarray:
        low, high = self.marks(phase, j)
        return high - low

    def window_of(self, phase: Phase, x: np.ndarray) -> np.ndarray:
        """The window of the phase that holds token x of those the queue sends in it."""
        rate = phase.upto[self.queue] - (phase.upto[self.queue - 1] if self.queue else 0)
        j = np.minimum(phase.count - 1, (x * (phase.upto[-1] / (self.window * rate))).astype(np.int64))
        while True:
            late, early = self.sent(phase, j) > x, self.sent(phase, j + 1) <= x
            if not (late | early).any():
                return j
            j = j - late + early

    def cut(self, begin: np.ndarray, end: np.ndarray):
        """Pieces of the runs [begin, end): (run, place in the queue, length, window, offset)."""
        out = []
        for i, phase in enumerate(self.phases):
            low = self.starts[i]
            high = self.starts[i + 1] if i + 1 < len(self.phases) else np.iinfo(np.int64).max
            some = np.flatnonzero((begin < high) & (end > low))
            if not len(some) or high == low:
                continue
            a, z = np.maximum(begin[some], low) - low, np.minimum(end[some], high) - low
            if phase.amounts is not None:
                first, n = np.zeros(len(some), np.int64), np.ones(len(some), np.int64)
            else:
                first = self.window_of(phase, a)
                n = self.window_of(phase, z - 1) - first + 1
            run = np.repeat(np.arange(len(some)), n)
            j = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            if phase.amounts is not None:
                base, from_, upto = np.full(len(run), sum(phase.amounts[: self.queue])), 0, phase.amounts[self.queue]
            else:
                (before, through), (before_next, through_next) = self.marks(phase, j), self.marks(phase, j + 1)
                base, from_, upto = before_next - before, through - before, through_next - before_next
            at, stop = np.maximum(a[run], from_), np.minimum(z[run], upto)
            keep = stop > at
            offset = base + at - from_
            out.append([c[keep] for c in (some[run], at + low, stop - at, phase.first + j, offset)])
        return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``ROWS_AT_ONCE``."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, columns: tuple[str, str, str]) -> DataFrame:
    """uid, doc_id, source, n_tokens, ids of every row, written once."""
    doc_id, text, source = (F.col(f"`{c}`") for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in small(batches):
            rows = [np.append(ids, np.uint32(end_id)) for ids in encode.batch(batch["text"].to_pylist())]
            yield pa.record_batch(
                [
                    batch["doc_id"],
                    batch["source"],
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([packed(r) for r in rows], pa.binary()),
                ],
                names=["doc_id", "source", "n_tokens", "ids"],
            )

    rows = docs.select(
        doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text"), source.cast("string").alias("source")
    ).mapInArrow(run, "doc_id long, source string, n_tokens long, ids binary")
    return staged(rows.withColumn("uid", F.monotonically_increasing_id()), "tokens")


def source_name(column: str = "source") -> Column:
    """A source as text; null is none of them."""
    return F.when(F.col(column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column))


def queues_of(
    meta: DataFrame, window: int, weights: Mapping[str | None, float] | None
) -> tuple[dict[str, int], list[int], list[int]]:
    """Numbers of the sources that have a queue of their own, and sizes and weights of queues.

    The last but one queue is that of all sources with less than a token of a window, the last
    that of the sources of weight 0. So there are at most ``window`` and two queues, however
    many sources there are.
    """
    totals = meta.groupBy(source_name().alias("name")).agg(F.sum("n_tokens").alias("size"))
    weight, given = F.col("size"), {}
    if weights is not None:
        if any(not 0 <= w < float("inf") for w in weights.values()):
            raise ValueError("weights are numbers from 0")
        unit = max([1.0, *weights.values()]) / (1 << 20)
        given = {"" if k is None else f"={k}": max(1, round(v / unit)) if v else 0 for k, v in weights.items()}
        pairs = [F.lit(x) for item in given.items() for x in item]
        listed = F.try_element_at(F.create_map(*pairs), F.col("name")) if pairs else F.lit(None)
        weight = F.coalesce(listed, F.lit(max(1, round(1 / unit)))).cast("long")
    totals = staged(totals.withColumn("weight", weight.cast("long")), "packing")
    unwanted = F.sum(F.when(F.col("weight") == 0, F.col("size")).otherwise(0))
    every = totals.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), unwanted.alias("unwanted")).first()
    if every["size"] is None:
        return {}, [], []
    # at most ``window`` of them, since each has a token of every window
    own = (F.col("weight") > 0) & (F.col("weight") * window >= every["weight"])
    large = totals.where(own).orderBy("name").collect()
    numbers = {r["name"]: i for i, r in enumerate(large)}
    sizes, shares = [r["size"] for r in large], [r["weight"] for r in large]
    sizes += [every["size"] - sum(sizes) - every["unwanted"], every["unwanted"]]
    shares += [every["weight"] - sum(shares), 0]
    numbers.update({name: len(large) + 1 for name, w in given.items() if not w})
    over = max(0, sum(shares).bit_length() - 44)
    return numbers, sizes, [max(1, w >> over) if w else 0 for w in shares]


def schedule(meta: DataFrame, numbers: dict[str, int], others: int) -> DataFrame:
    """uid, queue and the tokens of its queue before each document, from uid, source, n_tokens."""
    spans = max(1, -(-meta.count() // RANGE_ROWS))
    key = F.xxhash64("uid")
    pairs = [F.lit(x) for item in numbers.items() for x in item]
    listed = F.try_element_at(F.create_map(*pairs), source_name()) if pairs else F.lit(None)
    queue = F.coalesce(listed, F.lit(others)).cast("int")
    rows = meta.select(
        "uid", "n_tokens", key.alias("key"), queue.alias("queue"), F.pmod(key, F.lit(spans)).alias("span")
    )
    sums = staged(rows.groupBy("queue", "span").agg(F.sum("n_tokens").alias("n")), "packing")
    running = Window.partitionBy("queue").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("queue", "span", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("queue", "span").orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("begin") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.join(begins, ["queue", "span"]).select("uid", "queue", before.alias("before"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = 1024,
    weights: Mapping[str | None, float] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and ``end_id``; ``ids`` are little-endian
    unsigned 32 bits. Every id lies in exactly one piece, the pieces of a sequence leave no
    gap, and only the last sequence can be shorter than ``window``.

    ``weights`` are the target proportions of the sources, 1 where not given. In every window
    each source is within one token of its target, the deficit it carries, as long as its
    documents last; then the others share its part. Sources of weight 0 come when all others
    are used up; a negative weight is an error. Without weights the targets are the sources'
    own shares of all tokens, so that every window mirrors the input to its end. Sources with
    a target of less than one token of a window take turns by chance within one queue.

    Null and empty texts have the end id alone; a null source is a source; rows with equal or
    null ids are documents of their own. An empty table gives no rows.
    """
    tokens = tokenized(docs, tokenizer, end_id, (id_column, text_column, source_column))
    meta = tokens.select("uid", "source", "n_tokens")
    numbers, sizes, shares = queues_of(meta, window, weights)
    phases = plan(sizes, shares, window)
    placed = tokens.select("uid", "doc_id", "ids").join(schedule(meta, numbers, len(sizes) - 2), "uid")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutters = [Cutter(phases, q, window) for q in range(len(sizes))]
        for batch in small(batches):
            texts = [unpacked(data) for data in batch["ids"].to_pylist()]
            lengths = np.array([len(t) for t in texts], np.int64)
            begin, queue = batch["before"].to_numpy(), batch["queue"].to_numpy()
            found = []
            for q in np.unique(queue):
                of = np.flatnonzero(queue == q)
                run_, *rest = cutters[q].cut(begin[of], begin[of] + lengths[of])
                found.append([of[run_], *rest])
            doc, place, length, sequence, offset = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((place, doc))
            doc, place, length, sequence, offset = (c[order] for c in (doc, place, length, sequence, offset))
            # in this order the pieces are the documents' ids, one after the other
            ends = np.r_[0, 4 * np.cumsum(length)].astype(np.int32)
            buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(texts))]
            ids = pa.Array.from_buffers(pa.binary(), len(length), buffers)
            start = place - begin[doc]
            columns = [batch["doc_id"].take(pa.array(doc)), start, length, ids, lengths[doc], sequence, offset]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.record_batch(arrays, names=names)

    return placed.select("doc_id", "ids", "queue", "before").mapInArrow(run, PIECE)
