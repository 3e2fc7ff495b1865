"""Chunks of whole documents that exchange sorted keys through buckets.

A chunk is about ``CHUNK_BYTES`` of whole documents, drawn by hash, so that hot sources
and copies spread evenly. In each pass every chunk sends each distinct key at most once:
to the bucket named by the key's upper bits. The bucket meets the keys of all chunks and
answers a few bits for each. A key that a third of all documents share thus costs one
entry per chunk, and a task holds one chunk or one bucket, both of bounded size. Every
step is a function of its chunk and of the answers, so lost tasks run again with the same
result.

A chunk sends ``2 ** FAN_BITS`` rows at most, whatever the size of the table. Where that
many buckets are too few, keys reach them in levels: a relay meets one digit of the keys of
``2 ** FAN_BITS`` chunks, which is as much as one chunk holds, passes each distinct key on
by its next digit, and hands the answers back. Rows grow with the number of chunks times
the number of levels: one level up to 64 GB of text, two up to 64 TB, three beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
#: Most bytes of text per bucket, on average.
BUCKET_BYTES = 64 << 20
#: Bits of a key that name the next relay or bucket.
FAN_BITS = 10
#: Stands for a null id: larger than every other id and not smaller than itself.
NO_ID = np.iinfo(np.int64).max

Answers = dict[int, dict[int, bytes]]


class Chunk:
    """Documents in ascending order of id, one after the other in one buffer."""

    def __init__(self, table: pa.Table, gap: bytes = b""):
        ids = table["doc_id"].combine_chunks()
        given = ids.fill_null(NO_ID).to_numpy()
        order = np.argsort(given, kind="stable")
        texts = table["text"].to_pylist()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)[order]
        self.ids = given[order]
        self.texts = [texts[i] or b"" for i in order]
        self.buffer = gap.join(self.texts)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(lengths + len(gap)) - lengths - len(gap)
        self.ends = self.starts + lengths

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=~self.known)


class Keys:
    """Distinct keys of a chunk, in order, each with its smallest document.

    ``keys`` are columns of one key, the first of which names the bucket. ``places`` must
    be in ascending order of document.
    """

    def __init__(self, keys: Sequence[np.ndarray], docs: np.ndarray):
        order = np.lexsort(tuple(keys[::-1]))
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        self.first = order[new]
        self.columns = [k[self.first] for k in keys]
        self.docs = docs[self.first]
        #: Place among the distinct keys of each key given.
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def __len__(self) -> int:
        return len(self.first)

    def bounds(self, bits: int) -> list[tuple[int, int, int]]:
        """(bucket, from, to) for the buckets that have keys."""
        buckets = (self.columns[0] >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1))
        return [(int(buckets[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]

    def answers(self, got: dict[int, bytes], bits: int, width: int = 1) -> np.ndarray:
        """The answered bits, a row for each of ``width`` questions."""
        out = np.zeros((width, len(self)), bool)
        for bucket, a, b in self.bounds(bits):
            out[:, a:b] = read_answer(got[bucket], width, b - a)
        return out


def planes(values: np.ndarray) -> bytes:
    """Integers as planes of equal bytes, which compress well."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


class Routing:
    """The digits of a key, in bits, that lead from a chunk to a bucket.

    A node is a chunk, a relay or a bucket. Its number holds the digits that its keys have
    in common and, above them, the group of chunks that it serves.
    """

    def __init__(self, text_bytes: int):
        buckets = -(-text_bytes // BUCKET_BYTES)
        bits = max(FAN_BITS, (buckets - 1).bit_length())
        self.fan = FAN_BITS
        self.digits = [min(FAN_BITS, bits - used) for used in range(0, bits, FAN_BITS)]

    @property
    def bits(self) -> int:
        """Bits of the first digit, by which chunks send."""
        return self.digits[0]

    @property
    def levels(self) -> int:
        return len(self.digits)

    def wide(self, level: int) -> bool:
        """Whether what ``level`` sends goes to relays, which need whole keys."""
        return level + 1 < self.levels

    def onward(self, node: int, level: int) -> int:
        """The node for digit 0 of the keys that ``node`` of ``level`` sends."""
        used, digit = sum(self.digits[:level]), self.digits[level]
        group = node >> used + self.fan if self.wide(level) else 0
        return group << used + digit | (node & (1 << used) - 1) << digit

    def runs(self, first: np.ndarray, level: int) -> list[tuple[int, int, int]]:
        """(digit, from, to) of ascending keys that ``level`` sends."""
        used, bits = sum(self.digits[:level]), self.digits[level]
        digit = ((first >> np.uint64(64 - used - bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        edges = np.flatnonzero(np.diff(digit, prepend=-1, append=-1))
        return [(int(digit[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


def in_chunks(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, Routing]:
    """``doc_id``, ``text`` (binary), ``chunk``; and the way of keys to their buckets."""
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long")
    binary = rows.select("doc_id", F.col("text").cast("binary").alias("text"), chunk.alias("chunk"))
    return binary, Routing(size)


class Shared:
    """What a bucket or relay is asked about 64-bit keys: has another chunk sent the key too?"""

    width = 1

    def __init__(self, payloads: list[bytes], wide: bool = False):
        keys = [np.frombuffer(p, np.uint64) for p in payloads]
        self.first, self.of, self.counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        self.ends = np.cumsum([len(k) for k in keys])

    def payload(self, a: int, b: int, wide: bool) -> bytes:
        return self.first[a:b].tobytes()

    def answers(self, above: np.ndarray | None = None) -> list[bytes]:
        shared = self.counts > 1
        if above is not None:
            shared = shared | above[0]
        return answered(shared[self.of][None], self.ends)


class Later:
    """What is asked about pairs of 64-bit keys: has a document with a smaller id the pair?"""

    width = 1

    def __init__(self, payloads: list[bytes], wide: bool = False):
        first, second, ids, self.ends = sent_documents(payloads, wide)
        order = np.lexsort((ids, second, first))
        f, s, i = first[order], second[order], ids[order]
        new = np.r_[True, (f[1:] != f[:-1]) | (s[1:] != s[:-1])]
        self.first, self.second, self.least = f[new], s[new], i[new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.ids = ids

    def payload(self, a: int, b: int, wide: bool) -> bytes:
        return document_payload(self.first[a:b], self.second[a:b], self.least[a:b], wide)

    def judged(self) -> np.ndarray:
        return np.zeros((1, len(self.first)), bool)

    def answers(self, above: np.ndarray | None = None) -> list[bytes]:
        above = self.judged() if above is None else above
        out = above[:, self.of]
        out[0] |= self.ids > self.least[self.of]
        return answered(out, self.ends)


class LaterOrMixed(Later):
    """The same; then, whether the first key of the pair has other pairs.

    Buckets tell first keys apart by their lower 32 bits. Others taken for equal leave a
    pair open that could be settled, which costs work and changes no result.
    """

    width = 2

    def judged(self) -> np.ndarray:
        new = np.r_[True, self.first[1:] != self.first[:-1]]
        outer = np.cumsum(new) - 1
        return np.stack([np.zeros(len(new), bool), np.bincount(outer)[outer] > 1])


def answered(bits: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [np.packbits(a.ravel()).tobytes() for a in np.split(bits, ends[:-1], axis=1)]


def read_answer(answer: bytes, width: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(answer, np.uint8), count=width * n).reshape(width, n)


def passes(
    chunks: DataFrame,
    routing: Routing,
    steps: Sequence[tuple[Callable, type]],
    finish: Callable[[pa.Table, Answers], pa.Table],
    schema: str,
) -> DataFrame:
    """Run the passes and ``finish`` on every chunk.

    A step is (``send``, ``asked``): ``send(table, answers)`` yields (first digit, payload)
    for a chunk; ``asked``, such as :class:`Shared`, answers to each payload of a bucket.
    """
    sent_schema = pa.schema([("sender", pa.int64()), ("node", pa.int64()), ("payload", pa.binary())])
    told_schema = pa.schema([("sender", pa.int64()), ("node", pa.int64()), ("answer", pa.binary())])

    def by_digit(told: pa.Table, level: int) -> dict[int, bytes]:
        mask = (1 << routing.digits[level]) - 1
        return {n & mask: a for n, a in zip(told["node"].to_pylist(), told["answer"].to_pylist())}

    def gather(told: pa.Table | None) -> Answers:
        if told is None:
            return {}
        steps_told = told["step"].to_numpy()
        return {int(s): by_digit(told.filter(pa.array(steps_told == s)), 0) for s in np.unique(steps_told)}

    def onward(node: int, level: int, rows: list[tuple[int, bytes]]) -> pa.Table:
        base = routing.onward(node, level)
        columns = [[node] * len(rows), [base | digit for digit, _ in rows], [p for _, p in rows]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, sent_schema)], schema=sent_schema)

    def sender(send):
        def first(table: pa.Table) -> pa.Table:
            return later(table, None)

        def later(table: pa.Table, told: pa.Table | None) -> pa.Table:
            if not table.num_rows:
                return sent_schema.empty_table()
            return onward(table["chunk"][0].as_py(), 0, list(send(table, gather(told))))

        return first, later

    def relay(asked, level):
        def run(table: pa.Table) -> pa.Table:
            met, wide = asked(table["payload"].to_pylist(), True), routing.wide(level)
            rows = [(digit, met.payload(a, b, wide)) for digit, a, b in routing.runs(met.first, level)]
            return onward(table["node"][0].as_py(), level, rows)

        return run

    def answer(table: pa.Table, answers: list[bytes]) -> pa.Table:
        return pa.table([table["sender"], table["node"], pa.array(answers, pa.binary())], schema=told_schema)

    def judge(asked):
        def run(table: pa.Table) -> pa.Table:
            return answer(table, asked(table["payload"].to_pylist()).answers())

        return run

    def hand_back(asked, level):
        def run(table: pa.Table, told: pa.Table) -> pa.Table:
            met, got = asked(table["payload"].to_pylist(), True), by_digit(told, level)
            above = np.zeros((asked.width, len(met.first)), bool)
            for digit, a, b in routing.runs(met.first, level):
                above[:, a:b] = read_answer(got[digit], asked.width, b - a)
            return answer(table, met.answers(above))

        return run

    def last(table: pa.Table, told: pa.Table) -> pa.Table:
        return finish(table, gather(told))

    sent_ddl = "sender long, node long, payload binary"
    told_ddl = "sender long, node long, answer binary"
    by_chunk, told = chunks.groupBy("chunk"), None
    for step, (send, asked) in enumerate(steps):
        first, later = sender(send)
        if told is None:
            sent = [by_chunk.applyInArrow(first, sent_ddl)]
        else:
            sent = [by_chunk.cogroup(told.groupBy("sender")).applyInArrow(later, sent_ddl)]
        for level in range(1, routing.levels):
            sent.append(sent[-1].groupBy("node").applyInArrow(relay(asked, level), sent_ddl))
        answers = sent[-1].groupBy("node").applyInArrow(judge(asked), told_ddl)
        for level in range(routing.levels - 1, 0, -1):
            below = sent[level - 1].groupBy("node")
            answers = below.cogroup(answers.groupBy("sender")).applyInArrow(hand_back(asked, level), told_ddl)
        answers = answers.withColumn("step", F.lit(step))
        told = answers if told is None else told.unionByName(answers)
    return by_chunk.cogroup(told.groupBy("sender")).applyInArrow(last, schema)


def send_shared(keys: Keys, bits: int):
    for bucket, a, b in keys.bounds(bits):
        yield bucket, keys.columns[0][a:b].tobytes()


def document_payload(first: np.ndarray, second: np.ndarray, ids: np.ndarray, wide: bool) -> bytes:
    """Pairs of keys with an id each; of the first key only 32 bits, unless ``wide``."""
    return second.tobytes() + first.astype(np.uint64 if wide else np.uint32).tobytes() + planes(ids)


def send_documents(keys: Keys, ids: np.ndarray, routing: Routing):
    """For pairs of 64-bit keys: both, and the smallest id."""
    for bucket, a, b in keys.bounds(routing.bits):
        first, second = (c[a:b] for c in keys.columns)
        yield bucket, document_payload(first, second, ids[keys.docs[a:b]], routing.wide(0))


def sent_documents(payloads: list[bytes], wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, id) of all payloads, and where each payload ends."""
    kind, size = (np.uint64, 24) if wide else (np.uint32, 20)
    sizes = [len(p) // size for p in payloads]
    second = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, sizes)])
    first = np.concatenate([np.frombuffer(p, kind, n, 8 * n) for p, n in zip(payloads, sizes)])
    ids = np.concatenate([from_planes(p[(size - 8) * n :]) for p, n in zip(payloads, sizes)])
    return first, second, ids, np.cumsum(sizes)
