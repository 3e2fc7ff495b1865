"""Token ids as binary segments with Elias-Fano document boundaries.

A segment holds the ids of consecutive documents, one after the other, in 16 or 32 bits
each, and where each document ends as an Elias-Fano sequence: the low bits of every end
side by side, the high parts in unary, and the place of every 64th set bit, from which
``select`` finds any boundary. That takes about 2 + log2(ids per document) bits for a
document. The ids of documents, which ascend too, are a second sequence of that kind, less the
first of them, and a document is found in it by bisection. Segments are rows of a Parquet table in ascending order of document, written by
Spark's committer, so a lost task leaves no half-written file.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panewise.llm.tokens import encoder, packed, unpacked

#: Ids of a segment (one document may exceed it), and bytes of text per shard.
SEGMENT_IDS, SHARD_BYTES = 1 << 20, 16 << 20
#: Documents encoded at once; boundaries per sampled place.
ROWS_AT_ONCE, SAMPLE = 512, 64
SEGMENT = (
    "shard int, segment int, n_docs int, n_ids long, ids binary, "
    "low_bits int, low binary, high binary, samples binary, "
    "first_id long, last_id long, n_known int, "
    "id_low_bits int, id_low binary, id_high binary, id_samples binary"
)


class EliasFano:
    """A sequence of non-decreasing integers, none above ``universe``."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(math.log2(universe / n))) if n and universe > n else 0
        values = values.astype(np.uint64)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(
            n, low_bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()
        )

    def select(self, i: int) -> int:
        """The i-th value, read from its low bits and one stretch of the high ones."""
        place, left = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        word = self.high[byte] >> place % 8 << place % 8
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        low, at = 0, i * self.low_bits
        for b in range(self.low_bits):
            low |= (self.low[(at + b) // 8] >> (at + b) % 8 & 1) << b
        return (one - i) << self.low_bits | low

    def find(self, value: int) -> range:
        """The places of ``value``, by bisection over ``select``."""
        first = bisect_left(range(self.n), value, key=self.select)
        return range(first, bisect_right(range(self.n), value, lo=first, key=self.select))


def bounds_of(row: dict) -> EliasFano:
    """Where the documents of a segment end."""
    return EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])


def ids_of(row: dict) -> EliasFano:
    """The known ids of a segment's documents, less its first one."""
    return EliasFano(row["n_known"], row["id_low_bits"], row["id_low"], row["id_high"], row["id_samples"])


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode every text, append ``end_id``, and write the segments to ``path``.

    Documents are in ascending order of id, null ids last, equal ids in order of a hash of
    the text. A null or empty text has the end id alone. An empty table writes no segment.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(max(1, -(-size // SHARD_BYTES)), *order).sortWithinPartitions(*order)
    names = [f.split()[0] for f in SEGMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, segment = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts])
            bounds = EliasFano.of(ends, int(ends[-1]))
            known = [d for d in doc_ids if d is not None]  # the first ones
            first, last = (known[0], known[-1]) if known else (None, None)
            places = EliasFano.of(np.array([d - first for d in known], np.uint64), last - first if known else 0)
            values = (
                shard, segment, len(parts), int(ends[-1]), packed(np.concatenate(parts)),
                bounds.low_bits, bounds.low, bounds.high, bounds.samples, first, last, len(known),
                places.low_bits, places.low, places.high, places.samples,
            )
            kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            types = [kinds[f.split()[1]] for f in SEGMENT.split(", ")]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            for some in (batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE)):
                for doc_id, ids in zip(some["doc_id"].to_pylist(), encode.batch(some["text"].to_pylist())):
                    doc_ids.append(doc_id)
                    parts.append(np.append(ids, np.uint32(end_id)))
                    held += len(parts[-1])
                    if held >= SEGMENT_IDS:
                        yield flush()
                        doc_ids, parts, held, segment = [], [], 0, segment + 1
        if parts:
            yield flush()

    rows.mapInArrow(run, SEGMENT).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32 bits) and their crc of each document.

    ``start`` counts the ids of all documents before. It comes from sums per shard and
    segment, of which there is one row for some millions of ids.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    sums = segments.select("shard", "segment", "n_ids")
    shards = sums.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(shards, "shard").select(
        "shard",
        "segment",
        (F.col("shard_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("segment_start"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds, places, n = bounds_of(row), ids_of(row), row["n_docs"]
                ends = np.array([bounds.select(i) for i in range(n)], np.int64)
                begins = np.r_[0, ends[:-1]]
                ids = unpacked(row["ids"])
                doc_ids = [row["first_id"] + places.select(i) if i < row["n_known"] else None for i in range(n)]
                yield pa.record_batch(
                    [
                        pa.array([row["shard"]] * n, pa.int32()),
                        pa.array([row["segment"]] * n, pa.int32()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(begins, pa.int64()),
                        pa.array(ends - begins, pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()),
                    ],
                    names=["shard", "segment", "doc_id", "place", "n_tokens", "ids"],
                )

    schema = "shard int, segment int, doc_id long, place long, n_tokens long, ids binary"
    read = segments.drop("n_ids").mapInArrow(run, schema)
    digest = read.withColumn("crc", F.crc32("ids"))
    return digest.join(starts, ["shard", "segment"]).select(
        "doc_id", (F.col("segment_start") + F.col("place")).alias("start"), "n_tokens", "ids", "crc"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32 bits) of the documents asked for.

    Only segments whose ids span one of ``doc_ids`` are opened; in those a document is found
    by bisection and its ids by two boundaries, and nothing else is decoded. Ids that are not
    there give no row, repeated ones as many as there are documents.
    """
    wanted = sorted({int(i) for i in doc_ids})
    spanned = F.exists(F.lit(wanted).cast("array<long>"), lambda i: i.between(F.col("first_id"), F.col("last_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds, places, out = bounds_of(row), ids_of(row), []
                ids = unpacked(row["ids"])
                for doc_id in wanted[bisect_left(wanted, row["first_id"]) : bisect_right(wanted, row["last_id"])]:
                    for i in places.find(doc_id - row["first_id"]):
                        begin = bounds.select(i - 1) if i else 0
                        own = ids[begin : bounds.select(i)]
                        out.append((doc_id, len(own), own.tobytes()))
                columns = list(zip(*out)) or [(), (), ()]
                kinds = (pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_tokens", "ids"])

    segments = spark.read.schema(SEGMENT).parquet(path).where(spanned if wanted else F.lit(False))
    return segments.mapInArrow(run, "doc_id long, n_tokens long, ids binary")
