"""Near-duplicate groups by SimHash, found through the anchors of a covering code.

Anchors are the words of a product of repetition codes: the 64 bits are cut into blocks
of odd length and an anchor holds one majority bit per block. Every fingerprint lies
within the covering radius of the anchor it decodes to, its home. A fingerprint is
replicated to every anchor within covering radius plus threshold that can be the home of
something within the threshold; two fingerprints that link meet at the home of one of
them. Any code gives the same links; shorter blocks give more and smaller cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panewise.llm.components import roots
from panewise.llm.hashing import mix
from panewise.llm.tables import discard, staged

SEED = 42
#: Shingle hashes counted at once, entries sent at once, and pairs compared at once.
HASHES_AT_ONCE, ENTRIES_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 19, 1 << 20
#: Distinct fingerprints per cell that the code is chosen for, and per bucket of cells.
CELL, BUCKET = 16, 8_000
LEAST_BUCKETS = 64


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of the word shingles of a text; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = max(0, len(words) - shingle)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: last + 1].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    counts, n = np.zeros(64, np.int64), last + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    for i in range(0, n, HASHES_AT_ONCE):
        part = hashes[i : i + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, fingerprint (a signed long) and a hash of the text for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch["text"]]
            column = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.record_batch(
                [batch["doc_id"], column, batch["text_hash"]], names=["doc_id", "fingerprint", "text_hash"]
            )

    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
        F.xxhash64(F.col(f"`{text_column}`").cast("string")).alias("text_hash"),
    )
    return rows.mapInArrow(run, "doc_id long, fingerprint long, text_hash long")


def code_for(n: int) -> list[int]:
    """Block lengths of a code whose cells hold about ``CELL`` of ``n`` fingerprints."""
    if n <= CELL << 10:
        return [7] * 9 + [1]
    if n <= CELL << 14:
        return [5] * 12 + [3, 1]
    short = min(21, max(0, -(-((n // CELL).bit_length() - 22) // 2)))
    return [3] * (21 - short) + [1] * (1 + 3 * short)


def homes(prints: np.ndarray, code: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each fingerprint, and the bits to flip before each block changes."""
    anchors, costs, at = np.zeros(len(prints), np.uint64), [], 0
    for block, length in enumerate(code):
        ones = np.bitwise_count((prints >> np.uint64(at)) & np.uint64((1 << length) - 1)).astype(np.int64)
        high = 2 * ones > length
        anchors |= high.astype(np.uint64) << np.uint64(block)
        costs.append(np.where(high, ones - length // 2, length // 2 + 1 - ones))
        at += length
    return anchors, np.stack(costs)


def replicas(prints: np.ndarray, code: list[int], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, at home): the home, and each larger anchor within reach.

    Of two fingerprints that link, the one with the smaller home reaches the other's.
    """
    own, costs = homes(prints, code)
    anchors, found = [own], [np.arange(len(prints))]
    for size in range(1, threshold + 1):
        for blocks in combinations(range(len(code)), size):
            near = np.flatnonzero(costs[list(blocks)].sum(axis=0) <= threshold)
            there = own[near] ^ np.uint64(sum(1 << b for b in blocks))
            larger = there > own[near]
            anchors.append(there[larger])
            found.append(near[larger])
    places = np.concatenate(found)
    return np.concatenate(anchors), prints[places], np.arange(len(places)) < len(prints)


def flips(threshold: int) -> np.ndarray:
    """Every way to change one to ``threshold`` bits."""
    bits = [np.uint64(1) << np.uint64(i) for i in range(64)]
    ways = [sum(c, np.uint64(0)) for n in range(1, threshold + 1) for c in combinations(bits, n)]
    return np.array(ways, np.uint64)


def join_parts(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give what the pairs connect the smallest label of its part."""
    while len(a):
        x, y = label[a], label[b]
        open_pairs = x != y
        if not open_pairs.any():
            return
        a, b, x, y = a[open_pairs], b[open_pairs], x[open_pairs], y[open_pairs]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def stars(anchors: np.ndarray, prints: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest of its part) that connect what the cells connect.

    A fingerprint is compared with those at home in its cell. Where these are more than the
    ways to change ``threshold`` bits, as in a cell with a tight cluster, it goes by the finest
    of all codes instead, in which every fingerprint is an anchor: each way is looked up among
    the fingerprints at hand. So the work of a cell grows with its fingerprints, not with
    their square.
    """
    nodes, node = np.unique(prints, return_inverse=True)
    label = np.arange(len(nodes))
    order = np.argsort(anchors, kind="stable")
    anchors, node, home = anchors[order], node[order], home[order]
    at_home = np.flatnonzero(home)
    low = np.searchsorted(anchors[at_home], anchors, side="left")
    counts = np.searchsorted(anchors[at_home], anchors, side="right") - low
    ways = max(1, sum(comb(64, n) for n in range(1, threshold + 1)))
    crowded = np.unique(node[counts > ways])
    if len(crowded):
        changes = flips(threshold)
        at_once = max(1, PAIRS_AT_ONCE // ways)
        for i in range(0, len(crowded), at_once):
            some = crowded[i : i + at_once]
            sought = (nodes[some][:, None] ^ changes).ravel()
            place = np.minimum(np.searchsorted(nodes, sought), len(nodes) - 1)
            found = np.flatnonzero(nodes[place] == sought)
            join_parts(label, some[found // ways], place[found])
        counts = np.where(counts > ways, 0, counts)
    total, done = np.cumsum(counts), 0
    while done < len(counts):
        base = total[done] - counts[done]
        upto = max(done + 1, int(np.searchsorted(total, base + PAIRS_AT_ONCE, side="right")))
        some = counts[done:upto]
        left = np.repeat(node[done:upto], some)
        step = np.arange(len(left)) - np.repeat(np.cumsum(some) - some, some)
        right = node[at_home[np.repeat(low[done:upto], some) + step]]
        near = (np.bitwise_count(nodes[left] ^ nodes[right]) <= threshold) & (left != right)
        join_parts(label, left[near], right[near])
        done = upto
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def links(prints: DataFrame, threshold: int) -> DataFrame:
    """``a``, ``b``: links that connect all distinct fingerprints within the threshold."""
    n = prints.count()
    code, buckets = code_for(n), max(LEAST_BUCKETS, n // BUCKET)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size, typical = 0, mix(np.arange(1, 257, dtype=np.uint64))
        per = len(replicas(typical, code, threshold)[0]) / len(typical)

        def flush() -> pa.RecordBatch:
            anchors, found, home = replicas(np.concatenate(kept).view(np.uint64), code, threshold)
            bucket = (mix(anchors) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            anchors, found, home, bucket = anchors[order], found[order], home[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            payloads = [anchors[a:b].tobytes() + found[a:b].tobytes() + home[a:b].tobytes() for a, b in spans]
            return pa.record_batch(
                [pa.array(bucket[edges[:-1]], pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"]
            )

        for batch in batches:
            column = batch["fingerprint"].to_numpy()
            for i in range(0, len(column), 1024):
                kept.append(column[i : i + 1024])
                size += len(kept[-1])
                if size * per > ENTRIES_AT_ONCE:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    def compare(table: pa.Table) -> pa.Table:
        payloads = table["payload"].to_pylist()
        sizes = [len(p) // 17 for p in payloads]
        anchors = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, sizes)])
        found = np.concatenate([np.frombuffer(p, np.uint64, n, 8 * n) for p, n in zip(payloads, sizes)])
        home = np.concatenate([np.frombuffer(p, bool, n, 16 * n) for p, n in zip(payloads, sizes)])
        a, b = stars(anchors, found, home, threshold)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    sent = prints.select("fingerprint").mapInArrow(send, "bucket int, payload binary")
    return sent.groupBy("bucket").applyInArrow(compare, "a long, b long")


def near_groups(
    docs: DataFrame,
    shingle: int = 3,
    threshold: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, root and text_hash for every row.

    Rows whose fingerprints differ in at most ``threshold`` bits link; ``component_id`` is
    the smallest id that links reach. Copies meet in one distinct fingerprint before
    anything is compared. Null and empty texts and texts without words have fingerprint
    zero and link like any other; a null id is never the smallest, and a component of null
    ids has a null ``component_id``. Repeated rows give repeated rows; an empty table none.
    ``root`` is the same number within a component and differs between them.
    """
    prints = staged(fingerprints(docs, shingle, id_column, text_column), "simhash")
    distinct = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash")
    tree = roots(links(distinct, threshold))
    hung = tree.withColumnRenamed("node", "fingerprint")
    parts = distinct.join(hung, "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = staged(parts.groupBy("root").agg(F.min("least").alias("component_id")), "simhash")
    named = parts.select("fingerprint", "root").join(smallest, "root")
    named = staged(named.select("fingerprint", "root", "component_id"), "simhash")
    discard(distinct, tree, smallest)
    return prints.join(named, "fingerprint").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
        "root",
        "text_hash",
    )
