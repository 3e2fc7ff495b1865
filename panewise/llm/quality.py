"""A quality classifier: a byte-level convolutional network in numpy.

Every byte of a text has a learned vector. Learned filters see twelve bytes at a time,
every three bytes. Their outputs are max-pooled over overlapping chunks of about 600 bytes
that cover the whole document; a hidden layer reads each chunk, and its largest and mean
values over all chunks combine into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shape of the network. A window is WIDTH bytes every STRIDE, a block BLOCK windows, a
#: chunk CHUNK blocks every CHUNK - 1, so that neighbours share one block.
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 12, 3, 32, 16
BLOCK, CHUNK = 64, 3
PAD = 256
#: Training rows per class, and the longest text among them in bytes: the sample's bound.
TRAIN_DOCS, TRAIN_BYTES = 1_000, 32 << 10
STEPS, BATCH, RATE, DECAY = 480, 32, 4e-3, 1e-4
#: Bytes scored at once.
SCORE_BYTES = 1 << 18


@dataclass
class Weights:
    embed: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def all(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


def fresh(seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    embed = normal(PAD + 1, EMBED, scale=0.5)
    embed[PAD] = 0
    return Weights(
        embed,
        normal(WIDTH * EMBED, FILTERS, scale=(2 / (WIDTH * EMBED)) ** 0.5),
        np.zeros(FILTERS, np.float32),
        normal(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5),
        np.zeros(HIDDEN, np.float32),
        normal(2 * HIDDEN, scale=(1 / HIDDEN) ** 0.5),
        np.zeros(1, np.float32),
    )


def block_count(size: int) -> int:
    return max(1, -(-size // (BLOCK * STRIDE)))


class Layout:
    """Texts one after the other, padded, and where their blocks and chunks are.

    ``blocks`` are those of each text; the bytes behind its last block are what its last
    windows look ahead to.
    """

    def __init__(self, texts: list[bytes], blocks: np.ndarray | None = None):
        span = BLOCK * STRIDE
        if blocks is None:
            blocks = np.array([block_count(len(t)) for t in texts])
        # the gap keeps a window of one text from seeing the next
        sizes = blocks * span + WIDTH
        self.starts = np.cumsum(sizes) - sizes
        self.bytes = np.full(int(sizes.sum()), PAD, np.int16)
        for text, at in zip(texts, self.starts):
            self.bytes[at : at + len(text)] = np.frombuffer(text, np.uint8)
        step = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        #: First window of every block.
        self.windows = np.repeat(self.starts // STRIDE, blocks) + BLOCK * step
        chunks = np.maximum(1, -(-(blocks - 1) // (CHUNK - 1)))
        first = np.repeat(np.cumsum(blocks) - blocks, chunks)
        step = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        last = np.repeat(np.cumsum(blocks) - 1, chunks)
        #: Blocks of every chunk; the last block stands in where a text ends earlier.
        self.chunks = np.minimum((first + (CHUNK - 1) * step)[:, None] + np.arange(CHUNK), last[:, None])
        self.chunk_starts = np.cumsum(chunks) - chunks
        self.chunk_counts = chunks


def convolved(w: Weights, data: np.ndarray) -> np.ndarray:
    """Filter outputs of every window, as sums over groups of STRIDE bytes."""
    groups = w.embed[data].reshape(-1, STRIDE * EMBED)
    parts = w.filters.reshape(WIDTH // STRIDE, STRIDE * EMBED, FILTERS)
    n = len(groups) - len(parts) + 1
    total = groups[:n] @ parts[0]
    for i in range(1, len(parts)):
        total += groups[i : i + n] @ parts[i]
    return total + w.filter_bias


def pooled(layout: Layout, chunk_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and mean hidden values of each text."""
    most = np.maximum.reduceat(chunk_values, layout.chunk_starts, axis=0)
    mean = np.add.reduceat(chunk_values, layout.chunk_starts, axis=0) / layout.chunk_counts[:, None]
    return most, mean.astype(chunk_values.dtype)


def hidden_values(w: Weights, layout: Layout) -> np.ndarray:
    """Hidden values of every chunk."""
    outputs = convolved(w, layout.bytes)
    edges = np.stack([layout.windows, np.minimum(layout.windows + BLOCK, len(outputs) - 1)], axis=1).ravel()
    blocks = np.maximum(np.maximum.reduceat(outputs, edges, axis=0)[::2], 0)
    return np.maximum(blocks[layout.chunks].max(axis=1) @ w.hidden + w.hidden_bias, 0)


def probability(w: Weights, most: np.ndarray, mean: np.ndarray) -> np.ndarray:
    logits = np.concatenate([most, mean], axis=1) @ w.out + w.out_bias
    return 1 / (1 + np.exp(-logits.astype(np.float64)))


def scores(w: Weights, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text."""
    layout = Layout(texts)
    return probability(w, *pooled(layout, hidden_values(w, layout)))


def long_score(w: Weights, text: bytes) -> float:
    """The same for one text, in stretches of whole chunks of about ``SCORE_BYTES``.

    Stretches share the block at which they meet, as chunks do, and only the largest values
    and the sums are kept, so that memory does not grow with the text.
    """
    span, blocks, at = BLOCK * STRIDE, block_count(len(text)), 0
    chunks = max(1, SCORE_BYTES // (span * (CHUNK - 1)))
    most, total, count = np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN), 0
    while True:
        left = blocks - at
        own = left if left <= chunks * (CHUNK - 1) + 1 else chunks * (CHUNK - 1) + 1
        layout = Layout([text[at * span : (at + own) * span + WIDTH]], np.array([own]))
        hidden = hidden_values(w, layout)
        most, total, count = np.maximum(most, hidden.max(axis=0)), total + hidden.sum(axis=0), count + len(hidden)
        if own == left:
            mean = (total / count).astype(np.float32)
            return float(probability(w, most[None], mean[None])[0])
        at += own - 1


def gradients(w: Weights, texts: list[bytes], labels: np.ndarray, importance: np.ndarray) -> list[np.ndarray]:
    """Gradient of the weighted log loss, in the order of the weights."""
    layout = Layout(texts)
    outputs = convolved(w, layout.bytes)
    blocks = outputs[layout.windows[:, None] + np.arange(BLOCK)]
    place = blocks.argmax(axis=1)
    best = np.take_along_axis(blocks, place[:, None], axis=1)[:, 0]
    place += layout.windows[:, None]
    in_chunk = best[layout.chunks]
    which = in_chunk.argmax(axis=1)
    chunk_max = np.take_along_axis(in_chunk, which[:, None], axis=1)[:, 0]
    block_of = np.take_along_axis(layout.chunks, which.reshape(len(which), -1), axis=1)
    window = np.take_along_axis(place, block_of, axis=0)
    features = np.maximum(chunk_max, 0)
    before = features @ w.hidden + w.hidden_bias
    hidden = np.maximum(before, 0)
    most, mean = pooled(layout, hidden)
    document = np.concatenate([most, mean], axis=1)
    chance = 1 / (1 + np.exp(-(document @ w.out + w.out_bias)))
    d_logit = ((chance - labels) * importance / importance.sum()).astype(np.float32)
    d_document = d_logit[:, None] * w.out
    text_of = np.repeat(np.arange(len(texts)), layout.chunk_counts)
    d_hidden = d_document[text_of, HIDDEN:] / layout.chunk_counts[text_of, None]
    is_most = hidden == most[text_of]
    ties = np.add.reduceat(is_most.astype(np.float32), layout.chunk_starts, axis=0)
    d_hidden = d_hidden + is_most * (d_document[:, :HIDDEN] / ties)[text_of]
    d_hidden = (d_hidden * (before > 0)).astype(np.float32)
    d_features = (d_hidden @ w.hidden.T) * (chunk_max > 0)
    seen = layout.bytes[window[:, :, None] * STRIDE + np.arange(WIDTH)]
    inputs = w.embed[seen].reshape(*window.shape, WIDTH * EMBED)
    d_filters = np.einsum("cfk,cf->kf", inputs, d_features, optimize=True)
    d_inputs = (d_features[:, :, None] * w.filters.T).reshape(-1, EMBED)
    d_embed = np.stack(
        [np.bincount(seen.ravel(), weights=d_inputs[:, i], minlength=PAD + 1) for i in range(EMBED)], axis=1
    )
    d_embed[PAD] = 0
    return [
        d_embed,
        d_filters,
        d_features.sum(axis=0),
        features.T @ d_hidden,
        d_hidden.sum(axis=0),
        document.T @ d_logit,
        d_logit.sum(keepdims=True),
    ]


def train(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 7) -> Weights:
    """Weights fitted by Adam; ``share`` is that of label 1 among all training labels."""
    w, rng = fresh(seed), np.random.default_rng(seed)
    ones = max(1, int(labels.sum()))
    zeros = max(1, len(labels) - ones)
    importance = np.where(labels == 1, share / ones, (1 - share) / zeros)
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in w.all()]
    order = np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if not len(order):
            order = rng.permutation(len(texts))
        some, order = order[:BATCH], order[BATCH:]
        found = gradients(w, [texts[i] for i in some], labels[some], importance[some])
        rate = RATE * (1 - (step - 1) / STEPS)
        for a, d, (m, v) in zip(w.all(), found, moments):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            move = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + DECAY * a
            a -= (rate * move).astype(np.float32)
    return w


def held_out(id_column: str):
    """Whether labels of the row may not be learned from: crc32(id as text) mod 3 is 1; null ids too."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_column}`").cast("string")), F.lit(3)) == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> Weights | float:
    """A model of ``labels.quality`` from ``doc_id`` and ``text`` of a bounded sample.

    Of each label the ``TRAIN_DOCS`` documents of at most ``TRAIN_BYTES`` bytes whose ids
    hash lowest are the sample; held-out rows never are. Labels other than 0 and 1 count
    as missing. If one label has no example, the model is the share of label 1 (0.5
    without any).
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r.quality: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    key = F.md5(F.col("doc_id").cast("string"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(
        F.octet_length("text") <= TRAIN_BYTES
    )
    rows = []
    for label in (0, 1):
        # twice as many ids as texts wanted: long and missing documents fall out
        ids = usable.where(F.col("quality") == label).select("doc_id", key.alias("key")).distinct()
        ids = ids.orderBy("key", "doc_id").limit(2 * TRAIN_DOCS)
        found = texts.join(F.broadcast(ids), "doc_id").orderBy("key", "doc_id", "text").limit(TRAIN_DOCS)
        rows += [(r.text.encode(), label) for r in found.select("text").collect()]
    given = np.array([label for _, label in rows], np.int64)
    if not len(given) or given.min() == given.max():
        return share
    return train([t for t, _ in rows], given, share)


def with_score(docs: DataFrame, model: Weights | float, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and the probability of label 1 of every whole text."""
    if isinstance(model, float):
        return docs.withColumn(name, F.lit(model))

    def batches(texts: list[bytes]) -> Iterator[list[bytes]]:
        some, size = [], 0
        for text in texts:
            if some and size + len(text) > SCORE_BYTES:  # a longer text goes alone
                yield some
                some, size = [], 0
            some.append(text)
            size += len(text)
        if some:
            yield some

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        data = [(t or "").encode() for t in texts]
        parts = [
            scores(model, some) if len(some[0]) <= SCORE_BYTES else np.array([long_score(model, some[0])])
            for some in batches(data)
        ]
        return pd.Series(np.concatenate([np.zeros(0), *parts]))

    return docs.withColumn(name, score(F.col(f"`{text_column}`").cast("string")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is at least 0.5) of each row.

    The score depends on the text alone: null counts as empty, and repeated rows and texts
    score alike. A null id is held out. An empty table gives no rows.
    """
    model = fit(docs, labels)
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    scored = with_score(rows, model)
    return scored.select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
