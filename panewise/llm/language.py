"""Language identification by a byte convolutional network in numpy.

Texts are cut into windows of a fixed number of bytes, so that any number of texts is
scored in equal batches. Every byte has a learned vector; filters of several widths slide
over the bytes of a window, the largest value of each filter stays, and a linear layer
turns these into one logit per language. The logits of a text are the means over all its
windows, weighted by their bytes, and a softmax makes them probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panewise.llm.quality import held_out

#: Shape of the network: widths in bytes, filters of each, and places of a window at which
#: filters start. Windows overlap by the widest filter less one, so every place is seen once.
EMBED, WIDTHS, FILTERS = 8, (2, 3, 4, 5), 16
WIDEST, PLACES = max(WIDTHS), 252
SPAN = PLACES + WIDEST - 1
PAD = 256
#: The sample's bound: languages (the most frequent ones), texts of all languages together
#: and of one, and bytes of the longest text among them.
MOST_LANGUAGES, TRAIN_DOCS, LANGUAGE_DOCS, TRAIN_BYTES = 200, 4_000, 400, 16 << 10
STEPS, BATCH, RATE, DECAY = 500, 64, 4e-3, 1e-4
#: Windows scored at once: this bounds a worker's memory, whatever the length of a text.
WINDOWS_AT_ONCE = 256
UNKNOWN = "und"

#: A-Z count as a-z.
FOLD = np.arange(PAD + 1, dtype=np.int16)
FOLD[65:91] += 32


@dataclass
class Weights:
    embed: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def all(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


@dataclass
class Model:
    languages: list[str]
    weights: Weights | None


def shape_mask() -> np.ndarray:
    """Which inputs each filter sees: a filter of width w reads the first w bytes of its place."""
    widths = np.repeat(WIDTHS, FILTERS)
    return (np.repeat(np.arange(WIDEST), EMBED)[:, None] < widths).astype(np.float32)


def fresh(languages: int, seed: int = 11) -> Weights:
    rng = np.random.default_rng(seed)
    mask = shape_mask()
    embed = (rng.standard_normal((PAD + 1, EMBED)) * 0.5).astype(np.float32)
    embed[PAD] = 0
    filters = rng.standard_normal(mask.shape).astype(np.float32) * mask / np.sqrt(mask.sum(axis=0) / 2)
    out = rng.standard_normal((mask.shape[1], languages)) / np.sqrt(mask.shape[1])
    zeros = np.zeros(mask.shape[1], np.float32), np.zeros(languages, np.float32)
    return Weights(embed, filters.astype(np.float32), zeros[0], out.astype(np.float32), zeros[1])


def window_count(size: int) -> int:
    return max(1, -(-size // PLACES))


def windows_of(data: bytes, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` windows of a text from window ``first`` on, and how many bytes start in each."""
    piece = np.frombuffer(data, np.uint8)[first * PLACES : (first + count) * PLACES + WIDEST - 1]
    padded = np.full(count * PLACES + WIDEST - 1, PAD, np.int16)
    padded[: len(piece)] = piece
    views = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[::PLACES]
    sizes = np.clip(len(data) - (first + np.arange(count)) * PLACES, 1, PLACES)
    return FOLD[views], sizes


def filtered(w: Weights, windows: np.ndarray) -> np.ndarray:
    """Filter outputs by window and place."""
    vectors = w.embed[windows].reshape(len(windows), -1)
    views = np.lib.stride_tricks.sliding_window_view(vectors, WIDEST * EMBED, axis=1)[:, ::EMBED]
    return views.reshape(-1, WIDEST * EMBED) @ w.filters


def logits(w: Weights, windows: np.ndarray) -> np.ndarray:
    most = filtered(w, windows).reshape(len(windows), PLACES, -1).max(axis=1)
    return np.maximum(most + w.filter_bias, 0) @ w.out + w.out_bias


def softmax(values: np.ndarray) -> np.ndarray:
    e = np.exp(values - values.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(w: Weights, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradient of the mean log loss, in the order of the weights."""
    n, filters = len(windows), w.filters.shape[1]
    outputs = filtered(w, windows).reshape(n, PLACES, filters)
    place = outputs.argmax(axis=1)
    before = np.take_along_axis(outputs, place[:, None], axis=1)[:, 0] + w.filter_bias
    features = np.maximum(before, 0)
    d_logits = softmax(features @ w.out + w.out_bias)
    d_logits[np.arange(n), labels] -= 1
    d_logits = (d_logits / n).astype(features.dtype)
    d_features = (d_logits @ w.out.T) * (before > 0)
    seen = windows[np.arange(n)[:, None, None], place[:, :, None] + np.arange(WIDEST)]
    inputs = w.embed[seen].reshape(n, filters, WIDEST * EMBED)
    d_filters = np.einsum("nfk,nf->kf", inputs, d_features, optimize=True) * shape_mask()
    d_inputs = (d_features[:, :, None] * w.filters.T).reshape(-1, EMBED)
    d_embed = np.stack(
        [np.bincount(seen.ravel(), weights=d_inputs[:, i], minlength=PAD + 1) for i in range(EMBED)], axis=1
    )
    d_embed[PAD] = 0
    return [d_embed, d_filters, d_features.sum(axis=0), features.T @ d_logits, d_logits.sum(axis=0)]


def train(texts: list[bytes], labels: np.ndarray, languages: int, seed: int = 11) -> Weights:
    """Weights fitted by Adam; each step takes as many random windows of every language."""
    w, rng = fresh(languages, seed), np.random.default_rng(seed)
    of_language = [np.flatnonzero(labels == i) for i in range(languages)]
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in w.all()]
    for step in range(1, STEPS + 1):
        some = rng.permutation(languages)[np.arange(BATCH) % languages]
        chosen = [rng.choice(of_language[i]) for i in some]
        places = [int(rng.integers(window_count(len(texts[i])))) for i in chosen]
        windows = np.concatenate([windows_of(texts[i], at, 1)[0] for i, at in zip(chosen, places)])
        rate = RATE * (1 - (step - 1) / STEPS)
        for a, d, (m, v) in zip(w.all(), gradients(w, windows, some), moments):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            move = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + DECAY * a
            a -= (rate * move).astype(np.float32)
    return w


def has_letter(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame) -> Model:
    """A model of ``lang`` from ``doc_id``, ``text`` and ``lang`` of a bounded sample.

    Learned are the ``MOST_LANGUAGES`` most frequent values of ``lang`` among rows that are
    not held out and have a letter and at most ``TRAIN_BYTES`` bytes, from the
    ``LANGUAGE_DOCS`` documents of each whose ids hash lowest (fewer where that would be
    more than ``TRAIN_DOCS`` in all).
    """
    rows = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    rows = rows.where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    rows = rows.where((F.octet_length("text") <= TRAIN_BYTES) & has_letter("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r.lang: r.n for r in counts.collect()}
    languages = sorted(counts)
    if len(languages) < 2:
        return Model(languages, None)
    each = min(LANGUAGE_DOCS, max(1, TRAIN_DOCS // len(languages)))
    # of 2**32 hash values only so many are needed that about four times the sample remains
    shares = [F.lit(v) for lang in languages for v in (lang, min(1 << 32, (4 * each << 32) // counts[lang] + 1))]
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    near = rows.withColumn("key", key).where(F.col("key") < F.element_at(F.create_map(*shares), F.col("lang")))
    order = Window.partitionBy("lang").orderBy("key", "doc_id", "text")
    sample = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    found = sample.orderBy("lang", "key", "doc_id", "text").select("lang", "text").collect()
    labels = np.searchsorted(languages, [r.lang for r in found])
    if len(set(labels.tolist())) < len(languages):  # hashes left a language without a text
        languages = [languages[i] for i in sorted(set(labels.tolist()))]
        labels = np.searchsorted(languages, [r.lang for r in found])
        if len(languages) < 2:
            return Model(languages, None)
    return Model(languages, train([r.text.encode() for r in found], labels, len(languages)))


def text_logits(w: Weights, texts: list[bytes]) -> np.ndarray:
    """Mean logits of each whole text; windows of all texts go through in equal batches."""
    sums, total = np.zeros((len(texts), len(w.out_bias))), np.zeros(len(texts))
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> None:
        windows, sizes, owner = (np.concatenate(parts) for parts in zip(*waiting))
        np.add.at(sums, owner, logits(w, windows) * sizes[:, None])
        np.add.at(total, owner, sizes)

    for i, text in enumerate(texts):
        n, at = window_count(len(text)), 0
        while at < n:
            count = min(n - at, WINDOWS_AT_ONCE - held)
            windows, sizes = windows_of(text, at, count)
            waiting.append((windows, sizes, np.full(count, i)))
            at, held = at + count, held + count
            if held == WINDOWS_AT_ONCE:
                flush()
                waiting, held = [], 0
    if waiting:
        flush()
    return sums / np.maximum(total, 1)[:, None]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``; ``text`` is read whole."""
    rows = docs.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("text").cast("string").alias("text"),
    ).withColumn("known", has_letter("text"))
    if not model.languages:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model.weights is None:
        only = F.when(F.col("known"), model.languages[0]).otherwise(UNKNOWN)
        return rows.select(
            "doc_id", "held_out", only.alias("lang_pred"), F.col("known").cast("double").alias("score")
        )
    names, weights = np.array(model.languages, object), model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch["known"].to_numpy(zero_copy_only=False)
            texts = batch["text"].filter(batch["known"]).cast(pa.binary()).to_pylist()
            found, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
            if texts:
                chances = softmax(text_logits(weights, texts))
                found[known], score[known] = names[chances.argmax(axis=1)], chances.max(axis=1)
            columns = [batch["doc_id"], batch["held_out"], pa.array(found, pa.string()), pa.array(score)]
            yield pa.record_batch(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the probability of lang_pred) of each row.

    The prediction depends on the whole text alone, so repeated texts get the same one.
    Texts that are null, empty or without a letter get ``und`` with score 0; so does
    everything when no row can be learned from. With one learnable language every other
    text gets that one with score 1. A null id is held out. An empty table gives no rows.
    """
    return predict(docs, fit(docs))
