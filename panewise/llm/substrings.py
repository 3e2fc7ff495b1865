"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the word 5-grams of each 13-word window the one with the
smallest hash, so that equal windows hold the same seed at the same place. A first pass
joins all documents on their seeds and keeps the seeds that two documents share. A second
pass extends each such seed to the left and right, to every 13-word window that holds it,
and finds the first document of each extension. Extending a group at a time instead of a
pair at a time loses no match and makes no pairs within a group. Extensions that touch or
overlap are merged into maximal repeats, which leave every document but the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panewise.llm.chunks import (
    Answers,
    Chunk,
    Keys,
    Later,
    Shared,
    in_chunks,
    passes,
    send_documents,
    send_shared,
)
from panewise.llm.hashing import grams, leftmost_min, mix, runs_covered, word_hashes, word_spans

SEED_WORDS = 5
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


class Seeds:
    """Windows and seeds of a chunk."""

    def __init__(self, table: pa.Table, words: int):
        self.chunk = Chunk(table, b"\n")
        self.words = words
        starts, ends = word_spans(self.chunk.buffer)
        #: First word of each document, and the end of the last one.
        self.edges = np.searchsorted(starts, np.r_[self.chunk.starts, len(self.chunk.buffer) + 1])
        self.doc = np.repeat(np.arange(len(self.chunk.ids)), np.diff(self.edges))
        self.hashes = word_hashes(self.chunk.buffer, starts, ends)
        seed_hashes = grams(self.hashes, SEED_WORDS)
        at = leftmost_min(seed_hashes, words - SEED_WORDS + 1)
        self.windows = np.flatnonzero(self.doc[: len(at)] == self.doc[words - 1 :]) if len(at) else np.zeros(0, np.int64)
        at = at[self.windows]
        new = np.diff(at, prepend=-1) != 0
        self.seed_of_window = np.cumsum(new) - 1
        places = at[new]
        self.seed_keys = mix(seed_hashes[places])
        self.seeds = Keys([self.seed_keys], self.doc[places])
        last = np.zeros(len(self.seeds), np.int64)
        np.maximum.at(last, self.seeds.of, self.doc[places])
        ids = self.chunk.ids
        self.within = ids[last] != ids[self.seeds.docs] if len(last) else np.zeros(0, bool)

    def extensions(self, answers: Answers, bits: int) -> tuple[np.ndarray, Keys]:
        """The windows around shared seeds, and their distinct contents."""
        shared = self.seeds.answers(answers[0], bits)[0] | self.within if len(self.seeds) else self.within
        chosen = np.flatnonzero(shared[self.seeds.of[self.seed_of_window]])
        windows = self.windows[chosen]
        contents = mix(grams(self.hashes, self.words)[windows]) if len(windows) else np.zeros(0, np.uint64)
        return windows, Keys([self.seed_keys[self.seed_of_window[chosen]], contents], self.doc[windows])


def drop_repeats(docs: DataFrame, words: int = 13, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the remaining text of each document.

    Words are runs without ASCII white space. A word goes if it lies in a run of ``words``
    words that also starts in a document with a smaller id; remaining words are joined by
    one space. Repeats within one document stay. Null and empty texts have no words; a
    document without an id counts as later than all others and never as the earlier one;
    rows with equal ids do not remove each other. An empty table gives no rows.
    """
    if words < SEED_WORDS:
        raise ValueError(f"repeats must have at least {SEED_WORDS} words")
    chunks, routing = in_chunks(docs, id_column, text_column)
    bits = routing.bits

    def send_seeds(table, answers):
        return send_shared(Seeds(table, words).seeds, bits)

    def send_extensions(table, answers):
        seeds = Seeds(table, words)
        return send_documents(seeds.extensions(answers, bits)[1], seeds.chunk.ids, routing)

    def finish(table: pa.Table, answers: Answers) -> pa.Table:
        if not table.num_rows:
            return KEPT.empty_table()
        seeds = Seeds(table, words)
        ids = seeds.chunk.ids
        windows, contents = seeds.extensions(answers, bits)
        repeated = np.zeros(0, np.int64)
        if len(windows):
            later = contents.answers(answers[1], bits)[0]
            first = ids[contents.docs]
            repeated = windows[later[contents.of] | (ids[seeds.doc[windows]] > first[contents.of])]
        gone = runs_covered(repeated, words, len(seeds.doc))
        before = np.r_[0, np.cumsum(gone)]
        removed = np.diff(before[seeds.edges])
        kept = []
        for i, text in enumerate(seeds.chunk.texts):
            found = text.split()
            if removed[i]:
                stays = ~gone[seeds.edges[i] : seeds.edges[i + 1]]
                found = [w for w, keep in zip(found, stays.tolist()) if keep]
            kept.append(b" ".join(found).decode())
        return pa.table(
            [seeds.chunk.id_column(), pa.array(np.diff(seeds.edges)), pa.array(removed), pa.array(kept, pa.string())],
            schema=KEPT,
        )

    steps = [(send_seeds, Shared), (send_extensions, Later)]
    return passes(chunks, routing, steps, finish, "doc_id long, n_words long, n_removed long, text string")
