"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the first 50 bytes, most significant digit first; each
pass deals the suffixes that are still open to buckets, sorts there by the next digit and
drops what stands alone. After the last pass the equal groups are exactly the repeated
50-byte strings. Three passes do it:

1. The digit is the first 16 bytes. Only winnowed suffixes are dealt: of the 35 suffixes
   that start in a 50-byte string with 16 bytes to go, the one with the smallest hash.
   Equal strings hold the same one at the same place, so nothing repeated is missed.
2. Suffixes whose first digit is in two documents are sorted by the rest, from the first
   to the last string that holds them. Where all agree, or an earlier document has the
   same, those strings are settled at once.
3. What is left is cut into stretches of six strings and sorted in the same way: the digit
   is the 45 bytes that they have in common, the rest follows.
4. For what is still left every single string is sorted through its full depth.

Digits are compared by 64-bit hashes and the digits before them.
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
    LaterOrMixed,
    Shared,
    in_chunks,
    passes,
    send_documents,
    send_shared,
)
from panewise.llm.hashing import BASE, BYTE_VALUES, grams, leftmost_min, mix

FIRST_DIGIT = 16
#: Strings of a stretch.
STRETCH = 6
#: Bytes hashed at once, so that the arrays stay in the processor's cache.
BLOCK = 1 << 17
KEPT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
)


class Suffixes:
    """Winnowed suffixes of a chunk, with the first and the last string that chose them."""

    def __init__(self, table: pa.Table, depth: int):
        self.chunk, self.depth = Chunk(table), depth
        self.data = np.frombuffer(self.chunk.buffer, np.uint8)
        found = [self.winnow(a, b) for a, b in self.blocks()]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        #: First and last string that chose a suffix, and the suffix.
        self.first, self.last, self.at, keys = columns
        self.keys = mix(keys.astype(np.uint64))
        self.doc = np.searchsorted(self.chunk.ends, self.first, side="right")
        self.digits = Keys([self.keys], self.doc)
        ids, last = self.chunk.ids, np.zeros(len(self.digits), np.int64)
        np.maximum.at(last, self.digits.of, self.doc)
        self.within = ids[last] != ids[self.digits.docs] if len(last) else np.zeros(0, bool)

    def blocks(self):
        """(from, to): stretches of the buffer; neighbours share ``depth - 1`` bytes."""
        for a in range(0, max(0, len(self.data) - self.depth + 1), BLOCK):
            yield a, min(len(self.data), a + BLOCK + self.depth - 1)

    def winnow(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        hashes = grams(BYTE_VALUES[self.data[a:b]], FIRST_DIGIT)
        at = leftmost_min(hashes, self.depth - FIRST_DIGIT + 1)
        whole = np.ones(len(at), bool)  # strings inside one document
        for edge in self.chunk.ends[np.searchsorted(self.chunk.ends, a) : np.searchsorted(self.chunk.ends, b)]:
            whole[max(0, edge - a - self.depth + 1) : max(0, edge - a)] = False
        start = np.flatnonzero(whole)
        at = at[start]
        new = np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)] if len(at) else np.zeros(0, bool)
        ends = np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1] if len(at) else np.zeros(0, np.int64)
        return start[new] + a, start[ends] + a, at[new] + a, hashes[at[new]]

    def hashed(self, places: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes from each place."""
        h = np.zeros(len(places), np.uint64)
        for j in range(size):
            h = h * BASE + BYTE_VALUES[self.data[places + j]]
        return mix(h)

    def around(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of all bytes of the strings from ``first`` to ``last``.

        The two overlap, so together they tell all bytes between.
        """
        both = self.hashed(first, self.depth) * BASE + self.hashed(last, self.depth)
        return mix(both + (last - first).astype(np.uint64))

    def second(self, answers: Answers, bits: int) -> tuple[np.ndarray, Keys]:
        """Suffixes open after the first pass, and their distinct surroundings."""
        shared = self.digits.answers(answers[0], bits)[0] | self.within if len(self.digits) else self.within
        rows = np.flatnonzero(shared[self.digits.of])
        around = self.around(self.first[rows], self.last[rows])
        return rows, Keys([self.keys[rows], around], self.doc[rows])


class Stretches:
    """The strings of the surroundings that are open after the second pass."""

    def __init__(self, suffixes: Suffixes, answers: Answers, bits: int):
        self.suffixes, self.answers, self.bits = suffixes, answers, bits
        self.rows, self.surroundings = suffixes.second(answers, bits)
        self.later, mixed = self.told(self.surroundings, 1)
        #: One place for each open surrounding, in ascending order.
        groups = np.flatnonzero(mixed & ~self.later)
        rows = self.rows[self.surroundings.first[groups]]
        order = np.argsort(suffixes.first[rows], kind="stable")
        self.groups, rows = groups[order], rows[order]
        first, last, at = suffixes.first[rows], suffixes.last[rows], suffixes.at[rows]
        #: Strings before each open surrounding.
        self.base = np.r_[0, np.cumsum(last - first + 1)]
        # stretch k holds the strings that start STRETCH * k to STRETCH * k + STRETCH - 1 before the suffix
        high, low = (at - first) // STRETCH, (at - last) // STRETCH
        counts = high - low + 1
        k = np.repeat(high, counts) - (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        first, last, at = (np.repeat(x, counts) for x in (first, last, at))
        self.first = np.maximum(first, at - (STRETCH * k + STRETCH - 1))
        self.last = np.minimum(last, at - STRETCH * k)
        #: Place of the first string of each stretch among all open strings.
        self.place = np.repeat(self.base[:-1], counts) + self.first - first
        self.doc = np.repeat(suffixes.doc[rows], counts)
        core = suffixes.hashed(at - STRETCH * k, suffixes.depth - STRETCH + 1)
        self.keys = Keys([core, suffixes.around(self.first, self.last)], self.doc)

    def told(self, keys: Keys, step: int) -> np.ndarray:
        return keys.answers(self.answers[step], self.bits, 2) if len(keys) else np.zeros((2, 0), bool)

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, Keys]:
        """Whether a stretch is settled as repeated; then the single strings of what is
        still open: where those of each distinct stretch begin, their documents, their keys."""
        later, mixed = self.told(self.keys, 2)
        ids = self.suffixes.chunk.ids
        settled = later[self.keys.of] | (ids[self.doc] > ids[self.keys.docs][self.keys.of])
        groups = np.flatnonzero(mixed & ~later)
        rows = self.keys.first[groups]
        order = np.argsort(rows, kind="stable")
        groups, rows = groups[order], rows[order]
        counts = self.last[rows] - self.first[rows] + 1
        begins = np.full(len(self.keys), -1)
        begins[groups] = np.cumsum(counts) - counts
        places = np.repeat(self.first[rows] - begins[groups], counts) + np.arange(counts.sum())
        owner, doc = np.repeat(groups, counts), np.repeat(self.doc[rows], counts)
        found = self.suffixes.hashed(places, self.suffixes.depth)
        return settled, begins, doc, Keys([self.keys.columns[0][owner], found], doc)

    def repeated(self) -> np.ndarray:
        """For every open string whether it starts in an earlier document."""
        settled, begins, doc, keys = self.strings()
        out, ids = np.zeros(self.base[-1], bool), self.suffixes.chunk.ids
        single = np.zeros(0, bool)
        if len(keys):
            single = keys.answers(self.answers[3], self.bits)[0][keys.of] | (ids[doc] > ids[keys.docs][keys.of])
        counts = self.last - self.first + 1
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place = np.repeat(self.place, counts) + step
        whole = np.repeat(settled, counts)
        out[place[whole]] = True
        # stretches with equal keys have the same strings in the same order
        begin = np.repeat(begins[self.keys.of], counts)
        some = ~whole & (begin >= 0)
        out[place[some]] = single[begin[some] + step[some]]
        return out


def drop_repeated_bytes(docs: DataFrame, depth: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes of each document.

    A byte goes if it lies in a string of ``depth`` bytes of the UTF-8 text that also
    starts in a document with a smaller id. Strings never cross documents and are judged
    on the input; repeats within one document stay. ``n_spans`` counts maximal removed
    runs. A null text is empty; a document without an id counts as later than all others
    and never as the earlier one; rows with equal ids do not remove each other. An empty
    table gives no rows.
    """
    if not 2 * FIRST_DIGIT <= depth:
        raise ValueError(f"depth must be at least {2 * FIRST_DIGIT}")
    chunks, routing = in_chunks(docs, id_column, text_column)
    bits = routing.bits

    def send_digits(table, answers):
        return send_shared(Suffixes(table, depth).digits, bits)

    def send_rest(table, answers):
        suffixes = Suffixes(table, depth)
        return send_documents(suffixes.second(answers, bits)[1], suffixes.chunk.ids, routing)

    def send_stretches(table, answers):
        suffixes = Suffixes(table, depth)
        return send_documents(Stretches(suffixes, answers, bits).keys, suffixes.chunk.ids, routing)

    def send_strings(table, answers):
        suffixes = Suffixes(table, depth)
        return send_documents(Stretches(suffixes, answers, bits).strings()[3], suffixes.chunk.ids, routing)

    def finish(table: pa.Table, answers: Answers) -> pa.Table:
        if not table.num_rows:
            return KEPT.empty_table()
        suffixes = Suffixes(table, depth)
        chunk, ids = suffixes.chunk, suffixes.chunk.ids
        open_strings = Stretches(suffixes, answers, bits)
        rows, around = open_strings.rows, open_strings.surroundings
        change = np.zeros(len(suffixes.data) + 1, np.int32)
        settled = open_strings.later[around.of] | (ids[suffixes.doc[rows]] > ids[around.docs][around.of])
        np.add.at(change, suffixes.first[rows[settled]], 1)
        np.subtract.at(change, suffixes.last[rows[settled]] + depth, 1)
        repeated = open_strings.repeated()
        if len(repeated):
            # the n-th string of a surrounding that is not settled is the n-th of its group
            where = np.full(len(around), -1)
            where[open_strings.groups] = np.arange(len(open_strings.groups))
            rest = np.flatnonzero(~settled & (where[around.of] >= 0))
            base = open_strings.base[where[around.of[rest]]]
            counts = suffixes.last[rows[rest]] - suffixes.first[rows[rest]] + 1
            step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = repeated[np.repeat(base, counts) + step]
            at = (np.repeat(suffixes.first[rows[rest]], counts) + step)[hit]
            np.add.at(change, at, 1)
            np.subtract.at(change, at + depth, 1)
        gone = np.cumsum(change[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = chunk.starts[(chunk.starts < chunk.ends)]
        opens[inner] = gone[inner]
        edges = np.r_[chunk.starts, len(suffixes.data)]
        removed, spans = (np.diff(np.r_[0, np.cumsum(m)][edges]) for m in (gone, opens))
        kept = [
            suffixes.data[a:b][~gone[a:b]].tobytes() if n else text
            for a, b, n, text in zip(chunk.starts, chunk.ends, removed, chunk.texts)
        ]
        columns = [chunk.id_column(), chunk.ends - chunk.starts, removed, spans, pa.array(kept, pa.binary())]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=KEPT)

    steps = [
        (send_digits, Shared),
        (send_rest, LaterOrMixed),
        (send_stretches, LaterOrMixed),
        (send_strings, Later),
    ]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return passes(chunks, routing, steps, finish, schema)
