"""Token ids of whole texts, piece by piece.

Both tokenizers used here split a text before every run of white space that follows
something else, and between a letter and a comma or full stop that ends a word, and never
look back across such a place. A text is therefore cut there, and each distinct piece is encoded once by a worker; texts are put together again from
the ids of their pieces. Texts with white space that tokenizers may disagree about are
encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from itertools import chain

import numpy as np

from panewise.llm.hashing import word_hash_pairs

#: White space or joiners in some definition, other than the four above.
ODD_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
#: Distinct pieces that a worker keeps (about 40 bytes each) before it starts afresh, and
#: bytes of text encoded at once.
KEPT_PIECES, TEXT_BYTES = 1_500_000, 1 << 20
MOST_IDS = 1 << 16


def default_path(name: str) -> str:
    """Where the public tokenizer file ``name`` lies; every worker has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts with the tokenizer file at ``path``; one for each worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        """Keep no pieces: their two hashes, in order of the first, and where their ids are."""
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begins, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store, self.stored = np.zeros(1 << 16, "<u4"), 0

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers; null is empty."""
        out = [np.zeros(0, "<u4")] * len(texts)
        some: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if ODD_SPACE.search(text):
                out[i] = np.array(self.whole(text), "<u4")
                continue
            some.append(i)
            size += len(text)
            if size >= TEXT_BYTES:
                self.fill(out, texts, some)
                some, size = [], 0
        if some:
            self.fill(out, texts, some)
        return out

    def fill(self, out: list[np.ndarray], texts: Sequence[str | None], some: list[int]) -> None:
        """Encode some texts, none of them empty, by their pieces."""
        data = [texts[i].encode() for i in some]
        buffer, lengths = b"".join(data), np.array([len(d) for d in data])
        places = np.cumsum(lengths) - lengths
        b = np.frombuffer(buffer, np.uint8)
        space = (b == 32) | (b == 9) | (b == 10) | (b == 13)
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[places] = True
        # a comma or full stop at the end of a word is a piece of its own
        stop, last = (b == 44) | (b == 46), np.r_[space[1:], True]
        last[places[1:] - 1] = True
        letter = ((b | 32) >= 97) & ((b | 32) <= 122)
        begin[1:] |= stop[1:] & letter[:-1] & last[1:]
        starts = np.flatnonzero(begin)
        ends = np.r_[starts[1:], len(b)]
        keys, checks = word_hash_pairs(buffer, starts, ends)
        distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
        at = self.find(distinct, checks[first], buffer, starts[first], ends[first])
        if at is None or (checks[first][of] != checks).any():  # different pieces share a hash
            for i in some:
                out[i] = np.array(self.whole(texts[i]), "<u4")
            return
        begins, counts = self.begins[at][of], self.counts[at][of]
        total = np.cumsum(counts)
        gather = np.repeat(begins - (total - counts), counts) + np.arange(total[-1])
        ids = self.store[gather]
        cuts = np.r_[0, total][np.searchsorted(starts, np.r_[places, len(b)])]
        for i, a, z in zip(some, cuts, cuts[1:]):
            out[i] = ids[a:z]

    def find(self, keys, checks, buffer: bytes, starts, ends) -> np.ndarray | None:
        """Places of distinct pieces among those kept, after encoding the new ones."""
        if len(self.keys) + len(keys) > KEPT_PIECES:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            pieces = [buffer[a:z].decode() for a, z in zip(starts[new].tolist(), ends[new].tolist())]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            n = int(counts.sum())
            if self.stored + n > len(self.store):
                self.store = np.concatenate([self.store, np.zeros(max(n, len(self.store)), "<u4")])
            self.store[self.stored : self.stored + n] = np.fromiter(chain.from_iterable(found), "<u4", n)
            begins = self.stored + np.cumsum(counts) - counts
            self.stored += n
            self.begins = np.insert(self.begins, at[new], begins)
            self.counts = np.insert(self.counts, at[new], counts)
            self.checks = np.insert(self.checks, at[new], checks[new])
            self.keys = np.insert(self.keys, at[new], keys[new])
            at = np.searchsorted(self.keys, keys)
        return at if (self.checks[at] == checks).all() else None


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def packed(ids: np.ndarray) -> bytes:
    """Little-endian ids, 16 bits each where all fit, after one byte that tells the width."""
    wide = len(ids) and int(ids.max()) >= MOST_IDS
    return (b"\x04" if wide else b"\x02") + ids.astype("<u4" if wide else "<u2").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<u2", offset=1).astype("<u4")
