"""Rolling hashes, winnowing and grouping over the concatenated texts of one chunk."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the polynomial hashes and of the mixing steps.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: Words longer than this are rare and are hashed one at a time.
LONG_WORD = 48


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


#: One 64-bit value per byte value.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
#: Other values, for a second hash that is independent of the first.
OTHER_VALUES = mix(np.arange(1001, 1257, dtype=np.uint64) * BASE)


def grams(tokens: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of ``size`` tokens, by doubling; mod 2**64."""
    parts, h, width, power = [], tokens, 1, BASE
    left = size
    while True:
        if left & 1:
            parts.append((h, width, power))
        left >>= 1
        if not left:
            break
        h = h[:-width] * power + h[width:] if len(h) > width else h[:0]
        width, power = 2 * width, np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
    n = max(0, len(tokens) - size + 1)
    out, at = np.zeros(n, np.uint64), 0
    for h, width, power in parts:
        out = out * power + h[at : at + n] if at else h[:n].copy()
        at += width
    return out


def leftmost_min(values: np.ndarray, size: int) -> np.ndarray:
    """For every window of ``size`` values the place of its smallest, the leftmost of equals.

    Values count by their upper 32 bits, so that value and place fit one integer.
    """
    if len(values) < size:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    v, width = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while width < size:
        step = min(width, size - width)
        v = np.minimum(v[:-step], v[step:])
        width += step
    return (v & low).astype(np.int64)


def word_hashes(buffer: bytes, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hash of each word ``buffer[start:end]``; other byte values give another hash."""
    data, lengths = np.frombuffer(buffer, np.uint8), ends - starts
    h = lengths.astype(np.uint64)
    live = np.flatnonzero(lengths <= LONG_WORD)
    at, length, k = starts[live], lengths[live], 0
    while len(live):
        more = length > k
        if not more.all():
            live, at, length = live[more], at[more], length[more]
        h[live] = h[live] * BASE + values[data[at + k]]
        k += 1
    for i in np.flatnonzero(lengths > LONG_WORD):
        word = values[data[starts[i] : ends[i]]]
        while len(word) > 1:  # folds blocks, so that no array grows beyond the word
            word = np.array([grams(mix(b), len(b))[0] for b in np.array_split(word, -(-len(word) // 4096))])
        h[i : i + 1] = h[i : i + 1] * BASE + word[:1]
    return mix(h)


def word_hash_pairs(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of each word, as :func:`word_hashes` gives them by the two tables of byte
    values, from one pass over the bytes."""
    data, lengths = np.frombuffer(buffer, np.uint8), ends - starts
    order = np.argsort(-np.minimum(lengths, LONG_WORD + 1), kind="stable")
    size = lengths[order]
    first = int(np.searchsorted(-size, -LONG_WORD, side="left"))
    at, size = starts[order[first:]], size[first:]
    h, other = size.astype(np.uint64), size.astype(np.uint64)
    # of words in the order of length, those that have a k-th byte are the first ones
    counts = np.searchsorted(-size, -np.arange(LONG_WORD + 1), side="left")
    for k in range(int(size[0]) if len(size) else 0):
        n = counts[k]
        some = data[at[:n] + k]
        h[:n] = h[:n] * BASE + BYTE_VALUES[some]
        other[:n] = other[:n] * BASE + OTHER_VALUES[some]
    out = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    for result, short, values in zip(out, (h, other), (BYTE_VALUES, OTHER_VALUES)):
        result[order[first:]] = mix(short)
        if first:
            result[order[:first]] = word_hashes(buffer, starts[order[:first]], ends[order[:first]], values)
    return out


def word_spans(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    data = np.frombuffer(buffer, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def runs_covered(starts: np.ndarray, width: int, length: int) -> np.ndarray:
    """Whether each of ``length`` places lies in ``[s, s + width)`` of some start ``s``."""
    depth = np.zeros(length + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.subtract.at(depth, starts + width, 1)
    return np.cumsum(depth[:-1]) > 0
