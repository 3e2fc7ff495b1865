"""Mixing, token files and packing: exact sums, round trips and invariants."""

import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from panewise.llm import mixing, packing, token_files
from panewise.llm.token_files import EliasFano
from panewise.llm.tokens import Encoder, default_path, packed, unpacked

SCHEMA = "doc_id long, text string, source string, key string, size int, part int"
WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = [
    "a  b", "x  y\n\n z ", "  lead", "trail  ", "it's  we'll\tgo", "<|endoftext|>a <|endoftext|> b", "foo<|endoftext|>",
    "é é ́ x", "\n\n\n", "12 34 ... 'S 's", "日本　語 x", "a\r\n\r\nb", " ", "a\xa0 b\xa0\n\nc", "a ​ b",
    "İ X", "x\x0b\ny", "x\x1c y", "A" * 300 + " " + "b" * 300, "tab\t\ttab \t mix",
]


@cache
def reference(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path(name))


def ids_of(name, text, end):
    return [*reference(name).encode(text or "", add_special_tokens=False).ids, end]


def documents():
    rows = [(i, f"word{i % 7} " * (i % 40) + "Some text's end", f"s{i % 5}") for i in range(300)]
    rows += [(1000 + i, "hot " * 30, "hot") for i in range(400)]
    rows += [(2000 + i, t, None) for i, t in enumerate(ODD)]
    rows += [(3000, None, "s1"), (3001, "", "s1"), (None, "no id", "s2"), (None, "no id", "s2"), (5, "again", "s3")]
    return rows + [(3002, "only", "\U0001f600"), (3003, "long " * 3000, "s4"), (3004, "", "empty")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("name", [WORDS, BYTES])
def test_pieces_encode_like_whole_texts(name, monkeypatch):
    from panewise.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PIECES", 20)
    encoder = Encoder(default_path(name))
    texts = [t for _, t, _ in documents() if t] + ODD
    for text in texts + texts:
        assert encoder.ids(text).tolist() == encoder.whole(text), text
    monkeypatch.setattr(tokens, "KEPT_PIECES", 10_000)
    for size in (1, 1 << 10, 1 << 20):
        monkeypatch.setattr(tokens, "TEXT_BYTES", size)
        for _ in range(2):
            got = encoder.batch([None, *texts, ""])
            assert [g.tolist() for g in got] == [[], *map(encoder.whole, texts), []]


def test_pieces_that_share_a_hash_are_encoded_whole(monkeypatch):
    from panewise.llm import tokens

    encoder = Encoder(default_path(BYTES))
    same = lambda buffer, starts, ends: (np.zeros(len(starts), np.uint64), starts.astype(np.uint64))
    monkeypatch.setattr(tokens, "word_hash_pairs", same)
    assert encoder.ids("one two three").tolist() == encoder.whole("one two three")
    assert encoder.ids(None).tolist() == encoder.ids("").tolist() == []


def test_packed_ids():
    for ids in ([], [0, 65535], [65536, 1]):
        assert unpacked(packed(np.array(ids, np.uint32))).tolist() == ids


@pytest.mark.parametrize("n,most", [(0, 1), (1, 0), (1, 10**9), (500, 3), (500, 10**7), (129, 128)])
def test_elias_fano(n, most):
    values = np.sort(np.random.default_rng(n).integers(0, most + 1, n))
    found = EliasFano.of(values, most)
    assert [found.select(i) for i in range(n)] == values.tolist()
    for v in [0, most, *values.tolist()[:40]]:
        assert list(found.find(v)) == np.flatnonzero(values == v).tolist()
    if n == 500 and most > 1000:
        bits = 8 * (len(found.low) + len(found.high) + len(found.samples))
        assert bits / n < np.log2(most / n) + 4


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 9_000)
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 500)
    rows, path = documents(), str(tmp_path / "tokens")
    token_files.write_tokens(frame(spark, rows), path, default_path(WORDS), 2)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is None, i or 0))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter(
        (i, np.array(ids_of(WORDS, t, 2), "<u4").tobytes()) for i, t, _ in rows
    )
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.crc) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens


def test_no_token_files(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_tokens(frame(spark, []), path, default_path(WORDS), 2)
    assert token_files.read_tokens(spark, path).collect() == []


def check_pieces(got, rows, window):
    want = Counter((i, tuple(ids_of(BYTES, t, 0))) for i, t, _ in rows)
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0 and r.offset + r.length <= window
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id, r.doc_tokens].append((r.start, tuple(ids)))
    assert sorted(sequences) == list(range(len(sequences)))
    for i, pieces in sequences.items():
        ends = [0] + [a + n for a, n in sorted(pieces)]
        assert [a for a, _ in sorted(pieces)] == ends[:-1]
        assert ends[-1] == window or i == len(sequences) - 1
    total = Counter()
    for (doc_id, n), pieces in docs.items():
        found = Counter(p for p in pieces)
        copies = sum(c for (i, ids), c in want.items() if i == doc_id and len(ids) == n)
        assert sum(len(p[1]) * c for p, c in found.items()) == copies * n
        total[doc_id] += copies
    assert total == Counter(i for i, _, _ in rows)


@pytest.mark.parametrize("window", [64, 1024])
def test_packing(spark, window):
    rows = documents()
    check_pieces(packing.pack(frame(spark, rows), default_path(BYTES), 0, window).collect(), rows, window)


@pytest.mark.parametrize("seed", range(6))
def test_plan_sends_every_token_once(seed):
    """Every queue cut into runs: windows are full and gapless, and no queue strays from its share."""
    rng = np.random.default_rng(seed)
    for _ in range(25):
        window, n = int(rng.integers(8, 60)), int(rng.integers(1, 7))
        sizes = [int(rng.integers(0, 900)) for _ in range(n)]
        weights = [int(x) for x in (rng.integers(1, 9, n) if seed % 2 else np.maximum(1, sizes))]
        if seed % 3 == 0:
            weights[-1] = 0
        elif min(weights[:-1], default=sum(weights)) * window < sum(weights):
            continue
        phases = packing.plan(sizes, weights, window)
        seen = defaultdict(list)
        for q, size in enumerate(sizes):
            cuts = np.unique(np.r_[0, rng.integers(0, size + 1, 5), size])
            pieces = packing.Cutter(phases, q, window).cut(cuts[:-1], cuts[1:])
            for _, place, length, sequence, offset in zip(*(c.tolist() for c in pieces)):
                seen[sequence].append((offset, length, q, place))
        sent, total = [0] * n, sum(sizes)
        assert sorted(seen) == list(range(-(-total // window)))
        for sequence in sorted(seen):
            at = 0
            for offset, length, q, place in sorted(seen[sequence]):
                assert offset == at and place == sent[q]
                at, sent[q] = at + length, sent[q] + length
            assert at == min(window, total - sequence * window)
            for phase in phases:  # within a phase no queue is a token away from its share
                j = sequence + 1 - phase.first
                if phase.amounts is None and 0 < j <= phase.count:
                    for q in range(n):
                        rate = phase.upto[q] - (phase.upto[q - 1] if q else 0)
                        assert abs(sent[q] - phase.before[q] - j * window * rate / phase.upto[-1]) < 1
        assert sent == sizes


def test_exact_division():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = int(rng.integers(1, 1 << 55)), int(rng.integers(1, 1 << 45))
        k = rng.integers(0, 1 << 35, 20)
        if a // b < 1 << 20:
            assert packing.scaled(k, a, b).tolist() == [int(x) * a // b for x in k]


def held_by_source(pieces, source):
    held = defaultdict(Counter)
    for r in pieces:
        held[r.sequence_id][source[r.doc_id]] += r.length
    return [held[i] for i in range(len(held))]


def test_windows_hold_the_proportions(spark, sf):
    """On whole texts: in every window each source is within one token of its share and deficit."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(docs, default_path(BYTES), 0, 1024).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    size, sent = Counter(), Counter()
    for r in got:
        size[source[r.doc_id]] += r.length
    total = sum(size.values())
    windows = held_by_source(got, source)
    for k, held in enumerate(windows[:-1], 1):
        for name in size:
            sent[name] += held[name]
            assert abs(sent[name] - k * 1024 * size[name] / total) < 1
            assert abs(held[name] - 1024 * size[name] / total) < 2


def test_weights_hold_while_queues_last(spark):
    rows = [(i, "alpha beta gamma delta " * (i % 7), "abcd"[i % 4]) for i in range(2000)]
    rows += [(5000 + i, "rare", f"s{i}") for i in range(3)]
    weights = {"a": 3.0, "b": 1.0, "c": 0.5, "d": 0, "s0": 0.001, "s1": 0.001, "s2": 0.001}
    got = packing.pack(frame(spark, rows), default_path(BYTES), 0, 256, weights=weights).collect()
    check_pieces(got, rows, 256)
    size, source = Counter(), {i: s for i, _, s in rows}
    for r in got:
        size[source[r.doc_id]] += r.length
    windows, sent, total = held_by_source(got, source), Counter(), 4.503
    last = int(size["a"] / (256 * 3 / total))
    assert last > 10
    for k, held in enumerate(windows[:last], 1):
        sent.update(held)
        for name in "abc":
            assert abs(sent[name] - k * 256 * weights[name] / total) < 1.1
        assert not held["d"]
    after = [i for i, held in enumerate(windows) if held["d"]]
    assert after and all(set(windows[i]) == {"d"} for i in after[1:])


def test_refused_and_missing_weights(spark):
    rows = [(i, "alpha beta", None if i % 2 else "a") for i in range(300)]
    with pytest.raises(ValueError):
        packing.pack(frame(spark, rows), default_path(BYTES), 0, 64, weights={"a": -1.0})
    got = packing.pack(frame(spark, rows), default_path(BYTES), 0, 64, weights={None: 3.0}).collect()
    early = held_by_source(got, {i: s for i, _, s in rows})[:3]
    assert all(abs(h[None] - 48) < 2 for h in early)
    check_pieces(packing.pack(frame(spark, rows), default_path(BYTES), 0, 64, weights={}).collect(), rows, 64)


def test_more_sources_than_tokens_of_a_window(spark):
    rows = [(i, f"text {i}", f"source {i}") for i in range(400)] + [(900 + i, "one two three " * 30, "big") for i in range(40)]
    got = packing.pack(frame(spark, rows), default_path(BYTES), 0, 32).collect()
    check_pieces(got, rows, 32)


def brute_targets(sizes, weights, epochs):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_names, target = float(sum(sizes.values())), list(names), {}
    while open_names:
        unit = left / sum(weight[s] for s in open_names)
        full = [s for s in open_names if unit * weight[s] > epochs * sizes[s]]
        if not full:
            return target | {s: unit * weight[s] for s in open_names}
        for s in full:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
            open_names.remove(s)
    return target


@pytest.mark.parametrize("parts", [1, 20_000])
def test_mixing(spark, parts, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", parts)
    rows = documents()
    got = mixing.mix(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(frame(spark, rows[::-1])).collect()), key=repr)
    size = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.whole * r.size + r.part
    want = brute_targets(sizes, (5, 2, 1), 3)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12, abs=1e-9)
    for source in sizes:
        assert want[source] - 1 - 1e-6 < taken[source] <= want[source] + 1e-6
        # at most one document of a source is cut, and counts differ by one epoch at most
        own = [r for r in got if r.source == source and r.size]
        assert sum(r.part > 0 for r in own) <= 1
        assert max((r.whole for r in own), default=0) - min((r.whole for r in own), default=0) <= 1


def test_taking(spark):
    rows = documents()
    df = frame(spark, rows)
    got = mixing.take(df)
    assert got.columns == df.columns
    texts = Counter((r.doc_id, r.source, r.text) for r in got.collect())
    want = Counter()
    for r in mixing.mix(df, keep_text=True).collect():
        want[r.doc_id, r.source, r.text] += r["__mix"].whole
        if r["__mix"].part:
            want[r.doc_id, r.source, " ".join(r.text.split()[: r["__mix"].part])] += 1
    assert texts == +want


def test_empty_tables(spark):
    none = frame(spark, [])
    assert mixing.mix(none).collect() == [] and mixing.take(none).collect() == []
    assert packing.pack(none, default_path(BYTES), 0).collect() == []
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None)])).collect()] == [0]


def test_registered_queries(spark, sf):
    from panewise.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at, want = 0, []
    for doc_id in sorted(texts):
        ids = ids_of(WORDS, texts[doc_id], 2)
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op7_elias_fano_tokens"](spark, sf).collect())) == want
    got = QUERIES["op8_round_robin_packing"](spark, sf).collect()
    for r in got:
        ids = np.array(ids_of(BYTES, texts[r.doc_id], 0), "<u4")
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in got) == sum(len(ids_of(BYTES, t, 0)) for t in texts.values())


def test_hash_pairs_are_the_two_hashes():
    from panewise.llm import hashing

    rng = np.random.default_rng(9)
    for sizes in ([], [0], [1, 48, 49, 47, 0, 5000, 3, 3], rng.integers(0, 60, 300).tolist()):
        ends = np.cumsum(np.array(sizes, np.int64))
        starts, buffer = ends - np.array(sizes, np.int64), rng.bytes(sum(sizes))
        found = hashing.word_hash_pairs(buffer, starts, ends)
        want = [hashing.word_hashes(buffer, starts, ends, v) for v in (hashing.BYTE_VALUES, hashing.OTHER_VALUES)]
        assert all((a == b).all() for a, b in zip(found, want))


def test_wide_ids_fit():
    values = np.array([0, 5, 2**40, 2**63 + 3, 2**64 - 1], np.uint64)
    found = EliasFano.of(values, 2**64 - 1)
    assert [found.select(i) for i in range(5)] == [int(v) for v in values]
    assert list(found.find(2**63 + 3)) == [3] and not list(found.find(7))


def test_lookup_by_id(spark, tmp_path, monkeypatch):
    """Over several shards and segments, with negative, far, repeated and null ids."""
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 60)
    monkeypatch.setattr(token_files, "SHARD_BYTES", 300)
    ids = [-(2**63), -5, *range(0, 300, 3), 2**62, 2**63 - 1, 30, 30, None, None]
    rows = [(i, f"text of {i} and {k}", "s") for k, i in enumerate(ids)]
    path = str(tmp_path / "files")
    token_files.write_tokens(frame(spark, rows), path, default_path(WORDS), 2)
    segments = spark.read.parquet(path)
    assert segments.count() > 8 and segments.select("shard").distinct().count() > 1
    read = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted((i for i in ids if i is not None)) + [None, None]
    encode = Encoder(default_path(WORDS))
    want = Counter((i, tuple([*encode.whole(t), 2])) for i, t, _ in rows if i in (-(2**63), -5, 3, 30, 2**63 - 1))
    got = token_files.lookup(spark, path, [3, 30, 4, -5, 2**63 - 1, -(2**63), 1000]).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert token_files.lookup(spark, path, []).collect() == [] == token_files.lookup(spark, path, [1]).collect()
