"""Substring, suffix, line and SimHash dedup against brute force on small documents."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from panewise.llm import lines, simhash, substrings, suffixes
from panewise.llm.components import roots
from panewise.llm.hashing import grams, leftmost_min, word_hashes, word_spans

SCHEMA = "doc_id long, text string, chunk int, bucket string, row int"


def documents(seed=3, n=60):
    """Texts with copies, shared passages, long words, odd white space, nulls and ties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(40)] + ["x" * 90]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages = [prose(30), prose(14), prose(13), prose(12)]
    out = []
    for i in range(n):
        parts = [prose(rng.randint(0, 25)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        out.append((rng.randint(0, 3 * n), rng.choice(["\n", "  ", "\t", " "]).join(parts)))
    out += [(i, out[rng.randrange(n)][1]) for i in range(200, 215)]
    out += [(7, None), (8, ""), (9, " \n "), (None, out[0][1]), (None, out[0][1]), (10, out[0][1]), (10, out[0][1])]
    out += [(11, "word"), (12, "A b"), (13, "ab " * 400), (14, "ab " * 700)]
    return out


@pytest.fixture(scope="module")
def docs():
    return documents()


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 5, "b", 1) for i, t in docs], SCHEMA)


def later_starts(items, docs, size):
    """Places whose run of ``size`` also starts in a document with a smaller id."""
    first = {}
    for (doc_id, _), seq in zip(docs, items):
        if doc_id is not None:
            for p in range(len(seq) - size + 1):
                key = tuple(seq[p : p + size])
                first[key] = min(first.get(key, doc_id), doc_id)
    for (doc_id, _), seq in zip(docs, items):
        gone = [False] * len(seq)
        for p in range(len(seq) - size + 1):
            key = tuple(seq[p : p + size])
            if key in first and (doc_id is None or first[key] < doc_id):
                gone[p : p + size] = [True] * size
        yield gone


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_rolling_hashes():
    tokens = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for size in (1, 2, 5, 13, 16, 50):
        found = grams(np.r_[tokens, tokens], size)
        assert len(found) == 2 * len(tokens) - size + 1
        assert found[0] == found[len(tokens)] and len(set(found.tolist())) == len(tokens)
    values = np.random.default_rng(1).integers(0, 9, 50).astype(np.uint64) << np.uint64(40)
    for size in (1, 3, 8, 35):
        want = [p + int(np.argmin(values[p : p + size])) for p in range(len(values) - size + 1)]
        assert leftmost_min(values, size).tolist() == want
    assert len(leftmost_min(values, 51)) == len(grams(tokens, 60)) == 0


def test_word_hashes_tell_words_apart():
    words = [b"a", b"b", b"ab", b"ba", b"x" * 48, b"x" * 49, b"y" * 10_000, b"y" * 10_001, "é".encode()]
    buffer = b" ".join(words + words)
    found = word_hashes(buffer, *word_spans(buffer))
    assert found[: len(words)].tolist() == found[len(words) :].tolist()
    assert len(set(found.tolist())) == len(words)


def test_substrings(spark, docs):
    items = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for _, t in docs]
    want = []
    for (doc_id, _), words, gone in zip(docs, items, later_starts(items, docs, 13)):
        kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        want.append((doc_id, len(words), sum(gone), kept))
    got = substrings.drop_repeats(frame(spark, docs)).collect()
    assert ordered(got) == ordered(want)
    assert sum(w[2] for w in want) > 500


def test_suffixes(spark, docs):
    items = [(t or "").encode() for _, t in docs]
    want = []
    for (doc_id, _), data, gone in zip(docs, items, later_starts(items, docs, 50)):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((doc_id, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    got = [(*r[:4], bytes(r.kept)) for r in suffixes.drop_repeated_bytes(frame(spark, docs)).collect()]
    assert ordered(got) == ordered(want)
    assert sum(w[2] for w in want) > 2_000


@pytest.mark.parametrize("chunk", [1 << 9, 1 << 12])
def test_small_chunks_change_nothing(spark, docs, monkeypatch, chunk):
    from panewise.llm import chunks

    df = frame(spark, docs)
    before = [ordered(f(df).collect()) for f in (substrings.drop_repeats, suffixes.drop_repeated_bytes)]
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffixes, "BLOCK", 300)
    after = [ordered(f(df).collect()) for f in (substrings.drop_repeats, suffixes.drop_repeated_bytes)]
    assert before == after


@pytest.mark.parametrize("bucket, levels", [(1 << 12, 2), (1 << 10, 3)])
def test_relays_change_nothing(spark, docs, monkeypatch, bucket, levels):
    from panewise.llm import chunks

    df = frame(spark, docs)
    operators = (substrings.drop_repeats, suffixes.drop_repeated_bytes)
    before = [ordered(f(df).collect()) for f in operators]
    for name, value in (("CHUNK_BYTES", 1 << 10), ("FAN_BITS", 2), ("BUCKET_BYTES", bucket)):
        monkeypatch.setattr(chunks, name, value)
    assert chunks.in_chunks(df, "doc_id", "text")[1].levels == levels
    assert [ordered(f(df).collect()) for f in operators] == before


def shuffled_rows(plan):
    """Rows that the exchanges of a finished plan have written, reused ones once."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled_rows(plan.executedPlan())
    if name == "ReusedExchange":
        return 0
    if "QueryStage" in name:
        return shuffled_rows(plan.plan())
    found = plan.metrics().get("shuffleRecordsWritten")
    below = plan.children()
    total = found.get().value() if found.isDefined() else 0
    return total + sum(shuffled_rows(below.apply(i)) for i in range(below.size()))


@pytest.mark.parametrize("operator", [substrings.drop_repeats, suffixes.drop_repeated_bytes])
def test_rows_exchanged_grow_with_the_text(spark, monkeypatch, operator):
    """Sizes scaled down together: eight times the text needs more levels."""
    from panewise.llm import chunks

    for name, value in (("CHUNK_BYTES", 1 << 10), ("FAN_BITS", 2), ("BUCKET_BYTES", 1 << 14)):
        monkeypatch.setattr(chunks, name, value)
    rows, levels = [], []
    for n in (200, 1600):
        rng = random.Random(n)
        shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(20))
        texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(20)] + [shared] * (i % 3 == 0)) for i in range(n)]
        df = frame(spark, list(enumerate(texts)))
        levels.append(chunks.in_chunks(df, "doc_id", "text")[1].levels)
        out = operator(df)
        out.collect()
        rows.append(shuffled_rows(out._jdf.queryExecution().executedPlan()) / n)
    assert levels[0] == 1 < levels[1]
    # a level more adds the same number of rows for each document; buckets by chunks would quadruple it
    assert all(r <= 1.15 * rows[0] * level / levels[0] for r, level in zip(rows, levels)), (rows, levels)


def brute_fingerprint(text, shingle):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    spans = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, threshold):
    parent = {p: p for p in set(prints)}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= threshold:
                parent[find(a)] = find(b)
    return {p: find(p) for p in parent}


@pytest.mark.parametrize("threshold", [0, 2, 4])
def test_simhash(spark, docs, threshold):
    prints = [brute_fingerprint(t, 3) for _, t in docs]
    part = brute_components(prints, threshold)
    least = defaultdict(lambda: None)
    for (doc_id, _), p in zip(docs, prints):
        if doc_id is not None:
            least[part[p]] = min(doc_id, doc_id if least[part[p]] is None else least[part[p]])
    want = [(i, f"{p:016x}", least[part[p]]) for (i, _), p in zip(docs, prints)]
    got = simhash.near_groups(frame(spark, docs), threshold=threshold)
    assert ordered(got.select("doc_id", "fingerprint", "component_id").collect()) == ordered(want)


def clustered(n=400, seed=5):
    """Fingerprints in tight clusters, chains among them."""
    rng = np.random.default_rng(seed)
    out = list(rng.integers(0, 1 << 63, 40, dtype=np.uint64)) + [np.uint64(0), np.uint64(2**64 - 1)]
    while len(out) < n:
        p = int(out[rng.integers(len(out))])
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            p ^= 1 << int(b)
        out.append(np.uint64(p))
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("code", [[7] * 9 + [1], [5] * 12 + [3, 1], [3] * 21 + [1], [3] * 11 + [1] * 31])
@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_every_code_covers(code, threshold, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 500)
    prints = clustered()
    a, b = simhash.stars(*simhash.replicas(prints, code, threshold), threshold)
    parent = {int(p): int(p) for p in prints}
    parent.update(zip(a.tolist(), b.tolist()))
    want = brute_components([int(p) for p in prints], threshold)
    groups = lambda of: sorted(sorted(p for p in of if of[p] == r) for r in set(of.values()))
    assert groups(parent) == groups(want)


@pytest.mark.parametrize("threshold", [0, 1, 2])
def test_tight_cluster_goes_by_a_finer_code(monkeypatch, threshold):
    """More distinct fingerprints in a cell than ways to change the bits, and some elsewhere."""
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 20_000)
    rng = np.random.default_rng(7)
    base = np.uint64(0b1011)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(4500)]
    prints = np.unique(np.array([int(base) ^ f for f in flips] + rng.integers(0, 2**63, 50).tolist(), np.uint64))
    code = [64 - 1, 1]  # nearly all lie in one cell
    a, b = simhash.stars(*simhash.replicas(prints, code, threshold), threshold)
    parent = {int(p): int(p) for p in prints}
    parent.update(zip(a.tolist(), b.tolist()))
    known, part = set(map(int, prints)), {}
    masks = [int(m) for m in simhash.flips(threshold)] if threshold else []
    for p in sorted(known):
        if p in part:
            continue
        part[p], todo = p, [p]
        while todo:
            x = todo.pop()
            for m in masks:
                if x ^ m in known and x ^ m not in part:
                    part[x ^ m] = p
                    todo.append(x ^ m)
    by = lambda of: sorted(tuple(sorted(v)) for v in _inverted(of))
    assert by(parent) == by(part)
    assert np.unique(simhash.homes(prints, code)[0], return_counts=True)[1].max() > 2080


def _inverted(of):
    parts = {}
    for p, root in of.items():
        parts.setdefault(root, []).append(p)
    return parts.values()


def test_code_grows_with_the_corpus():
    sizes = [len(simhash.code_for(n)) for n in (1, 20_000, 300_000, 10**9, 10**13)]
    assert sizes == sorted(sizes)
    assert all(sum(simhash.code_for(n)) == 64 for n in (1, 20_000, 300_000, 10**9, 10**13, 10**18))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (60, 61), (61, 60)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {61: 60}
    assert got == want


def test_patience():
    assert sorted(lines.patience([1, 2, 3], [1, 2, 3])) == [0, 1, 2]
    assert sorted(lines.patience([9, 1, 2, 8, 3], [1, 2, 7, 3])) == [1, 2, 4]
    assert sorted(lines.patience([5, 1, 5, 2, 5], [5, 1, 5, 2, 5, 4])) == [0, 1, 2, 3, 4]
    assert lines.patience([1, 2], [3]) == [] and lines.patience([], [1]) == []
    assert len(lines.patience([1, 2, 3, 4], [4, 1, 2, 3])) == 3


def test_lines(spark):
    a, b, c, d = ("line " + x * 9 for x in "abcd")
    texts = [
        (1, "\n".join([a, b, "", c])),
        (2, "\n".join(["own", a, b, "", c, "tail"])),
        (3, "\n".join([a, b, "", c])),
        (4, "\n".join([d, "  ", c])),
        (5, None),
        (6, ""),
        (None, a),
        (7, "\n".join([c, a])),
        (3, "\n".join([a, b, "", c])),
    ]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, row int, h string")
    got = [(r.row.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.drop_lines(df).collect()]
    want = [
        (1, texts[0][1], 4, 0),
        (2, "own\n\ntail", 6, 3),
        (3, "", 4, 4),
        (3, "", 4, 4),
        (4, d + "\n  ", 3, 1),
        (5, None, 0, 0),
        (6, "", 0, 0),
        (None, a, 1, 0),
        (7, "", 2, 2),  # c is aligned with 4, and a or c with 1
    ]
    assert ordered(got) == ordered(want)


def test_lines_leave_no_shared_block(spark, docs):
    """Of whole copies only the first keeps its lines, and unshared lines always stay."""
    got = {}
    for r in lines.drop_lines(frame(spark, docs)).collect():
        got.setdefault(r.row.doc_id, []).append(r.text)
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            held[line].add(i)
    for i, t in docs:
        own = [x for x in (t or "").split("\n") if x.strip(" \t\n") and held[x] == {i}]
        assert any(all(x in (kept or "").split("\n") for x in own) for kept in got[i])
        earlier = [j for j, u in docs if u == t and t and t.strip(" \t\n") and j is not None and i is not None and j < i]
        if earlier:
            assert "" in got[i]


@pytest.mark.parametrize(
    "operator", [substrings.drop_repeats, suffixes.drop_repeated_bytes, simhash.near_groups, lines.drop_lines]
)
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []
    assert operator(spark.createDataFrame([(None, None, 1, "", 1)], SCHEMA)).count() == 1


def test_query_digests(spark, sf):
    from panewise.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op3_patience_lines"](spark, sf).collect()}
    kept = {r.row.doc_id: r for r in lines.drop_lines(table).collect()}
    assert len(got) == table.count()
    for doc_id, r in kept.items():
        assert got[doc_id].kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        assert (got[doc_id].n_lines, got[doc_id].n_removed) == (r.n_lines, r.n_removed)
