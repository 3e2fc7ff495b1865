"""Ranked search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from panewise.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    own = [(i, Counter(words(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own]
    n_docs, n_terms = sum(n > 0 for _, _, n in own), sum(n for _, _, n in own)
    holders = Counter(t for _, c, _ in own for t in c)
    texts = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(texts.get(i, t), t)
    out = []
    for item, text in texts.items():
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1))) for t in set(words(text))}
        scored = []
        for i, c, n in own:
            m = n and 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weights.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def made(seed=3, n=400):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve", "X9"]
    pick = lambda size: " ".join(rng.choice(vocabulary, size, p=None)) + rng.choice([".", "!?", "-tail", ""])
    docs = [(i, pick(int(rng.integers(1, 120)))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(90)]  # ties
    docs += [(2000, None), (2001, ""), (2002, " .,;\t\n"), (None, docs[3][1]), (5, docs[5][1]), (2003, docs[9][1] * 300)]
    items = [(i, pick(int(rng.integers(1, 12)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "??"), (None, "w1"), (3, "w1 w1 W2"), (23, "nowhere"), (24, docs[7][1])]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, score int, terms string")
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    return d, q


@pytest.mark.parametrize("small", [False, True])
def test_same_as_brute_force(spark, monkeypatch, small):
    docs, items = made()
    if small:  # several groups of items, buckets and stretches of text
        for name, value in (("QUERY_BYTES", 60), ("BUCKET_ROWS", 16), ("BUCKET_CELLS", 1), ("SAMPLE", 3)):
            monkeypatch.setattr(ranking, name, value)
    got = ranking.top_documents(*frames(spark, docs, items), k=10)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 10)


def test_empty(spark):
    docs, items = made(n=20)
    assert ranking.top_documents(*frames(spark, [], items), k=5).collect() == []
    assert ranking.top_documents(*frames(spark, docs, []), k=5).collect() == []
    assert ranking.top_documents(*frames(spark, [(1, None), (2, "")], items), k=5).collect() == []


@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_pieces_cut_between_terms(monkeypatch, size):
    monkeypatch.setattr(ranking, "TEXT_BYTES", size)
    rng = np.random.default_rng(4)
    for _ in range(60):
        text = "".join(rng.choice(list("aBc9é .-\n"), rng.integers(0, 60)))
        total, counts = ranking.term_counts(text.encode(), lambda w: w)
        want = Counter(w.encode() for w in words(text))
        assert counts == want and total == sum(want.values())


def test_buckets_never_lose_a_document(monkeypatch):
    """Thresholds, buckets and bounds against plain scores, with heavy and light vectors."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    for trial in range(20):
        width, n = 40, 200
        owned = [np.sort(rng.choice(width, rng.integers(0, 20), replace=False)) for _ in range(n)]
        tfs = [rng.integers(1, 9, len(o)) for o in owned]
        batch = pa.record_batch(
            [pa.array(rng.permutation(n)), pa.array([int(t.sum()) + 5 for t in tfs]),
             pa.array([o.tolist() for o in owned], pa.list_(pa.int32())), pa.array([t.tolist() for t in tfs], pa.list_(pa.int64()))],
            names=["doc_id", "n", "terms", "counts"],
        )
        terms = [np.sort(rng.choice(width, rng.integers(1, 15), replace=False)) for _ in range(8)]
        queries = ranking.Queries(list(range(8)), terms, [rng.integers(0, 9000, len(t)) for t in terms])
        monkeypatch.setattr(ranking, "BUCKET_ROWS", int(rng.integers(16, 60)))
        best = ranking.Best(queries, 7, np.ones(8, np.int64))
        ranking.search_batch(batch, queries, width, n, int(sum(t.sum() + 5 for t in tfs)), best)
        m = 50 + (50 * batch["n"].to_numpy() * n) // int(sum(t.sum() + 5 for t in tfs))
        for q in range(8):
            weight = dict(zip(queries.terms[q].tolist(), queries.weights[q].tolist()))
            plain = [
                (-sum(weight.get(int(t), 0) * ((10**9 * int(f)) // (1000 * int(f) + 20 * int(m[i]))) for t, f in zip(o, tf)), d)
                for i, (o, tf, d) in enumerate(zip(owned, tfs, batch["doc_id"].to_pylist()))
            ]
            want = sorted(p for p in plain if p[0] < 0)[:7]
            assert [(-s, d) for s, d in zip(best.scores[q].tolist(), best.docs[q].tolist())] == want
