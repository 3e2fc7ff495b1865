"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from panewise.llm import negatives
from tests.llm.test_search import integers

SCHEMA = "vec_id long, embedding array<float>, label int, block int, positives string"


def vectors(seed=5, n=260, width=14):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((4, width))
    rows = [
        (i, ((centre[i % 4] + rng.standard_normal(width)) / 4).astype(np.float32).tolist(), int(rng.integers(0, 4)))
        for i in range(n)
    ]
    rows += [(400 + i, rows[10][1], i % 3) for i in range(50)]  # ties over labels
    rows += [(500, [0.0] * width, 1), (520, None, 1), (521, [], 1), (522, [1.0] + [None] * (width - 1), 1)]
    rows += [(523, [math.nan] * width, 1), (524, [math.inf] * width, 2), (None, rows[0][1], 1), (525, rows[4][1], None)]
    rows += [(20, rows[20][1], 3), (540, [0.5, -0.25], 2), (560, [2.0] * (width + 3), 0), (580, rows[1][1], 77)]
    return rows


def brute(rows, step=20, positives=5, count=3, low=50, high=95):
    found = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        found[i] = min(found.get(i, (v, label)), (v, label))
    out = []
    for a in sorted(i for i in found if i % step == 0):
        scored = sorted((-integers(found[a][0], v), i, label) for i, (v, label) in found.items() if i != a)
        for score, p, _ in [s for s in scored if s[2] == found[a][1]][:positives]:
            inside = [s for s in scored if s[2] != found[a][1] and low * -score <= 100 * -s[0] <= high * -score]
            out += [(a, p, r, i, -score, -s) for r, (s, i, _) in enumerate(inside[:count], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)


@pytest.mark.parametrize("block,batch,steps,lists", [(8192, 4096, 4, 8), (40, 5, 2, 3), (100, 50, 1, 20)])
def test_same_as_brute_force(spark, monkeypatch, block, batch, steps, lists):
    monkeypatch.setattr(negatives, "STEPS", steps)
    monkeypatch.setattr(negatives, "LISTS_AT_ONCE", lists)
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 3)
    rows = vectors()
    df = frame(spark, rows)
    got = negatives.mine(df, df.where("vec_id % 20 = 0"), block_rows=block, batch_rows=batch)
    single = [
        (i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows
    ]
    want = brute(single)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_other_windows(spark):
    rows = vectors(seed=9, n=120)
    df = frame(spark, rows)
    got = negatives.mine(df, df.where("vec_id % 30 = 0"), positives=2, negatives=4, low_percent=10, high_percent=120)
    single = [
        (i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows
    ]
    assert sorted(map(tuple, got.collect())) == brute(single, 30, 2, 4, 10, 120)


def test_threshold_join_never_misses():
    rng = np.random.default_rng(4)
    for _ in range(40):
        x = rng.integers(-200, 200, (rng.integers(1, 120), rng.integers(1, 25)))
        q = rng.integers(-200, 200, (5, x.shape[1])) * rng.integers(0, 2, x.shape[1])
        labels, own = rng.integers(0, 3, len(x)), rng.integers(0, 3, 5)
        block = negatives.Block(np.arange(len(x)), labels, x)
        scores = q @ x.T
        reach = rng.choice([-np.inf, 0, 1, 5000, 60000, 300000], 5).astype(np.float64)
        for same in (True, False):
            a, r, s = block.at_least(np.arange(5), own, q, reach, same)
            mask = (scores >= reach[:, None]) & ((own[:, None] == labels) == same)
            mask &= np.arange(5)[:, None] != np.arange(len(x))
            assert sorted(zip(a.tolist(), r.tolist(), s.tolist())) == sorted(
                (i, j, int(scores[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(mask)))
            )


def test_lists_omit_what_cannot_reach():
    x = np.array([[100, 1, 1], [50, 50, 50], [1, 0, 0]])
    block = negatives.Block(np.arange(3), np.zeros(3, int), x)
    depth = block.depths(60.0 * 100, 100.0)
    assert depth.tolist() == [1, 2, 0]


def test_empty(spark):
    df = frame(spark, vectors(n=30))
    assert negatives.mine(df.limit(0), df).collect() == []
    assert negatives.mine(df, df.limit(0)).collect() == []
    assert negatives.mine(df.where("label is null"), df).collect() == []
