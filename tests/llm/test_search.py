"""Exact top-k and block matrix neighbours against brute force."""

import math

import numpy as np
import pytest

from panewise.llm import bitslice, neighbours

SCHEMA = "vec_id long, embedding array<float>, block int, batch string"


def vectors(seed=2, n=300, width=12):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.standard_normal(width) / 3).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(500, [0.0] * width), (501, None), (502, []), (503, [1.0] + [None] * (width - 1))]
    rows += [(504, [float("nan")] * width), (505, [float("inf")] * width), (None, rows[0][1])]
    rows += [(10, rows[10][1]), (520, [0.5, -0.25]), (540, [2.0] * (width + 3))]
    return rows


def usable(rows, zero):
    found = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if zero or any(v):
            found[i] = min(found.get(i, v), v)
    return found


def brute(rows, step, k, score, zero):
    found, out = usable(rows, zero), []
    for q in sorted(i for i in found if i % step == 0):
        best = sorted((-score(found[q], v), i) for i, v in found.items() if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return out


def integers(q, v):
    return sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(q, v))


def products(q, v):
    total = 0.0
    for a, b in zip(q, v):
        total += a * b
    return total


@pytest.mark.parametrize("block,batch", [(16384, 4096), (50, 3)])
def test_bit_sliced_top_k(spark, block, batch):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    got = bitslice.top_k(df, df.where("vec_id % 20 = 0"), k=5, block_rows=block, batch_rows=batch)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == brute(single, 20, 5, integers, True)


@pytest.mark.parametrize("dropped", [0, 1, 3, 6])
def test_index_never_misses(dropped):
    rng = np.random.default_rng(4)
    for _ in range(30):
        x = rng.integers(-200, 200, (rng.integers(1, 200), 7))
        q = rng.integers(-200, 200, 7) * rng.integers(0, 2, 7)
        index = bitslice.Index(x, dropped)
        allowed = rng.random(len(x)) < 0.8
        found = set(index.candidates(q, bitslice.pack(allowed), 4).tolist())
        scores = x @ q
        places = np.flatnonzero(allowed)
        best = places[np.lexsort((places, -scores[places]))[:4]]
        assert set(best.tolist()) <= found <= set(places.tolist())


def test_sums_are_the_sliced_sums():
    rng = np.random.default_rng(6)
    x, q = rng.integers(-50, 50, (130, 5)), np.array([3, -7, 0, 12, -1])
    index = bitslice.Index(x, 0)
    total = sum(np.unpackbits(s.view(np.uint8), count=130, bitorder="little").astype(int) << p for p, s in enumerate(index.sums(q)))
    shift = total - x @ q
    assert (shift == shift[0]).all()


@pytest.mark.parametrize("block,batch", [(8192, 4096), (64, 4)])
def test_neighbours(spark, block, batch, monkeypatch):
    monkeypatch.setattr(neighbours, "PAIRS_AT_ONCE", 100)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=7, block_rows=block, batch_rows=batch)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == brute(single, 20, 7, products, False)


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [-1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.nearest(df, df.where("vec_id = 0"), k=20).collect()))
    assert got == [(0, 1, 1, 2.0), (0, 2, 20, -1.0)]
    got = sorted(map(tuple, bitslice.top_k(df, df.where("vec_id = 0"), k=5).collect()))
    assert got == [(0, 1, 1, 131072), (0, 2, 20, -65536)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(df, df).collect() == [] and bitslice.top_k(df, df).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, "")], SCHEMA)
    assert neighbours.nearest(one, one).collect() == [] and bitslice.top_k(one, one).collect() == []


def test_registered_neighbours(spark, sf):
    from panewise.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(map(tuple, QUERIES["op9_block_matrix_neighbours"](spark, sf).collect()))
    assert got == brute(rows, 20, 20, products, False)
