"""The classifier: gradients, whole texts, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest

from panewise.llm import quality

JUNK = ["BUY!! NOW!! " * 40, "a | b | c | " * 30, "spam spam spam " * 30]


def samples(n=240, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 4 == 0:
            text = JUNK[i // 4 % 3][rng.integers(9) :]
        else:
            text = " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(20, 200)))
        rows.append((i, text, int(i % 4 != 0)))
    return rows


def test_gradients():
    texts = [t.encode() for _, t, _ in samples(8)] + [b"", b"x" * 700]
    labels, importance = np.array([0, 1, 1, 1, 0, 1, 1, 1, 0, 1]), np.linspace(1, 2, 10)
    w = quality.fresh(3)
    for name in ("embed", "filters", "filter_bias", "hidden", "hidden_bias", "out", "out_bias"):
        setattr(w, name, getattr(w, name).astype(np.float64))
    for bias in (w.filter_bias, w.hidden_bias):  # off the corner of the rectifier
        bias += np.random.default_rng(2).standard_normal(len(bias)) / 10

    def loss():
        p = quality.scores(w, texts)
        return -(importance * np.where(labels == 1, np.log(p), np.log(1 - p))).sum() / importance.sum()

    found = quality.gradients(w, texts, labels, importance)
    rng = np.random.default_rng(0)
    for a, d in zip(w.all(), found):
        for place in rng.choice(a.size, min(12, a.size), replace=False):
            at, step = np.unravel_index(place, a.shape), 1e-7
            if a is w.embed and at[0] == quality.PAD:
                continue
            before = a[at]
            a[at] = before + step
            up = loss()
            a[at] = before - step
            down = loss()
            a[at] = before
            assert d[at] == pytest.approx((up - down) / (2 * step), rel=1e-2, abs=1e-5)


def test_score_is_of_the_text_alone():
    w = quality.fresh(5)
    texts = [t.encode() for _, t, _ in samples(12)] + [b"", b"a" * 191, b"a" * 192, b"a" * 193, b"b" * 5000]
    together = quality.scores(w, texts)
    alone = np.concatenate([quality.scores(w, [t]) for t in texts])
    assert together == pytest.approx(alone, abs=1e-6)


@pytest.mark.parametrize("bound", [1, 400, 2000, 1 << 18])
def test_long_texts_in_stretches(monkeypatch, bound):
    """Any stretch length gives the score of the text in one piece, within bounded memory."""
    monkeypatch.setattr(quality, "SCORE_BYTES", bound)
    w, rng = quality.fresh(5), np.random.default_rng(6)
    for n in (0, 1, 191, 192, 193, 383, 384, 577, 768, 769, 5000, 20011):
        text = rng.bytes(n)
        assert quality.long_score(w, text) == pytest.approx(quality.scores(w, [text])[0], abs=1e-6)
    seen = []
    layout = quality.Layout.__init__
    monkeypatch.setattr(quality.Layout, "__init__", lambda self, t, b=None: (seen.append(len(t[0])), layout(self, t, b))[1])
    quality.long_score(w, rng.bytes(1 << 20))
    assert max(seen) <= bound + 4 * quality.BLOCK * quality.STRIDE


def test_chunks_cover_every_block():
    for n in (0, 1, 192, 600, 5000, 5001):
        layout = quality.Layout([b"x" * n, b"y" * 300])
        first = -(-max(1, n) // (quality.BLOCK * quality.STRIDE))
        assert set(layout.chunks[: layout.chunk_counts[0]].ravel()) == set(range(first))
        assert len(layout.chunks) == layout.chunk_counts.sum()


def test_end_of_a_long_text_counts():
    w = quality.fresh(5)
    body = b"plain words here " * 3000
    assert quality.scores(w, [body])[0] != quality.scores(w, [body + b"\xff\xfe\x01\x02" * 200])[0]


@pytest.fixture(scope="module")
def scored(spark):
    rows = samples()
    docs = [(i, t, 1, 0.5) for i, t, _ in rows]
    docs += [(None, rows[0][1], 1, 0.5), (None, None, 1, 0.5), (900, None, 1, 0.5), (901, "", 1, 0.5), (4, rows[4][1], 1, 0.5)]
    docs += [(902, rows[1][1] * 300, 1, 0.5)]
    labels = [(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (5000, 0, 1), (900, 7, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, held_out int, score double")
    return rows, quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()


def test_held_out_accuracy(scored):
    rows, got = scored
    by_id = {r.doc_id: r for r in got}
    out = [(by_id[i].predicted, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(out) > 50 and np.mean([a == b for a, b in out]) > 0.9


def test_rows(scored):
    rows, got = scored
    assert len(got) == len(rows) + 6
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    empty = {r.score for r in got if r.doc_id in (900, 901)}
    assert len(empty) == 1
    assert len({round(r.score, 6) for r in got if r.doc_id == 4}) == 1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = "doc_id long, quality int"
    assert {r.score for r in quality.classify(docs, spark.createDataFrame([], labels)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(9)], labels)
    assert {r.score for r in quality.classify(docs, ones).collect()} == {1.0}
    assert quality.classify(docs.limit(0), ones).collect() == []


def test_registered_query(spark, sf):
    from panewise.llm.queries import QUERIES

    got = QUERIES["op1_byte_cnn_quality"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    known = [(r.predicted, labels[r.doc_id]) for r in got if r.doc_id in labels]
    assert np.mean([a == b for a, b in known]) > 0.85
