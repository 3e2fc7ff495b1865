"""Tables in the shared folder: what is no longer read goes, what is read stays."""

import os

import pytest

import corpus_pipeline
from panewise.llm.components import roots
from panewise.llm.simhash import near_groups
from panewise.llm.tables import discard, scope, staged, written
from tests.conftest import DATA


@pytest.fixture
def left(spark):
    """Purposes of the folders that are new since the test began."""
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/panewise"

    def names():
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    before = names()
    return lambda: sorted(n.rsplit("-", 1)[0] for n in names() - before)


def test_discard(spark, left):
    a, b = written(spark.range(3), "a"), staged(spark.range(4), "b")
    discard(a, spark.range(5), a.select("id"))
    assert left() == ["b"] and b.count() == 4
    discard(a, b)
    assert left() == []


def test_scopes(spark, left):
    with scope(spark):
        outer, stays = staged(spark.range(2), "outer"), written(spark.range(1), "stays")
        with pytest.raises(ValueError), scope(spark):
            staged(spark.range(3), "inner")
            raise ValueError
        assert left() == ["outer", "stays"] and outer.count() == 2
        discard(outer)
    assert left() == ["stays"] and stays.count() == 1


def test_rounds_of_components_go(spark, left):
    n = 12
    path = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert sorted(map(tuple, roots(path).collect())) == [(i, 0) for i in range(1, n + 1)]
    assert left() == ["components"]


def test_near_groups_keep_what_they_read(spark, left):
    texts = [f"word{i % 7} and five more words here now" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = near_groups(docs)
    assert left() == ["simhash", "simhash"]
    assert {(r.doc_id, r.component_id) for r in groups.collect()} >= {(7, 0), (29, 1)}


def test_pipeline_leaves_its_result(spark, left):
    got = corpus_pipeline.run(spark, DATA)
    assert left() == ["packing"] and got.count()
