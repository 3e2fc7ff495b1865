"""Each stage of the pipeline against brute force, and the registered SQL."""

from collections import Counter

import pytest

import corpus_pipeline
from panewise.llm.queries import QUERIES, SQL
from tests.conftest import DATA
from tests.llm.test_repeats import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns and s.schema == stages[0].schema for s in stages[:-1])


def test_quality_drops_documents_only(stages):
    raw, kept = (Counter(map(tuple, s.collect())) for s in stages[:2])
    assert not kept - raw and 0.8 * sum(raw.values()) < sum(kept.values()) < sum(raw.values())


def test_lines(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[1:3])
    assert before.keys() == after.keys()
    first = {}
    for doc_id in sorted(before):
        for line in before[doc_id].split("\n"):
            first.setdefault(line, doc_id)
    for doc_id, text in before.items():
        kept = after[doc_id].split("\n")
        own = [x for x in text.split("\n") if x.strip() and first[x] == doc_id]
        assert [x for x in kept if x.strip() and first[x] == doc_id] == own
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())
    assert sum(map(len, after.values())) < sum(map(len, before.values()))


def test_one_of_each_group(stages):
    rows = stages[2].collect()
    prints = {r.doc_id: brute_fingerprint(r.text, 3) for r in rows}
    part = brute_components(prints.values(), 2)
    least = {}
    for doc_id in sorted(prints):
        least.setdefault(part[prints[doc_id]], doc_id)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(least.values())


def test_one_of_equal_rows(spark):
    rows = [(1, "a b c", "en", "s", 5)] * 3 + [(1, "other text", "en", "s", 9), (None, "a b c", "en", "s", 5), (2, None, "en", None, 0)]
    rows += [(None, None, None, None, None)] * 2 + [(3, "zz zz", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [(1, "a b c"), (1, "other text"), (2, None), (3, "zz zz")], key=repr
    )


def test_mix_takes_the_budget(stages):
    size, taken = Counter(), Counter()
    for r in stages[3].collect():
        size[r.source] += len(r.text.split())
    for r in stages[4].collect():
        taken[r.source] += len(r.text.split())
    names = sorted(size)
    assert abs(sum(taken.values()) - sum(size.values())) <= len(names)
    assert all(taken[s] <= 3 * size[s] for s in names)


def test_pack_holds_every_document(stages):
    copies = Counter(r.doc_id for r in stages[4].collect())
    heads = Counter(r.doc_id for r in stages[5].collect() if r.start == 0)
    assert heads == copies


CLASHING = ("score", "row", "others", "__score", "__mix", "__at", "__start", "__copy", "__goal", "key", "a.b", "uid", "number")


def test_stages_with_clashing_columns(spark):
    """Columns with the names of inner ones pass through, and odd rows do no harm."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, "
    schema += ", ".join(f"`{c}` int" for c in CLASHING)
    texts = ["some plain words about things", None, "", "one line\nanother line", "one line\nanother line\nmore of it"]
    rows = [(i, t, "en", "s" if i % 2 else None, 5, *range(len(CLASHING))) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "no id", None, None, None, *range(len(CLASHING)))]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns, name
        assert all(tuple(r[5:]) == tuple(range(len(CLASHING))) for r in got.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= len(rows)


def test_stages_of_an_empty_table(spark, stages):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages[0].limit(0), DATA).count() == 0, name


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, stages[-1].collect()))


def test_registered():
    import __spark_entry__ as contract

    names = [*(f"op{n}_" for n in range(1, 14)), "pipeline"]
    for name in names:
        assert sum(q == name or q.startswith(name) for q in contract.queries()) == 1
    assert set(SQL) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df, relation = QUERIES[name](spark, DATA), connection.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in places) for r in relation.fetchall()), key=repr)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == want
    assert want


def test_lines_of_late_holders_go(spark):
    """Line dedup follows every holder of a frequent line; only the last one has them in order."""
    own = [f"line {i}" for i in range(6)]
    texts = ["\n".join([f"first {i}", *own[::-1]]) for i in range(20)]
    texts += ["\n".join(own), "\n".join([*own, "new"])]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    kept = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert (kept[21].text, kept[21].n_chars) == ("new", 3)
