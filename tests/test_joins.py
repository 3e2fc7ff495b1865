"""Table joins: kinds, keys, hot keys, and join profiles."""

import pytest
from pyspark.sql import functions as F

from panewise.functions.names import qualified
from panewise.operators.joins import join
from panewise.operators.selectivity import (
    edge_selectivities,
    join_selectivity,
    product_size,
    rank_edges,
    window_selectivity,
)
from panewise.operators.window_joins import window_join
from panewise.plans import joins as plans
from tests.conftest import final_plan, plan, rows


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")], "lk int, l string"
    )


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n")], "rk int, r string")


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_same_as_spark(left, right, how):
    want = rows(left.join(right, F.col("lk") == F.col("rk"), how))
    assert rows(join(left, right, [("lk", "rk")], how)) == want
    assert rows(join(left, right, [("rk", "lk")], how)) == want
    for split_hot in (True, False):
        assert rows(join(left, right, [("lk", "rk")], how, split_hot)) == want
    assert join(left, right, [("lk", "rk")], how).columns == ["lk", "l", "rk", "r"]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_odd_doubles_and_strings(spark, how):
    """The hash of the keys never separates keys that are equal."""
    nan = float("nan")
    values = [(0.0, "é"), (-0.0, "é"), (nan, ""), (-nan, ""), (1.5, "e\u0301"), (None, "x")]
    left = spark.createDataFrame(values, "a double, s string")
    right = spark.createDataFrame(values, "b double, t string")
    for on in ([("a", "b")], [("s", "t")], [("a", "b"), ("s", "t")]):
        want = rows(join(left, right, on, how, split_hot=False))
        assert repr(rows(join(left, right, on, how, split_hot=True))) == repr(want)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_two_keys(spark, how):
    a = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "p int, q int, a string")
    b = spark.createDataFrame([(1, 2, "x"), (2, 2, "y")], "u int, v int, b string")
    on = [("p", "u"), ("v", "q")]
    want = rows(a.join(b, (F.col("p") == F.col("u")) & (F.col("q") == F.col("v")), how))
    assert rows(join(a, b, on, how)) == want


def test_self_join_keeps_both_sides(left):
    a, b = left.alias("a"), left.alias("b")
    both = join(a, b, [("b.lk", "a.lk")])
    assert len(both.columns) == 4
    assert both.select("a.l", "b.l").count() == 4 + 1 + 1


def test_three_tables_with_a_condition_on_an_earlier_one(spark, left, right):
    third = spark.createDataFrame([("a", 10), ("b", 20)], "t string, n int")
    both = join(join(left.alias("l"), right.alias("r"), [("l.lk", "r.rk")]), third, [("l.l", "t")])
    assert rows(both.select("l.l", "r.r", "n")) == [
        ("a", "x", 10), ("a", "y", 10), ("b", "x", 20), ("b", "y", 20),
    ]


def test_refused_joins(left, right):
    with pytest.raises(ValueError):
        join(left, right, [])
    with pytest.raises(ValueError):
        join(left, right, [("lk", "rk")], "semi")
    with pytest.raises(ValueError):
        join(left, right, [("lk", "nothing")])
    with pytest.raises(ValueError):
        join(left, left, [("lk", "lk")], "full")
    with pytest.raises(TypeError):
        join(left, right, [("lk", "r")])
    with pytest.raises(TypeError):
        join(left, right.withColumn("rk", F.col("rk").cast("bigint")), [("lk", "rk")])


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_no_cross_join(spark, sf, name):
    text = plan(plans.QUERIES[name](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.fixture
def small_partitions_are_large(conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "40KB")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "40KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")


def hot_side_of(spark, prefix, hot):
    """A third of 60,000 rows share a key, or 990 rows with a key each."""
    n = 60_000 if hot else 990
    key = F.when(F.lit(hot) & (F.col("id") % 3 == 0), 7).otherwise(F.col("id") % 997)
    return spark.range(0, n, 1, 8).select(key.alias(f"{prefix}k"), F.col("id").alias(f"{prefix}id"))


def joins_in(text):
    """The join lines of the final plan."""
    final = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    return [line.strip() for line in final.splitlines() if "SortMergeJoin" in line]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("hot", ["left", "right"])
def test_hot_key_is_split(spark, small_partitions_are_large, how, hot):
    """Whichever side is hot, every join that meets its rows splits them. The outer join
    proper gets the rows of ordinary keys."""
    left = hot_side_of(spark, "l", hot == "left")
    right = hot_side_of(spark, "r", hot == "right")
    joined = join(left, right, [("lk", "rk")], how)
    plain = join(left, right, [("lk", "rk")], how, split_hot=False)
    ids = F.xxhash64("lk", "lid", "rk", "rid").cast("decimal(38,0)")
    sums = [F.count("*"), F.sum(ids)]
    assert joined.agg(*sums).collect() == plain.agg(*sums).collect()
    text = final_plan(joined)
    side = {"left": "[lk", "right": "[rk"}[hot]
    for line in joins_in(text):
        if "Outer" not in line and ("LeftAnti" not in line or side in line.split("],")[0]):
            assert "skew=true" in line, line
    assert sum("Outer" in line for line in joins_in(text)) == (how != "inner")
    assert any("skew=true" in line for line in joins_in(text))


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_join_without_hot_keys_is_one_join(spark, small_partitions_are_large, how):
    left, right = hot_side_of(spark, "l", False), hot_side_of(spark, "r", False)
    text = final_plan(join(left, right, [("lk", "rk")], how))
    assert len(joins_in(text)) == 1


@pytest.mark.parametrize("how", ["left", "right", "full"])
@pytest.mark.parametrize("share", [0.9, 0.2, 0.001])
def test_share_changes_nothing(left, right, how, share):
    want = rows(join(left, right, [("lk", "rk")], how, split_hot=False))
    assert rows(join(left, right, [("lk", "rk")], how, hot_share=share)) == want


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_shared_names(left, how):
    """Inputs with equal columns, named by table."""
    a, b = qualified(left, "a"), qualified(left, "b")
    both = join(a, b, [("b.lk", "a.lk")], how)
    assert both.columns == ["a.lk", "a.l", "b.lk", "b.l"]
    want = left.toDF("x", "y").join(left.toDF("u", "v"), F.col("x") == F.col("u"), how)
    assert rows(both) == rows(want)


def test_keys_that_cannot_be_told_apart(left):
    with pytest.raises(ValueError, match="alias or qualify"):
        join(left, left, [("lk", "lk")])


def test_outer_joins_shuffle_the_preserved_side_once(spark, small_partitions_are_large):
    left, right = hot_side_of(spark, "l", True), hot_side_of(spark, "r", False)
    assert "ReusedExchange" in final_plan(join(left, right, [("lk", "rk")], "left"))
    assert final_plan(join(left, right, [("lk", "rk")], "full")).count("ReusedExchange") >= 2


def test_hot_rows_meet_their_own_totals(spark, small_partitions_are_large):
    """A side grouped by the join keys is shuffled again, or the hot rows stay together."""
    left = hot_side_of(spark, "l", True)
    totals = left.groupBy(F.col("lk").alias("tk")).agg(F.count("*").alias("n"))
    assert "skew=true" not in final_plan(join(left, totals, [("lk", "tk")]))
    joined = join(left, totals, [("lk", "tk")], split_hot=True)
    assert "skew=true" in final_plan(joined)
    assert joined.columns == ["lk", "lid", "tk", "n"]
    assert joined.count() == 60_000


def test_largest_table_is_shuffled_once(spark, sf, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(plans.QUERIES["join_three_way"](spark, sf))
    assert text.count("Exchange hashpartitioning(l_orderkey") == 1
    assert text.count("Exchange") == 4


# --- profiles -----------------------------------------------------------------------


def test_selectivity_by_hand(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    b = spark.createDataFrame([(1,), (3,)], "b int")
    assert rows(join_selectivity(a, b, [("a", "b")])) == [(3, 2, 2.0, 2 / 6)]


def test_selectivity_counts_the_real_join(left, right):
    (row,) = join_selectivity(left, right, [("rk", "lk")]).collect()
    assert row.joined_rows == join(left, right, [("lk", "rk")]).count()
    assert (row.left_rows, row.right_rows) == (5, 4)


def test_selectivity_of_nothing(left, right):
    assert rows(join_selectivity(left.where("lk > 9"), right, [("lk", "rk")])) == []
    assert rows(join_selectivity(left, right.where("rk > 9"), [("lk", "rk")])) == []


def test_selectivity_of_huge_counts_does_not_overflow(spark):
    """More than 2**63 pairs for one key, from counts alone."""
    from panewise.operators import selectivity

    counted = spark.sql("SELECT 1 AS __k0, 4000000000000L AS l, 5000000000000L AS r")
    out = selectivity.totals(counted, ["__k0"])
    assert rows(out) == [(4_000_000_000_000, 5_000_000_000_000, 2e25, 1.0)]


def test_product_size(left, right):
    assert rows(product_size(left, right)) == [(5, 4, 20.0)]
    assert rows(product_size(left, right.where("rk > 9"))) == []


def test_edges_most_selective_first(left, right):
    """All edges from one pass over each table; as the profiles of single joins."""
    tables = {"l": left, "r": right, "l2": left.toDF("k2", "l2")}
    edges = {"wide": ("l", "lk", "l2", "k2"), "narrow": ("r", "rk", "l", "lk"), "none": ("l", "lk", "e", "rk")}
    tables["e"] = right.where("rk > 9")
    profiles = edge_selectivities(tables, edges)
    wide, narrow = ([(*r, name) for r in rows(p)] for name, p in (
        ("wide", join_selectivity(left, tables["l2"], [("lk", "k2")])),
        ("narrow", join_selectivity(right, left, [("rk", "lk")])),
    ))
    assert sorted((*r[1:], r[0]) for r in map(tuple, profiles.collect())) == sorted(wide + narrow)
    ranked = {r.edge: (r.place, r.selectivity) for r in rank_edges(profiles).collect()}
    assert min(ranked.values())[1] == min(s for _, s in ranked.values())


def test_edge_keys_of_every_type(spark):
    a = spark.createDataFrame([(0.0, "1"), (-0.0, None), (float("nan"), "x"), (None, "x")], "d double, s string")
    b = spark.createDataFrame([(-0.0, "x"), (float("nan"), "y"), (None, None)], "e double, t string")
    got = edge_selectivities({"a": a, "b": b}, {"d": ("a", "d", "b", "e"), "s": ("a", "s", "b", "t")})
    want = {"d": a.join(b, a.d == b.e).count(), "s": a.join(b, a.s == b.t).count()}
    assert {r.edge: r.joined_rows for r in got.collect()} == want == {"d": 3, "s": 2}


def kept(spark, seed, n, names):
    """Rows over 40 panes of ten seconds, a third of them with one key, some without key or time."""
    df = spark.range(n).select(
        F.when(F.rand(seed) < 0.3, 1).when(F.rand(seed + 1) < 0.05, None).otherwise((F.rand(seed + 2) * 9).cast("int")).alias("k"),
        F.expr(f"TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, CAST(rand({seed + 3}) * 400 AS DECIMAL(18, 6)))").alias("t"),
        F.col("id"),
    )
    return df.withColumn("t", F.when(F.col("id") > 2, F.col("t"))).toDF(*names)


@pytest.mark.parametrize("n, m", [(1, 1), (3, 3), (1, 7), (12, 2)])
def test_window_selectivity_counts_the_window_join(spark, n, m):
    left, right = kept(spark, 3, 150, ["a", "at", "i"]).cache(), kept(spark, 9, 70, ["b", "bt", "j"]).cache()
    got = window_selectivity(left, right, [("b", "a")], "at", "bt", 10, n, m).collect()
    pairs = window_join(left, right, [("a", "b")], "at", "bt", 10, n, m).groupBy("last_pane").count()
    pairs = {r.last_pane: r["count"] for r in pairs.collect()}

    def held(df, ts, panes):
        ends = df.where(f"{ts} IS NOT NULL").select(F.window(ts, "10 seconds").start.alias("p"))
        ends = ends.select(F.explode(F.expr(f"transform(sequence(0, {panes - 1}), x -> p + make_dt_interval(0, 0, 0, x * 10))")).alias("p"))
        return {r.p: r["count"] for r in ends.groupBy("p").count().collect()}

    lefts, rights = held(left, "at", n), held(right, "bt", m)
    want = sorted((p, lefts[p], rights[p], float(pairs.get(p, 0)), pairs.get(p, 0) / (lefts[p] * rights[p])) for p in lefts.keys() & rights.keys())
    assert sorted(map(tuple, got)) == want and len(want) > 20


def test_window_selectivity_forms_no_join(spark, sf):
    text = plan(plans.QUERIES["window_selectivity"](spark, sf))
    assert "Join" not in text and text.count("Exchange") == 3


def test_profile_has_no_join(spark, sf):
    text = plan(plans.QUERIES["join_selectivity"](spark, sf))
    assert "Join" not in text
    assert text.count("Exchange hashpartitioning") == 1
