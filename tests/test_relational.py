"""Filters, aggregates and statements."""

import pytest
from pyspark.sql import functions as F

from panewise.functions.aggregates import Aggregate, count, highest, lowest, mean, total
from panewise.operators.filters import where
from panewise.operators.grouping import summarise
from panewise.operators.statement import select_from
from panewise.plans import relational
from tests.conftest import plan, rows


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [("a", 1, 1.5, "x"), ("a", 2, 2.5, "a"), ("b", 3, 0.5, "b")],
        "k string, n int, d double, s string",
    )


@pytest.mark.parametrize(
    "symbol, expected",
    [("=", {2}), ("<>", {1, 3}), ("<", {1}), ("<=", {1, 2}), (">", {3}), (">=", {2, 3})],
)
def test_integer_against_double(df, symbol, expected):
    assert {r.n for r in where(df, F.col("n"), symbol, F.lit(2.0)).collect()} == expected


def test_strings(df):
    assert rows(where(df, F.col("k"), "=", F.col("s")).select("n")) == [(2,), (3,)]
    assert rows(where(df, F.col("s"), "<>", F.lit("x")).select("n")) == [(2,), (3,)]


def test_refused_comparisons(df):
    with pytest.raises(TypeError):
        where(df, F.col("k"), "=", F.lit(1))
    with pytest.raises(TypeError):
        where(df, F.col("k"), "<", F.lit("x"))
    with pytest.raises(ValueError):
        where(df, F.col("n"), "like", F.lit(1))


def test_filter_and_columns_reach_the_scan(spark, sf):
    text = plan(relational.QUERIES["filter_gt"](spark, sf))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in text


def test_all_aggregates(df):
    got = rows(
        summarise(
            df,
            ["k"],
            {
                "s": total("n"),
                "e": total("d", 1),
                "lo": lowest("d"),
                "hi": highest("d"),
                "m": mean("d", 1),
                "m2": mean("n"),
                "c": count("s"),
            },
        )
    )
    assert got == [("a", 3, 4.0, 1.5, 2.5, 2.0, 1.5, 2), ("b", 3, 0.5, 0.5, 0.5, 0.5, 3.0, 1)]


def test_integer_sums_are_wide(spark):
    df = spark.createDataFrame([(2147483647,), (2147483647,)], "n int")
    assert rows(summarise(df, [], {"s": total("n"), "m": mean("n")})) == [
        (4294967294, 2147483647.0)
    ]


def test_exact_sum_does_not_depend_on_order(spark):
    df = spark.range(100_000).select((F.col("id") / 100).alias("v"))
    sums = {
        summarise(df.repartition(n), [], {"s": total("v", 2)}).collect()[0].s for n in (1, 3, 7)
    }
    assert sums == {sum(range(100_000)) / 100}


def test_sums_never_round_a_value_away(spark):
    """A value with more decimals than the scale says stops the query."""
    df = spark.createDataFrame([(0.004,), (None,), (0.07,), (-2.5,)], "v double")
    assert rows(summarise(df.where("v <> 0.004"), [], {"s": total("v", 2)})) == [(-2.43,)]
    assert rows(summarise(df, [], {"s": total("v", 3)})) == [(-2.426,)]
    for wrong in (df, spark.createDataFrame([(float("nan"),)], "v double"), spark.createDataFrame([(1e300,)], "v double")):
        with pytest.raises(Exception, match="more than 2 decimals"):
            summarise(wrong, [], {"s": total("v", 2)}).collect()


def test_long_windows_of_a_statement_do_not_copy_rows(spark, sf):
    from panewise.plans.relational import statement_day

    text = plan(statement_day(spark, sf))
    assert "Expand" not in text
    assert text.rindex("partial_sum") > text.rindex("Generate explode")  # rows are combined below the copies


def test_global_aggregate_of_nothing(df):
    assert rows(summarise(df.where("n > 9"), [], {"c": count("n")})) == []
    assert rows(summarise(df.where("n > 9"), ["k"], {"c": count("n")})) == []


def test_refused_aggregates(df):
    with pytest.raises(TypeError):
        summarise(df, ["k"], {"s": total("s")})
    with pytest.raises(ValueError):
        summarise(df, ["k"], {"s": total("n")}, group_by=["s"])
    with pytest.raises(ValueError):
        summarise(df, ["k"], {"k": total("n")})
    with pytest.raises(ValueError):
        summarise(df, ["k"], {})
    with pytest.raises(ValueError):
        Aggregate("median", "n")


def test_statement_runs_in_a_fixed_order(spark, df):
    other = spark.createDataFrame([("a", 10), ("b", 20)], "name string, code int")
    got = select_from(
        df.alias("f"),
        [("name", "key"), "total", "code"],
        joins=((other, [("k", "name")], "inner"),),
        group_by=["k"],
        aggregates={"total": total("n")},
        where=(F.col("n"), ">", F.lit(1)),
    )
    assert got.columns == ["key", "total", "code"]
    assert rows(got) == [("a", 2, 10), ("b", 3, 20)]


def test_statement_refuses_other_keys(df):
    with pytest.raises(ValueError):
        select_from(df, ["k", "c"], group_by=["s"], aggregates={"c": count("n")})
    with pytest.raises(ValueError):
        select_from(df, ["k"], group_by=["k"])


def test_statement_window_rows(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:30:00' AS ts, 1 AS v")
    got = select_from(df, ["window_start", "v"], window=("ts", 7200, 3600))
    assert got.count() == 2


def test_hot_key_is_combined_before_the_shuffle(spark, sf):
    text = plan(relational.QUERIES["agg_having"](spark, sf))
    assert text.index("partial_sum") > text.index("Exchange")
