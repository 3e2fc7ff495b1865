"""Windows and window joins against small hand-made cases and brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panewise.functions.aggregates import count, highest, lowest, mean, total
from panewise.functions.event_time import from_instant, pane_start, to_instant, with_pane
from panewise.operators.window_joins import pane_join, window_join
from panewise.operators.windows import pane_aggregate, window_aggregate, window_rows
from panewise.plans import joins as join_plans
from panewise.plans import windows as window_plans
from tests.conftest import final_plan, plan, rows

T0 = datetime(2024, 1, 1)
ALL = {
    "s": total("v"),
    "lo": lowest("v"),
    "hi": highest("v"),
    "m": mean("v"),
    "n": count("v"),
}


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def series(spark, data, columns="ts timestamp_ntz, k string, v int"):
    return spark.createDataFrame(data, columns)


@pytest.mark.parametrize("form", [window_aggregate, pane_aggregate])
def test_three_pane_window(spark, form):
    df = series(spark, [(at(10 * p + 3), "x", 2**p) for p in range(4)])
    out = form(df, "ts", 30, 10, [], {"s": total("v"), "n": count("v")})
    by_last = {(r.window_end - T0).total_seconds() / 10 - 1: (r.n, r.s) for r in out.collect()}
    assert by_last == {0: (1, 1), 1: (2, 3), 2: (3, 7), 3: (3, 14), 4: (2, 12), 5: (1, 8)}


def test_names_that_look_like_partials(spark):
    """Partial results are told apart by place, and columns and keys may be qualified."""
    data = [(at(10 * i), "ab"[i % 2], i / 100, i * 7, "k") for i in range(50)]
    df = series(spark, data, "ts timestamp_ntz, count_v string, v double, v_2 int, sum_v string")
    wanted = {"v": total("v", 2), "v_2": total("v_2"), "m": mean("v"), "n": count("v_2"), "hi": highest("v")}
    for keys in (["count_v"], ["count_v", "sum_v"], []):
        want = rows(window_aggregate(df, "ts", 60, 20, keys, wanted))
        got = pane_aggregate(df, "ts", 60, 20, keys, wanted)
        assert got.columns == window_aggregate(df, "ts", 60, 20, keys, wanted).columns
        assert [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(got)] == [
            tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want
        ]
    named = {"v": total("t.v", 2), "n": count("t.v_2")}
    got = pane_aggregate(df.alias("t"), "t.ts", 60, 20, ["t.count_v"], named)
    assert rows(got) == rows(window_aggregate(df.alias("t"), "t.ts", 60, 20, ["t.count_v"], named))
    with pytest.raises(ValueError):
        pane_aggregate(df.withColumnRenamed("sum_v", "__p0"), "ts", 60, 20, ["__p0"], wanted)


def random_events(n, seed):
    rng = random.Random(seed)
    return [
        (
            T0 + timedelta(microseconds=rng.randrange(400_000_000)),
            "hot" if rng.random() < 0.5 else rng.choice("abc"),
            rng.randrange(-50, 50),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("size, slide", [(60, 60), (60, 20), (70, 10), (90, 30)])
def test_panes_equal_rows_equal_brute_force(spark, size, slide):
    data = random_events(300, seed=size + slide)
    df = series(spark, data)
    expected = {}
    for ts, k, v in data:
        seconds = int((ts - T0).total_seconds() // slide) * slide
        for start in range(seconds - size + slide, seconds + slide, slide):
            expected.setdefault((at(start), k), []).append(v)
    want = sorted(
        (
            (start, start + timedelta(seconds=size), k, sum(v), min(v), max(v), sum(v) / len(v), len(v))
            for (start, k), v in expected.items()
        ),
        key=repr,
    )
    assert rows(window_aggregate(df, "ts", size, slide, ["k"], ALL)) == want
    assert rows(pane_aggregate(df, "ts", size, slide, ["k"], ALL)) == want
    n_rows = sum(len(v) for v in expected.values())
    assert window_rows(df, "ts", size, slide).count() == n_rows


def test_instants_and_other_zones(spark, conf):
    """Results do not depend on the session zone, whichever timestamp type is used."""
    df = series(spark, random_events(100, seed=5))
    want = rows(pane_aggregate(df, "ts", 60, 20, ["k"], ALL))
    conf("spark.sql.session.timeZone", "America/New_York")
    assert rows(pane_aggregate(df, "ts", 60, 20, ["k"], ALL)) == want
    instants = df.withColumn("ts", to_instant("ts"))
    out = pane_aggregate(instants, "ts", 60, 20, ["k"], ALL)
    bounds = [from_instant(c).alias(c) for c in ("window_start", "window_end")]
    assert rows(out.select(*bounds, "k", *ALL)) == want
    for frame in (df, instants):
        numbered = with_pane(frame, "ts", 20, "p")
        back = numbered.withColumn("start", pane_start(numbered, "ts", "p", 20))
        if frame is instants:
            back = back.withColumn("start", from_instant("start")).withColumn("ts", from_instant("ts"))
        ok = (F.col("start") <= F.col("ts")) & (F.col("ts") < F.expr("start + interval 20 second"))
        assert back.where(ok).count() == 100


def test_before_1970(spark):
    df = series(spark, [(datetime(1969, 12, 31, 23, 59, 59, 500000), "x", 1)])
    assert with_pane(df, "ts", 10, "p").collect()[0].p == -1
    (row,) = pane_aggregate(df, "ts", 10, 10, [], {"n": count("v")}).collect()
    assert row.window_start == datetime(1969, 12, 31, 23, 59, 50)


def test_refused_windows(spark):
    df = series(spark, random_events(2, seed=1))
    with pytest.raises(ValueError):
        pane_aggregate(df, "ts", 25, 10, [], ALL)
    with pytest.raises(ValueError):
        window_rows(df, "ts", 0)
    with pytest.raises(TypeError):
        with_pane(df, "k", 10, "p")
    with pytest.raises(TypeError):
        window_aggregate(df, "ts", 10, 10, [], {"s": total("k")})


def test_rows_of_a_window_are_a_projection(spark, sf):
    assert "Exchange" not in plan(window_plans.QUERIES["window_rows_sliding"](spark, sf))


def test_panes_copy_partials_not_rows(spark, sf):
    """Partials are placed by key and block, and copied to windows only after that."""
    text = plan(window_plans.QUERIES["window_agg_panes"](spark, sf))
    assert text.count("Exchange") == 2
    placed = text.index("Exchange hashpartitioning(__block")
    assert text.index("explode(sequence(") < placed < text.index("Exchange hashpartitioning(__pane")
    assert "Expand" not in text


def test_long_windows_cross_blocks(spark):
    """One key, windows of 50 panes, rows far apart and close together."""
    data = [(at(10 * p), "x", p) for p in (*range(0, 400, 7), *range(390, 420), 5000)]
    df = series(spark, data)
    want = rows(window_aggregate(df, "ts", 500, 10, ["k"], ALL))
    assert rows(pane_aggregate(df, "ts", 500, 10, ["k"], ALL)) == want
    assert rows(pane_aggregate(df, "ts", 500, 10, [], ALL)) == rows(
        window_aggregate(df, "ts", 500, 10, [], ALL)
    )


# --- window joins -----------------------------------------------------------------


def sides(spark, left, right):
    lefts = series(spark, left, "lts timestamp_ntz, lk string, lid int")
    rights = series(spark, right, "rts timestamp_ntz, rk string, rid int")
    return lefts, rights


@pytest.mark.parametrize("form", [window_join, pane_join])
def test_window_join_by_hand(spark, form):
    lefts, rights = sides(
        spark, [(at(1), "x", 1)], [(at(2), "x", 10), (at(12), "x", 11), (at(22), "x", 12)]
    )
    out = form(lefts, rights, [("lk", "rk")], "lts", "rts", 10, 2, 1)
    got = rows(out.select("last_pane", "lid", "rid"))
    assert got == [(at(0), 1, 10), (at(10), 1, 11)]


def pairs_by_brute_force(left, right, pane, n, m):
    out = []
    for lts, lk, lid in left:
        for rts, rk, rid in right:
            lp = int((lts - T0).total_seconds() // pane)
            rp = int((rts - T0).total_seconds() // pane)
            if lk == rk:
                for end in range(max(lp, rp), min(lp + n - 1, rp + m - 1) + 1):
                    out.append((at(end * pane), lid, rid))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, m", [(1, 1), (3, 3), (1, 4), (5, 2), (12, 3)])
def test_window_joins_equal_brute_force(spark, n, m):
    left = [(ts, k, i) for i, (ts, k, _) in enumerate(random_events(60, seed=n))]
    right = [(ts, k, i) for i, (ts, k, _) in enumerate(random_events(60, seed=100 + m))]
    want = pairs_by_brute_force(left, right, 10, n, m)
    lefts, rights = sides(spark, left, right)
    assert want
    for form in (window_join, pane_join):
        out = form(lefts, rights, [("lk", "rk")], "lts", "rts", 10, n, m)
        assert rows(out.select("last_pane", "lid", "rid")) == want


def test_window_join_on_two_keys_in_either_order(spark):
    left = [(at(1), "x", 1), (at(1), "x", 2)]
    lefts, rights = sides(spark, left, left)
    for form in (window_join, pane_join):
        out = form(lefts, rights, [("rk", "lk"), ("lid", "rid")], "lts", "rts", 10, 1, 1)
        assert rows(out.select("lid", "rid")) == [(1, 1), (2, 2)]


def test_refused_window_joins(spark):
    lefts, rights = sides(spark, [(at(1), "x", 1)], [(at(1), "x", 1)])
    for form in (window_join, pane_join):
        with pytest.raises(ValueError):
            form(lefts, rights, [], "lts", "rts", 10, 1, 1)
        with pytest.raises(ValueError):
            form(lefts, rights, [("lk", "rk")], "lts", "rts", 10, 0, 1)
        with pytest.raises(ValueError):
            form(lefts, lefts, [("lk", "lk")], "lts", "lts", 10, 1, 1)
        with pytest.raises(TypeError):
            form(lefts, rights, [("lk", "rid")], "lts", "rts", 10, 1, 1)


@pytest.mark.parametrize("name", [n for n in join_plans.QUERIES if n.startswith("window_join")])
def test_window_joins_are_equality_joins(spark, sf, name):
    text = plan(join_plans.QUERIES[name](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_hot_user_is_split_in_a_pane_join(spark, conf):
    """A user with most of the rows, all at one time: the hot partition is split."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")

    def side(prefix, n):
        key = F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id") % 200)
        ts = F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, CAST(id % 2 AS DECIMAL(18,6)))")
        return spark.range(0, n, 1, 8).select(
            ts.alias(f"{prefix}ts"), key.alias(f"{prefix}k"), F.col("id").alias(f"{prefix}id")
        )

    lefts, rights = side("l", 600), side("r", 60_000)
    joined = pane_join(lefts, rights, [("lk", "rk")], "lts", "rts", 1, 2, 2)
    counted = joined.groupBy("last_pane").agg(F.count("*").alias("n"))
    assert "skew=true" in final_plan(counted)
    # Same pane: kept together for two panes; neighbouring panes: for one.
    direct = lefts.join(rights, F.col("lk") == F.col("rk")).select(
        F.sum(F.expr("2 - abs(lid % 2 - rid % 2)"))
    )
    assert counted.agg(F.sum("n")).collect() == direct.collect()
