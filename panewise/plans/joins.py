"""Joins of tables, joins of windows, and join profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from panewise.functions.aggregates import count, total
from panewise.functions.names import qualified
from panewise.operators.filters import where
from panewise.operators.grouping import summarise
from panewise.operators.joins import join
from panewise.operators.selectivity import (
    edge_selectivities,
    join_selectivity,
    product_size,
    rank_edges,
    window_selectivity,
)
from panewise.operators.window_joins import pane_join, window_join
from panewise.plans.relational import exact_sum
from panewise.sources.tables import table

HOUR = 3600


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _customer(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")


def join_single(spark, sf):
    orders, customer = _orders(spark, sf).alias("orders"), _customer(spark, sf).alias("customer")
    return join(orders, customer, [("orders.o_custkey", "customer.c_custkey")])


def join_reversed_condition(spark, sf):
    orders, customer = _orders(spark, sf).alias("orders"), _customer(spark, sf).alias("customer")
    return join(orders, customer, [("customer.c_custkey", "orders.o_custkey")])


def join_multi_key(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    totals = summarise(events, ["user_id", "event_type"], {"spent": total("value", 2)})
    both = join(
        events.alias("e"),
        totals.alias("t"),
        [("e.user_id", "t.user_id"), ("e.event_type", "t.event_type")],
        split_hot=True,
    )
    return both.select("event_id", "e.user_id", "e.event_type", "value", "spent")


def join_three_way(spark, sf):
    """Orders meet customers first, so the largest table is shuffled only once."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    buyers = join(_orders(spark, sf), _customer(spark, sf), [("o_custkey", "c_custkey")])
    both = join(lines, buyers, [("l_orderkey", "o_orderkey")])
    return both.select("l_orderkey", "l_linenumber", "l_quantity", "o_totalprice", "c_name")


def join_self(spark, sf):
    """Two results of the same table joined with each other; both sides keep all columns."""
    orders = table(spark, sf, "orders")
    spent = {"n": count("o_totalprice"), "spent": total("o_totalprice", 2)}
    finished = summarise(
        where(orders, F.col("o_orderstatus"), "=", F.lit("F")), ["o_custkey"], spent
    ).alias("f")
    pending = summarise(
        where(orders, F.col("o_orderstatus"), "=", F.lit("O")), ["o_custkey"], spent
    ).alias("p")
    both = join(finished, pending, [("f.o_custkey", "p.o_custkey")])
    return both.select(
        F.col("f.o_custkey").alias("custkey"),
        F.col("f.n").alias("n_finished"),
        F.col("p.n").alias("n_pending"),
        F.col("f.spent").alias("spent_finished"),
        F.col("p.spent").alias("spent_pending"),
    )


def _rich(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return where(customer, F.col("c_acctbal"), ">", F.lit(5000.0))


def _large(spark, sf):
    return where(_orders(spark, sf), F.col("o_totalprice"), ">", F.lit(400000.0))


def _partners(joined):
    """Keys as text: a row without a partner says "none" in place of the missing key."""
    keys = [c for c in ("c_custkey", "o_orderkey") if c in joined.columns]
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in keys]
    return joined.select(*shown, *[c for c in joined.columns if c not in (*keys, "o_custkey")])


def join_left(spark, sf):
    customer, large = _customer(spark, sf), _large(spark, sf)
    return _partners(join(customer, large, [("c_custkey", "o_custkey")], "left"))


def join_right(spark, sf):
    rich, orders = _rich(spark, sf), _orders(spark, sf)
    return _partners(join(rich, orders, [("c_custkey", "o_custkey")], "right"))


def join_full(spark, sf):
    rich, large = _rich(spark, sf), _large(spark, sf)
    return _partners(join(rich, large, [("c_custkey", "o_custkey")], "full"))


def join_full_plain(spark, sf):
    rich, large = _rich(spark, sf), _large(spark, sf)
    return _partners(join(rich, large, [("c_custkey", "o_custkey")], "full", split_hot=False))


def join_after_agg(spark, sf):
    totals = summarise(
        _orders(spark, sf),
        ["o_custkey"],
        {"n": count("o_totalprice"), "spent": total("o_totalprice", 2)},
    )
    both = join(totals, _customer(spark, sf), [("o_custkey", "c_custkey")])
    return both.select("c_custkey", "c_name", "n", "spent")


def _clicks(spark, sf):
    events = table(spark, sf, "events").where("event_type = 'click'")
    return events.select(
        F.col("user_id"), F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts")
    )


def _purchases(spark, sf):
    events = table(spark, sf, "events").where("event_type = 'purchase'")
    return events.select(
        F.col("user_id").alias("buyer_id"),
        F.col("event_id").alias("purchase_id"),
        F.col("ts").alias("purchase_ts"),
    )


def windows_meet(form, left_panes, right_panes):
    def query(spark, sf):
        return form(
            _clicks(spark, sf),
            _purchases(spark, sf),
            [("user_id", "buyer_id")],
            "click_ts",
            "purchase_ts",
            HOUR,
            left_panes,
            right_panes,
        ).select("last_pane", "user_id", "click_id", "purchase_id")

    return query


def kind_of_event(events, kind, name):
    """Two of these share all their column names; ``qualified`` tells them apart."""
    rows = events.where(F.col("event_type") == kind).select("user_id", "event_id", "ts")
    return qualified(rows, name)


MEETING = ["last_pane", "click_user", "click_id", "click_ts", "buyer", "purchase_id", "purchase_ts"]


def join_left_shared(spark, sf):
    events = table(spark, sf, "events")
    large = events.where(F.col("value") > 60.0)
    clicks = kind_of_event(large, "click", "c")
    pairs = join(clicks, kind_of_event(large, "purchase", "p"), [("c.user_id", "p.user_id")], "left")
    keys = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("none")) for c in ("c.event_id", "p.event_id")]
    return pairs.select(keys[0].alias("click_id"), keys[1].alias("purchase_id"))


def windows_meet_shared(form):
    def query(spark, sf):
        events = table(spark, sf, "events")
        sides = kind_of_event(events, "click", "c"), kind_of_event(events, "purchase", "p")
        return form(*sides, [("c.user_id", "p.user_id")], "c.ts", "p.ts", HOUR, 4, 3).toDF(*MEETING)

    return query


def _orders_customer(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return join_selectivity(orders, customer, [("o_custkey", "c_custkey")])


def join_edge_ranking(spark, sf):
    names = ("lineitem", "orders", "part", "supplier", "customer")
    tables = {name: table(spark, sf, name) for name in names}
    edges = {
        "lineitem-orders": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        "lineitem-part": ("lineitem", "l_partkey", "part", "p_partkey"),
        "lineitem-supplier": ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        "orders-customer": ("orders", "o_custkey", "customer", "c_custkey"),
    }
    return rank_edges(edge_selectivities(tables, edges))


def window_selectivity_panes(spark, sf):
    """How selective the join of the last 24 panes of clicks with the last 3 of purchases is."""
    sides = _clicks(spark, sf), _purchases(spark, sf)
    return window_selectivity(*sides, [("user_id", "buyer_id")], "click_ts", "purchase_ts", HOUR, 24, 3)


def cross_product_size(spark, sf):
    return product_size(table(spark, sf, "orders"), table(spark, sf, "customer"))


QUERIES = {
    "join_left_shared": join_left_shared,
    "window_join_shared": windows_meet_shared(window_join),
    "window_join_panes_shared": windows_meet_shared(pane_join),
    "join_single": join_single,
    "join_reversed_condition": join_reversed_condition,
    "join_multi_key": join_multi_key,
    "join_three_way": join_three_way,
    "join_self": join_self,
    "join_left": join_left,
    "join_right": join_right,
    "join_full": join_full,
    "join_full_plain": join_full_plain,
    "join_after_agg": join_after_agg,
    "window_join_equal": windows_meet(window_join, 3, 3),
    "window_join_panes_equal": windows_meet(pane_join, 3, 3),
    "window_join_asym": windows_meet(pane_join, 24, 3),
    "window_join_panes_asym": windows_meet(pane_join, 24, 3),
    "join_selectivity": _orders_customer,
    "join_edge_ranking": join_edge_ranking,
    "window_selectivity": window_selectivity_panes,
    "cross_product_size": cross_product_size,
}

_SINGLE = """
    SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey"""
_RICH = "(SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000)"
_LARGE = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000)"
_KEYS = """coalesce(CAST(c_custkey AS VARCHAR), 'none') AS c_custkey,
           coalesce(CAST(o_orderkey AS VARCHAR), 'none') AS o_orderkey"""
_FULL = f"""
    SELECT {_KEYS}, c_acctbal, o_totalprice
    FROM {_RICH} FULL JOIN {_LARGE} ON c_custkey = o_custkey"""


def _windows_meet(left_panes, right_panes):
    """Copies of both sides, one per pane that keeps them, joined pane by pane."""

    def side(kind, panes, columns):
        hour = "time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')"
        return f"""(SELECT {columns}, {hour} + to_hours(k) AS last_pane
            FROM events, range({panes}) AS steps(k) WHERE event_type = '{kind}')"""

    return f"""
        SELECT last_pane, user_id, click_id, purchase_id
        FROM {side('click', left_panes, 'user_id, event_id AS click_id')}
        JOIN {side('purchase', right_panes, 'user_id, event_id AS purchase_id')}
        USING (user_id, last_pane)"""


def _profile(name, left, right, left_key, right_key):
    return f"""
        SELECT '{name}' AS edge, l AS left_rows, r AS right_rows, j AS joined_rows,
               j / (CAST(l AS DOUBLE) * r) AS selectivity
        FROM (SELECT count(*) AS l FROM {left}), (SELECT count(*) AS r FROM {right}),
             (SELECT CAST(count(*) AS DOUBLE) AS j FROM {left} JOIN {right}
              ON {left_key} = {right_key})"""


_SHARED = f"""
    SELECT last_pane, c.user_id AS click_user, click_id, c.ts AS click_ts,
           p.user_id AS buyer, purchase_id, p.ts AS purchase_ts
    FROM ({_windows_meet(4, 3)}) AS m
    JOIN events AS c ON c.event_id = m.click_id JOIN events AS p ON p.event_id = m.purchase_id"""

_EDGES = " UNION ALL ".join(
    _profile(*edge)
    for edge in (
        ("lineitem-orders", "lineitem", "orders", "l_orderkey", "o_orderkey"),
        ("lineitem-part", "lineitem", "part", "l_partkey", "p_partkey"),
        ("lineitem-supplier", "lineitem", "supplier", "l_suppkey", "s_suppkey"),
        ("orders-customer", "orders", "customer", "o_custkey", "c_custkey"),
    )
)

_KEPT = """
    SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + to_hours(k) AS last_pane, user_id
    FROM events, range({panes}) AS steps(k) WHERE event_type = '{kind}'"""

SQL = {
    "window_selectivity": f"""
        WITH l AS ({_KEPT.format(panes=24, kind='click')}), r AS ({_KEPT.format(panes=3, kind='purchase')}),
        lefts AS (SELECT last_pane, count(*) AS left_rows FROM l GROUP BY last_pane),
        rights AS (SELECT last_pane, count(*) AS right_rows FROM r GROUP BY last_pane),
        pairs AS (SELECT last_pane, CAST(count(*) AS DOUBLE) AS n FROM l JOIN r USING (last_pane, user_id) GROUP BY last_pane)
        SELECT last_pane, left_rows, right_rows, coalesce(n, 0) AS joined_rows,
               coalesce(n, 0) / (CAST(left_rows AS DOUBLE) * right_rows) AS selectivity
        FROM lefts JOIN rights USING (last_pane) LEFT JOIN pairs USING (last_pane)""",
    "join_left_shared": """
        SELECT CAST(c.event_id AS VARCHAR) AS click_id,
               coalesce(CAST(p.event_id AS VARCHAR), 'none') AS purchase_id
        FROM (SELECT * FROM events WHERE event_type = 'click' AND value > 60) AS c
        LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase' AND value > 60) AS p
          ON c.user_id = p.user_id""",
    "window_join_shared": _SHARED,
    "window_join_panes_shared": _SHARED,
    "join_single": _SINGLE,
    "join_reversed_condition": _SINGLE,
    "join_multi_key": f"""
        SELECT event_id, user_id, event_type, value, spent FROM events JOIN (
            SELECT user_id, event_type, {exact_sum('value')} AS spent
            FROM events GROUP BY user_id, event_type) USING (user_id, event_type)""",
    "join_three_way": """
        SELECT l_orderkey, l_linenumber, l_quantity, o_totalprice, c_name
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey""",
    "join_self": f"""
        SELECT o_custkey AS custkey, f.n AS n_finished, p.n AS n_pending,
               f.spent AS spent_finished, p.spent AS spent_pending
        FROM (SELECT o_custkey, count(*) AS n, {exact_sum('o_totalprice')} AS spent
              FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) AS f
        JOIN (SELECT o_custkey, count(*) AS n, {exact_sum('o_totalprice')} AS spent
              FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) AS p
        USING (o_custkey)""",
    "join_left": f"""
        SELECT {_KEYS}, c_name, c_mktsegment, o_totalprice
        FROM customer LEFT JOIN {_LARGE} ON c_custkey = o_custkey""",
    "join_right": f"""
        SELECT {_KEYS}, c_acctbal, o_totalprice
        FROM {_RICH} RIGHT JOIN orders ON c_custkey = o_custkey""",
    "join_full": _FULL,
    "join_full_plain": _FULL,
    "join_after_agg": f"""
        SELECT c_custkey, c_name, n, spent FROM customer JOIN (
            SELECT o_custkey, count(*) AS n, {exact_sum('o_totalprice')} AS spent
            FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
    "window_join_equal": _windows_meet(3, 3),
    "window_join_panes_equal": _windows_meet(3, 3),
    "window_join_asym": _windows_meet(24, 3),
    "window_join_panes_asym": _windows_meet(24, 3),
    "join_selectivity": f"""
        SELECT left_rows, right_rows, joined_rows, selectivity
        FROM ({_profile('', 'orders', 'customer', 'o_custkey', 'c_custkey')})""",
    "join_edge_ranking": f"""
        SELECT *, CAST(row_number() OVER (ORDER BY selectivity, edge) AS INTEGER) AS place
        FROM ({_EDGES})""",
    "cross_product_size": """
        SELECT l AS left_rows, r AS right_rows, CAST(l AS DOUBLE) * r AS product_rows
        FROM (SELECT count(*) AS l FROM orders), (SELECT count(*) AS r FROM customer)""",
}
