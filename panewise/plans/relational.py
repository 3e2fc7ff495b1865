"""Projections, filters, aggregates and chained results."""

from __future__ import annotations

from pyspark.sql import functions as F

from panewise.functions.aggregates import count, highest, lowest, mean, total
from panewise.operators.filters import where
from panewise.operators.grouping import summarise
from panewise.operators.joins import join
from panewise.operators.statement import select_from
from panewise.sources.tables import named, table

LINE = ("l_orderkey", "l_linenumber", "l_quantity")
HOUR = 3600


def project_rename(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))


def project_qualified(spark, sf):
    orders = table(spark, sf, "orders").alias("orders")
    return orders.select(
        F.col("orders.o_orderkey").alias("order_key"), F.col("orders.o_custkey").alias("cust_key")
    )


def project_repeated(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(
        "o_orderkey", F.col("o_custkey").alias("buyer"), F.col("o_custkey").alias("payer")
    )


def quantity_filter(symbol, bound):
    def query(spark, sf):
        lines = table(spark, sf, "lineitem")
        return where(lines, F.col("l_quantity"), symbol, F.lit(bound)).select(*LINE)

    return query


def filter_int_double(spark, sf):
    lines = table(spark, sf, "lineitem")
    return where(lines, F.col("l_linenumber"), "=", F.lit(2.0)).select(*LINE)


def filter_col_col(spark, sf):
    lines = table(spark, sf, "lineitem")
    kept = where(lines, F.col("l_tax"), "<", F.col("l_discount"))
    return kept.select("l_orderkey", "l_linenumber", "l_tax", "l_discount")


def filter_literal_left(spark, sf):
    lines = table(spark, sf, "lineitem")
    return where(lines, F.lit(45.0), "<", F.col("l_quantity")).select(*LINE)


def event_filter(symbol):
    def query(spark, sf):
        events = table(spark, sf, "events")
        kept = where(events, F.col("event_type"), symbol, F.lit("click"))
        return kept.select("event_id", "event_type", "value")

    return query


def filter_string_col_col(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    both = join(lines, orders, [("l_orderkey", "o_orderkey")])
    kept = where(both, F.col("l_linestatus"), "=", F.col("o_orderstatus"))
    return kept.select("l_orderkey", "l_linenumber", "o_orderstatus")


def filter_chain(spark, sf):
    large = where(table(spark, sf, "lineitem"), F.col("l_quantity"), ">", F.lit(30.0))
    cheap = where(large, F.col("l_extendedprice"), "<", F.lit(20000.0))
    return cheap.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def named_chain(spark, sf):
    """Three statements, each over the result the one before it named."""
    named(table(spark, sf, "orders"), "pw_orders")
    spark.sql(
        "SELECT o_custkey AS cust, o_totalprice AS price FROM pw_orders WHERE o_orderstatus = 'F'"
    ).createOrReplaceTempView("pw_finished")
    spark.sql(
        "SELECT cust, count(price) AS n, max(price) AS top FROM pw_finished GROUP BY cust"
    ).createOrReplaceTempView("pw_per_customer")
    return spark.sql("SELECT cust, n, top FROM pw_per_customer WHERE n > 2")


def agg_sum_min_max_avg_count(spark, sf):
    return summarise(
        table(spark, sf, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {
            "sum_price": total("l_extendedprice", 2),
            "min_price": lowest("l_extendedprice"),
            "max_price": highest("l_extendedprice"),
            "avg_price": mean("l_extendedprice", 2),
            "n": count("l_extendedprice"),
        },
    )


def agg_int_types(spark, sf):
    return summarise(
        table(spark, sf, "lineitem"),
        ["l_suppkey"],
        {
            "sum_line": total("l_linenumber"),
            "min_line": lowest("l_linenumber"),
            "max_line": highest("l_linenumber"),
            "avg_line": mean("l_linenumber"),
            "n": count("l_linenumber"),
        },
    )


def agg_global(spark, sf):
    return summarise(
        table(spark, sf, "events"),
        [],
        {"total": total("value", 2), "top": highest("value"), "n": count("value")},
    )


def agg_global_empty(spark, sf):
    none = where(table(spark, sf, "events"), F.col("value"), "<", F.lit(-1.0))
    return summarise(none, [], {"top": highest("value"), "n": count("value")})


def agg_implicit_keys(spark, sf):
    return select_from(
        table(spark, sf, "orders"),
        ["o_orderpriority", "spent"],
        aggregates={"spent": total("o_totalprice", 2)},
    )


def agg_explicit_keys(spark, sf):
    return select_from(
        table(spark, sf, "orders"),
        ["o_orderpriority", "o_orderstatus", "n"],
        group_by=["o_orderstatus", "o_orderpriority"],
        aggregates={"n": count("o_totalprice")},
    )


def agg_count_string(spark, sf):
    return summarise(table(spark, sf, "documents"), ["lang"], {"n": count("source")})


def agg_same_column(spark, sf):
    return summarise(
        table(spark, sf, "events"), ["user_id"], {"low": lowest("value"), "high": highest("value")}
    )


def agg_having(spark, sf):
    per_user = summarise(
        table(spark, sf, "events"), ["user_id"], {"n": count("value"), "spent": total("value", 2)}
    )
    return where(per_user, F.col("n"), ">", F.lit(60))


def whole_statement(spark, sf):
    """Where, window and group by in one statement, given in another order."""
    return select_from(
        table(spark, sf, "events"),
        ["window_start", "event_type", ("n", "events"), "spent"],
        group_by=["event_type"],
        aggregates={"n": count("value"), "spent": total("value", 2)},
        window=("ts", 6 * HOUR, 6 * HOUR),
        where=(F.col("value"), ">", F.lit(10.0)),
    )


def statement_day(spark, sf):
    """A window of 24 panes in a statement: rows are combined per pane, not copied 24 times."""
    return select_from(
        table(spark, sf, "events"),
        ["window_start", "user_id", "n", "spent"],
        aggregates={"n": count("value"), "spent": total("value", 2)},
        window=("ts", 24 * HOUR, HOUR),
    )


QUERIES = {
    "statement_day": statement_day,
    "project_rename": project_rename,
    "project_qualified": project_qualified,
    "project_repeated": project_repeated,
    "filter_gt": quantity_filter(">", 45.0),
    "filter_lt": quantity_filter("<", 5.0),
    "filter_eq": quantity_filter("=", 7.0),
    "filter_le": quantity_filter("<=", 5.0),
    "filter_ge": quantity_filter(">=", 45.0),
    "filter_ne": quantity_filter("<>", 7.0),
    "filter_int_double": filter_int_double,
    "filter_col_col": filter_col_col,
    "filter_literal_left": filter_literal_left,
    "filter_string_eq": event_filter("="),
    "filter_string_ne": event_filter("<>"),
    "filter_string_col_col": filter_string_col_col,
    "filter_chain": filter_chain,
    "named_chain": named_chain,
    "agg_sum_min_max_avg_count": agg_sum_min_max_avg_count,
    "agg_int_types": agg_int_types,
    "agg_global": agg_global,
    "agg_global_empty": agg_global_empty,
    "agg_implicit_keys": agg_implicit_keys,
    "agg_explicit_keys": agg_explicit_keys,
    "agg_count_string": agg_count_string,
    "agg_same_column": agg_same_column,
    "agg_having": agg_having,
    "whole_statement": whole_statement,
}


def _quantity(condition):
    return f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {condition}"


def exact_sum(column):
    """A sum in decimals; values with up to four of them count whole."""
    return f"CAST(sum(CAST({column} AS DECIMAL(38, 4))) AS DOUBLE)"


SQL = {
    "project_rename": "SELECT o_orderkey, o_totalprice AS price FROM orders",
    "project_qualified": (
        "SELECT orders.o_orderkey AS order_key, orders.o_custkey AS cust_key FROM orders"
    ),
    "project_repeated": (
        "SELECT o_orderkey, o_custkey AS buyer, o_custkey AS payer FROM orders"
    ),
    "filter_gt": _quantity("l_quantity > 45"),
    "filter_lt": _quantity("l_quantity < 5"),
    "filter_eq": _quantity("l_quantity = 7"),
    "filter_le": _quantity("l_quantity <= 5"),
    "filter_ge": _quantity("l_quantity >= 45"),
    "filter_ne": _quantity("l_quantity <> 7"),
    "filter_int_double": _quantity("l_linenumber = 2"),
    "filter_col_col": (
        "SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax < l_discount"
    ),
    "filter_literal_left": _quantity("45 < l_quantity"),
    "filter_string_eq": (
        "SELECT event_id, event_type, value FROM events WHERE event_type = 'click'"
    ),
    "filter_string_ne": (
        "SELECT event_id, event_type, value FROM events WHERE event_type <> 'click'"
    ),
    "filter_string_col_col": """
        SELECT l_orderkey, l_linenumber, o_orderstatus
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_linestatus = o_orderstatus""",
    "filter_chain": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
        WHERE l_quantity > 30 AND l_extendedprice < 20000""",
    "named_chain": """
        SELECT o_custkey AS cust, count(*) AS n, max(o_totalprice) AS top
        FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) > 2""",
    "agg_sum_min_max_avg_count": f"""
        SELECT l_returnflag, l_linestatus, {exact_sum('l_extendedprice')} AS sum_price,
               min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price,
               {exact_sum('l_extendedprice')} / count(*) AS avg_price, count(*) AS n
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "agg_int_types": """
        SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS sum_line,
               min(l_linenumber) AS min_line, max(l_linenumber) AS max_line,
               CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS avg_line, count(*) AS n
        FROM lineitem GROUP BY l_suppkey""",
    "agg_global": f"""
        SELECT {exact_sum('value')} AS total, max(value) AS top, count(*) AS n FROM events""",
    "agg_global_empty": """
        SELECT max(value) AS top, count(*) AS n FROM events WHERE value < -1 HAVING count(*) > 0""",
    "agg_implicit_keys": f"""
        SELECT o_orderpriority, {exact_sum('o_totalprice')} AS spent
        FROM orders GROUP BY o_orderpriority""",
    "agg_explicit_keys": """
        SELECT o_orderpriority, o_orderstatus, count(*) AS n
        FROM orders GROUP BY o_orderstatus, o_orderpriority""",
    "agg_count_string": "SELECT lang, count(source) AS n FROM documents GROUP BY lang",
    "agg_same_column": """
        SELECT user_id, min(value) AS low, max(value) AS high FROM events GROUP BY user_id""",
    "agg_having": f"""
        SELECT user_id, count(*) AS n, {exact_sum('value')} AS spent
        FROM events GROUP BY user_id HAVING count(*) > 60""",
    "statement_day": f"""
        SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(k) AS window_start,
               user_id, count(*) AS n, {exact_sum('value')} AS spent
        FROM events, range(24) AS steps(k) GROUP BY 1, 2""",
    "whole_statement": f"""
        SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,
               event_type, count(*) AS events, {exact_sum('value')} AS spent
        FROM events WHERE value > 10 GROUP BY 1, 2""",
}
