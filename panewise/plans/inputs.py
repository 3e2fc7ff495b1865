"""Delimited text, addresses and slices, from lines that Spark builds out of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panewise.functions.aggregates import count, total
from panewise.functions.text import join_fields
from panewise.operators.grouping import summarise
from panewise.operators.sinks import write_delimited
from panewise.plans.relational import exact_sum
from panewise.session import shared_folder
from panewise.sources.delimited import declare, line_counts, parse, split_addresses
from panewise.sources.slices import dense_slice, time_slice, with_arrival_index, with_line_index
from panewise.sources.tables import table

LINE_SCHEMA = "orderkey int, linenumber int, price double, flag string"


def damaged_lines(spark, sf):
    """One line per row of lineitem; some kinds of rows get lines that are odd or wrong."""
    lines = table(spark, sf, "lineitem")
    number = F.col("l_linenumber").cast("string")
    number = (
        F.when(F.col("l_linenumber") == 2, F.concat(F.lit(" "), number))
        .when(F.col("l_linenumber") == 4, F.concat(number, F.lit("x")))
        .when(F.col("l_linenumber") == 5, F.lit(""))
        .otherwise(number)
    )
    price = F.col("l_extendedprice").cast("string")
    price = F.when(F.col("l_linenumber") == 6, F.concat(F.lit(" "), price, F.lit(" ")))
    price = price.otherwise(F.col("l_extendedprice").cast("string"))
    tail = (
        F.when(F.col("l_returnflag") == "A", F.lit(",,"))
        .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), F.lit(",more"))
        .otherwise(F.lit(""))
    )
    line = F.concat_ws(",", F.col("l_orderkey").cast("string"), number, price, "l_returnflag")
    line = F.concat(line, tail)
    padded = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("\t "), line, F.lit(" ")))
    return lines.select(padded.otherwise(line).alias("value"))


def parse_delimited(spark, sf):
    return parse(damaged_lines(spark, sf), LINE_SCHEMA, ",")


def parse_rejected_count(spark, sf):
    return line_counts(damaged_lines(spark, sf), LINE_SCHEMA, ",")


def parse_pairs(spark, sf):
    """Two-integer lines; error events send a word for the second number."""
    events = table(spark, sf, "events")
    second = F.when(F.col("event_type") == "error", F.col("event_type"))
    second = second.otherwise(F.col("event_id").cast("string"))
    lines = events.select(F.concat_ws(",", F.col("user_id").cast("string"), second).alias("value"))
    return parse(lines, "k int, v int", ",")


def declared_input(spark, sf):
    """Write a table as delimited text, declare the folder as an input, and query it."""
    path = shared_folder(spark, "events-text")
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    write_delimited(events, path, events.columns, "|")
    schema = "event int, user int, kind string, value double"
    typed = declare(spark, "pw_events_text", schema, path, "|")
    return summarise(typed, ["kind"], {"n": count("event"), "spent": total("value", 2)})


def address_lines(spark, sf):
    """Blank-separated lines; field 3 always has five dotted parts, field 5 only sometimes."""
    lines = table(spark, sf, "lineitem")
    source = join_fields(
        ["l_suppkey", "l_linenumber", "l_partkey", "l_orderkey", "l_linenumber"], "."
    )
    target = F.when(
        F.col("l_returnflag") == "N", join_fields(["l_partkey", "l_suppkey", "l_orderkey"], ".")
    ).otherwise(
        join_fields(["l_partkey", "l_suppkey", "l_linenumber", "l_orderkey", "l_suppkey"], ".")
    )
    line = F.concat_ws(
        " ",
        F.col("l_orderkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.col("l_returnflag"),
        source,
        F.lit(">"),
        target,
        F.col("l_linestatus"),
    )
    return lines.select(line.alias("value"))


def normalise_address(spark, sf):
    return split_addresses(address_lines(spark, sf)).withColumnRenamed("value", "line")


def normalise_and_parse(spark, sf):
    """Both addresses split: nine fields. Lines with an unsplit address are dropped."""
    schema = (
        "orderkey int, linenumber int, flag string, srcnet string, srchost string, "
        "arrow string, dstnet string, dsthost string, status string"
    )
    return parse(split_addresses(address_lines(spark, sf)), schema, " ").drop("arrow")


def time_slices(spark, sf):
    events = table(spark, sf, "events").select(time_slice("ts", 6 * 3600).alias("w"), "value")
    sums = summarise(events, ["w"], {"n": count("value"), "spent": total("value", 2)})
    return sums.select(F.col("w.start").alias("slice_start"), "n", "spent")


def count_slices(spark, sf):
    events = table(spark, sf, "events").withColumn("slice", dense_slice("event_id", 500))
    return summarise(events, ["slice"], {"n": count("event_id"), "spent": total("value", 2)})


def count_slices_arrival(spark, sf):
    """Slices by place in the files. How many rows each holds does not depend on the order."""
    lines = with_arrival_index(table(spark, sf, "lineitem"))
    sliced = lines.withColumn("slice", dense_slice("arrival", 18000))
    return summarise(sliced, ["slice"], {"n": count("arrival")})


def text_line_index(spark, sf):
    """Lines of text files numbered in the order in which the files hold them."""
    path = shared_folder(spark, "orders-text")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    in_order = orders.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    write_delimited(in_order, path, orders.columns, "|")
    return with_line_index(spark.read.text(path)).select("arrival", F.col("value").alias("line"))


QUERIES = {
    "text_line_index": text_line_index,
    "parse_delimited": parse_delimited,
    "parse_rejected_count": parse_rejected_count,
    "parse_pairs": parse_pairs,
    "declared_input": declared_input,
    "normalise_address": normalise_address,
    "normalise_and_parse": normalise_and_parse,
    "time_slices": time_slices,
    "count_slices": count_slices,
    "count_slices_arrival": count_slices_arrival,
}

# The rows whose lines stay valid, said in terms of the table rather than of the text.
_VALID = """
    (l_linenumber NOT IN (2, 4, 5) AND NOT (l_returnflag = 'R' AND l_linestatus = 'O')
     AND TRY_CAST(l_orderkey AS INTEGER) IS NOT NULL)"""
_SOURCE = "concat_ws('.', l_suppkey, l_linenumber, l_partkey)"
_SOURCE_HOST = "concat_ws('.', l_orderkey, l_linenumber)"
_TARGET = "concat_ws('.', l_partkey, l_suppkey, l_linenumber)"
_TARGET_HOST = "concat_ws('.', l_orderkey, l_suppkey)"

SQL = {
    "text_line_index": """
        SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS arrival,
               concat_ws('|', o_orderkey, o_orderpriority) AS line
        FROM orders""",
    "parse_delimited": f"""
        SELECT CAST(l_orderkey AS INTEGER) AS orderkey, l_linenumber AS linenumber,
               l_extendedprice AS price, l_returnflag AS flag
        FROM lineitem WHERE {_VALID}""",
    "parse_rejected_count": f"""
        SELECT count(*) AS n_lines, count(*) FILTER (WHERE {_VALID}) AS n_kept,
               count(*) FILTER (WHERE NOT {_VALID}) AS n_rejected
        FROM lineitem""",
    "parse_pairs": """
        SELECT CAST(user_id AS INTEGER) AS k, CAST(event_id AS INTEGER) AS v
        FROM events WHERE event_type <> 'error'""",
    "declared_input": f"""
        SELECT event_type AS kind, count(*) AS n, {exact_sum('value')} AS spent
        FROM events GROUP BY event_type""",
    "normalise_address": f"""
        SELECT concat_ws(' ', l_orderkey, l_linenumber, l_returnflag, {_SOURCE}, {_SOURCE_HOST},
               '>', CASE WHEN l_returnflag = 'N'
                    THEN concat_ws('.', l_partkey, l_suppkey, l_orderkey)
                    ELSE concat_ws(' ', {_TARGET}, {_TARGET_HOST}) END, l_linestatus) AS line
        FROM lineitem""",
    "normalise_and_parse": f"""
        SELECT CAST(l_orderkey AS INTEGER) AS orderkey, l_linenumber AS linenumber,
               l_returnflag AS flag, {_SOURCE} AS srcnet, {_SOURCE_HOST} AS srchost,
               {_TARGET} AS dstnet, {_TARGET_HOST} AS dsthost, l_linestatus AS status
        FROM lineitem WHERE l_returnflag <> 'N' AND TRY_CAST(l_orderkey AS INTEGER) IS NOT NULL""",
    "time_slices": f"""
        SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS slice_start,
               count(*) AS n, {exact_sum('value')} AS spent
        FROM events GROUP BY 1""",
    "count_slices": f"""
        SELECT CAST(event_id // 500 AS BIGINT) AS slice, count(*) AS n,
               {exact_sum('value')} AS spent
        FROM events GROUP BY 1""",
    "count_slices_arrival": """
        SELECT CAST((place - 1) // 18000 AS BIGINT) AS slice, count(*) AS n
        FROM (SELECT row_number() OVER () AS place FROM lineitem) GROUP BY 1""",
}
