"""How selective a join is, from counts per key: the join itself is never formed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panewise.functions.event_time import block_start, pane_start, with_pane
from panewise.operators.joins import oriented
from panewise.operators.windows import BLOCK_WINDOWS

_COUNT = "decimal(19,0)"


def join_selectivity(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """One row: rows left, rows right, rows joined, and joined / (left * right).

    No row when a side is empty. Both sides are counted per key in one aggregation
    (map-side first, so hot keys are no burden), and the joined rows are the sum over
    keys of the product of the two counts. Products are exact up to 38 digits.
    """
    pairs = [oriented(left, right, pair) for pair in on]
    keys = [f"__k{i}" for i in range(len(pairs))]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def tagged(df: DataFrame, columns: list[str], in_left, in_right) -> DataFrame:
        renamed = [F.col(c).alias(k) for c, k in zip(columns, keys)]
        return df.select(*renamed, in_left.alias("l"), in_right.alias("r"))

    both = tagged(left, [a for a, _ in pairs], one, none).unionByName(
        tagged(right, [b for _, b in pairs], none, one)
    )
    counts = both.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return totals(counts, keys)


def totals(counts: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The profile from the rows ``l`` and ``r`` per key; null keys join nothing."""
    matched = reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys), F.lit(True))
    product = F.col("l").cast(_COUNT) * F.col("r").cast(_COUNT)
    sums = counts.groupBy(*by).agg(
        F.sum("l").alias("left_rows"),
        F.sum("r").alias("right_rows"),
        F.sum(F.when(matched, product).otherwise(0)).cast("double").alias("joined_rows"),
    )
    possible = F.col("left_rows").cast("double") * F.col("right_rows").cast("double")
    return sums.where((F.col("left_rows") > 0) & (F.col("right_rows") > 0)).withColumn(
        "selectivity", F.col("joined_rows") / possible
    )


def window_selectivity(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    pane: int,
    left_panes: int,
    right_panes: int,
) -> DataFrame:
    """The selectivity of a window join, one row for every pane at whose end both sides have
    rows: ``last_pane`` (its start), rows left, rows right, rows joined, and joined / (left *
    right).

    Both sides are counted per pane and key in one aggregation, combined map-side. The left
    counts of a pane belong to the ``left_panes`` ends from it on, the right ones to
    ``right_panes``. Counts go to one or two blocks of ends, are copied to their ends there
    and merged without another shuffle, as in ``pane_aggregate``; then the products of the
    two counts of a key are summed per end. The join itself is never formed, so neither a
    hot key nor a long window multiplies rows. Rows without a time lie in no pane; rows with
    a null key count on their side and join nothing.
    """
    if min(left_panes, right_panes) < 1:
        raise ValueError("a window holds at least one pane")
    if not on:
        raise ValueError("a join needs at least one pair of columns")
    pairs = [oriented(left, right, pair) for pair in on]
    keys = [f"__k{i}" for i in range(len(pairs))]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def tagged(df: DataFrame, ts: str, columns: list[str], in_left, in_right) -> DataFrame:
        rows = with_pane(df, ts, pane, "__pane").where(F.col("__pane").isNotNull())
        renamed = [F.col(c).alias(k) for c, k in zip(columns, keys)]
        return rows.select("__pane", *renamed, in_left.alias("l"), in_right.alias("r"))

    both = tagged(left, left_ts, [a for a, _ in pairs], one, none).unionByName(
        tagged(right, right_ts, [b for _, b in pairs], none, one)
    )
    counts = both.groupBy("__pane", *keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    longest = max(left_panes, right_panes)
    block = BLOCK_WINDOWS * longest
    first, last = F.col("__pane"), F.col("__pane") + (longest - 1)
    blocks = F.array_distinct(F.array(block_start(first, block), block_start(last, block)))
    number = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = counts.withColumn("__block", F.explode(blocks)).repartition(number, "__block", *keys)
    ends = F.sequence(F.greatest(first, F.col("__block")), F.least(last, F.col("__block") + (block - 1)))
    aged = placed.withColumn("__last", F.explode(ends))
    age = F.col("__last") - first
    per_key = aged.groupBy("__block", "__last", *keys).agg(
        F.sum(F.when(age < left_panes, F.col("l")).otherwise(0)).alias("l"),
        F.sum(F.when(age < right_panes, F.col("r")).otherwise(0)).alias("r"),
    )
    found = totals(per_key, keys, ("__last",))
    return found.select(pane_start(left, left_ts, "__last", pane).alias("last_pane"), *found.columns[1:])


def edge_selectivities(
    tables: dict[str, DataFrame], edges: dict[str, tuple[str, str, str, str]]
) -> DataFrame:
    """A :func:`join_selectivity` row for each of several edges, with its name as ``edge``.

    An edge is (left table, left column, right table, right column). Every table is read
    once, whatever the number of its edges: each row gives one (edge, key) pair per edge,
    and all of them are counted in one aggregation, combined map-side.
    """
    shared: dict[str, list] = {}
    for edge, (left, left_key, right, right_key) in edges.items():
        left_key, right_key = oriented(tables[left], tables[right], (left_key, right_key))
        for name, key, side in ((left, left_key, (1, 0)), (right, right_key, (0, 1))):
            # keys of one edge have one type, so equal texts are equal keys once zero has one sign
            number = isinstance(tables[name].select(key).schema[0].dataType, T.FractionalType)
            value = (F.col(key) + 0 if number else F.col(key)).cast("string").alias("key")
            counted = [F.lit(n).cast("bigint").alias(c) for n, c in zip(side, "lr")]
            shared.setdefault(name, []).append(F.struct(F.lit(edge).alias("edge"), value, *counted))
    rows = [tables[name].select(F.inline(F.array(*items))) for name, items in shared.items()]
    both = reduce(DataFrame.unionByName, rows)
    counts = both.groupBy("edge", "key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return totals(counts, ["key"], ("edge",))


def product_size(left: DataFrame, right: DataFrame) -> DataFrame:
    """The number of rows a join without a condition would have, without forming it."""
    sizes = join_selectivity(left, right, [])
    return sizes.select("left_rows", "right_rows", F.col("joined_rows").alias("product_rows"))


def rank_edges(profiles: DataFrame) -> DataFrame:
    """Join edges, most selective first, from the rows of :func:`edge_selectivities`."""
    # One row per edge: the window without partitions sees only these.
    order = Window.orderBy("selectivity", "edge")
    return profiles.withColumn("place", F.row_number().over(order))
