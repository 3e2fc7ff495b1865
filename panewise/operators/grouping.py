"""Grouped and global aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panewise.functions.aggregates import Aggregate, check_types, one_step


def summarise(
    df: DataFrame,
    keys: list[str],
    aggregates: dict[str, Aggregate],
    group_by: list[str] | None = None,
) -> DataFrame:
    """Group by the plain columns of the select list; ``aggregates`` names the rest.

    ``group_by`` may repeat the keys, in any order, but not differ from them. Without
    keys an empty input gives no row. Rows of one hot key are combined on the map
    side, so a shuffle carries at most one row per key and task.
    """
    if group_by is not None and set(group_by) != set(keys):
        raise ValueError(f"grouped by {sorted(group_by)} but selecting {sorted(keys)}")
    if not aggregates:
        raise ValueError("nothing to aggregate")
    if set(keys) & set(aggregates):
        raise ValueError(f"names used twice: {sorted(set(keys) & set(aggregates))}")
    check_types(df, aggregates)
    if keys:
        return df.groupBy(*keys).agg(*one_step(aggregates))
    counted = df.agg(*one_step(aggregates), F.count("*").alias("__n"))
    return counted.where(F.col("__n") > 0).drop("__n")
