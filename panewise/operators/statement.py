"""A whole select statement in one call, for queries given as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.functions.aggregates import Aggregate
from panewise.operators.filters import where as keep
from panewise.operators.grouping import summarise
from panewise.operators.joins import join
from panewise.operators.windows import BOUNDS, pane_aggregate, window_aggregate, window_rows


def select_from(
    source: DataFrame,
    select: list[str | tuple[str, str]],
    *,
    where: tuple[Column, str, Column] | None = None,
    window: tuple[str, int, int] | None = None,
    aggregates: dict[str, Aggregate] | None = None,
    group_by: list[str] | None = None,
    joins: tuple[tuple[DataFrame, list[tuple[str, str]], str], ...] = (),
) -> DataFrame:
    """Always where, window, group by, joins, select, in this order.

    ``select`` holds column names, or (column, alias) pairs. Its plain columns are the
    group keys unless ``group_by`` is needed because joins add further columns.
    ``window`` is (timestamp column, size, slide) in seconds and adds the bounds.
    """
    items = [(i, i.split(".")[-1]) if isinstance(i, str) else i for i in select]
    df = source if where is None else keep(source, *where)
    if aggregates:
        plain = [c for c, _ in items if c not in aggregates and c not in BOUNDS]
        keys = group_by if joins and group_by else plain
        if group_by is not None and set(group_by) != set(keys):
            raise ValueError(f"grouped by {sorted(group_by)} but selecting {sorted(keys)}")
        if window:
            # windows of several whole panes are merged from panes, whatever their length
            of_panes = window[1] > window[2] and window[1] % window[2] == 0
            form = pane_aggregate if of_panes else window_aggregate
            df = form(df, *window, keys, aggregates)
        else:
            df = summarise(df, keys, aggregates)
    elif group_by:
        raise ValueError("group by needs an aggregate")
    elif window:
        df = window_rows(df, *window)
    for other, on, how in joins:
        df = join(df, other, on, how)
    return df.select(*[F.col(column).alias(alias) for column, alias in items])
