"""Joins of two windowed inputs.

The left input keeps its last ``left_panes`` panes and the right one its last
``right_panes``. A pair of rows with equal keys is reported for every pane at whose end
both rows are kept; ``last_pane`` is the start of that pane. Rows without a timestamp lie
in no pane. Inputs that share column names are named with
:func:`panewise.functions.names.qualified` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.functions.event_time import block_start, pane_start, with_pane
from panewise.functions.names import quoted
from panewise.operators.joins import equal, oriented, shared_names

_L, _R = "__left_pane", "__right_pane"


def _prepare(
    left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, pane: int, *counts: int
) -> tuple[DataFrame, DataFrame]:
    shared_names(left, right)
    if min(counts) < 1:
        raise ValueError("a window holds at least one pane")
    return with_pane(left, left_ts, pane, _L), with_pane(right, right_ts, pane, _R)


def _equal(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> Column:
    if not on:
        raise ValueError("a join needs at least one pair of columns")
    return equal([oriented(left, right, pair) for pair in on])


def _report(joined: DataFrame, left: DataFrame, right: DataFrame, ts: str, pane: int) -> DataFrame:
    kept = [quoted(c) for c in (*left.columns, *right.columns)]
    return joined.select(pane_start(left, ts, "__last", pane).alias("last_pane"), *kept)


def window_join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    pane: int,
    left_panes: int,
    right_panes: int,
) -> DataFrame:
    """Join window by window: every row is copied to each pane that still keeps it.

    Rows are shuffled once per copy, so this suits windows of few panes. The pane is
    part of the join key, so a hot key spreads over its panes.
    """
    lefts, rights = _prepare(left, right, left_ts, right_ts, pane, left_panes, right_panes)
    kept = lefts.withColumn("__last", F.explode(F.sequence(_L, F.col(_L) + (left_panes - 1))))
    other = rights.withColumn("__end", F.explode(F.sequence(_R, F.col(_R) + (right_panes - 1))))
    joined = kept.join(other, _equal(left, right, on) & (F.col("__last") == F.col("__end")))
    return _report(joined, left, right, left_ts, pane)


def pane_join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    pane: int,
    left_panes: int,
    right_panes: int,
) -> DataFrame:
    """The same result as :func:`window_join`, forming each pair of rows once.

    Two rows meet when their panes are near enough, and are then reported for the run
    of panes that keeps both. Nearness is an equality on blocks of panes: a left row
    goes to the one or two blocks its partners can lie in, a right row to its own.
    So a row is shuffled at most twice whatever the window, a key's rows from distant
    times never meet, and a hot key spreads over its blocks. Pass the smaller input
    as ``left``.
    """
    lefts, rights = _prepare(left, right, left_ts, right_ts, pane, left_panes, right_panes)
    block = left_panes + right_panes - 1
    first, last = F.col(_L) - (right_panes - 1), F.col(_L) + (left_panes - 1)
    blocks = F.array_distinct(F.array(block_start(first, block), block_start(last, block)))
    near = F.col(_R).between(first, last)
    joined = lefts.withColumn("__block", F.explode(blocks)).join(
        rights.withColumn("__own", block_start(F.col(_R), block)),
        _equal(left, right, on) & (F.col("__block") == F.col("__own")) & near,
    )
    ends = F.sequence(
        F.greatest(_L, _R),
        F.least(F.col(_L) + (left_panes - 1), F.col(_R) + (right_panes - 1)),
    )
    return _report(joined.withColumn("__last", F.explode(ends)), left, right, left_ts, pane)
