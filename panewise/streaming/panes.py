"""Incremental window aggregates on live input.

Rows are combined once, into panes. A pane leaves the first aggregation when the watermark
has passed its end, and its partial results, one per pane and key, are merged into the
windows that hold it by a second one. So a row touches one pane of state however long the
windows are, and what reaches the windows depends on the panes and keys, not on the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panewise.functions.aggregates import Aggregate, check_types, merge, part_names, partial
from panewise.functions.event_time import duration
from panewise.functions.names import quoted, resolve
from panewise.streaming.queries import bound, is_ntz, stream_window_aggregate, with_watermark


def stream_pane_aggregate(
    df: DataFrame,
    ts: str,
    size: int,
    slide: int,
    delay: int,
    keys: list[str],
    aggregates: dict[str, Aggregate],
) -> DataFrame:
    """Closed windows, each once: the streaming twin of ``pane_aggregate``.

    The result has the columns and types of :func:`stream_window_aggregate` and must be
    written in append mode. Windows come out when the watermark, the largest time seen less
    ``delay`` seconds, has passed their end. A restart with the same checkpoint goes on with
    the open panes and windows. Rows without a time lie in no window.

    State is one row per open pane and key, and one per open window and key: together about
    as many as a window has panes, for each key. Names that start with two underscores are
    kept for partial results.
    """
    if size % slide:
        raise ValueError(f"a window of {size} s is not made of whole panes of {slide} s")
    if size == slide:
        return stream_window_aggregate(df, ts, size, None, delay, keys, aggregates)
    check_types(df, aggregates)
    names = [df.select(resolve(df, k)).columns[0] for k in keys]
    if any(n.startswith("__") for n in (*names, *aggregates)):
        raise ValueError("names must not start with two underscores")
    inner = [f"__k{i}" for i in range(len(keys))]
    zoneless = is_ntz(df, ts)
    rows = with_watermark(df, ts, delay)
    grouped = [F.col(resolve(rows, k)).alias(i) for k, i in zip(keys, inner)]
    pane = F.window(resolve(rows, ts), duration(slide)).alias("__pane")
    panes = rows.groupBy(pane, *grouped).agg(*partial(aggregates))
    parts = list(part_names(aggregates).values())
    timed = panes.select(F.window_time("__pane").alias("__time"), *inner, *parts)
    window = F.window("__time", duration(size), duration(slide)).alias("__w")
    merged = timed.groupBy(window, *inner).agg(*merge(aggregates))
    results = [quoted(a) for a in aggregates]
    bounds = [bound("__w.start", zoneless), bound("__w.end", zoneless)]
    return merged.select(*bounds, *inner, *results).toDF("window_start", "window_end", *names, *aggregates)
