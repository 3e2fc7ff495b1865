"""Event-time windows over rows, and window aggregates from pane partials.

A pane is the smallest step of time; a window is a run of panes and moves by
``slide``. Windows that hold no rows give no rows. Bounds come out as
``window_start`` and ``window_end``. Rows without a timestamp lie in no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panewise.functions.aggregates import Aggregate, check_types, merge, one_step, partial
from panewise.functions.event_time import block_start, duration, pane_start, with_pane
from panewise.functions.names import quoted, resolve

BOUNDS = ["window_start", "window_end"]

# Window lengths per block: a partial is copied 1 + 1/BLOCK_WINDOWS times on average.
BLOCK_WINDOWS = 4


def _with_bounds(df: DataFrame) -> DataFrame:
    rest = [quoted(c) for c in df.columns if c != "__w"]
    return df.select(F.col("__w.start").alias(BOUNDS[0]), F.col("__w.end").alias(BOUNDS[1]), *rest)


def window_rows(df: DataFrame, ts: str, size: int, slide: int | None = None) -> DataFrame:
    """Every row once per window that holds it: a projection, without a shuffle."""
    window = F.window(resolve(df, ts), duration(size), duration(slide or size))
    return _with_bounds(df.select("*", window.alias("__w")))


def window_aggregate(
    df: DataFrame,
    ts: str,
    size: int,
    slide: int | None,
    keys: list[str],
    aggregates: dict[str, Aggregate],
) -> DataFrame:
    """Aggregate per window and key, straight from the rows.

    Each row is copied once per window before the map-side combine: right for
    tumbling and slightly overlapping windows. See :func:`pane_aggregate` for others.
    """
    check_types(df, aggregates)
    window = F.window(resolve(df, ts), duration(size), duration(slide or size)).alias("__w")
    return _with_bounds(df.groupBy(window, *[resolve(df, k) for k in keys]).agg(*one_step(aggregates)))


def pane_aggregate(
    df: DataFrame,
    ts: str,
    size: int,
    slide: int,
    keys: list[str],
    aggregates: dict[str, Aggregate],
) -> DataFrame:
    """The same result as :func:`window_aggregate`, from one partial per pane and key.

    Rows are combined once, into panes of ``slide`` seconds. Windows are cut into blocks
    of consecutive starts, and each partial goes to the one or two blocks its windows lie
    in; there it is copied to those windows and merged without another shuffle. So what
    is shuffled depends neither on the number of rows nor on the length of a window, and
    a block of one key holds at most a few windows' worth of partials, however hot it is.

    Columns may be qualified (``t.value``); a key comes out under its last name, as in
    Spark. Names that start with two underscores are kept for partial results.
    """
    if size % slide:
        raise ValueError(f"a window of {size} s is not made of whole panes of {slide} s")
    if size == slide:
        return window_aggregate(df, ts, size, slide, keys, aggregates)
    check_types(df, aggregates)
    names = [df.select(resolve(df, k)).columns[0] for k in keys]
    if any(n.startswith("__") for n in (*names, *aggregates)):
        raise ValueError("names must not start with two underscores")
    inner = [f"__k{i}" for i in range(len(keys))]
    panes_per_window = size // slide
    block = BLOCK_WINDOWS * panes_per_window

    grouped = [F.col(resolve(df, k)).alias(i) for k, i in zip(keys, inner)]
    panes = with_pane(df, ts, slide, "__pane").groupBy("__pane", *grouped).agg(*partial(aggregates))
    last = F.col("__pane")
    first = last - (panes_per_window - 1)
    blocks = F.array_distinct(F.array(block_start(first, block), block_start(last, block)))
    copies = panes.withColumn("__block", F.explode(blocks))
    # Adaptive execution would size partitions by what comes in, before each partial is
    # copied to its windows; a fixed number is left as it is.
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = copies.repartition(number, "__block", *inner)
    starts = F.sequence(
        F.greatest(first, F.col("__block")), F.least(last, F.col("__block") + (block - 1))
    )
    merged = (
        placed.withColumn("__first", F.explode(starts))
        .groupBy("__block", "__first", *inner)
        .agg(*merge(aggregates))
    )
    start = pane_start(df, ts, "__first", slide).alias("window_start")
    end = F.expr(f"window_start + INTERVAL '{int(size)}' SECOND").alias("window_end")
    results = [quoted(a) for a in aggregates]
    bounds = merged.select(start, *inner, *results).select("window_start", end, *inner, *results)
    return bounds.toDF(*BOUNDS, *names, *aggregates)
