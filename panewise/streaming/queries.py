"""Streaming twins: event-time window aggregates and stream-stream joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panewise.functions.aggregates import Aggregate, check_types, one_step
from panewise.functions.event_time import duration, from_instant, to_instant
from panewise.functions.names import quoted, resolve
from panewise.operators.joins import equal, oriented, shared_names


def with_watermark(df: DataFrame, ts: str, delay: int) -> DataFrame:
    """Bound the state: rows later than ``delay`` seconds may be dropped.

    Watermarks need instants, so a zone-less column is read as UTC.
    """
    if is_ntz(df, ts):
        df = df.withColumn(ts, to_instant(quoted(ts)))
    return df.withWatermark(resolve(df, ts), duration(delay))


def is_ntz(df: DataFrame, ts: str) -> bool:
    return isinstance(df.schema[ts].dataType, T.TimestampNTZType)


def bound(instant: str, zoneless: bool) -> Column:
    """An instant in the type of the input's time column."""
    return from_instant(instant) if zoneless else F.col(instant)


def stream_window_aggregate(
    df: DataFrame,
    ts: str,
    size: int,
    slide: int | None,
    delay: int,
    keys: list[str],
    aggregates: dict[str, Aggregate],
) -> DataFrame:
    """Window aggregate with bounds in the type of ``ts``, as in the batch form."""
    check_types(df, aggregates)
    window = F.window(resolve(df, ts), duration(size), duration(slide or size)).alias("w")
    out = with_watermark(df, ts, delay).groupBy(window, *keys).agg(*one_step(aggregates))
    zoneless = is_ntz(df, ts)
    return out.select(
        bound("w.start", zoneless).alias("window_start"),
        bound("w.end", zoneless).alias("window_end"),
        *keys,
        *aggregates,
    )


def block_of(seconds: Column, block: int) -> Column:
    return F.floor(seconds / F.lit(block)).cast("bigint")


def part_of(column: str | None, df: DataFrame, parts: int) -> Column:
    """The hash part of a row; all rows lie in part 0 if there is only one."""
    if parts == 1:
        return F.lit(0)
    return F.pmod(F.xxhash64(resolve(df, column)), F.lit(parts)).cast("int")


def every(parts: int) -> Column:
    return F.sequence(F.lit(0), F.lit(parts - 1))


def near_in_time(time: str, other: str, before: int, after: int) -> Column:
    """Whether ``other`` lies ``before`` s before to ``after`` s after ``time``."""
    return F.expr(
        f"{other} >= {time} - INTERVAL '{int(before)}' SECOND AND "
        f"{other} <= {time} + INTERVAL '{int(after)}' SECOND"
    )


def stream_join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    before: int,
    after: int,
    delay: int,
    right_id: str,
    splits: int = 1,
    left_id: str | None = None,
    left_splits: int = 1,
    left_marked: bool = False,
) -> DataFrame:
    """Pairs with equal keys whose right row lies ``before`` s before to ``after`` s after
    the left row, each emitted once. Watermarks on both sides let old state go.

    Adaptive execution does not split stateful tasks, so the key is split by hand. Time
    blocks of ``before + after`` seconds join the equality: a left row goes to the one or
    two blocks its partners can lie in, and a key's distant rows never meet. So a left row
    is stored at most twice and a right row once. For keys that are hot within one block,
    ``splits`` spreads the right rows of a key by a hash of their ``right_id`` and
    ``left_splits`` the left rows by ``left_id``; each row then goes to every split of the
    other side. Pass the smaller stream as ``left``.

    Joins can be chained: ``left`` may be the result of another stream join or aggregate,
    whose times carry a watermark already; say so with ``left_marked``, and keep only the one
    time column that this join uses. The watermark of a
    query over several inputs is that of the slowest one. While an input is idle it stands
    still: pairs whose rows have arrived are emitted all the same, only old state stays.

    Times come out as instants. Rows without a time join nothing.
    """
    shared_names(left, right)
    if not on:
        raise ValueError("a join needs at least one pair of columns")
    if before < 0 or after < 0 or before + after == 0 or min(splits, left_splits) < 1:
        raise ValueError("before, after and splits must span something")
    if left_splits > 1 and left_id is None:
        raise ValueError("left_splits needs a left_id")
    keys = equal([oriented(left, right, pair) for pair in on])
    block = before + after
    lefts = left if left_marked else with_watermark(left, left_ts, delay)
    rights = with_watermark(right, right_ts, delay)
    left_time, right_time = resolve(left, left_ts), resolve(right, right_ts)
    first = block_of(F.unix_seconds(left_time) - before, block)
    last = block_of(F.unix_seconds(left_time) + after, block)
    lefts = lefts.withColumn("__block", F.explode(F.array_distinct(F.array(first, last))))
    lefts = lefts.withColumn("__of_left", part_of(left_id, left, left_splits))
    rights = rights.withColumn("__own", block_of(F.unix_seconds(right_time), block))
    rights = rights.withColumn("__of_right", part_of(right_id, right, splits))
    if splits > 1:
        lefts = lefts.withColumn("__for_right", F.explode(every(splits)))
    else:
        lefts = lefts.withColumn("__for_right", F.lit(0))
    if left_splits > 1:
        rights = rights.withColumn("__for_left", F.explode(every(left_splits)))
    else:
        rights = rights.withColumn("__for_left", F.lit(0))
    joined = lefts.join(
        rights,
        keys
        & (F.col("__block") == F.col("__own"))
        & (F.col("__for_right") == F.col("__of_right"))
        & (F.col("__of_left") == F.col("__for_left"))
        & near_in_time(left_time, right_time, before, after),
    )
    return joined.select(*[quoted(c) for c in (*left.columns, *right.columns)])


def stream_outer_join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    before: int,
    after: int,
    delay: int,
    how: str,
    left_id: str | None = None,
    left_splits: int = 1,
    right_id: str | None = None,
    right_splits: int = 1,
) -> DataFrame:
    """The pairs of :func:`stream_join`, and the rows without a partner of the kept sides:
    ``how`` is "left", "right" or "full". The columns of the missing partner are null.

    A row without a partner comes out once, when the watermark says that none can come any
    more: ``after`` seconds after a left row, ``before`` seconds after a right one. Rows that
    may still find one are not emitted.

    A kept row must lie in one place, or its copies would each miss the others' partners. So
    the rows of the other side are copied to the one or two time blocks, and to all hash parts
    (``left_splits`` or ``right_splits`` of a kept side's hot keys), where a kept row can be.
    A full join keeps both sides: it is a left join and the rows of a right join that have no
    partner; for these only keys and times of the left side are stored.

    Rows with a null key have no partner; rows without a time take no part. Times come out as
    instants.
    """
    if how not in ("left", "right", "full"):
        raise ValueError(f"unknown join {how}: use left, right or full")
    shared_names(left, right)
    if not on:
        raise ValueError("a join needs at least one pair of columns")
    if before < 0 or after < 0 or before + after == 0 or min(left_splits, right_splits) < 1:
        raise ValueError("before, after and splits must span something")
    if left_splits > 1 and left_id is None or right_splits > 1 and right_id is None:
        raise ValueError("splits need an id")
    pairs = [oriented(left, right, pair) for pair in on]
    lefts, rights = (
        with_watermark(df, ts, delay).where(F.col(resolve(df, ts)).isNotNull())
        for df, ts in ((left, left_ts), (right, right_ts))
    )
    left_time, right_time = resolve(left, left_ts), resolve(right, right_ts)
    columns = [quoted(c) for c in (*left.columns, *right.columns)]
    out = None
    if how in ("left", "full"):
        condition = equal(pairs) & near_in_time(left_time, right_time, before, after)
        spread = _one_place(lefts, rights, left_time, right_time, before, after, left_id, left_splits)
        out = _joined(*spread, condition, "left_outer").select(*columns)
    if how == "right":
        condition = equal(pairs) & near_in_time(right_time, left_time, after, before)
        spread = _one_place(rights, lefts, right_time, left_time, after, before, right_id, right_splits)
        out = _joined(*spread, condition, "left_outer").select(*columns)
    if how == "full":
        keys = [F.col(a).alias(f"__k{i}") for i, (a, _) in enumerate(pairs)]
        narrow = lefts.select(*keys, F.col(left_time).alias("__time"), F.lit(1).alias("__here"))
        same = equal([(f"__k{i}", b) for i, (_, b) in enumerate(pairs)])
        condition = same & near_in_time(right_time, "__time", after, before)
        spread = _one_place(rights, narrow, right_time, "__time", after, before, right_id, right_splits)
        alone = _joined(*spread, condition, "left_outer").where(F.col("__here").isNull())
        types = {f.name: f.dataType for f in lefts.schema}
        nothing = [F.lit(None).cast(types[c]).alias(c) for c in left.columns]
        out = out.unionByName(alone.select(*nothing, *[quoted(c) for c in right.columns]))
    return out


def _one_place(
    kept: DataFrame,
    other: DataFrame,
    kept_time: str,
    other_time: str,
    before: int,
    after: int,
    kept_id: str | None,
    splits: int,
) -> tuple[DataFrame, DataFrame]:
    """Every kept row in its own time block and hash part, the others wherever they can be met."""
    block = before + after
    kept = kept.withColumns(
        {"__own": block_of(F.unix_seconds(kept_time), block), "__part": part_of(kept_id, kept, splits)}
    )
    first = block_of(F.unix_seconds(other_time) - after, block)
    last = block_of(F.unix_seconds(other_time) + before, block)
    other = other.withColumn("__block", F.explode(F.array_distinct(F.array(first, last))))
    return kept, other.withColumn("__for", F.explode(every(splits)) if splits > 1 else F.lit(0))


def _joined(kept: DataFrame, other: DataFrame, condition: Column, how: str) -> DataFrame:
    meets = (F.col("__own") == F.col("__block")) & (F.col("__part") == F.col("__for"))
    return kept.join(other, condition & meets, how)


def stream_aggregate_join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    size: int,
    slide: int | None,
    delay: int,
    keys: list[str],
    aggregates: dict[str, Aggregate],
) -> DataFrame:
    """A windowed aggregate of ``left`` joined to the rows of ``right`` in the same window.

    ``on`` pairs keys of the aggregate with columns of ``right``. Result columns are the
    window's bounds, the keys, the aggregates and the columns of ``right``. Aggregates come
    out when the watermark has closed their window and meet the waiting rows by key and
    window, so state goes with the watermark and a hot key spreads over its windows. A row of
    ``right`` is copied to each of its windows; its time comes out as an instant.
    """
    check_types(left, aggregates)
    names = [left.select(resolve(left, k)).columns[0] for k in keys]
    clash = {*names, *aggregates, "window_start", "window_end"} & set(right.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}: name the columns with qualified()")
    if not on:
        raise ValueError("a join needs at least one pair of columns")
    zoneless = is_ntz(left, left_ts)
    spans = duration(size), duration(slide or size)
    lefts, rights = with_watermark(left, left_ts, delay), with_watermark(right, right_ts, delay)
    grouped = [F.col(resolve(lefts, k)).alias(n) for k, n in zip(keys, names)]
    window = F.window(resolve(lefts, left_ts), *spans).alias("__w")
    totals = lefts.groupBy(window, *grouped).agg(*one_step(aggregates))
    # a join takes one time column from each side, so the others travel as microseconds
    micros = [F.unix_micros("__w.start").alias("__from"), F.unix_micros("__w.end").alias("__to")]
    closed = F.window_time("__w").alias("__closed")
    totals = totals.select(closed, *micros, *[quoted(c) for c in (*names, *aggregates)])
    rights = rights.withColumn("__of", F.window(resolve(rights, right_ts), *spans))
    time = F.unix_micros(resolve(rights, right_ts)).alias("__micros")
    kept = [c for c in right.columns if c != right_ts]
    waiting = rights.select(F.window_time("__of").alias("__time"), time, *[quoted(c) for c in kept])
    pairs = equal([oriented(totals, waiting, pair) for pair in on])
    joined = totals.join(waiting, pairs & (F.col("__closed") == F.col("__time")))
    instants = {c: F.timestamp_micros(f"__{m}") for c, m in zip(("start", "end", right_ts), ("from", "to", "micros"))}
    joined = joined.withColumns({f"__{c}": instants[c] for c in ("start", "end")})
    return joined.select(
        bound("__start", zoneless).alias("window_start"),
        bound("__end", zoneless).alias("window_end"),
        *[quoted(c) for c in (*names, *aggregates)],
        *[instants[c].alias(c) if c == right_ts else F.col(quoted(c)) for c in right.columns],
    )


def stream_window_join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    pane: int,
    left_panes: int,
    right_panes: int,
    delay: int,
    right_id: str,
    splits: int = 1,
    left_id: str | None = None,
    left_splits: int = 1,
) -> DataFrame:
    """Two windowed streams joined: the streaming twin of the batch pane join.

    A pair is found once, as soon as both rows are there, and then reported for every
    pane at whose end both are kept; ``last_pane`` is the start of that pane.
    """
    if min(left_panes, right_panes) < 1:
        raise ValueError("a window holds at least one pane")
    # Rows in panes near enough are never further apart than these times.
    pairs = stream_join(
        left, right, on, left_ts, right_ts, right_panes * pane, left_panes * pane,
        delay, right_id, splits, left_id, left_splits,
    )

    def pane_of(ts: str) -> Column:
        return F.floor(F.unix_seconds(ts) / F.lit(pane)).cast("bigint")

    zoneless = is_ntz(left, left_ts)
    left_ts, right_ts = resolve(left, left_ts), resolve(right, right_ts)
    lefts, rights = F.col("__left_pane"), F.col("__right_pane")
    near = pairs.withColumns(
        {"__left_pane": pane_of(left_ts), "__right_pane": pane_of(right_ts)}
    ).where(rights.between(lefts - (right_panes - 1), lefts + (left_panes - 1)))
    ends = F.sequence(
        F.greatest(lefts, rights), F.least(lefts + (left_panes - 1), rights + (right_panes - 1))
    )
    last = F.timestamp_seconds(F.col("__last") * F.lit(pane))
    return (
        near.withColumn("__last", F.explode(ends))
        .withColumn("last_pane", last)
        .select(
            bound("last_pane", zoneless).alias("last_pane"),
            *[quoted(c) for c in (*left.columns, *right.columns)],
        )
    )
