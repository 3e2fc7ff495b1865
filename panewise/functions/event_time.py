"""Event-time arithmetic that does not depend on the session time zone.

Durations are whole seconds. Pane ``p`` covers ``[p*width, (p+1)*width)`` counted
from 1970-01-01; a zone-less timestamp is read as if it were UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panewise.functions.names import resolve

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def duration(seconds: int) -> str:
    if int(seconds) != seconds or seconds <= 0:
        raise ValueError(f"a duration must be a positive whole number of seconds: {seconds}")
    return f"{int(seconds)} seconds"


def _is_ntz(df: DataFrame, ts: str) -> bool:
    dtype = df.select(resolve(df, ts)).schema[0].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return True
    if isinstance(dtype, T.TimestampType):
        return False
    raise TypeError(f"{ts} is {dtype.simpleString()}, not a timestamp")


def with_pane(df: DataFrame, ts: str, width: int, name: str) -> DataFrame:
    """Add the pane number of each row as a BIGINT column."""
    start = F.window(resolve(df, ts), duration(width)).getField("start")
    panes = df.withColumn(name, start)
    if _is_ntz(df, ts):
        # Pane starts are whole seconds, so the integral cast loses nothing.
        seconds = F.expr(f"CAST(CAST(`{name}` - {EPOCH} AS INTERVAL SECOND) AS BIGINT)")
    else:
        seconds = F.unix_seconds(F.col(name))
    return panes.withColumn(name, F.floor(seconds / F.lit(width)).cast("bigint"))


def block_start(pane: Column, width: int) -> Column:
    """The first pane of the block of ``width`` panes that holds ``pane``."""
    return pane - F.pmod(pane, F.lit(width))


def pane_start(df: DataFrame, ts: str, pane: str, width: int) -> Column:
    """The first instant of a pane, in the type of ``df[ts]``."""
    if _is_ntz(df, ts):
        return F.expr(
            f"{EPOCH} + make_dt_interval(0, 0, 0, CAST(`{pane}` * {int(width)} AS DECIMAL(18, 6)))"
        )
    return F.timestamp_seconds(F.col(pane) * F.lit(int(width)))


def to_instant(ts: str) -> Column:
    """Zone-less timestamp as an instant, reading it as UTC (watermarks need instants)."""
    return F.expr(
        f"timestamp_seconds(CAST(CAST({ts} - {EPOCH} AS INTERVAL SECOND) AS DECIMAL(20, 6)))"
    )


def from_instant(ts: str) -> Column:
    """The inverse of :func:`to_instant`."""
    return F.expr(
        f"{EPOCH} + make_dt_interval(0, 0, 0, CAST(unix_micros({ts}) / 1000000BD AS DECIMAL(18, 6)))"
    )
