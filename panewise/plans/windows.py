"""Windows over the event table; panes are one hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from panewise.functions.aggregates import count, highest, lowest, mean, total
from panewise.operators.filters import where
from panewise.operators.windows import pane_aggregate, window_aggregate, window_rows
from panewise.plans.relational import exact_sum
from panewise.sources.tables import table

HOUR = 3600
FIVE = {
    "spent": total("value", 2),
    "low": lowest("value"),
    "high": highest("value"),
    "average": mean("value", 2),
    "n": count("value"),
}


def batch_count(spark, sf):
    return window_aggregate(table(spark, sf, "events"), "ts", HOUR, None, [], {"n": count("event_id")})


def window_rows_sliding(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    return window_rows(events, "ts", 3 * HOUR, HOUR)


def window_agg_tumbling(spark, sf):
    return window_aggregate(table(spark, sf, "events"), "ts", HOUR, None, ["event_type"], FIVE)


def window_agg_sliding(spark, sf):
    return window_aggregate(table(spark, sf, "events"), "ts", 3 * HOUR, HOUR, ["event_type"], FIVE)


def window_agg_panes(spark, sf):
    return pane_aggregate(table(spark, sf, "events"), "ts", 3 * HOUR, HOUR, ["event_type"], FIVE)


def window_agg_hopping(spark, sf):
    events = table(spark, sf, "events")
    return window_aggregate(events, "ts", 6 * HOUR, 2 * HOUR, ["event_type"], FIVE)


def window_agg_panes_hopping(spark, sf):
    events = table(spark, sf, "events")
    return pane_aggregate(events, "ts", 6 * HOUR, 2 * HOUR, ["event_type"], FIVE)


def window_agg_panes_day(spark, sf):
    """Long windows over many keys: 24 panes, one key per user."""
    spent = {"spent": total("value", 2), "n": count("value")}
    return pane_aggregate(table(spark, sf, "events"), "ts", 24 * HOUR, HOUR, ["user_id"], spent)


def window_filtered(spark, sf):
    clicks = where(table(spark, sf, "events"), F.col("event_type"), "=", F.lit("click"))
    return window_rows(clicks.select("event_id", "user_id", "ts"), "ts", 3 * HOUR, HOUR)


def window_agg_names(spark, sf):
    """Qualified columns, and names that look like those of partial results."""
    events = table(spark, sf, "events").withColumn("value_2", F.col("event_id").cast("double"))
    events = events.withColumn("count_value", F.col("event_type"))
    return pane_aggregate(
        events.alias("t"),
        "t.ts",
        3 * HOUR,
        HOUR,
        ["t.count_value"],
        {"spent": total("t.value", 2), "ids": total("t.value_2"), "average": mean("value", 2)},
    )


QUERIES = {
    "window_agg_names": window_agg_names,
    "batch_count": batch_count,
    "window_rows_sliding": window_rows_sliding,
    "window_agg_tumbling": window_agg_tumbling,
    "window_agg_sliding": window_agg_sliding,
    "window_agg_panes": window_agg_panes,
    "window_agg_hopping": window_agg_hopping,
    "window_agg_panes_hopping": window_agg_panes_hopping,
    "window_agg_panes_day": window_agg_panes_day,
    "window_filtered": window_filtered,
}


def windowed(size, slide, columns="*", condition="TRUE"):
    """Every row of events once per window of ``size`` hours moving by ``slide`` hours."""
    start = f"time_bucket(INTERVAL {slide} HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(k * {slide})"
    return f"""
        SELECT {start} AS window_start, {start} + INTERVAL {size} HOUR AS window_end, {columns}
        FROM events, range({size // slide}) AS steps(k) WHERE {condition}"""


def _five(size, slide):
    return f"""
        SELECT window_start, window_end, event_type, {exact_sum('value')} AS spent,
               min(value) AS low, max(value) AS high,
               {exact_sum('value')} / count(*) AS average, count(*) AS n
        FROM ({windowed(size, slide)}) GROUP BY window_start, window_end, event_type"""


SQL = {
    "window_agg_names": f"""
        SELECT window_start, window_end, event_type AS count_value, {exact_sum('value')} AS spent,
               CAST(sum(event_id) AS DOUBLE) AS ids, {exact_sum('value')} / count(*) AS average
        FROM ({windowed(3, 1)}) GROUP BY window_start, window_end, event_type""",
    "batch_count": f"""
        SELECT window_start, window_end, count(*) AS n
        FROM ({windowed(1, 1)}) GROUP BY window_start, window_end""",
    "window_rows_sliding": windowed(3, 1, "event_id, ts, event_type, value"),
    "window_agg_tumbling": _five(1, 1),
    "window_agg_sliding": _five(3, 1),
    "window_agg_panes": _five(3, 1),
    "window_agg_hopping": _five(6, 2),
    "window_agg_panes_hopping": _five(6, 2),
    "window_agg_panes_day": f"""
        SELECT window_start, window_end, user_id, {exact_sum('value')} AS spent, count(*) AS n
        FROM ({windowed(24, 1)}) GROUP BY window_start, window_end, user_id""",
    "window_filtered": windowed(3, 1, "event_id, user_id, ts", "event_type = 'click'"),
}
