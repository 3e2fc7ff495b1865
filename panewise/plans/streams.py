"""Streams that keep partial results, chain stateful steps, or count what they drop."""

from __future__ import annotations

from pyspark.sql import functions as F

from panewise.functions.aggregates import count, total
from panewise.functions.event_time import from_instant
from panewise.operators.filters import where
from panewise.plans.inputs import LINE_SCHEMA
from panewise.plans.inputs import SQL as INPUT_SQL
from panewise.plans.outputs import HOUR, clicks_and_purchases, replayed_events, text_in_batches
from panewise.plans.relational import exact_sum
from panewise.plans.windows import FIVE
from panewise.plans.windows import SQL as WINDOW_SQL
from panewise.plans.windows import windowed
from panewise.session import shared_folder
from panewise.sources.delimited import declare_stream
from panewise.streaming.panes import stream_pane_aggregate
from panewise.streaming.queries import stream_aggregate_join, stream_join, stream_outer_join
from panewise.streaming.sinks import append_parquet, batch_log, observed_totals, timings


def _appended(spark, df, purpose):
    """Run ``df`` over all its input and read what it wrote."""
    path = shared_folder(spark, purpose)
    append_parquet(df, f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")


def stream_window_panes(spark, sf):
    """A day by the hour for every user: each row enters one pane, and closed windows come out."""
    spent = {"spent": total("value", 2), "n": count("value")}
    events = replayed_events(spark, sf)()
    return _appended(spark, stream_pane_aggregate(events, "ts", 24 * HOUR, HOUR, HOUR, ["user_id"], spent), "panes")


def stream_window_panes_five(spark, sf):
    """All five aggregates over hopping windows, merged from panes."""
    events = replayed_events(spark, sf)()
    return _appended(spark, stream_pane_aggregate(events, "ts", 6 * HOUR, 2 * HOUR, HOUR, ["event_type"], FIVE), "panes")


def _outer(how, **splits):
    """Clicks and purchases of a user within three hours, and those that stay alone."""

    def query(spark, sf):
        sides = clicks_and_purchases(spark, sf)
        pairs = stream_outer_join(*sides, 2 * HOUR, 3 * HOUR, HOUR, how, **splits)
        ids = [F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in ("click_id", "purchase_id")]
        times = [F.coalesce("click_ts", "purchase_ts").alias("at")]
        rows = _appended(spark, pairs, f"outer-{how}").select(*ids, *times)
        return rows.withColumn("at", from_instant("at"))

    return query


def stream_three_way(spark, sf):
    """Three live inputs: a click, a purchase within two hours, and a view within one hour of that."""
    clicks, purchases, on, click_ts, purchase_ts = clicks_and_purchases(spark, sf)
    views = where(replayed_events(spark, sf)(), F.col("event_type"), "=", F.lit("view")).select(
        F.col("user_id").alias("viewer_id"), F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts")
    )
    pairs = stream_join(clicks, purchases, on, click_ts, purchase_ts, 0, 2 * HOUR, HOUR, "purchase_id")
    pairs = pairs.select("user_id", "click_id", "purchase_id", "purchase_ts")
    triples = stream_join(
        pairs, views, [("user_id", "viewer_id")], "purchase_ts", "view_ts", HOUR, HOUR, HOUR, "view_id", left_marked=True
    )
    return _appended(spark, triples, "three").select("user_id", "click_id", "purchase_id", "view_id")


def stream_join_after_agg(spark, sf):
    """What a user spent in an hour, next to each error of the user in that hour."""
    stream = replayed_events(spark, sf)
    errors = where(stream(), F.col("event_type"), "=", F.lit("error")).select(
        F.col("user_id").alias("failed_id"), F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts")
    )
    bought = {"spent": total("value", 2), "n": count("value")}
    both = stream_aggregate_join(
        stream(), errors, [("user_id", "failed_id")], "ts", "error_ts", HOUR, None, HOUR, ["user_id"], bought
    )
    return _appended(spark, both, "agg-join").select("window_start", "window_end", "user_id", "spent", "n", "error_id")


def stream_rejects(spark, sf):
    """Lines read, kept and rejected by a stream, as its micro-batches reported them."""
    text, files = text_in_batches(spark, sf)
    path = shared_folder(spark, "rejects")
    typed = declare_stream(spark, "pw_counted", LINE_SCHEMA, text, ",", files, count_as="lines")
    with batch_log(spark, f"{path}/log"):
        append_parquet(typed, f"{path}/rows", f"{path}/checkpoint")
    return observed_totals(timings(spark, f"{path}/log"), "lines", ["n_lines", "n_kept", "n_rejected"])


QUERIES = {
    "stream_window_panes": stream_window_panes,
    "stream_window_panes_five": stream_window_panes_five,
    "stream_join_left": _outer("left"),
    "stream_join_right": _outer("right", right_id="purchase_id", right_splits=2),
    "stream_join_full": _outer("full", left_id="click_id", left_splits=4),
    "stream_three_way": stream_three_way,
    "stream_join_after_agg": stream_join_after_agg,
    "stream_rejects": stream_rejects,
}

_CLOSED = "window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def _outer_sql(how):
    """Rows that stay alone count once the slower side is an hour past their last partner."""
    return f"""
        WITH c AS (SELECT * FROM events WHERE event_type = 'click'),
        p AS (SELECT * FROM events WHERE event_type = 'purchase'),
        slower AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 1 HOUR AS t)
        SELECT coalesce(CAST(c.event_id AS VARCHAR), 'none') AS click_id,
               coalesce(CAST(p.event_id AS VARCHAR), 'none') AS purchase_id, coalesce(c.ts, p.ts) AS at
        FROM c {how} JOIN p ON c.user_id = p.user_id
         AND p.ts BETWEEN c.ts - INTERVAL 2 HOUR AND c.ts + INTERVAL 3 HOUR, slower
        WHERE c.ts + INTERVAL 3 HOUR < t OR p.ts + INTERVAL 2 HOUR < t
           OR (c.event_id IS NOT NULL AND p.event_id IS NOT NULL)"""


SQL = {
    "stream_window_panes": f"SELECT * FROM ({WINDOW_SQL['window_agg_panes_day']}) WHERE {_CLOSED}",
    "stream_window_panes_five": f"SELECT * FROM ({WINDOW_SQL['window_agg_hopping']}) WHERE {_CLOSED}",
    "stream_join_left": _outer_sql("LEFT"),
    "stream_join_right": _outer_sql("RIGHT"),
    "stream_join_full": _outer_sql("FULL"),
    "stream_three_way": """
        SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id, v.event_id AS view_id
        FROM events AS c JOIN events AS p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 2 HOUR
        JOIN events AS v ON v.user_id = p.user_id
         AND v.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts + INTERVAL 1 HOUR
        WHERE c.event_type = 'click' AND p.event_type = 'purchase' AND v.event_type = 'view'""",
    "stream_join_after_agg": f"""
        WITH sums AS (
            SELECT window_start, window_end, user_id, {exact_sum('value')} AS spent, count(*) AS n
            FROM ({windowed(1, 1)}) GROUP BY window_start, window_end, user_id)
        SELECT window_start, window_end, user_id, spent, n, event_id AS error_id
        FROM sums JOIN events USING (user_id)
        WHERE event_type = 'error' AND ts >= window_start AND ts < window_end
          AND window_end <= (SELECT least(max(ts), max(ts) FILTER (event_type = 'error')) FROM events) - INTERVAL 1 HOUR""",
    "stream_rejects": INPUT_SQL["parse_rejected_count"],
}
