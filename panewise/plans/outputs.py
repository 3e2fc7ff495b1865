"""Delimited output and streams that run over the whole tables and stop.

A stream's result is read back from the shared folder it wrote to; nothing passes
through the driver.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from panewise.functions.aggregates import count, highest, total
from panewise.functions.event_time import from_instant
from panewise.functions.names import quoted
from panewise.operators.filters import where
from panewise.operators.sinks import delimited_lines, write_delimited
from panewise.plans.inputs import LINE_SCHEMA, damaged_lines
from panewise.plans.inputs import SQL as INPUT_SQL
from panewise.plans.joins import MEETING, kind_of_event
from panewise.plans.joins import SQL as JOIN_SQL
from panewise.plans.relational import exact_sum
from panewise.plans.windows import windowed
from panewise.session import shared_folder
from panewise.sources.delimited import declare, declare_stream
from panewise.sources.slices import dense_slice, replay_by_count, replay_by_time, with_arrival_index
from panewise.sources.tables import stream_table, table
from panewise.streaming.queries import stream_join, stream_window_aggregate, stream_window_join
from panewise.streaming.sinks import (
    append_parquet,
    batch_log,
    one_output,
    several_outputs,
    tagged_outputs,
    timings,
)
from panewise.streaming.store import keep_windows, windows

HOUR = 3600
#: Slices of event time, one micro-batch each, in which the streams get their input.
SLICES = 6
#: Micro-batches at most in which a table comes slice by slice of records; with more slices
#: than that, a micro-batch holds several whole ones.
RECORD_BATCHES = 64
SPENT = {"spent": total("value", 2), "high": highest("value"), "n": count("value")}


def output_delimited(spark, sf):
    lines = delimited_lines(
        table(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"], "|"
    )
    return lines.withColumnRenamed("value", "line")


@cache
def _events_in_slices(spark, sf):
    """Written once by a session for each table; a stored table does not change."""
    folder = shared_folder(spark, "replay")
    return folder, replay_by_time(table(spark, sf, "events"), "ts", f"{folder}/events.parquet", SLICES)


def replayed_events(spark, sf):
    """The table as a stream of several micro-batches in the order of event time."""
    folder, files = _events_in_slices(spark, sf)
    return lambda: stream_table(spark, folder, "events", files_per_batch=files)


def output_read_back(spark, sf):
    """Write texts as delimited lines, declare the folder, and count what came back."""
    path = shared_folder(spark, "texts")
    columns = ["doc_id", "text", "lang"]
    documents = table(spark, sf, "documents").select(*columns)
    write_delimited(documents, f"{path}/lines", columns, "|", rejects=f"{path}/rejects")
    typed = declare(spark, "pw_texts", "doc_id int, text string, lang string", f"{path}/lines", "|")
    read = typed.agg(F.count("*").alias("n_read"), F.sum(F.length("text")).alias("n_chars"))
    rejected = spark.read.parquet(f"{path}/rejects").agg(F.count("*").alias("n_rejected"))
    one = F.lit(1)
    return read.withColumn("one", one).join(rejected.withColumn("one", one), "one").drop("one")


def stream_window_agg(spark, sf):
    """Every window, open ones too: each micro-batch writes the windows it changed."""
    events = replayed_events(spark, sf)()
    sums = stream_window_aggregate(events, "ts", 3 * HOUR, HOUR, HOUR, ["event_type"], SPENT)
    path = shared_folder(spark, "window-agg")
    keep_windows(sums, f"{path}/rows", f"{path}/checkpoint", ["event_type"], HOUR, fold_every=4)
    return windows(spark, f"{path}/rows", ["event_type"])


def stream_window_closed(spark, sf):
    """Only the windows the watermark has closed, each written once."""
    events = replayed_events(spark, sf)()
    sums = stream_window_aggregate(events, "ts", 3 * HOUR, HOUR, HOUR, ["event_type"], SPENT)
    path = shared_folder(spark, "window-closed")
    append_parquet(sums, f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")


def stream_batch_count(spark, sf):
    events = replayed_events(spark, sf)()
    counts = stream_window_aggregate(events, "ts", HOUR, None, HOUR, [], {"n": count("event_id")})
    path = shared_folder(spark, "batch-count")
    keep_windows(counts, f"{path}/rows", f"{path}/checkpoint", [], HOUR)
    return windows(spark, f"{path}/rows", [])


def clicks_and_purchases(spark, sf):
    stream = replayed_events(spark, sf)
    events = stream()
    clicks = where(events, F.col("event_type"), "=", F.lit("click")).select(
        "user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts")
    )
    events = stream()
    purchases = where(events, F.col("event_type"), "=", F.lit("purchase")).select(
        F.col("user_id").alias("buyer_id"),
        F.col("event_id").alias("purchase_id"),
        F.col("ts").alias("purchase_ts"),
    )
    return clicks, purchases, [("user_id", "buyer_id")], "click_ts", "purchase_ts"


def stream_pairs(spark, sf):
    """Purchases within ten hours of a click of the same user, from two streams."""
    pairs = stream_join(
        *clicks_and_purchases(spark, sf),
        before=10 * HOUR,
        after=10 * HOUR,
        delay=HOUR,
        right_id="purchase_id",
    )
    path = shared_folder(spark, "pairs")
    append_parquet(pairs, f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows").select(
        "user_id",
        "click_id",
        "purchase_id",
        from_instant("click_ts").alias("click_ts"),
        from_instant("purchase_ts").alias("purchase_ts"),
    )


def stream_windows_meet(spark, sf):
    """Clicks of the last 24 panes joined with purchases of the last 3, pane by pane."""
    pairs = stream_window_join(
        *clicks_and_purchases(spark, sf),
        pane=HOUR,
        left_panes=24,
        right_panes=3,
        delay=HOUR,
        right_id="purchase_id",
    )
    path = shared_folder(spark, "windows-meet")
    append_parquet(pairs, f"{path}/rows", f"{path}/checkpoint")
    rows = spark.read.parquet(f"{path}/rows")
    return rows.select("last_pane", "user_id", "click_id", "purchase_id")


def stream_windows_shared(spark, sf):
    """Two windowed streams of one schema, joined pane by pane."""
    stream = replayed_events(spark, sf)
    sides = kind_of_event(stream(), "click", "c"), kind_of_event(stream(), "purchase", "p")
    pairs = stream_window_join(
        *sides, [("c.user_id", "p.user_id")], "c.ts", "p.ts", HOUR, 4, 3, HOUR, "p.event_id"
    )
    times = {"c.ts": from_instant("`c.ts`"), "p.ts": from_instant("`p.ts`")}
    shown = [times.get(c, F.col(quoted(c))).alias(m) for c, m in zip(pairs.columns, MEETING)]
    path = shared_folder(spark, "windows-shared")
    append_parquet(pairs.select(*shown), f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")


def stream_count_slices(spark, sf):
    """A table replayed in slices of 2,500 records; every micro-batch counts its own slices."""
    path = shared_folder(spark, "records")
    stored = table(spark, sf, "events").select("event_id", "value")
    together = max(1, -(-stored.count() // (2500 * RECORD_BATCHES)))
    events = with_arrival_index(stored)
    files = replay_by_count(events, "arrival", 2500, f"{path}/in/events.parquet", slices_at_once=together)
    stream = stream_table(spark, f"{path}/in", "events", files_per_batch=files)
    size = F.min("arrival").alias("first"), F.count("*").alias("n")
    sizes = {"sizes": lambda batch: batch.groupBy(dense_slice("arrival", 2500)).agg(*size).select("first", "n")}
    several_outputs(stream, sizes, f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows/sizes").select("first", "n")


def text_in_batches(spark, sf):
    """A folder of text files, and how many of them make about a ``SLICES``-th of the lines."""
    path = f'{shared_folder(spark, "lines")}/text'
    lines = damaged_lines(spark, sf)
    parts = max(SLICES, lines.rdd.getNumPartitions())
    lines.repartition(parts).write.text(path)
    return path, -(-parts // SLICES)


def stream_parse(spark, sf):
    """Delimited text files arriving in a folder, parsed as they arrive."""
    text, files = text_in_batches(spark, sf)
    path = shared_folder(spark, "parsed")
    typed = declare_stream(spark, "pw_lines", LINE_SCHEMA, text, ",", files)
    append_parquet(typed, f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")


def stream_several_outputs(spark, sf):
    """One stream, two results per micro-batch."""
    events = replayed_events(spark, sf)().select("event_id", "event_type", "value")
    outputs = {"clicks": F.col("event_type") == "click", "dear": F.col("value") > 100.0}
    path = shared_folder(spark, "outputs")
    tagged_outputs(events, outputs, f"{path}/rows", f"{path}/checkpoint")
    results = [
        one_output(spark, f"{path}/rows", name).select(F.lit(name).alias("output"), "event_id", "event_type", "value")
        for name in outputs
    ]
    return results[0].unionByName(results[1])


def stream_progress(spark, sf):
    """Rows read and rows left out as late, over all logged micro-batches of a query."""
    events = replayed_events(spark, sf)()
    sums = stream_window_aggregate(events, "ts", HOUR, None, HOUR, ["user_id"], SPENT)
    path = shared_folder(spark, "progress")
    with batch_log(spark, f"{path}/log"):
        append_parquet(sums, f"{path}/rows", f"{path}/checkpoint")
    return timings(spark, f"{path}/log").agg(
        F.sum("input_rows").alias("input_rows"), F.sum("dropped_rows").alias("dropped_rows")
    )


def stream_late_rows(spark, sf):
    """Slices that are not in the order of time: rows counted and rows reported as late
    are all rows. Every row is a group of its own, so that each late one counts."""
    path = shared_folder(spark, "late")
    events = table(spark, sf, "events").withColumn("place", F.pmod(F.xxhash64("event_id"), F.lit(SLICES)))
    files = replay_by_count(events, "place", 1, f"{path}/in/events.parquet")
    stream = stream_table(spark, f"{path}/in", "events", files_per_batch=files)
    counts = stream_window_aggregate(stream, "ts", HOUR, None, HOUR, ["event_id"], {"n": count("ts")})
    with batch_log(spark, f"{path}/log"):
        keep_windows(counts, f"{path}/rows", f"{path}/checkpoint", ["event_id"], HOUR, fold_every=3)
    counted = windows(spark, f"{path}/rows", ["event_id"])
    rows = counted.select("n").unionByName(
        timings(spark, f"{path}/log").select(F.col("dropped_rows").alias("n"))
    )
    return rows.agg(F.sum("n").alias("n_rows"))


QUERIES = {
    "stream_late_rows": stream_late_rows,
    "output_delimited": output_delimited,
    "stream_window_agg": stream_window_agg,
    "stream_window_closed": stream_window_closed,
    "stream_batch_count": stream_batch_count,
    "stream_join": stream_pairs,
    "stream_window_join": stream_windows_meet,
    "stream_windows_shared": stream_windows_shared,
    "stream_count_slices": stream_count_slices,
    "output_read_back": output_read_back,
    "stream_parse": stream_parse,
    "stream_several_outputs": stream_several_outputs,
    "stream_progress": stream_progress,
}

_SUMS = f"""
    SELECT window_start, window_end, event_type, {exact_sum('value')} AS spent,
           max(value) AS high, count(*) AS n
    FROM ({windowed(3, 1)}) GROUP BY window_start, window_end, event_type"""

SQL = {
    "stream_late_rows": "SELECT count(*) AS n_rows FROM events",
    "output_delimited": """
        SELECT concat_ws('|', c_custkey, c_name, c_mktsegment, c_nationkey) AS line
        FROM customer""",
    "stream_window_agg": _SUMS,
    "stream_window_closed": f"""
        SELECT * FROM ({_SUMS})
        WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_batch_count": f"""
        SELECT window_start, window_end, count(*) AS n
        FROM ({windowed(1, 1)}) GROUP BY window_start, window_end""",
    "stream_join": """
        SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id,
               c.ts AS click_ts, p.ts AS purchase_ts
        FROM events AS c JOIN events AS p ON c.user_id = p.user_id
         AND p.ts BETWEEN c.ts - INTERVAL 10 HOUR AND c.ts + INTERVAL 10 HOUR
        WHERE c.event_type = 'click' AND p.event_type = 'purchase'""",
    "stream_window_join": JOIN_SQL["window_join_asym"],
    "stream_windows_shared": JOIN_SQL["window_join_shared"],
    "stream_count_slices": """
        SELECT min(place - 1) AS first, count(*) AS n
        FROM (SELECT row_number() OVER () AS place FROM events) GROUP BY (place - 1) // 2500""",
    "output_read_back": r"""
        SELECT count(*) FILTER (WHERE whole) AS n_read, count(*) FILTER (WHERE NOT whole) AS n_rejected,
               CAST(sum(length(text)) FILTER (WHERE whole) AS BIGINT) AS n_chars
        FROM (SELECT text, coalesce(NOT regexp_matches(text, '[|\n\r]'), FALSE) AS whole FROM documents)""",
    "stream_progress": """
        SELECT count(*) AS input_rows, CAST(0 AS BIGINT) AS dropped_rows FROM events""",
    "stream_parse": INPUT_SQL["parse_delimited"],
    "stream_several_outputs": """
        SELECT 'clicks' AS output, event_id, event_type, value
        FROM events WHERE event_type = 'click'
        UNION ALL
        SELECT 'dear' AS output, event_id, event_type, value FROM events WHERE value > 100""",
}
