"""Streams over many files, restarts, late rows, and sinks."""

from datetime import datetime, timedelta
from glob import glob

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from panewise.functions.aggregates import count, highest, mean, total
from panewise.functions.event_time import from_instant
from panewise.operators.window_joins import window_join
from panewise.operators.windows import window_aggregate
from panewise.plans import outputs
from panewise.session import shared_folder
from panewise.sources.delimited import declare_stream
from panewise.sources.slices import dense_slice, replay_by_count, replay_by_time
from panewise.sources.tables import stream_table
from panewise.streaming import sinks
from panewise.streaming.queries import stream_join, stream_window_aggregate, stream_window_join
from tests.conftest import rows

HOUR = 3600
FOUR = {"s": total("value", 2), "hi": highest("value"), "m": mean("value", 2), "n": count("value")}
KEYS = ["window_start", "window_end", "event_type"]


@pytest.fixture(scope="module")
def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def write_in_order(events, folder, parts, first=0, last=None):
    """One file per run of event ids, oldest first."""
    n = events.count()
    step = -(-n // parts)
    for i in range(first, last or parts):
        events.where(F.expr(f"event_id div {step} = {i}")).coalesce(1).write.mode("append").parquet(
            f"{folder}/events.parquet"
        )


@pytest.fixture(scope="module")
def folder(spark, events):
    path = shared_folder(spark, "ordered")
    write_in_order(events, path, 5)
    return path


def places(spark, name):
    path = shared_folder(spark, name)
    return f"{path}/rows", f"{path}/checkpoint"


def test_window_aggregate_over_many_batches(spark, events, folder):
    out, checkpoint = places(spark, "w")
    stream = stream_table(spark, folder, "events", files_per_batch=1)
    sums = stream_window_aggregate(stream, "ts", 3 * HOUR, HOUR, HOUR, ["event_type"], FOUR)
    with sinks.batch_log(spark, f"{out}-log"):
        sinks.upsert_parquet(sums, out, checkpoint)
    want = rows(window_aggregate(events, "ts", 3 * HOUR, HOUR, ["event_type"], FOUR))
    assert rows(sinks.latest(spark, out, KEYS)) == want
    timings = sinks.timings(spark, f"{out}-log")
    assert timings.agg(F.sum("input_rows")).collect()[0][0] == events.count()
    assert timings.where("input_rows > 0").count() == 5
    assert timings.agg(F.sum("dropped_rows")).collect()[0][0] == 0


def test_closed_windows_are_written_once(spark, events, folder):
    out, checkpoint = places(spark, "c")
    stream = stream_table(spark, folder, "events", files_per_batch=1)
    sums = stream_window_aggregate(stream, "ts", HOUR, None, HOUR, ["event_type"], FOUR)
    sinks.append_parquet(sums, out, checkpoint)
    closed = events.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).collect()[0][0]
    batch = window_aggregate(events, "ts", HOUR, None, ["event_type"], FOUR)
    assert rows(spark.read.parquet(out)) == rows(batch.where(F.col("window_end") <= F.lit(closed)))


def test_restart_goes_on_where_it_stopped(spark, events):
    source = shared_folder(spark, "growing")
    out, checkpoint = places(spark, "r")

    def run():
        stream = stream_table(spark, source, "events", files_per_batch=1)
        sums = stream_window_aggregate(stream, "ts", 3 * HOUR, HOUR, HOUR, ["event_type"], FOUR)
        sinks.upsert_parquet(sums, out, checkpoint)

    write_in_order(events, source, 4, 0, 2)
    run()
    write_in_order(events, source, 4, 2, 4)
    run()
    run()
    want = rows(window_aggregate(events, "ts", 3 * HOUR, HOUR, ["event_type"], FOUR))
    assert rows(sinks.latest(spark, out, KEYS)) == want


def test_a_batch_that_runs_again_does_not_count_twice(spark, events):
    """The second batch fails after its first output is written, and is run again."""
    source = shared_folder(spark, "again")
    write_in_order(events, source, 3)
    out, checkpoint = places(spark, "again-out")
    calls = []

    def clicks(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return batch.where("event_type = 'click'")

    def run():
        stream = stream_table(spark, source, "events", files_per_batch=1)
        sinks.several_outputs(stream, {"all": lambda b: b, "clicks": clicks}, out, checkpoint)

    with pytest.raises(StreamingQueryException):
        run()
    run()
    columns = events.columns
    assert len(calls) == 4
    assert rows(spark.read.parquet(f"{out}/all").select(columns)) == rows(events)
    want = rows(events.where("event_type = 'click'"))
    assert rows(spark.read.parquet(f"{out}/clicks").select(columns)) == want


def two_sides(spark, folder):
    stream = stream_table(spark, folder, "events", files_per_batch=1)
    clicks = stream.where("event_type = 'click'").select(
        "user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts")
    )
    stream = stream_table(spark, folder, "events", files_per_batch=1)
    purchases = stream.where("event_type = 'purchase'").select(
        F.col("user_id").alias("buyer_id"),
        F.col("event_id").alias("purchase_id"),
        F.col("ts").alias("purchase_ts"),
    )
    return clicks, purchases


@pytest.mark.parametrize("before, after, splits", [(20, 20, 1), (50, 10, 5)])
def test_stream_join_over_many_batches(spark, events, folder, before, after, splits):
    clicks, purchases = two_sides(spark, folder)
    pairs = stream_join(
        clicks, purchases, [("user_id", "buyer_id")], "click_ts", "purchase_ts",
        before=before * HOUR, after=after * HOUR, delay=HOUR, right_id="purchase_id", splits=splits,
    )
    out, checkpoint = places(spark, "j")
    sinks.append_parquet(pairs, out, checkpoint)
    c, p = events.alias("c"), events.alias("p")
    near = F.expr(
        f"p.ts BETWEEN c.ts - INTERVAL {before} HOUR AND c.ts + INTERVAL {after} HOUR"
        " AND c.event_type = 'click' AND p.event_type = 'purchase'"
    )
    want = c.join(p, (F.col("c.user_id") == F.col("p.user_id")) & near)
    got = spark.read.parquet(out)
    assert rows(got.select("click_id", "purchase_id", from_instant("click_ts"))) == rows(
        want.select("c.event_id", "p.event_id", "c.ts")
    )
    assert got.count() > 0


@pytest.mark.parametrize("n, m, splits", [(1, 1, 1), (4, 30, 3)])
def test_stream_window_join_equals_the_batch_form(spark, events, folder, n, m, splits):
    args = ([("user_id", "buyer_id")], "click_ts", "purchase_ts", HOUR, n, m)
    met = stream_window_join(*two_sides(spark, folder), *args, HOUR, "purchase_id", splits)
    out, checkpoint = places(spark, "m")
    sinks.append_parquet(met, out, checkpoint)
    clicks = events.where("event_type = 'click'").selectExpr("user_id", "event_id AS click_id", "ts AS click_ts")
    purchases = events.where("event_type = 'purchase'").selectExpr(
        "user_id AS buyer_id", "event_id AS purchase_id", "ts AS purchase_ts"
    )
    columns = ["last_pane", "click_id", "purchase_id"]
    want = rows(window_join(clicks, purchases, *args).select(columns))
    assert rows(spark.read.parquet(out).select(columns)) == want
    assert want or n == 1


def test_refused_stream_joins(spark, folder):
    clicks, purchases = two_sides(spark, folder)
    times = ("click_ts", "purchase_ts", 10, 10, HOUR, "purchase_id")
    with pytest.raises(ValueError):
        stream_join(clicks, purchases, [], *times)
    with pytest.raises(TypeError):
        stream_join(clicks, purchases, [("user_id", "purchase_ts")], *times)
    with pytest.raises(ValueError):
        stream_join(clicks, purchases, [("user_id", "buyer_id")], *times, splits=0)
    with pytest.raises(ValueError):
        stream_join(clicks, clicks, [("user_id", "user_id")], *times)


def test_rows_later_than_the_watermark_are_left_out(spark):
    base = datetime(2024, 1, 1)
    source = shared_folder(spark, "late")
    for seconds in ([10, 4000], [4005], [5, 4010], [9000]):
        data = [(base + timedelta(seconds=s), s) for s in seconds]
        spark.createDataFrame(data, "ts timestamp_ntz, v int").coalesce(1).write.mode("append").parquet(
            f"{source}/late.parquet"
        )
    stream = stream_table(spark, source, "late", files_per_batch=1)
    sums = stream_window_aggregate(stream, "ts", 60, None, 60, [], {"n": count("v")})
    out, checkpoint = places(spark, "late-out")
    sinks.append_parquet(sums, out, checkpoint)
    got = {(r.window_start - base).total_seconds(): r.n for r in spark.read.parquet(out).collect()}
    assert got == {0.0: 1, 3960.0: 3}


def test_text_files_as_they_arrive(spark):
    path = shared_folder(spark, "text-in")
    for chunk in (["1,2", "bad"], ["3,4,", " 5,6"]):
        spark.createDataFrame([(c,) for c in chunk], "value string").coalesce(1).write.mode(
            "append"
        ).text(path)
    typed = declare_stream(spark, "pw_arriving", "a int, b int", path, ",", files_per_batch=1)
    out, checkpoint = places(spark, "text-out")
    sinks.append_parquet(typed, out, checkpoint)
    assert rows(spark.read.parquet(out)) == [(1, 2), (3, 4), (5, 6)]
    # The named stream can be queried with SQL, too.
    out, checkpoint = places(spark, "text-sql")
    sinks.append_parquet(spark.sql("SELECT b FROM pw_arriving WHERE a > 1"), out, checkpoint)
    assert rows(spark.read.parquet(out)) == [(4,), (6,)]


def test_log_keeps_every_batch(spark, events, conf):
    """More batches than Spark itself remembers, and late rows among them."""
    conf("spark.sql.streaming.numRecentProgressUpdates", "2")
    source = shared_folder(spark, "many")
    write_in_order(events, source, 7)
    out, checkpoint = places(spark, "many-out")
    with sinks.batch_log(spark, f"{out}-log"):
        query = sinks.append_parquet(stream_table(spark, source, "events", 1), out, checkpoint)
    assert len(query.recentProgress) <= 2
    timings = sinks.timings(spark, f"{out}-log")
    assert timings.where("input_rows > 0").count() == 7
    assert timings.agg(F.sum("input_rows")).collect()[0][0] == events.count()


def test_log_tells_of_late_rows(spark):
    base = datetime(2024, 1, 1)
    source = shared_folder(spark, "dropped")
    for seconds in ([10, 4000], [4005], [5, 4010], [9000]):
        data = [(base + timedelta(seconds=s), s) for s in seconds]
        spark.createDataFrame(data, "ts timestamp_ntz, v int").coalesce(1).write.mode("append").parquet(
            f"{source}/late.parquet"
        )
    stream = stream_table(spark, source, "late", files_per_batch=1)
    sums = stream_window_aggregate(stream, "ts", 60, None, 60, [], {"n": count("v")})
    out, checkpoint = places(spark, "dropped-out")
    with sinks.batch_log(spark, f"{out}-log"):
        sinks.append_parquet(sums, out, checkpoint)
    assert sinks.timings(spark, f"{out}-log").agg(F.sum("dropped_rows")).collect()[0][0] == 1


@pytest.mark.parametrize("slices, rows_per_file", [(1, 10**6), (4, 10**6), (3, 90)])
def test_replay(spark, events, slices, rows_per_file):
    """Every slice has the same number of files, and the files follow in the order of time."""
    path = shared_folder(spark, "replayed") + "/events.parquet"
    nulls = events.limit(3).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    files = replay_by_time(events.unionByName(nulls), "ts", path, slices, rows_per_file)
    written = spark.read.parquet(path)
    assert rows(written) == rows(events.unionByName(nulls))
    found = written.select("ts", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("at"))
    spans = found.groupBy("f", "at").agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.count("*").alias("n")).orderBy("at").collect()
    assert len(spans) == slices * files and max(r.n for r in spans) <= 2 * rows_per_file
    assert (files > 1) == (rows_per_file == 90)
    parts = [spans[i : i + files] for i in range(0, len(spans), files)]
    assert all(max(r.z for r in x) <= min(r.a for r in y) for x, y in zip(parts, parts[1:]))


def test_replay_of_nothing(spark, events):
    path = shared_folder(spark, "replayed") + "/events.parquet"
    assert replay_by_time(events.limit(0), "ts", path, 4) == 1
    assert spark.read.parquet(path).count() == 0


def test_replay_by_count(spark, events):
    path = shared_folder(spark, "counted") + "/events.parquet"
    assert replay_by_count(events, "event_id", 400, path) == 1
    n = events.count()
    sizes = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count()
    assert rows(sizes.select("count")) == sorted(
        [(400,)] * (n // 400) + ([(n % 400,)] if n % 400 else []), key=repr
    )


def test_replay_of_several_slices_at_once(spark, events):
    """Whole slices of records come together, and no slice is cut."""
    path = shared_folder(spark, "counted") + "/events.parquet"
    assert replay_by_count(events, "event_id", 100, path, slices_at_once=4) == 1
    found = spark.read.parquet(path).groupBy(dense_slice("event_id", 100).alias("s"))
    files = found.agg(F.count_distinct("_metadata.file_path").alias("files"), F.count("*").alias("n"))
    assert files.where("files > 1").count() == 0 and files.agg(F.sum("n")).first()[0] == events.count()
    assert len(spark.read.parquet(path).inputFiles()) == -(-events.count() // 400)


def test_micro_batches_do_not_grow_with_slices(spark, sf):
    """With more slices than micro-batches, each slice is still counted on its own."""
    folder = shared_folder(spark, "many")
    rows_ = spark.range(0, 2500 * 150 + 7, 1, 1).select(F.col("id").alias("event_id"), F.lit(1.0).alias("value"))
    rows_.write.parquet(f"{folder}/events.parquet")
    before = set(glob(spark.conf.get("spark.checkpoint.dir") + "/panewise/records-*"))
    got = sorted(tuple(r) for r in outputs.stream_count_slices(spark, folder).collect())
    assert got == [(2500 * i, 2500) for i in range(150)] + [(375_000, 7)]
    (new,) = set(glob(spark.conf.get("spark.checkpoint.dir") + "/panewise/records-*")) - before
    assert len(glob(f"{new}/rows/sizes/batch=*")) <= outputs.RECORD_BATCHES


def test_hot_left_key_is_spread(spark, folder):
    """Left rows go to left splits, right rows to all of them."""
    clicks, purchases = two_sides(spark, folder)
    out, checkpoint = places(spark, "spread")
    pairs = stream_join(
        clicks, purchases, [("user_id", "buyer_id")], "click_ts", "purchase_ts", 20 * HOUR, 20 * HOUR,
        HOUR, "purchase_id", 2, "click_id", 3,
    )
    sinks.append_parquet(pairs, out, checkpoint)
    plain, checkpoint = places(spark, "plain")
    clicks, purchases = two_sides(spark, folder)
    pairs = stream_join(
        clicks, purchases, [("user_id", "buyer_id")], "click_ts", "purchase_ts", 20 * HOUR, 20 * HOUR,
        HOUR, "purchase_id",
    )
    sinks.append_parquet(pairs, plain, checkpoint)
    want = rows(spark.read.parquet(plain))
    assert rows(spark.read.parquet(out)) == want and want


def test_running_trigger(spark, folder):
    stream = stream_table(spark, folder, "events").select("event_id")
    out, checkpoint = places(spark, "running")
    query = sinks.append_parquet(stream, out, checkpoint, every="1 second")
    try:
        assert query.isActive
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(out).count() > 0


def test_mean_after_warm_up(spark):
    timings = spark.createDataFrame(
        [("q", i, 1, 1000 if i < 11 else 10 + i, 5, 0, {}) for i in range(14)], sinks.PROGRESS_SCHEMA
    )
    assert rows(sinks.mean_batch_ms(timings)) == [(3, 22.0)]


def test_shared_folder(spark):
    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))


class FakeSession:
    """A session without the setting; only the two lookups are made."""

    def __init__(self, master):
        self.master, self.applicationId = master, "app-1"
        self.sparkContext, self.conf = self, {}


def test_shared_folder_without_the_setting():
    local = FakeSession("local[2]")
    assert shared_folder(local, "x").rsplit("/", 2)[0] == shared_folder(local, "y").rsplit("/", 2)[0]
    with pytest.raises(RuntimeError):
        shared_folder(FakeSession("spark://host:7077"), "x")
