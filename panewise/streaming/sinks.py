"""Sinks. Results and checkpoints go to the folder all executors share.

Each run function processes what has arrived, stops, and returns the query; the same
function with ``every`` keeps running with that trigger. A restart with the same
checkpoint folder goes on where the last run stopped.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

Transform = Callable[[DataFrame], DataFrame]


def start_stream(writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_parquet(
    df: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Final rows only, written exactly once by the file sink."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path)
    return start_stream(writer, checkpoint, every)


def upsert_parquet(
    df: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """The rows each micro-batch changed, in a folder per batch.

    A batch that runs again overwrites its own folder. :func:`latest` reads the result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return start_stream(df.writeStream.outputMode("update").foreachBatch(write), checkpoint, every)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each row that :func:`upsert_parquet` wrote."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("__v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "__v.*")


def several_outputs(
    df: DataFrame,
    outputs: dict[str, Transform],
    path: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Several results of every micro-batch, each in its own folder.

    For outputs that are more than conditions on rows, such as aggregates; see
    :func:`tagged_outputs` for the others. With more than one output the batch is read once
    and kept (spilling to disk) while they are written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if len(outputs) > 1:
            batch.persist()
        try:
            for name, transform in outputs.items():
                transform(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return start_stream(df.writeStream.outputMode("append").foreachBatch(write), checkpoint, every)


OUTPUT = "output"


def tagged_outputs(
    df: DataFrame,
    outputs: dict[str, Column],
    path: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Several outputs that are conditions on the rows, from one pass over every micro-batch.

    A row is written once for each output whose condition it meets, below ``output=name``, by
    one job per batch and exactly once. :func:`one_output` reads one of them.
    """
    if OUTPUT in df.columns:
        raise ValueError(f"the rows have a column {OUTPUT} already")
    met = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in outputs.items()]))
    tagged = df.withColumn(OUTPUT, F.explode(met))
    writer = tagged.writeStream.outputMode("append").partitionBy(OUTPUT).format("parquet").option("path", path)
    return start_stream(writer, checkpoint, every)


def one_output(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one output of :func:`tagged_outputs`; only its files are read."""
    return spark.read.parquet(path).where(F.col(OUTPUT) == name).drop(OUTPUT)


PROGRESS_SCHEMA = (
    "query string, batch_id bigint, input_rows bigint, trigger_ms bigint, add_batch_ms bigint, "
    "dropped_rows bigint, observed map<string, bigint>"
)
#: Rows of a log that wait to be written together.
LOG_ROWS = 64


class BatchLog(StreamingQueryListener):
    """Appends one row per micro-batch of every query of a session to a Parquet folder.

    Spark itself keeps the last batches only. ``dropped_rows`` are the rows later than the
    watermark that stateful operators left out; aggregates count them after the map-side
    combine, so several late rows of one group may count once. ``observed`` holds the whole
    numbers the query observes, such as those of ``parse_counted``, as ``name.number``.

    Rows are written ``LOG_ROWS`` at a time, and when a query ends; a driver that is lost
    takes those that wait with it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.running, self.idle = spark, path, set(), threading.Event()
        self.waiting: list[tuple] = []
        self.idle.set()

    def onQueryStarted(self, event) -> None:
        self.running.add(str(event.runId))
        self.idle.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        times, dropped = p.durationMs, sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        observed = {
            f"{name}.{number}": value
            for name, row in p.observedMetrics.items()
            for number, value in row.asDict().items()
            if isinstance(value, int)
        }
        self.waiting.append(
            (str(p.id), p.batchId, p.numInputRows, times.get("triggerExecution"), times.get("addBatch"), dropped, observed)
        )
        if len(self.waiting) >= LOG_ROWS:
            self.flush()

    def flush(self) -> None:
        rows, self.waiting = self.waiting, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()
        self.running.discard(str(event.runId))
        if not self.running:
            self.idle.set()


@contextmanager
def batch_log(spark: SparkSession, path: str, patience: float = 600.0) -> Iterator[None]:
    """Log every micro-batch of the queries run inside to ``path``.

    Events arrive after their batch, so leaving waits for those of queries that ended.
    """
    log = BatchLog(spark, path)
    spark.streams.addListener(log)
    try:
        yield
        if not spark.streams.active and not log.idle.wait(patience):
            raise TimeoutError(f"the log {path} is not complete")
    finally:
        spark.streams.removeListener(log)
        log.flush()


def timings(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a batch log; a batch that ran again counts once, with its last times."""
    rows = spark.read.schema(PROGRESS_SCHEMA).parquet(path)
    values = [c for c in rows.columns if c not in ("query", "batch_id")]
    newest = F.max_by(F.struct(*values), F.struct("input_rows", "trigger_ms")).alias("__v")
    return rows.groupBy("query", "batch_id").agg(newest).select("query", "batch_id", "__v.*")


def observed_totals(timings: DataFrame, name: str, numbers: list[str]) -> DataFrame:
    """One row: the sums over all logged micro-batches of numbers observed as ``name``."""
    sums = [F.sum(F.try_element_at("observed", F.lit(f"{name}.{n}"))).alias(n) for n in numbers]
    return timings.agg(*sums)


# Fixed value: the batches left out of the mean while the query warms up.
WARM_UP_BATCHES = 11


def mean_batch_ms(timings: DataFrame, warm_up: int = WARM_UP_BATCHES) -> DataFrame:
    """Mean milliseconds per batch after the first ``warm_up`` ones."""
    return timings.where(F.col("batch_id") >= warm_up).agg(
        F.count("*").alias("batches"), F.avg("trigger_ms").alias("mean_ms")
    )
