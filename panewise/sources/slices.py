"""Cutting a stored input into batches, by time or by number of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panewise.functions.event_time import duration

#: Rows of a file that a replay writes, at most.
ROWS_PER_FILE = 1_000_000
_SLICE = "__slice"


def time_slice(ts: str, seconds: int) -> Column:
    """The slice of ``seconds`` of event time a row belongs to (struct start, end)."""
    return F.window(ts, duration(seconds))


def dense_slice(index: str, per_slice: int) -> Column:
    """Slices of ``per_slice`` records by a column that numbers the records 0, 1, 2, …"""
    return F.expr(f"`{index}` div {int(per_slice)}")


def replay_by_time(
    df: DataFrame, ts: str, path: str, slices: int, rows_per_file: int = ROWS_PER_FILE
) -> int:
    """Write a stored input to ``path`` slice by slice of event time, oldest first.

    Slices have equal lengths, so a watermark delay of one slice never drops a row. Rows
    without a time come with the last slice. See :func:`_write_slices` for what is returned.
    """
    first, last = df.agg(F.min(ts), F.max(ts)).first()
    number = F.lit(slices - 1)
    if first is not None:
        step = (last - first) / slices
        bounds = [F.when(F.col(ts) < F.lit(first + i * step), i - 1) for i in range(1, slices)]
        number = F.coalesce(*bounds, number)
    return _write_slices(df, number, path, rows_per_file)


def replay_by_count(
    df: DataFrame,
    index: str,
    per_slice: int,
    path: str,
    rows_per_file: int = ROWS_PER_FILE,
    slices_at_once: int = 1,
) -> int:
    """Write a stored input to ``path`` in slices of ``per_slice`` records, in order.

    ``index`` numbers the records 0, 1, 2, …, as :func:`with_arrival_index` does. A stream
    gets ``slices_at_once`` whole slices per micro-batch, so that batches need not grow with
    the slices; :func:`dense_slice` tells the slices of a batch apart. See
    :func:`_write_slices` for what is returned.
    """
    return _write_slices(df, dense_slice(index, per_slice * slices_at_once), path, rows_per_file)


def _write_slices(df: DataFrame, number: Column, path: str, rows_per_file: int) -> int:
    """Write rows in the order of their slice numbers and return the files of each slice.

    A stream over ``path`` with ``files_per_batch`` set to that gets one slice per
    micro-batch, with the rows of a slice in any order. ``df`` is read once: one job deals
    its rows to a folder for each slice, and then every slice, which holds as many files as
    the largest one needs at ``rows_per_file`` rows, is appended from its folder alone, all
    files at once. File streams go by the time of a file, so the slices follow each other.
    """
    spark, dealt = df.sparkSession, f"{path}-dealt"
    df.withColumn(_SLICE, number.cast("bigint")).write.partitionBy(_SLICE).parquet(dealt)
    schema = T.StructType([*df.schema.fields, T.StructField(_SLICE, T.LongType())])
    rows = spark.read.schema(schema).parquet(dealt)
    # one number for each slice; only file footers are read
    sizes = {r[_SLICE]: r["count"] for r in rows.groupBy(_SLICE).count().collect()}
    files = max(1, -(-max(sizes.values(), default=0) // rows_per_file))
    for i in sorted(sizes):
        part = rows.where(F.col(_SLICE) == i).drop(_SLICE)
        part.repartition(files).write.mode("append").parquet(path)
    if not sizes:
        rows.drop(_SLICE).write.mode("append").parquet(path)
    return files


def with_arrival_index(df: DataFrame, name: str = "arrival") -> DataFrame:
    """Number the rows of a Parquet input 0, 1, 2, … in file and row order.

    ``df`` must be a plain ``spark.read.parquet``. The place of a row within its file
    comes from the file itself, so nothing is sorted or shuffled and a task that runs
    again gives the same numbers. Only one count per file is brought together, in one
    task: 400,000 rows for 100 TB in files of 256 MB. Spark picks the join by their size.
    """
    rows = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.row_index").alias("__row"),
    )
    # A window without partitions, over one row per file.
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("__file")
        .agg(F.count("*").alias("__n"))
        .select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    )
    return rows.join(offsets, "__file").select(
        *df.columns, (F.col("__first") + F.col("__row")).alias(name)
    )


def with_line_index(lines: DataFrame, name: str = "arrival") -> DataFrame:
    """Number the lines of a text input 0, 1, 2, … in file and line order.

    ``lines`` must be a plain ``spark.read.text``. A file is read in blocks, and a task reads
    the lines of a block one after the other, so the place of a line is its running number
    in the task less the smallest one of the block; a task that runs again gives the same.
    Lines are not shuffled: only one row per block is brought together, and Spark picks the
    join by its size.
    """
    rows = lines.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__order"),
    )
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("__file", "__start").agg(F.count("*").alias("__n"), F.min("__order").alias("__least"))
    offsets = blocks.select(
        F.col("__file").alias("__in"),
        F.col("__start").alias("__from"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least")).alias("__offset"),
    )
    same = (F.col("__file") == F.col("__in")) & (F.col("__start") == F.col("__from"))
    return rows.join(offsets, same).select(*lines.columns, (F.col("__offset") + F.col("__order")).alias(name))
