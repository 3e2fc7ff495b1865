"""Declared text inputs: delimited lines read as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panewise.functions.text import CONVERTERS, drop_trailing, normalise_addresses, split_fields
from panewise.sources.tables import named

_PARTS, _RECORD, _OK = "__parts", "__record", "__ok"


def _columns(schema: str) -> list[tuple[str, str]]:
    """``"k int, v double"`` as pairs; only the three declared types are allowed."""
    pairs = []
    for item in schema.split(","):
        words = item.split()
        if len(words) != 2 or words[1] not in CONVERTERS:
            raise ValueError(f"expected 'name int|double|string', got {item.strip()!r}")
        pairs.append((words[0], words[1]))
    return pairs


def _records(lines: DataFrame, schema: str, delimiter: str, value: str) -> DataFrame:
    """One row per line: the typed record and whether the line is a valid one."""
    columns = _columns(schema)
    fields = [
        CONVERTERS[kind](F.get(_PARTS, F.lit(i))).alias(name)
        for i, (name, kind) in enumerate(columns)
    ]
    ok = F.size(_PARTS) == len(columns)
    for name, _ in columns:
        ok = ok & F.col(_RECORD).getField(name).isNotNull()
    return (
        lines.withColumn(_PARTS, split_fields(F.col(value), delimiter))
        .withColumn(_RECORD, F.struct(*fields))
        .withColumn(_OK, F.coalesce(ok, F.lit(False)))
    )


def parse(
    lines: DataFrame,
    schema: str,
    delimiter: str,
    value: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Typed rows of the valid lines; ``keep`` carries other columns along.

    A line with the wrong number of fields, or with a field that does not convert,
    is dropped. ``inline`` rather than a filter does the dropping, so that the split
    is evaluated once per line and not pushed into a predicate a second time.
    """
    rows = F.when(F.col(_OK), F.array(_RECORD))
    return _records(lines, schema, delimiter, value).select(*keep, F.inline(rows))


def parse_counted(
    lines: DataFrame,
    schema: str,
    delimiter: str,
    name: str | Observation,
    value: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """As :func:`parse`, and counts what it drops while it runs.

    The numbers ``n_lines``, ``n_kept`` and ``n_rejected`` are observed as ``name``: a batch
    hands them to an ``Observation`` when it has run, a stream reports them with every
    micro-batch, where the batch log keeps them. No second pass over the lines is made.
    """
    kept = F.count_if(F.col(_OK))
    counts = F.count(F.lit(1)).alias("n_lines"), kept.alias("n_kept"), F.count_if(~F.col(_OK)).alias("n_rejected")
    records = _records(lines, schema, delimiter, value).observe(name, *counts)
    return records.select(*keep, F.inline(F.when(F.col(_OK), F.array(_RECORD))))


def line_counts(
    lines: DataFrame, schema: str, delimiter: str, value: str = "value"
) -> DataFrame:
    """How many lines were read, kept and rejected, from one pass over the lines."""
    kept = F.count_if(F.col(_OK))
    return _records(lines, schema, delimiter, value).agg(
        F.count("*").alias("n_lines"),
        kept.alias("n_kept"),
        (F.count("*") - kept).alias("n_rejected"),
    )


def split_addresses(lines: DataFrame, value: str = "value") -> DataFrame:
    """Blank-separated lines whose address fields become two fields each."""
    fields = lines.withColumn(_PARTS, F.split(drop_trailing(F.col(value), " "), " "))
    return fields.withColumn(value, normalise_addresses(F.col(_PARTS))).drop(_PARTS)


def declare(
    spark: SparkSession, name: str, schema: str, path: str, delimiter: str
) -> DataFrame:
    """Name a folder of delimited text as a typed table."""
    return named(parse(spark.read.text(path), schema, delimiter), name)


def declare_stream(
    spark: SparkSession,
    name: str,
    schema: str,
    path: str,
    delimiter: str,
    files_per_batch: int | None = None,
    count_as: str | None = None,
) -> DataFrame:
    """The same folder as a stream: new files arrive as new micro-batches.

    With ``count_as`` the lines kept and rejected are observed under that name.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path)
    if count_as:
        return named(parse_counted(lines, schema, delimiter, count_as), name)
    return named(parse(lines, schema, delimiter), name)
