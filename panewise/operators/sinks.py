"""Writing chosen columns as delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.functions.text import join_fields, split_fields


def delimited_lines(df: DataFrame, columns: list[str], delimiter: str) -> DataFrame:
    """One ``value`` line per row, in the order of ``columns``."""
    return df.select(join_fields(columns, delimiter).alias("value"))


def reads_back(columns: list[str], delimiter: str) -> Column:
    """Whether the line of a row splits into the same fields again.

    Not so for a null, an empty last field, a delimiter or a line end in a value, and
    blanks at the ends of the line.
    """
    line, fields = join_fields(columns, delimiter), F.array(*[F.col(c).cast("string") for c in columns])
    whole = split_fields(line, delimiter) == fields
    return F.coalesce(whole, F.lit(False)) & ~line.contains("\n") & ~line.contains("\r")


def write_delimited(
    df: DataFrame, path: str, columns: list[str], delimiter: str, rejects: str | None = None
) -> None:
    """Write the lines as text files, one per task.

    A row that would not read back as it is stops the write, or goes to the Parquet folder
    ``rejects`` where one is given.
    """
    good = reads_back(columns, delimiter)
    if rejects is None:
        line = join_fields(columns, delimiter)
        wrong = F.concat(F.lit("this line would not read back: "), line)
        df.select(F.when(good, line).otherwise(F.raise_error(wrong)).cast("string").alias("value")).write.mode(
            "overwrite"
        ).text(path)
        return
    delimited_lines(df.where(good), columns, delimiter).write.mode("overwrite").text(path)
    df.where(~good).select(*columns).write.mode("overwrite").parquet(rejects)
