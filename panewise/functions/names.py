"""Column names that may hold a dot, such as ``clicks.ts``."""

from __future__ import annotations

from pyspark.sql import DataFrame


def quoted(name: str) -> str:
    """The name as one identifier."""
    return f"`{name}`"


def resolve(df: DataFrame, name: str) -> str:
    """``name`` so that Spark finds it: a column of that very name, or a qualified one."""
    return quoted(name) if name in df.columns else name


def qualified(df: DataFrame, table: str) -> DataFrame:
    """Every column renamed to ``table.column``.

    Two inputs that share column names can then be joined in every form, and the result
    says which side a column comes from.
    """
    return df.toDF(*[f"{table}.{c}" for c in df.columns])
