"""Small shared steps: written tables and missing columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panewise.session import remove_folder, shared_folder, ship_package

#: Where the tables lie that are still in use, and those of the scope around, if any.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share and read it back.

    What follows reads only the columns it needs, and a lost executor costs no more
    than the tasks it was running.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """As :func:`written`, for a table that goes with the :func:`scope` around it."""
    out = written(df, purpose)
    if (scope_paths := _SCOPE.get()) is not None:
        scope_paths.append(_PATHS[out])
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables; whatever was made from them must have been written too.

    Tables that :func:`written` did not return, such as inputs, stay.
    """
    for df in tables:
        if (path := _PATHS.pop(df, None)) is not None:
            remove_folder(df.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving all that is staged inside; what is to stay must be written by then."""
    token = _SCOPE.set([])
    try:
        yield
    finally:
        paths = _SCOPE.get()
        _SCOPE.reset(token)
        for path in paths:
            remove_folder(spark, path)


def is_finite_vector(column: str):
    """Whether a vector is there, has components, and all of them are finite numbers."""
    inf = F.lit(float("inf"))
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.col(column).isNotNull() & (F.size(column) > 0) & good


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns, so that no other column can clash with an inner name."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query``, whose first argument is a session, with this package on its workers."""

    @wraps(query)
    def run(spark, *args):
        ship_package(spark)
        return query(spark, *args)

    return run
