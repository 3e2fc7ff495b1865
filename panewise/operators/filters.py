"""One typed comparison between columns and literals."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

COMPARISONS = {
    "=": operator.eq,
    "<>": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


def where(df: DataFrame, left: Column, symbol: str, right: Column) -> DataFrame:
    """Rows for which the comparison holds.

    Numbers compare with numbers whatever their width. Strings compare with strings,
    for equality only. Anything else is refused while the query is built. The result
    is an ordinary filter, so it reaches the scan.
    """
    if symbol not in COMPARISONS:
        raise ValueError(f"unknown comparison {symbol}: use one of {sorted(COMPARISONS)}")
    sides = [field.dataType for field in df.select(left, right).schema]
    strings = [isinstance(side, T.StringType) for side in sides]
    numbers = [isinstance(side, T.NumericType) for side in sides]
    if all(strings):
        if symbol not in ("=", "<>"):
            raise TypeError(f"{symbol} is not defined for strings")
    elif not all(numbers):
        names = " and ".join(side.simpleString() for side in sides)
        raise TypeError(f"type mismatch: {names} do not compare")
    return df.where(COMPARISONS[symbol](left, right))
