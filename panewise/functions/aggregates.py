"""The five aggregates, in one step or as partial results that merge.

``scale`` sums a DOUBLE column as whole units of ``10**-scale``. The total is then
the same whatever the order of the rows, and additions stay on 64-bit integers. A value
that is not the nearest double of so many decimals raises, so nothing is rounded away. In
ANSI mode a total beyond 9.2e18 units raises instead of wrapping.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUNCTIONS = ("sum", "min", "max", "avg", "count")


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str
    scale: int | None = None

    def __post_init__(self) -> None:
        if self.function not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {self.function}: use one of {FUNCTIONS}")

    @property
    def value(self) -> Column:
        if self.scale is None or self.function not in ("sum", "avg"):
            return F.col(self.column)
        value, unit = F.col(self.column), F.lit(10.0**self.scale)
        units = F.rint(value * unit)
        wrong = F.concat(
            F.lit(f"{self.column} holds a value with more than {self.scale} decimals: "), value.cast("string")
        )
        whole = value.isNull() | ((units / unit == value) & (F.abs(units) < F.lit(2.0**53)))
        return F.when(whole, units.cast("bigint")).otherwise(F.raise_error(wrong).cast("bigint"))

    def rescaled(self, total: Column) -> Column:
        return total if self.scale is None else total / F.lit(10.0**self.scale)


def total(column: str, scale: int | None = None) -> Aggregate:
    return Aggregate("sum", column, scale)


def lowest(column: str) -> Aggregate:
    return Aggregate("min", column)


def highest(column: str) -> Aggregate:
    return Aggregate("max", column)


def mean(column: str, scale: int | None = None) -> Aggregate:
    return Aggregate("avg", column, scale)


def count(column: str) -> Aggregate:
    return Aggregate("count", column)


def check_types(df: DataFrame, aggregates: dict[str, Aggregate]) -> None:
    """Every aggregate but ``count`` needs a number."""
    fields = {field.name: field.dataType for field in df.schema}
    for name, item in aggregates.items():
        dtype = fields.get(item.column) or df.select(item.column).schema[0].dataType
        if item.function != "count" and not isinstance(dtype, T.NumericType):
            raise TypeError(
                f"{name}: {item.function} of {item.column} needs a number, "
                f"not {dtype.simpleString()}"
            )


def one_step(aggregates: dict[str, Aggregate]) -> list[Column]:
    """Aggregate expressions over rows."""
    out = []
    for name, item in aggregates.items():
        if item.function == "sum":
            column = item.rescaled(F.sum(item.value))
        elif item.function == "avg":
            column = item.rescaled(F.sum(item.value)) / F.count(item.column)
        elif item.function == "min":
            column = F.min(item.column)
        elif item.function == "max":
            column = F.max(item.column)
        else:
            column = F.count(item.column)
        out.append(column.alias(name))
    return out


#: The partial results each aggregate is merged from, and how each of them is merged.
PARTS = {"sum": ("sum",), "avg": ("sum", "count"), "min": ("min",), "max": ("max",), "count": ("count",)}
MERGED = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def part_names(aggregates: dict[str, Aggregate]) -> dict[tuple, str]:
    """A column name by place for each distinct partial result, so that none can clash."""
    names: dict[tuple, str] = {}
    for item in aggregates.values():
        for part in PARTS[item.function]:
            scale = item.scale if part == "sum" else None
            names.setdefault((part, item.column, scale), f"__p{len(names)}")
    return names


def partial(aggregates: dict[str, Aggregate]) -> list[Column]:
    """Expressions over rows whose results :func:`merge` can add up."""
    out = []
    for (part, column, scale), name in part_names(aggregates).items():
        value = Aggregate(part, column, scale).value
        out.append(getattr(F, part)(value).alias(name))
    return out


def merge(aggregates: dict[str, Aggregate]) -> list[Column]:
    """Final results over partial ones; averages are merged sum over merged count."""
    names, out = part_names(aggregates), []
    for name, item in aggregates.items():
        scales = {"sum": item.scale}
        merged = [
            MERGED[part](names[part, item.column, scales.get(part)]) for part in PARTS[item.function]
        ]
        if item.function in ("sum", "avg"):
            merged[0] = item.rescaled(merged[0])
        out.append((merged[0] / merged[1] if len(merged) == 2 else merged[0]).alias(name))
    return out
