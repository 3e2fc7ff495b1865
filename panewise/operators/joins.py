"""Equality joins.

No join here asks for a broadcast: Catalyst and adaptive execution broadcast a side
only when its size is known to be below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panewise.functions.names import resolve

KINDS = ("inner", "left", "right", "full")

#: A key with more than this share of a side's rows is split in outer joins.
HOT_SHARE = 0.01


def _field(df: DataFrame, name: str) -> T.StructField | None:
    names = df.columns
    if names.count(name) == 1:
        return df.schema[name]
    if name.split(".")[-1] not in names:
        return None
    try:
        return df.select(name).schema[0]
    except AnalysisException as error:
        if "UNRESOLVED_COLUMN" not in str(error.getCondition()):
            raise
        return None


def oriented(left: DataFrame, right: DataFrame, pair: tuple[str, str]) -> tuple[str, str]:
    """The pair as (left column, right column), whichever way it was written."""
    for a, b in (pair, pair[::-1]):
        left_field, right_field = _field(left, a), _field(right, b)
        if left_field and right_field:
            if left_field.dataType != right_field.dataType:
                raise TypeError(
                    f"{a} is {left_field.dataType.simpleString()} but "
                    f"{b} is {right_field.dataType.simpleString()}"
                )
            if a == b:
                raise ValueError(f"{a} = {b} does not tell the sides apart: alias or qualify them")
            return resolve(left, a), resolve(right, b)
    raise ValueError(f"{pair[0]} = {pair[1]} does not join the two sides")


def equal(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(a) == F.col(b) for a, b in pairs))


def shared_names(left: DataFrame, right: DataFrame) -> None:
    """Refuse inputs whose columns could not be told apart in the result."""
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise ValueError(f"both sides have {sorted(shared)}: name the columns with qualified()")


def join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    how: str = "inner",
    split_hot: bool | None = None,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Join on one or more equal columns, keeping the columns of both sides.

    ``on`` holds pairs such as ``("orders.o_custkey", "customer.c_custkey")`` in either
    order; both columns must have the same type. An empty list would mean a cross
    product and is refused. Sides that share column names are aliased (inner joins) or
    named with :func:`panewise.functions.names.qualified` (all joins).

    Adaptive execution splits the partition of a hot key, within two limits. Both sides
    must be shuffled for the join itself, which is not so for a side that is already
    grouped by the keys. And it splits either side of an inner join, but only the
    preserved side of a left or right join and no side of a full join.

    An outer join therefore first counts both sides per key, combined map-side. Rows whose
    key has more than ``hot_share`` of a side (so at most ``1 / hot_share`` keys a side)
    become an inner join plus the rows without a partner, which Spark can split; all other
    rows take one plain join. A small side has hot keys by this count without harm. The
    result is the same for any share. ``split_hot=False`` leaves the counting out; ``split_hot=True`` treats every
    key as hot, and for an inner join hashes the keys, so that both sides are shuffled.
    """
    if how not in KINDS:
        raise ValueError(f"unknown join {how}: use one of {KINDS}")
    if not on:
        raise ValueError("a join needs at least one pair of columns")
    pairs = [oriented(left, right, pair) for pair in on]
    if how != "inner":
        shared_names(left, right)
    if split_hot is False or how == "inner" and not split_hot:
        return left.join(right, equal(pairs), how)
    if split_hot:
        return _split_join(left, right, pairs, how)
    left_keys, right_keys = [a for a, _ in pairs], [b for _, b in pairs]
    hot = _hot_keys(left, right, pairs, hot_share)
    if not hot:
        return left.join(right, equal(pairs), how)
    left_hot, right_hot = _is_one_of(left_keys, hot), _is_one_of(right_keys, hot)
    ordinary = left.where(~left_hot).join(right.where(~right_hot), equal(pairs), how)
    return ordinary.unionByName(_split_join(left.where(left_hot), right.where(right_hot), pairs, how))


def _hot_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], share: float) -> set[tuple]:
    """Keys that more than ``share`` of a side's rows have: at most ``2 / share`` of them."""
    names = [f"__k{i}" for i in range(len(pairs))]

    def keys(df: DataFrame, columns: list[str], side: str) -> DataFrame:
        known = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in columns))
        named = [F.col(c).alias(n) for c, n in zip(columns, names)]
        return df.where(known).select(F.lit(side).alias("__side"), *named)

    both = keys(left, [a for a, _ in pairs], "left").unionByName(keys(right, [b for _, b in pairs], "right"))
    # the rows of a side and of its keys in one pass; no key has more rows than its side, so the
    # two sides come first
    counts = both.groupingSets([["__side"], ["__side", *names]], "__side", *names).agg(
        F.count("*").alias("__n"), F.grouping_id().alias("__all")
    )
    order = [F.desc("__n"), F.desc("__all"), "__side", *names]
    top = counts.orderBy(*order).limit(int(2 / share) + 4).collect()
    rows = {r["__side"]: r["__n"] for r in top if r["__all"]}
    return {tuple(r[n] for n in names) for r in top if not r["__all"] and r["__n"] > share * rows[r["__side"]]}


def _is_one_of(keys: list[str], values: set[tuple]) -> Column:
    """Whether the keys are one of a bounded set of values; never null."""
    ordered = sorted(values, key=repr)
    one = [reduce(lambda x, y: x & y, (F.col(k) == F.lit(v) for k, v in zip(keys, row))) for row in ordered]
    return F.coalesce(reduce(lambda x, y: x | y, one), F.lit(False))


def _split_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str) -> DataFrame:
    """An inner join plus the rows without a partner, found by an anti join against the
    distinct keys of the other side. Hashes of the keys make every side shuffle for it."""
    lefts = _with_hash(left, [a for a, _ in pairs], "__left_hash")
    rights = _with_hash(right, [b for _, b in pairs], "__right_hash")
    hashes = ("__left_hash", "__right_hash")
    out = lefts.join(rights, equal([*pairs, hashes]), "inner")
    if how in ("left", "full"):
        alone = _unmatched(lefts, right, pairs, hashes[0])
        out = out.unionByName(alone, allowMissingColumns=True)
    if how in ("right", "full"):
        alone = _unmatched(rights, left, [(b, a) for a, b in pairs], hashes[1])
        out = out.unionByName(alone, allowMissingColumns=True)
    return out.drop(*hashes)


def _with_hash(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.xxhash64(*keys))


def _unmatched(
    df: DataFrame, other: DataFrame, pairs: list[tuple[str, str]], hashed: str
) -> DataFrame:
    """Rows of ``df`` without a partner. The distinct keys are combined map-side.

    Rows with a null key have no partner and skip the shuffle; the others meet it with
    the same filter the inner join puts on them, so that its exchange is reused.
    """
    names = [f"__k{i}" for i in range(len(pairs))]
    keys = other.select(*[F.col(b).alias(k) for k, (_, b) in zip(names, pairs)]).distinct()
    matches = [*((a, k) for k, (a, _) in zip(names, pairs)), (hashed, "__key_hash")]
    known = reduce(lambda x, y: x & y, (F.col(a).isNotNull() for a, _ in pairs))
    keys = _with_hash(keys, names, "__key_hash")
    alone = df.where(known).join(keys, equal(matches), "left_anti")
    return alone.unionByName(df.where(~known))
