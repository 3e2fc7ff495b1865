"""Mixing sources to target weights with exact budgets.

Every document gets a hash-random key. Equal ranges of the key split a source evenly, so
the rows are sorted range by range; word counts are summed per range, running sums over
the ranges place each range, and running sums inside it place each document. A source is
cut at its exact budget, and a budget beyond its size repeats whole epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panewise.llm.tables import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one range of keys of one source may hold on average.
RANGE_ROWS = 1_000


def word_count(column: str):
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``budget`` from ``source``, ``source_size``.

    The whole size is shared by weight; no target exceeds ``epochs`` times its source, and
    the excess is shared again by weight. With the sources in order of size by weight, the
    first j are full for the smallest j whose next source can take its share of the rest.
    Sources are few, so one task ranks them.
    """
    kinds = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(by_name)
    whole = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = whole - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ranked = (
        sizes.withColumn("place", place)
        .withColumn("weight", F.element_at(kinds, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("left", left)
        .withColumn("weights", F.sum("weight").over(rest))
        .withColumn("share", F.col("weight") * F.col("left").cast("double") / F.col("weights"))
        .withColumn("ratio_place", F.row_number().over(by_ratio))
    )
    fits = F.when(F.col("share") <= epochs * F.col("source_size"), F.col("ratio_place"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.struct("ratio_place", "left", "weights")
    shared = ranked.withColumn("cut", F.min(F.when(fits.isNotNull(), first)).over(everything))
    target = F.when(
        F.col("ratio_place") < F.col("cut.ratio_place"), (epochs * F.col("source_size")).cast("double")
    ).otherwise(F.col("weight") * F.col("cut.left").cast("double") / F.col("cut.weights"))
    return shared.withColumn("target", target).select(
        "source", "source_size", "target", F.floor("target").cast("long").alias("budget")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    epochs: int = 3,
    keep_text: bool = False,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, whole, part for each document.

    Size is the number of words. ``whole`` is how often the mix takes the entire document,
    ``part`` how many of its first words it takes once more; ``taken`` counts the words.
    ``weights`` repeat over the sources in code point order, null last, and share the size
    of all documents; a source gives at most ``epochs`` times its size. The words taken
    from a source are its target, rounded down. The order of documents depends on their
    ids alone (texts where the id is null), so reruns agree; of rows with equal ids the
    shorter comes first, then a hash of the text decides. Null and empty texts have size 0 and give nothing; a null source
    is a source. Empty tables give no rows. ``keep_text`` keeps the columns of ``docs``, none
    of which may then start with two underscores.
    """
    named = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    sized = docs.select(
        *[F.col(f"`{c}`") for c in (docs.columns if keep_text else ["doc_id", "source"])],
        F.struct(
            word_count("text").alias("size"), F.md5(named).alias("key"), F.xxhash64("text").alias("tie")
        ).alias("__mix"),
    )
    sized = staged(sized, "mixing")
    parts = max(1, -(-sized.count() // RANGE_ROWS))
    width = -(-16**6 // parts)
    span = F.floor(F.conv(F.substring("__mix.key", 1, 6), 16, 10).cast("long") / width)
    name = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rows = sized.withColumn("__at", F.struct(name.alias("source"), span.alias("span")))
    sums = rows.groupBy("__at").agg(F.sum("__mix.size").alias("words"))
    running = Window.partitionBy("__at.source").orderBy("__at.span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("words").over(running), F.lit(0)))
    by_source = sums.groupBy(F.col("__at.source").alias("key")).agg(F.sum("words").alias("source_size"))
    goal = targets(
        by_source.select(
            F.when(~F.col("key.none"), F.col("key.name")).alias("source"), "source_size"
        ),
        weights,
        epochs,
    ).select(
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("key"),
        F.struct("source_size", "target", "budget").alias("__goal"),
    )
    ranges = starts.join(goal, F.col("__at.source") == F.col("key")).select("__at", "__start", "__goal")
    inside = Window.partitionBy("__at").orderBy("__mix.key", "doc_id", "__mix.size", "__mix.tie")
    before = F.sum("__mix.size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.join(ranges, "__at").withColumn("__end", F.col("__start") + before)
    size, source_size, budget = F.col("__mix.size"), F.col("__goal.source_size"), F.col("__goal.budget")
    whole = F.when(size > 0, F.floor(budget / F.greatest(source_size, F.lit(1)))).otherwise(0).cast("long")
    rest = budget - F.floor(budget / F.greatest(source_size, F.lit(1))).cast("long") * source_size
    part = F.greatest(F.lit(0), F.least(size, rest - (F.col("__end") - size))).cast("long")
    full = part == size
    taken = F.struct(
        (whole * size + part).alias("taken"),
        (whole + F.when(full & (size > 0), 1).otherwise(0)).cast("long").alias("whole"),
        F.when(full, 0).otherwise(part).cast("long").alias("part"),
    )
    placed = placed.withColumn("__taken", taken)
    kept = [F.col(f"`{c}`") for c in docs.columns] if keep_text else [F.col("doc_id"), F.col("source")]
    counts = [
        size.alias("size"),
        source_size.alias("source_size"),
        F.col("__goal.target").alias("target"),
        F.col("__taken.taken").alias("taken"),
        F.col("__taken.whole").alias("whole"),
        F.col("__taken.part").alias("part"),
    ]
    if keep_text:
        return placed.select(*kept, F.struct(*counts).alias("__mix"))
    return placed.select(*kept, *counts)


def take(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    A document taken n times gives n equal rows; of the one at the end of a budget only the
    words taken stay, joined by a space. Documents of which nothing is taken, null and empty
    ones among them, give no row. Other columns may have any names.
    """
    others = [F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text"]
    held = docs.select("doc_id", "source", "text", F.struct(*others).alias("others"))
    mixed = mix(held, weights, epochs, keep_text=True)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    first_words = F.array_join(F.slice(words, F.lit(1), F.col("__mix.part").cast("int")), " ")
    copies = F.sequence(F.lit(1), F.col("__mix.whole") + F.when(F.col("__mix.part") > 0, 1).otherwise(0))
    rows = mixed.where((F.col("__mix.whole") > 0) | (F.col("__mix.part") > 0)).withColumn("__copy", F.explode(copies))
    cut = F.when(F.col("__copy") > F.col("__mix.whole"), first_words).otherwise(F.col("text"))
    return rows.select(*[cut.alias(c) if c == "text" else F.col("others").getField(c).alias(c) for c in docs.columns])
