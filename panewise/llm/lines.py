"""Line dedup by pairwise alignment.

A document's partners are all earlier documents of different content that share a line with
it, blank ones aside. Each pair is aligned by patience diff on the lines it shares: lines
that occur once on both sides anchor it, the longest increasing run of them fixes the order,
and equal lines next to it and between extend the blocks. What is aligned with any partner
leaves the later document. A copy of an earlier document, blank lines aside, goes whole and
is nobody's partner.

A line is rare when at most ``HOLDERS`` documents of different content hold it; pairs that
share a rare line are formed one by one. All other partners share frequent lines only, so
what is aligned follows from the two sequences of frequent lines: documents with equal
sequences are one class. One with an earlier partner in its own class loses all its frequent
lines. Only the others are aligned with other classes, those that come first for a line
before later ones, and only as long as a line is left that a class holds. ``HOLDERS``
decides on the way, never on the result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panewise.llm.tables import discard, staged

#: Bytes of text that one task call holds.
CHUNK_BYTES = 2 << 20
#: Documents of different content that may hold a rare line, and classes that a frequent line
#: leads to at first; each further round goes so many times as far.
HOLDERS, FURTHER = 8, 16
#: Shared lines of pairs that one task call aligns, about.
MATCHES_AT_ONCE = 50_000
DOC, PARTNER, LINE = ["doc_id", "text_hash"], ["first_id", "first_hash"], ["h", "h2"]
CLASS = ["class_id", "class_hash"]
BLANK = r"\A[\x20\x09-\x0D]*\z"


def increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by first place, whose second places increase."""
    tails: list[int] = []
    holders: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(places):
        k = bisect_left(tails, b)
        back.append(holders[k - 1] if k else -1)
        if k == len(tails):
            tails.append(b)
            holders.append(i)
        else:
            tails[k], holders[k] = b, i
    out, i = [], holders[-1] if holders else -1
    while i >= 0:
        out.append(places[i])
        i = back[i]
    return out[::-1]


def patience(left: list[int], right: list[int]) -> list[int]:
    """Places in ``left`` of the lines aligned with ``right``."""
    aligned: list[int] = []
    stack = [(0, len(left), 0, len(right))]
    while stack:
        a, z, b, y = stack.pop()
        while a < z and b < y and left[a] == right[b]:
            aligned.append(a)
            a, b = a + 1, b + 1
        while a < z and b < y and left[z - 1] == right[y - 1]:
            z, y = z - 1, y - 1
            aligned.append(z)
        if a >= z or b >= y:
            continue
        here, there = Counter(left[a:z]), Counter(right[b:y])
        place = {line: i for i, line in enumerate(right[b:y], b) if there[line] == 1}
        anchors = increasing([(i, place[x]) for i, x in enumerate(left[a:z], a) if here[x] == 1 and x in place])
        if not anchors:
            continue
        for i, j in [*anchors, (z, y)]:
            stack.append((a, i, b, j))
            if i < z:
                aligned.append(i)
            a, b = i + 1, j + 1
    return aligned


def aligned_lines(matches: list[tuple[tuple[int, int], list[int], list[int]]]) -> set[int]:
    """Line numbers of a document to delete, from its lines and their partners.

    A match is (partner, places of a line here, places there); each partner is aligned on
    its own.
    """
    partners: dict[tuple[int, int], list] = {}
    for partner, here, there in matches:
        partners.setdefault(partner, []).append((here, there))
    gone: set[int] = set()
    for found in partners.values():
        if len(found) == 1 and len(found[0][0]) == len(found[0][1]) == 1:
            gone.add(found[0][0][0])
            continue
        here = sorted((p, k) for k, m in enumerate(found) for p in m[0])
        there = sorted((p, k) for k, m in enumerate(found) for p in m[1])
        gone.update(here[i][0] for i in patience([k for _, k in here], [k for _, k in there]))
    return gone


def renamed(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(old, new)))


def shared_lines(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The lines of ``held`` that both documents of a pair hold: their places here and there."""
    here = held.withColumnRenamed("places", "here")
    there = renamed(held, [*DOC, "places"], [*PARTNER, "there"])
    return pairs.join(here, DOC).join(there, [*PARTNER, *LINE]).select(*DOC, *PARTNER, "here", "there")


def aligned(matches: DataFrame) -> DataFrame:
    """doc_id, text_hash, ``gone``: places aligned with some partner, from a written table."""
    groups = max(1, matches.count() // MATCHES_AT_ONCE)
    group = F.pmod(F.xxhash64(*DOC, *PARTNER), F.lit(groups)).alias("group")

    def run(table: pa.Table) -> pa.Table:
        by_doc: dict[tuple[int, int], list] = {}
        columns = (*DOC, *PARTNER, "here", "there")
        for d, t, first_id, first_hash, here, there in zip(*(table[c].to_pylist() for c in columns)):
            by_doc.setdefault((d, t), []).append(((first_id, first_hash), here, there))
        gone = [sorted(aligned_lines(found)) for found in by_doc.values()]
        ids, hashes = zip(*by_doc)
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(gone, pa.list_(pa.int32()))],
            names=[*DOC, "gone"],
        )

    found = matches.select("*", group).groupBy("group").applyInArrow(run, "doc_id long, text_hash long, gone array<int>")
    return found.groupBy(*DOC).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def gone_by_frequent(often: DataFrame, rare_pairs: DataFrame) -> list[DataFrame]:
    """Tables of doc_id, text_hash, ``gone``: what partners without a rare line are aligned with.

    ``often`` has the places of the frequent lines of all documents, ``rare_pairs`` the pairs
    that share a rare line. A class counts for a document if it has an earlier member that is
    not among these; as many of them as are in the class cannot be all that come before.
    """
    sequence = F.array_sort(F.collect_list(F.struct("place", *LINE))).alias("s")
    members = often.select(*DOC, *LINE, F.explode("places").alias("place")).groupBy(*DOC).agg(sequence)
    codes = F.transform("s", lambda x: F.struct(x["h"], x["h2"]))
    content = [F.xxhash64(codes).alias("w"), F.hash(codes).alias("w2"), F.size("s").alias("n")]
    members = staged(members.select(*DOC, *content, F.col("s.place").alias("gone")), "lines")
    first = members.groupBy("w", "w2", "n").agg(F.min(F.struct(*DOC)).alias("first"))
    classes = first.select("w", "w2", "n", F.col("first.doc_id").alias("class_id"), F.col("first.text_hash").alias("class_hash"))
    classes = staged(classes, "lines")
    named = staged(members.join(classes, ["w", "w2", "n"]).select(*DOC, *CLASS, "gone"), "lines")

    partners = rare_pairs.join(renamed(named.select(*DOC, *CLASS), DOC, PARTNER), PARTNER)
    partners = staged(partners.groupBy(*DOC, *CLASS).agg(F.count("*").alias("known")), "lines")
    most = partners.agg(F.max("known")).first()[0] or 0
    number = F.row_number().over(Window.partitionBy(*CLASS).orderBy(*DOC))
    ranked = named.select(*CLASS, *DOC).withColumn("number", number).where(F.col("number") <= most + 1)
    next_one = ranked.select(*CLASS, (F.col("number") - 1).alias("known"), F.col("doc_id").alias("next_id"))
    unknown = partners.join(next_one, [*CLASS, "known"], "left")
    known = staged(unknown.where(F.col("next_id").isNull() | (F.col("next_id") >= F.col("doc_id"))).select(*DOC, *CLASS), "lines")

    alike = named.where(F.col("doc_id") > F.col("class_id")).join(known, [*DOC, *CLASS], "left_anti")
    out = [staged(alike.select(*DOC, "gone"), "lines")]
    left = staged(often.join(out[0], DOC, "left_anti"), "lines")
    leads = staged(renamed(often, DOC, CLASS).join(classes, CLASS, "left_semi").select(*LINE, *CLASS), "lines")
    furthest = leads.groupBy(*LINE).count().agg(F.max("count")).first()[0] or 0
    lead = F.row_number().over(Window.partitionBy(*LINE).orderBy(*CLASS))
    done, upto = 0, HOLDERS
    while done < furthest and not left.isEmpty():
        some = leads.join(left.select(*LINE).distinct(), LINE, "left_semi").withColumn("lead", lead)
        some = some.where(F.col("lead") <= upto).where(F.col("lead") > done)
        # both sides of the join are tables, so Spark can split a line that many documents hold
        some = staged(some.select(*LINE, *CLASS), "lines")
        pairs = left.join(some, LINE).where(F.col("doc_id") > F.col("class_id")).select(*DOC, *CLASS).distinct()
        pairs = renamed(pairs.join(known, [*DOC, *CLASS], "left_anti"), CLASS, PARTNER)
        matches = staged(shared_lines(staged(pairs, "lines"), often), "lines")
        out.append(staged(aligned(matches), "lines"))
        rest = F.when(F.col("gone").isNull(), F.col("places")).otherwise(F.array_except("places", "gone"))
        left = left.join(out[-1], DOC, "left").select(*LINE, *DOC, rest.alias("places"))
        left = staged(left.where(F.size("places") > 0), "lines")
        discard(some, matches)
        done, upto = upto, upto * FURTHER
    discard(members, partners)
    return out


def drop_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The columns of ``docs`` as struct ``row``, then ``text``, ``n_lines``, ``n_removed``.

    Lines are separated by a line feed; a null or empty text has no lines, and a null text
    stays null. Blank lines are never compared and stay unless their whole document goes
    empty. Ids decide which document is later: rows without an id and the first of each
    group stay as they are, and rows with equal ids are not compared. A document of which
    all lines but blank ones go has an empty text. An empty table gives no rows.
    """
    doc_id, text = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string")
    others = [c for c in docs.columns if c != text_column]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        text.alias("text"),
        doc_id.alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
    )
    chunks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(chunks)).cast("int").alias("chunk")
    line = F.col("line")
    lines = (
        rows.where(F.col("doc_id").isNotNull())
        .select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("place", "line"))
        .where(~F.rlike(line, F.lit(BLANK)))
        .select("doc_id", "text_hash", "place", F.xxhash64(line).alias("h"), F.hash(line).alias("h2"))
    )
    full = F.filter(F.split("text", "\n"), lambda x: ~F.rlike(x, F.lit(BLANK)))
    whole = rows.where(F.col("doc_id").isNotNull()).select(
        "doc_id", "text_hash", F.xxhash64(full).alias("w"), F.hash(full).alias("w2"), F.size(full).alias("n")
    )
    whole = staged(whole.where(F.col("n") > 0), "lines")
    oldest = staged(whole.groupBy("w", "w2", "n").agg(F.min("doc_id").alias("first_id")), "lines")
    copies = whole.join(oldest, ["w", "w2", "n"]).where(F.col("doc_id") > F.col("first_id"))
    copies = staged(copies.select("doc_id", "text_hash").distinct(), "lines")
    held = lines.groupBy("h", "h2", "doc_id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("places"))
    held = staged(held.join(copies, ["doc_id", "text_hash"], "left_anti"), "lines")
    holders = staged(held.groupBy(*LINE).agg(F.count("*").alias("holders")).where(F.col("holders") > 1), "lines")
    # both sides of the join are tables, so Spark can split a line that many documents hold
    rare = staged(held.join(holders.where(F.col("holders") <= HOLDERS), LINE).drop("holders"), "lines")
    often = staged(held.join(holders.where(F.col("holders") > HOLDERS), LINE).drop("holders"), "lines")
    discard(held, holders)
    earlier = renamed(rare, [*DOC, "places"], [*PARTNER, "there"])
    matches = rare.withColumnRenamed("places", "here").join(earlier, LINE).where(F.col("doc_id") > F.col("first_id"))
    matches = staged(matches.select(*DOC, *PARTNER, "here", "there"), "lines")
    none = F.lit(None).cast("array<int>")
    zero = F.lit(0).cast("long")
    gone = []
    if not often.isEmpty():
        pairs = staged(matches.select(*DOC, *PARTNER).distinct(), "lines")
        gone = gone_by_frequent(often, pairs)
        matches = matches.unionByName(shared_lines(pairs, often))
    for found in gone:
        alone = [zero.alias("first_id"), zero.alias("first_hash"), F.col("gone").alias("here"), none.alias("there")]
        matches = matches.unionByName(found.select(*DOC, *alone))
    own = copies.select(
        *DOC, zero.alias("first_id"), zero.alias("first_hash"), none.alias("here"), none.alias("there")
    )
    matches = matches.unionByName(own).select("*", chunk)
    schema = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_removed", T.LongType()),
        ]
    )

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        by_doc: dict[tuple[int, int], list] = {}
        known: dict[tuple[int, int], set[int]] = {}
        whole: set[tuple[int, int]] = set()
        columns = (*DOC, *PARTNER, "here", "there")
        if found.num_rows:
            for d, t, first_id, first_hash, here, there in zip(*(found[c].to_pylist() for c in columns)):
                if here is None:
                    whole.add((d, t))
                elif there is None:
                    known.setdefault((d, t), set()).update(here)
                else:
                    by_doc.setdefault((d, t), []).append(((first_id, first_hash), here, there))
        texts, totals, removed = [], [], []
        for d, t, body in zip(*(table[c].to_pylist() for c in ("doc_id", "text_hash", "text"))):
            parts = body.split("\n") if body else []
            if (d, t) in whole:
                gone = set(range(len(parts)))
            else:
                gone = known.get((d, t), set()) | aligned_lines(by_doc.get((d, t), []))
            kept = [x for i, x in enumerate(parts) if i not in gone] if gone else parts
            if gone and not any(x.strip(" \t\n\v\f\r") for x in kept):
                kept = []
            texts.append(body if not gone else "\n".join(kept))
            totals.append(len(parts))
            removed.append(len(parts) - len(kept))
        return pa.table(
            [table["row"], pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
            names=["row", "text", "n_lines", "n_removed"],
        )

    return rows.select("*", chunk).groupBy("chunk").cogroup(matches.groupBy("chunk")).applyInArrow(run, schema)
