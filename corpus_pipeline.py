"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes every stage as Parquet to the shared folder, deletes
what the stage has read and staged, and hands what it reads back to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panewise.llm import lines, mixing, packing, quality, simhash
from panewise.llm.tables import discard, scope, shipped, staged, written
from panewise.llm.tokens import default_path
from panewise.sources.tables import table

#: Near-duplicates: fingerprints of three-word shingles that differ in two bits at most.
SHINGLE, THRESHOLD = 3, 2


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least an even chance; every text is read whole.

    Null and empty texts are scored like any other; repeated rows go or stay together. An
    empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"), "text")
    kept = quality.with_score(rows, model).where(F.col("score") >= 0.5)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines aligned with an earlier one; ``n_chars`` follows."""
    kept = lines.drop_lines(docs)
    columns = {
        "text": F.col("text"),
        "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast("long"),
    }
    return kept.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, null ids last.

    Groups are those of SimHash: fingerprints within ``THRESHOLD`` bits link, and texts
    without words have one fingerprint. Of rows with equal ids the text with the smaller hash
    stays, of equal rows any one. An empty table stays empty.
    """
    groups = staged(simhash.near_groups(docs, SHINGLE, THRESHOLD), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = groups.groupBy("root").agg(F.min(order).alias("first"))
    chosen = staged(first.select("first.doc_id", "first.text_hash").distinct(), "groups")
    text_hash = F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_hash.alias("text_hash"),
    )
    same = rows["doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["text_hash"] == chosen["text_hash"])
    kept = rows.join(chosen, same, "left_semi")
    number = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0)))
    return kept.withColumn("number", number).where(F.col("number") == 1).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at weights 5, 2, 1 in turn, at most three times each.

    Null and empty texts give nothing, a null source is a source, rows of one id go by length
    and a hash of the text. An empty table stays empty.
    """
    mixed = mixing.take(docs, weights=(5, 2, 1), epochs=3)
    counted = mixed.withColumn("n_chars", F.length("text").cast("long"))
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, each with the sources' shares of all tokens.

    Null and empty texts are their end id, rows of one id are documents of their own. An empty
    table gives no pieces.
    """
    pieces = packing.pack(docs, default_path("byte_bpe_50k.json"), end_id=0, window=1024)
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(*columns)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]
STAGES = [(name, shipped(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; nothing but these stays in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scope(spark):
            before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs


#: A trained model and SimHash are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
