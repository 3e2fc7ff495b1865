"""Cutting inputs into slices."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from panewise.session import remove_folder, shared_folder
from panewise.sources import slices
from panewise.plans import inputs
from tests.conftest import final_plan, rows


@pytest.fixture(scope="module")
def files(spark):
    """Three files, the middle one the largest; ``n`` follows file and row order."""
    path = shared_folder(spark, "files")
    for name, (first, last) in {"a": (0, 10), "b": (10, 5000), "c": (5000, 5003)}.items():
        spark.range(first, last, 1, 1).toDF("n").write.parquet(f"{path}/part={name}")
    return path


@pytest.mark.parametrize("limit", ["-1", "10MB"])
def test_arrival_index(spark, files, limit, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", limit)
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
    df = slices.with_arrival_index(spark.read.parquet(files))
    assert df.columns == ["n", "part", "arrival"]
    assert df.count() == 5003
    assert df.where("arrival <> n").count() == 0


def test_arrival_index_of_many_tasks(spark, files, conf):
    conf("spark.sql.files.maxPartitionBytes", "1KB")
    df = slices.with_arrival_index(spark.read.parquet(files))
    assert df.where("arrival <> n").count() == 0


def test_arrival_index_after_a_filter(spark, files):
    """The index is that of the file, whatever is filtered later."""
    df = slices.with_arrival_index(spark.read.parquet(files)).where("n > 4999")
    assert rows(df.select("arrival")) == [(5000,), (5001,), (5002,)]


def test_dense_slice(spark):
    got = spark.range(10).groupBy(slices.dense_slice("id", 4).alias("s")).count()
    assert rows(got) == [(0, 4), (1, 4), (2, 2)]
    big = spark.range(2**60, 2**60 + 2).select(slices.dense_slice("id", 2**59).alias("s"))
    assert rows(big) == [(2,), (2,)]


def test_time_slice(spark):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-02', INTERVAL 1 HOUR)) AS ts")
    got = df.groupBy(slices.time_slice("ts", 6 * 3600).alias("w")).count().select(
        F.hour("w.start"), "count"
    )
    assert rows(got) == [(0, 1), (0, 6), (12, 6), (18, 6), (6, 6)]


def test_indexing_does_not_shuffle_rows(spark, sf):
    """Only counts per file and per slice are exchanged once Spark knows how few they are."""
    text = final_plan(inputs.QUERIES["count_slices_arrival"](spark, sf))
    text = text[: text.index("== Initial Plan ==")]
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "hashpartitioning(__file" in text and "partial_count" in text


@pytest.mark.parametrize("block", ["128MB", "2KB"])
def test_line_index(spark, block, conf):
    """Lines of three files, whether a file is one block or many."""
    conf("spark.sql.files.maxPartitionBytes", block)
    path = shared_folder(spark, "lines")
    for first, last in ((0, 10), (10, 5000), (5000, 5003)):
        lines = spark.range(first, last, 1, 1).select(F.concat(F.lit("line "), F.col("id")).alias("value"))
        lines.write.text(f"{path}/{first:06}")
    df = slices.with_line_index(spark.read.text([f"{path}/{n}" for n in ("000000", "000010", "005000")]))
    assert df.count() == 5003
    assert df.where(F.concat(F.lit("line "), F.col("arrival")) != F.col("value")).count() == 0


def test_line_index_does_not_shuffle_lines(spark):
    path = shared_folder(spark, "lines")
    spark.range(0, 500, 1, 3).select(F.col("id").cast("string").alias("value")).write.text(path)
    text = final_plan(slices.with_line_index(spark.read.text(path)))
    text = text[: text.index("== Initial Plan ==")]
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    lines = [x for x in text.split("\n") if "Exchange" in x]
    assert all("__file" in x or "SinglePartition" in x or "Broadcast" in x for x in lines), lines


def test_removed_folder(spark):
    """A folder of the shared place goes with all it holds; one that is not there does no harm."""
    path = shared_folder(spark, "gone")
    spark.range(5).write.parquet(path)
    remove_folder(spark, path)
    remove_folder(spark, path)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
