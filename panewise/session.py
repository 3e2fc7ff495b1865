"""Session settings for large clusters, and the folder shared by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import cache

from pyspark.sql import SparkSession

CLUSTER_SETTINGS = {
    # Runtime re-planning: small shuffle partitions are merged and hot join
    # partitions are split, so the initial count can be set for the largest query.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    # A stream over several inputs advances with the slowest of them.
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    # Stream state lives off-heap and is checkpointed as a changelog.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(
    app: str = "panewise",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **settings: str,
) -> SparkSession:
    """A session with the settings above; keyword settings (dots as ``__``) win.

    ``shuffle_partitions`` should be about the shuffled bytes of the largest query
    divided by 128 MB; adaptive execution merges what a smaller query leaves over.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    merged = dict(CLUSTER_SETTINGS)
    if shuffle_partitions:
        merged["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    merged.update({key.replace("__", "."): value for key, value in settings.items()})
    for key, value in merged.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder every executor can reach (``spark.checkpoint.dir``).

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/panewise/{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`shared_folder` named, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of ``spark``.

    Nothing is done where the workers find it by themselves: when its folder is on
    ``PYTHONPATH`` or, in a local session, the working directory. Otherwise Spark sends a
    zip file of the package to every executor, once per application.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root in paths or local and os.getcwd() == root:
        return
    spark.sparkContext.addPyFile(_package_zip(root, spark.sparkContext.applicationId))


@cache
def _package_zip(root: str, application: str) -> str:
    """A zip file on the driver, from which Spark serves it."""
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "panewise_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "panewise")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    return path
