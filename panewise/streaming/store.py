"""Results of a windowed stream that stay readable and bounded.

A micro-batch in update mode writes the windows it changed. From time to time the versions
written since are folded: of each window only the newest stays, closed windows go to a
folder that is never touched again, and open ones replace the open ones before. A manifest
names the folders that count. So a reader meets every closed window once and each open one
as often as it changed since the last fold, however long the stream has run.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panewise.streaming.sinks import start_stream

_END, _START, _BATCH, _CLOSED = "window_end", "window_start", "__batch", "__closed"


class _Folder:
    """Small files and folders below ``path``, by the file system Spark uses for it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark._jvm
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: the file appears under its name when it is complete."""
        out = self._fs.create(self._at(f"{name}.part"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self._at(name), False)
        self._fs.rename(self._at(f"{name}.part"), self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def _manifests(folder: _Folder) -> list[int]:
    return sorted(int(n.split(".")[0]) for n in folder.names("manifest") if n.endswith(".json"))


def _newest(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The newest version of each window; one row per version comes in."""
    newest = [F.max_by(c, _BATCH).alias(c) for c in values]
    return rows.groupBy(*keys).agg(*newest)


def _versions(spark: SparkSession, path: str, manifest: dict, schema: T.StructType) -> DataFrame | None:
    """The open windows of the last fold and what has changed since, with their batches."""
    parts = [spark.read.schema(schema).parquet(f"{path}/changed/{i}").withColumn(_BATCH, F.lit(i)) for i in manifest["changed"]]
    if manifest["open"] is not None:
        folder = f"{path}/folded/{manifest['open']}/{_CLOSED}=false"
        parts.append(spark.read.schema(schema).parquet(folder).withColumn(_BATCH, F.lit(-1)))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def keep_windows(
    df: DataFrame,
    path: str,
    checkpoint: str,
    keys: list[str],
    delay: int,
    fold_every: int = 16,
    every: str | None = None,
) -> StreamingQuery:
    """Run a windowed aggregate in update mode and keep its result at ``path``.

    ``df`` has the columns ``window_start`` and ``window_end`` of a stream window aggregate
    with a watermark of ``delay`` seconds over one input, and one row per window and
    ``keys``. After ``fold_every`` batches with changes their versions are folded. A window is
    closed when it ends ``delay`` or more before the latest window start seen: the watermark
    of the next batch has then passed its end.

    A batch that runs again overwrites what it wrote, or does nothing if its manifest is
    there. :func:`windows` reads the result, also while the query runs.
    """
    spark, schema, columns = df.sparkSession, df.schema, df.columns
    names = [_START, _END, *keys]
    values = [c for c in columns if c not in names]
    folder = _Folder(spark, path)
    state: dict = {}

    def fold(batch_id: int, manifest: dict) -> list[str]:
        """Write the folded windows and change the manifest; folders that no longer count."""
        rows = _versions(spark, path, manifest, schema)
        latest = rows.agg(F.max(_START)).first()[0]
        closed = F.col(_END) <= F.lit(latest) - F.expr(f"INTERVAL '{int(delay)}' SECOND")
        out = _newest(rows, names, values).select(*columns, F.coalesce(closed, F.lit(False)).alias(_CLOSED))
        out.write.mode("overwrite").partitionBy(_CLOSED).parquet(f"{path}/folded/{batch_id}")
        written = folder.names(f"folded/{batch_id}")
        old = [f"changed/{i}" for i in manifest["changed"]]
        if manifest["open"] is not None:
            old.append(f"folded/{manifest['open']}/{_CLOSED}=false")
        manifest["changed"] = []
        manifest["open"] = batch_id if f"{_CLOSED}=false" in written else None
        if f"{_CLOSED}=true" in written:
            manifest["closed"] = [*manifest["closed"], batch_id]
        return old

    def write(batch: DataFrame, batch_id: int) -> None:
        if not state:
            known = [i for i in _manifests(folder) if i <= batch_id]
            state.update(json.loads(folder.read(f"manifest/{known[-1]}.json")) if known else
                         {"batch": -1, "changed": [], "open": None, "closed": []})
        if state["batch"] >= batch_id:
            return
        changed = f"{path}/changed/{batch_id}"
        batch.write.mode("overwrite").parquet(changed)
        manifest, old = dict(state, batch=batch_id), []
        if spark.read.schema(schema).parquet(changed).isEmpty():
            old = [f"changed/{batch_id}"]
        else:
            manifest["changed"] = [*manifest["changed"], batch_id]
            if len(manifest["changed"]) >= fold_every:
                old = fold(batch_id, manifest)
        # what no longer counts stays for one batch more, for readers of the manifest before
        old += [f"manifest/{i}.json" for i in _manifests(folder) if i < batch_id]
        manifest.update(schema=schema.json(), late=old)
        folder.write(f"manifest/{batch_id}.json", json.dumps(manifest))
        gone = state.get("late", [])
        state.clear()
        state.update(manifest)
        for name in gone:
            folder.remove(name)

    return start_stream(df.writeStream.outputMode("update").foreachBatch(write), checkpoint, every)


def windows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Every window that :func:`keep_windows` has kept at ``path``, as it was last."""
    folder = _Folder(spark, path)
    manifest = json.loads(folder.read(f"manifest/{_manifests(folder)[-1]}.json"))
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    names = [_START, _END, *keys]
    values = [c for c in schema.names if c not in names]
    out = _versions(spark, path, manifest, schema)
    if out is not None:
        out = _newest(out, names, values).select(*schema.names)
    if manifest["closed"]:
        closed = [f"{path}/folded/{i}/{_CLOSED}=true" for i in manifest["closed"]]
        closed = spark.read.schema(schema).parquet(*closed)
        out = closed if out is None else out.unionByName(closed)
    return out if out is not None else spark.createDataFrame([], schema)
