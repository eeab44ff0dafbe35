"""Incremental ingestion: arriving parts of clouds to inventory, density levels and manifest rows.

An upload is a cloud in one or more files. Beside the files it sends notes, one per
finished part, and at some time the number of parts. The stream reads the notes only;
keyed state remembers the parts of each cloud until the last one is there, a timer
gives up those that stay unfinished. The points are read once, from the files of
complete clouds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from canopyframe.dims import CLOUD_LEVELS
from canopyframe.operators.inventory import SINGLE_SCAN, InventoryParams, stem_inventory
from canopyframe.operators.sampling import lod_levels
from canopyframe.runtime import cut_lineage

POINT_SCHEMA = "tile_id string, point_idx bigint, x double, y double, z double, r int, g int, b int"


def process_batch(points: DataFrame, batch_id: int, out: str, params: InventoryParams = SINGLE_SCAN,
                  levels: dict[str, tuple[float, int]] | None = None) -> None:
    """Inventory, density levels and manifest rows of one batch of uploads.

    Every batch overwrites its own folder, so a batch that is run again after a
    failure replaces its earlier output.
    """
    points = cut_lineage(points)
    if not points.take(1):
        return
    stem_inventory(points, params).write.mode("overwrite").parquet(f"{out}/inventory/batch={batch_id}")
    lod = cut_lineage(lod_levels(points, levels or CLOUD_LEVELS))
    lod.write.mode("overwrite").partitionBy("level").parquet(f"{out}/levels/batch={batch_id}")
    rows = lod.groupBy("tile_id", "level").agg(
        F.count(F.lit(1)).alias("count"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])
    rows.write.mode("overwrite").parquet(f"{out}/manifest/batch={batch_id}")


#: A note on a finished part; ``n_parts`` may come with any of them or in a note without part and path.
NOTE_SCHEMA = "tile_id string, part int, n_parts int, path string, at timestamp"
UPLOAD_SCHEMA = "tile_id string, complete boolean, n_parts int, paths array<string>"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class UploadParts(StatefulProcessor):
    """Parts of one cloud. A part that is announced again replaces its earlier file."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part int", "path string")
        self.size = handle.getValueState("size", "n_parts int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for notes in rows:
            first = min(x for x in (first, notes["at"].min()) if x is not None)
            for note in notes.itertuples(index=False):
                if not pd.isna(note.part) and note.path is not None:
                    self.parts.updateValue((int(note.part),), (note.path,))
                if not pd.isna(note.n_parts):
                    self.size.update((int(note.n_parts),))
        found = sorted((k[0], v[0]) for k, v in self.parts.iterator())
        wanted = self.size.get()[0] if self.size.exists() else None
        timers = list(self.handle.listTimers())
        if wanted is not None and [k for k, _ in found] == list(range(wanted)):
            for at in timers:
                self.handle.deleteTimer(at)
            yield self._out(key, True, wanted, found)
        elif not timers:
            self.handle.registerTimer(int(first.timestamp() * 1000))  # the watermark is there when the wait is over

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = sorted((k[0], v[0]) for k, v in self.parts.iterator())
        yield self._out(key, False, self.size.get()[0] if self.size.exists() else None, found)

    def _out(self, key, complete: bool, wanted: int | None, found: list[tuple[int, str]]) -> pd.DataFrame:
        self.parts.clear()
        self.size.clear()
        return pd.DataFrame({"tile_id": [key[0]], "complete": [complete], "n_parts": pd.array([wanted], "Int32"), "paths": [[p for _, p in found]]})

    def close(self) -> None:
        pass


def complete_uploads(notes: DataFrame, wait_seconds: float = 86_400.0) -> DataFrame:
    """``tile_id, complete, n_parts, paths`` of each cloud once all its parts are announced, or given up after the wait.

    Parts are numbered from 0; notes may come in any order, in any number of batches
    and more than once. The wait is one of the notes' own times ``at``, so a run that is repeated
    decides alike: a cloud is given up when a note of any cloud is that much later than
    the cloud's first one, and notes that are that late count no more. A note without time
    has that of its reading; notes without tile are ignored.
    """
    timed = notes.where(F.col("tile_id").isNotNull()).withColumn("at", F.coalesce("at", F.current_timestamp()))
    return timed.withWatermark("at", f"{int(wait_seconds * 1000)} milliseconds").groupBy("tile_id").transformWithStateInPandas(
        statefulProcessor=UploadParts(), outputStructType=UPLOAD_SCHEMA, outputMode="Append", timeMode="EventTime")


def ingest_clouds(spark: SparkSession, notes: str, out: str, checkpoint: str, fmt: str = "parquet",
                  params: InventoryParams = SINGLE_SCAN, levels: dict[str, tuple[float, int]] | None = None,
                  files_per_batch: int = 1000, wait_seconds: float = 86_400.0) -> StreamingQuery:
    """Process the clouds that the notes since the last run completed, then stop.

    ``notes`` is a folder of JSON notes. Files of clouds hold points in the format ``fmt``.
    Clouds that are given up go to ``out/incomplete``.
    """
    def save(uploads: DataFrame, batch_id: int) -> None:
        uploads = cut_lineage(uploads)
        uploads.where(~F.col("complete")).write.mode("overwrite").parquet(f"{out}/incomplete/batch={batch_id}")
        # at most one path for each note of the batch or of the state that it completes
        paths = [r["path"] for r in uploads.where("complete").select(F.explode("paths").alias("path")).toLocalIterator()]
        if paths:
            process_batch(spark.read.schema(POINT_SCHEMA).format(fmt).load(paths), batch_id, out, params, levels)

    stream = spark.readStream.schema(NOTE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(notes)
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # keyed state with maps and timers needs it; a running query keeps its own copy of the setting
    try:
        return (complete_uploads(stream, wait_seconds).writeStream.foreachBatch(save).outputMode("append")
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)
