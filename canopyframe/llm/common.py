"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.runtime import ensure_checkpoint_dir

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: str, *cols: Column) -> Column:
    """Number in (0, 1) from 52 bits of an MD5 of the seed and the columns; nulls count as empty text.

    MD5 gives the same number in any engine, so runs can be checked elsewhere.
    """
    joined = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    bits = F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def binary_batches(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``rows`` rows with the bytes of a text column and its offsets.

    A null text has no bytes. Row ``i`` is ``data[offsets[i]:offsets[i + 1]]``.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            yield batch, raw[ends[0]:ends[-1]], ends - ends[0]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a Parquet table in the checkpoint folder and read it back.

    Like a checkpoint it outlives lost executors and cuts the lineage, but columns
    are compressed and later reads can skip some. The tables stay until the folder
    is emptied.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver find shuffles that nothing uses any more, so that executors can delete their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
