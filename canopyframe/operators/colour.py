"""Colour operators that need a pass over the data first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.dims import RAMPS, UNASSIGNED_RGB
from canopyframe.functions import colour
from canopyframe.ranking import percentiles_by
from canopyframe.runtime import broadcast_if_small, salted_join


def minmax_rescale(df: DataFrame, column: str, name: str, top: int = 65535) -> DataFrame:
    """Stretch a column to 0..top; a constant column becomes 0."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    return (df.crossJoin(F.broadcast(ends))
            .withColumn(name, F.floor((F.col(column) - F.col("_lo")) / span * top).cast("int")).drop("_lo", "_hi"))


def colour_16bit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Widen 8-bit colours to 16 bit; data that already exceeds 8 bit stays as it is."""
    tops = df.agg(*[F.max(c).alias(f"_m_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(tops))
    return out.withColumns({c: F.when(F.col(f"_m_{c}") <= 255, F.col(c) * 257).otherwise(F.col(c))
                            for c in columns}).drop(*[f"_m_{c}" for c in columns])


def colour_8bit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Narrow 16-bit colours to 8 bit when the data exceeds 8 bit."""
    top = df.agg(F.max(columns[0]).alias("_m"))
    out = df.crossJoin(F.broadcast(top))
    return out.withColumns({c: F.when(F.col("_m") > 255, F.floor(F.col(c) / 257)).otherwise(F.col(c)).cast("int")
                            for c in columns}).drop("_m")


def colour_by_height(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Height ramp between the 2nd and 98th percentile of z: adds ``cr, cg, cb``."""
    keys = keys or []
    ends = percentiles_by(points, keys, {"_lo": ("z", 0.02), "_hi": ("z", 0.98)})
    out = salted_join(points, ends, keys) if keys else points.crossJoin(F.broadcast(ends))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    rgb = colour.ramp((F.col("z") - F.col("_lo")) / span, RAMPS["height"])
    return out.withColumns(dict(zip(("cr", "cg", "cb"), rgb))).drop("_lo", "_hi")


def colour_by_label(points: DataFrame, index: str = "label") -> DataFrame:
    """Palette colour per label, grey where there is none."""
    rgb = colour.palette(F.col(index))
    return points.withColumns({n: F.when(F.col(index).isNull(), F.lit(UNASSIGNED_RGB[k])).otherwise(rgb[k])
                               for k, n in enumerate(("cr", "cg", "cb"))})


def recolour_segments(points: DataFrame, values: DataFrame, ramp: str = "hvi", lo: float | None = None,
                      hi: float | None = None) -> DataFrame:
    """Colour points by the value of their segment; points without one keep ``r, g, b``.

    ``values`` has ``seg_id, value`` and, where segments are numbered per tile, ``tile_id``; without
    ``lo``/``hi`` its own range is used.
    """
    by = [k for k in ("tile_id",) if k in values.columns] + ["seg_id"]
    if lo is None or hi is None:
        ends = values.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        values = values.crossJoin(F.broadcast(ends))
    else:
        values = values.withColumns({"_lo": F.lit(float(lo)), "_hi": F.lit(float(hi))})
    out = salted_join(points, broadcast_if_small(values), by, "left")
    t = (F.col("value") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))
    hit = F.col("value").isNotNull() & (F.col("seg_id") > 0)
    rgb = colour.ramp(t, RAMPS[ramp])
    return out.withColumns({n: F.when(hit, rgb[k]).otherwise(F.col(n).cast("double"))
                            for k, n in enumerate(("r", "g", "b"))}).drop("_lo", "_hi", "value")


def colour_transfer(pixels: DataFrame, target_mean: list[float], target_std: list[float]) -> DataFrame:
    """Match mean and spread of each channel to a target, clipped to 0..255."""
    bands = ("r", "g", "b")
    stats = pixels.agg(*[F.avg(c).alias(f"_m_{c}") for c in bands],
                       *[(F.stddev_pop(c) + 1e-6).alias(f"_s_{c}") for c in bands])
    out = pixels.crossJoin(F.broadcast(stats))
    moved = {c: (F.col(c) - F.col(f"_m_{c}")) * (F.lit(float(target_std[k])) / F.col(f"_s_{c}")) + F.lit(float(target_mean[k]))
             for k, c in enumerate(bands)}
    return out.withColumns({f"t{c}": F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) for c, v in moved.items()}).drop(
        *[f"_m_{c}" for c in bands], *[f"_s_{c}" for c in bands])
