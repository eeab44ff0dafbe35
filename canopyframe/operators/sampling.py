"""Thinning and sampling of clouds, deterministic and without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.ranking import running_total
from canopyframe.runtime import broadcast_if_small, cut_lineage, salted_join


def voxel_thin(points: DataFrame, voxel: float, keep: list[str] | None = None) -> DataFrame:
    """First point in input order of every voxel of every tile."""
    keep = keep or [c for c in points.columns if c not in ("tile_id", "point_idx")]
    size = F.lit(float(voxel))
    keys = [F.floor(F.col(a) / size).alias(f"_v{a}") for a in ("x", "y", "z")]
    best = points.groupBy("tile_id", *keys).agg(
        F.min_by(F.struct("point_idx", *keep), F.col("point_idx")).alias("p"))
    return best.select("tile_id", "p.*")


def sample_key(ids: list[str], seed: int = 0) -> Column:
    """Uniform text key of a row: the order of the keys is a fixed random permutation."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def sample_cap(df: DataFrame, cap: int | Column, ids: list[str], keys: list[str] | None = None,
               seed: int = 0) -> DataFrame:
    """At most ``cap`` rows (per ``keys``), drawn without replacement by hash order.

    A histogram over key prefixes finds the prefix where the cap is reached:
    rows before it are kept, rows after it dropped, and only that one prefix
    (a millionth of the rows) is ranked.
    """
    keys = keys or []
    cap = F.lit(cap) if isinstance(cap, int) else cap
    keyed = df.withColumn("_key", sample_key(ids, seed)).withColumn("_pre", F.substring("_key", 1, 5))
    hist = keyed.groupBy(*keys, "_pre").agg(F.count(F.lit(1)).alias("_c"))
    # at most 16^5 prefixes per group
    w = Window.partitionBy(*keys).orderBy("_pre").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_upto", F.sum("_c").over(w)).withColumn("_cap", cap)
    over = F.col("_upto") > F.col("_cap")
    cut = hist.groupBy(*keys).agg(F.min(F.when(over, F.struct(
        F.col("_pre").alias("pre"), (F.col("_cap") - F.col("_upto") + F.col("_c")).alias("room")))).alias("_cut"))
    if keys:
        # one row per group: broadcast when their measured number allows it
        near = salted_join(keyed, broadcast_if_small(cut_lineage(cut)), keys, salts=1)
    else:
        near = keyed.crossJoin(F.broadcast(cut))  # exactly one row
    whole = near.where(F.col("_cut").isNull() | (F.col("_pre") < F.col("_cut.pre")))
    edge = near.where(F.col("_pre") == F.col("_cut.pre"))
    rank = Window.partitionBy(*keys, "_pre").orderBy("_key", *ids)
    edge = edge.withColumn("_no", F.row_number().over(rank)).where(F.col("_no") <= F.col("_cut.room")).drop("_no")
    return whole.unionByName(edge).drop("_key", "_pre", "_cut")


def stratified_cap(df: DataFrame, first: Column, cap: int, ids: list[str], share: float = 0.7,
                   seed: int = 0) -> DataFrame:
    """Fill up to ``share`` of the budget from rows matching ``first``, the rest from the others."""
    flagged = df.withColumn("_first", F.coalesce(first, F.lit(False)))
    n_first = int(cap * share)
    counts = flagged.agg(F.count_if("_first").alias("_nf"))
    a = sample_cap(flagged.where("_first"), n_first, ids, seed=seed)
    room = F.lit(cap) - F.least(F.col("_nf"), F.lit(n_first))
    others = flagged.where(~F.col("_first")).crossJoin(F.broadcast(counts.select(room.alias("_budget"))))
    b = sample_cap(others, F.col("_budget"), ids, keys=["_budget"], seed=seed).drop("_budget")
    return a.unionByName(b).drop("_first")


def stride_sample(points: DataFrame, n: int) -> DataFrame:
    """Every n-th point of the input order."""
    return points.where(F.col("point_idx") % n == 0)


def top_n(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    """The ``n`` rows with the largest value, ties by the lowest ``tie``."""
    return df.orderBy(F.col(column).desc(), F.col(tie)).limit(n)


def lod_levels(points: DataFrame, levels: dict[str, tuple[float, int]], seed: int = 0) -> DataFrame:
    """Density levels ``{name: (voxel, cap)}`` of each tile in one frame with a ``level`` column.

    Voxels and samples of all levels are found from the point numbers alone; only the sampled numbers fetch the other columns.
    """
    keep = [c for c in points.columns if c not in ("tile_id", "point_idx")]
    sizes = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(float(v)).alias("_size"), F.lit(cap).cast("bigint").alias("_most"))
                      for n, (v, cap) in levels.items()])
    voxels = [F.floor(F.col(a) / F.col("_l._size")).alias(f"_v{a}") for a in ("x", "y", "z")]
    place = ["level", "tile_id", "_vx", "_vy", "_vz"]
    first = (points.select("tile_id", "point_idx", "x", "y", "z", F.explode(sizes).alias("_l"))
             .select("tile_id", "point_idx", "_l.level", "_l._most", *voxels)
             .groupBy(*place, "_most").agg(F.min("point_idx").alias("point_idx")))
    picked = cut_lineage(sample_cap(cut_lineage(first), F.col("_most"), ["tile_id", "point_idx"], ["level", "tile_id", "_most"], seed).drop("_most"))
    sides = F.array(*[F.struct(F.lit(n).alias("level"), *[F.floor(F.col(a) / F.lit(float(v))).alias(f"_v{a}") for a in ("x", "y", "z")])
                      for n, (v, _) in levels.items()])
    # a number names its points; those that share it are told apart by their voxels
    numbers = picked.groupBy("tile_id", "point_idx").agg(F.collect_list(F.struct("level", "_vx", "_vy", "_vz")).alias("_in"))
    met = points.join(broadcast_if_small(cut_lineage(numbers)), ["tile_id", "point_idx"])
    met = met.withColumn("_at", F.explode(F.array_intersect(sides, "_in"))).select("_at.*", "tile_id", "point_idx", *keep)
    best = met.groupBy(*place).agg(F.min_by(F.struct("point_idx", *keep), F.col("point_idx")).alias("p"))
    return best.select("tile_id", "p.*", "level")


def bounding_boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Count, box and centroid of each group."""
    aggs = [F.count(F.lit(1)).alias("n_points")]
    for a in ("x", "y", "z"):
        aggs += [F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"), F.avg(a).alias(f"mean_{a}")]
    return points.groupBy(*keys).agg(*aggs)


def grid_layout(items: DataFrame, order: list[Column], spacing: float = 16.0) -> DataFrame:
    """Place items row by row on a nearly square grid: ``off_x, off_y``."""
    numbered = running_total(items, [], order, None, "_no")
    n = items.agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("bigint").alias("_cols"))
    i = F.col("_no") - 1
    return (numbered.crossJoin(F.broadcast(n))
            .withColumn("off_x", (i % F.col("_cols")) * F.lit(float(spacing)))
            .withColumn("off_y", F.floor(i / F.col("_cols")) * F.lit(float(spacing))).drop("_no", "_cols"))
