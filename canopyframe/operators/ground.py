"""Ground model per raster cell and height above ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.ranking import percentiles_by
from canopyframe.runtime import BROADCAST_LIMIT, broadcast_if_small, cut_lineage, fits_one_task, salted_join
from canopyframe.spatial import cell, range_join, spread, with_cells

GROUND_KEYS = ["tile_id", "gx", "gy"]


def ground_model(points: DataFrame, size: float = 0.5, share: float = 0.02,
                 min_points: int = 20) -> DataFrame:
    """Low height percentile of each cell with enough points: ``tile_id, gx, gy, ground, n_points``."""
    keyed = with_cells(points.select("tile_id", "x", "y", "z"), size, names=("gx", "gy"))
    cells = percentiles_by(keyed, GROUND_KEYS, {"ground": ("z", share)},
                           [F.count(F.lit(1)).alias("n_points")])
    return cells.where(F.col("n_points") >= min_points)


def normalize_height(points: DataFrame, ground: DataFrame, size: float = 0.5,
                     default_ground: bool = False) -> DataFrame:
    """Add ``hag``: z minus the ground of the point's cell, null where the cell has none.

    ``default_ground`` uses the median cell ground instead of null, and the
    lowest point of the tile when no cell has a ground at all.
    """
    if default_ground:
        ground = cut_lineage(ground)  # cells are read for the join and for the median
    keyed = with_cells(points, size, names=("gx", "gy"))
    cells = ground.select(*GROUND_KEYS, "ground")
    out = _meet(keyed, cells, GROUND_KEYS) if default_ground else salted_join(keyed, cells, GROUND_KEYS, "left")
    level = F.col("ground")
    if default_ground:
        median = percentiles_by(ground, ["tile_id"], {"_median": ("ground", 0.5)})
        lowest = points.groupBy("tile_id").agg(F.min("z").alias("_lowest"))
        base = lowest.join(median, "tile_id", "left").select(
            "tile_id", F.coalesce("_median", "_lowest").alias("_base"))
        out = _meet(out, cut_lineage(base), ["tile_id"])
        level = F.coalesce("ground", "_base")
    return out.withColumn("hag", F.col("z") - level).drop("gx", "gy", "ground", "_base")


def _meet(points: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that moves the points only if the counted rows of the other side are too many to broadcast."""
    if fits_one_task(few, [], BROADCAST_LIMIT):
        return points.join(F.broadcast(few), keys, "left")
    return salted_join(points, few, keys, "left")


def height_band(points: DataFrame, low: float, high: float) -> DataFrame:
    """Points whose height above ground lies in the closed band."""
    return points.where(F.col("hag").between(float(low), float(high)))


def band_above(points: DataFrame, ground: DataFrame, low: float, high: float, size: float = 0.5) -> DataFrame:
    """``height_band`` of ``normalize_height``: points that no ground of their tile lifts into the band aren't moved to their cell.

    ``ground`` is read twice and should be checkpointed.
    """
    # the margin is far above the rounding of z minus ground
    ends = ground.groupBy("tile_id").agg((F.min("ground") + F.lit(float(low)) - 1e-3).alias("_low"), (F.max("ground") + F.lit(float(high)) + 1e-3).alias("_high"))
    near = salted_join(points, broadcast_if_small(cut_lineage(ends)), ["tile_id"], salts=1)
    near = near.where(F.col("z").between(F.col("_low"), F.col("_high"))).select(*points.columns)
    return height_band(normalize_height(near, ground, size), low, high)


def stem_ground(stems: DataFrame, ground: DataFrame, size: float = 0.5,
                fallback: str | None = "cluster_ground") -> DataFrame:
    """Ground under the stem centre; the fallback column is used where the cell has none.

    Without a fallback, stems off the ground model are dropped.
    """
    keyed = stems.withColumn("gx", cell("x", size)).withColumn("gy", cell("y", size))
    out = keyed.join(ground.select(*GROUND_KEYS, F.col("ground").alias("_cell_ground")), GROUND_KEYS, "left")
    level = F.coalesce("_cell_ground", fallback) if fallback else F.col("_cell_ground")
    return out.withColumn("ground", level).where(F.col("ground").isNotNull()).drop("gx", "gy", "_cell_ground")


def radius_filter(points: DataFrame, ox: float, oy: float, radius: float, margin: float = 0.0) -> DataFrame:
    """Points within a radius; the box predicate lets parquet skip row groups."""
    r = float(radius + margin)
    return points.where(F.col("x").between(ox - r, ox + r) & F.col("y").between(oy - r, oy + r)
                        & (F.hypot(F.col("x") - F.lit(float(ox)), F.col("y") - F.lit(float(oy))) <= r))


def merge_scans(scans: list[DataFrame], ox: float, oy: float, radius: float, margin: float = 3.0) -> DataFrame:
    """One cloud from registered set-ups, each cut to the plot plus a margin first."""
    merged = None
    for scan in scans:
        part = radius_filter(scan, ox, oy, radius, margin)
        merged = part if merged is None else merged.unionByName(part)
    return merged


def window_read(points: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float,
                zmin: float = -1.0, zmax: float = 200.0) -> DataFrame:
    """Rectangular cut with a height range and only the columns later steps need."""
    return (points.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax)
                         & F.col("z").between(zmin, zmax))
            .select("tile_id", "point_idx", "x", "y", "z", "class"))


def tree_height(points: DataFrame, stems: DataFrame, radius: float = 1.5,
                keys: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """Highest point within ``radius`` of each stem: ``stem_id, top_z`` (null when none)."""
    side = stems.select(*keys, "stem_id", F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    small = fits_one_task(side, [], BROADCAST_LIMIT)
    near = range_join(points.select(*keys, "point_idx", "x", "y", "z"), F.broadcast(side) if small else side, radius,
                      ("x", "y"), ("_sx", "_sy"), on=list(keys), salts=1 if small else None)
    tops = near.groupBy("stem_id").agg(F.max("z").alias("top_z"))
    return stems.join(tops, "stem_id", "left")


#: Stems that a cell and its neighbours may hold to travel in one row.
PACK = 256


def nearest_stem(points: DataFrame, stems: DataFrame, max_radius: float = 4.0,
                 min_hag: float = 0.4, pack: int = PACK) -> DataFrame:
    """Label each point above ground with its nearest stem if that lies within its crown.

    The nearest stem is chosen first and tested against ``min(crown_radius_m,
    max_radius)`` afterwards; ties go to the lowest stem. Output ``label`` is
    null for ground points and points out of reach.

    The stems in reach of a cell are packed into one row, so a point meets one row and is
    never regrouped. Only points of cells with more than ``pack`` of them meet stem rows one by one.
    """
    columns = points.columns
    live = F.col("hag") > min_hag
    side = stems.select("tile_id", F.col("x").alias("_sx"), F.col("y").alias("_sy"), "stem_id", "crown_radius_m")
    packed, crowded = _packed_cells(side, max_radius, pack)
    keyed = with_cells(points, max_radius, names=("_gx", "_gy"))
    # ground points stay in the result but match no cell
    keyed = keyed.withColumn("_gx", F.when(live, F.col("_gx")))
    out = _attach_stems(keyed, packed, ["tile_id", "_gx", "_gy"])
    best = F.array_min(_distances())
    out = out.withColumn("_near", best)
    if crowded is not None:
        out = _nearest_in_crowds(out, crowded)
    ok = F.col("_near.d") <= F.least(F.col("_near.c"), F.lit(float(max_radius)))
    return out.select(*[c for c in columns if c in ("tile_id", "point_idx", "x", "y", "z", "hag")], F.when(ok, F.col("_near.s")).alias("label"))


def _packed_cells(side: DataFrame, size: float, pack: int) -> tuple[DataFrame, DataFrame | None]:
    """``tile_id, _gx, _gy, _stems`` of cells whose neighbourhood holds at most ``pack`` stems, and the stems around all others."""
    names = ("_gx", "_gy")
    near = spread(with_cells(side, size, "_sx", "_sy", names), names)
    keys = ["tile_id", *names]
    sizes = cut_lineage(near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > pack).select(*keys))
    if not sizes.take(1):
        return _pack(near, keys), None
    return _pack(salted_join(near, sizes, keys, "left_anti"), keys), cut_lineage(salted_join(near, sizes, keys, "left_semi"))


def _pack(near: DataFrame, keys: list[str]) -> DataFrame:
    return near.groupBy(*keys).agg(F.collect_list(F.struct("_sx", "_sy", "stem_id", "crown_radius_m")).alias("_stems"))


def _attach_stems(keyed: DataFrame, packed: DataFrame, keys: list[str]) -> DataFrame:
    packed = cut_lineage(packed)
    # a row is at most PACK stems, so the number of stems bounds what is sent
    held = packed.agg(F.sum(F.size("_stems")).alias("n")).first()["n"] or 0
    return keyed.join(F.broadcast(packed), keys, "left") if held <= BROADCAST_LIMIT else salted_join(keyed, packed, keys, "left")


def _distances() -> Column:
    return F.transform("_stems", lambda s: F.struct(F.hypot(F.col("x") - s["_sx"], F.col("y") - s["_sy"]).alias("d"), s["stem_id"].alias("s"), s["crown_radius_m"].alias("c")))


def _nearest_in_crowds(out: DataFrame, crowded: DataFrame) -> DataFrame:
    """Nearest stems of the points in crowded cells: every stem and point meet, grouped by point; other rows stay as they are."""
    keys = ["tile_id", "_gx", "_gy"]
    cells = crowded.select(*keys).distinct().withColumn("_crowd", F.lit(True))
    marked = salted_join(out, broadcast_if_small(cells), keys, "left")
    dist = F.hypot(F.col("x") - F.col("_sx"), F.col("y") - F.col("_sy"))
    inside = marked.where("_crowd").select("tile_id", "point_idx", "x", "y", "z", "hag", "_gx", "_gy")
    met = salted_join(inside, crowded, keys)
    best = met.groupBy("tile_id", "point_idx", "x", "y", "z", "hag").agg(
        F.min(F.struct(dist.alias("d"), F.col("stem_id").alias("s"), F.col("crown_radius_m").alias("c"))).alias("_near"))
    return marked.where(F.col("_crowd").isNull()).select(*best.columns).unionByName(best)
