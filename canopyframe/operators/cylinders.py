"""Cylinder models of trees and Gaussian splats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.functions import colour, geometry
from canopyframe.ranking import percentiles_by
from canopyframe.runtime import broadcast_if_small, cut_lineage, salted_join


def cylinder_geometry(cyl: DataFrame) -> DataFrame:
    """Length, volume and lateral surface of each cylinder.

    Uses start and end points where present, otherwise the vertical extent.
    """
    if "start_x" in cyl.columns:
        length = geometry.distance3(*[F.col(f"end_{a}") - F.col(f"start_{a}") for a in "xyz"])
    else:
        length = F.abs(F.col("end_z") - F.col("start_z"))
    volume, surface = geometry.cylinder(length, F.col("radius"))
    return cyl.withColumns({"length_m": length, "volume_m3": volume, "surface_m2": surface})


def qsm_summary(cyl: DataFrame, key: str = "tree_id") -> DataFrame:
    """Totals per tree: wood volume, surface, height, order, count, diameter at breast height."""
    at_breast = (F.col("start_z") <= 1.4) & (F.col("end_z") >= 1.2) & (F.col("branch_order") <= 1)
    geo = cylinder_geometry(cyl).withColumn("_bh", F.when(at_breast, F.col("radius")))
    out = percentiles_by(geo, [key], {"_r": ("_bh", 0.5)}, [
        (F.sum("volume_m3") * 1000).alias("volume_l"), F.sum("surface_m2").alias("surface_m2"),
        (F.max("end_z") - F.min("start_z")).alias("height_m"), F.max("branch_order").alias("max_order"),
        F.count(F.lit(1)).alias("n_cylinders")])
    return out.withColumn("dbh_cm", F.col("_r") * 200).drop("_r")


def qsm_by_order(cyl: DataFrame, key: str = "tree_id") -> DataFrame:
    """Volume and count per branching order, with the tree total as order null."""
    return cylinder_geometry(cyl).rollup(key, "branch_order").agg(
        (F.sum("volume_m3") * 1000).alias("volume_l"), F.count(F.lit(1)).alias("n_cylinders"),
        F.grouping(key).alias("_g")).where("_g = 0").drop("_g")


def attach_qsm(trees: DataFrame, qsm: DataFrame, key: str = "tree_id", tolerance: float = 0.25) -> DataFrame:
    """Add cylinder model figures to trees; zeros count as missing.

    The model diameter is kept only when it agrees with the fitted one.
    """
    side = qsm.select(key, *[F.nullif(F.col(c), F.lit(0)).alias(f"qsm_{c}") for c in ("volume_l", "surface_m2", "max_order", "n_cylinders")],
                      F.nullif(F.col("dbh_cm"), F.lit(0.0)).alias("_q"))
    out = trees.join(side, key, "left")
    agrees = F.try_divide(F.abs(F.col("_q") - F.col("dbh_cm")), F.col("dbh_cm")) <= tolerance
    return out.withColumn("qsm_dbh_cm", F.when(agrees, F.col("_q"))).drop("_q")


def cylinders_to_world(cyl: DataFrame, offsets: DataFrame, key: str = "tree_id") -> DataFrame:
    """Local cylinder coordinates to world coordinates; ``offsets``: ``key, off_x, off_y, off_z``."""
    out = salted_join(cyl, offsets, [key])
    return out.withColumns({f"{e}_{a}": F.col(f"{e}_{a}") + F.col(f"off_{a}") for e in ("start", "end") for a in "xyz"}).drop(
        "off_x", "off_y", "off_z")


def splat_decode(splats: DataFrame) -> DataFrame:
    """Opacity, radii in metres and 8-bit colour of stored splats."""
    return splats.withColumns({
        "alpha": colour.splat_opacity(F.col("opacity")),
        **{f"radius_{i}": F.exp(f"scale_{i}") for i in range(3)},
        **{c: F.floor(colour.splat_colour(F.col(f"f_dc_{i}")) * 255).cast("int") for i, c in enumerate("rgb")}})


def splat_clean(splats: DataFrame, keep: float = 0.96, max_scale: float = 0.6, min_opacity: float = 0.12) -> DataFrame:
    """Drop splats far from the median position, too large or too faint."""
    med = percentiles_by(splats, [], {f"_m{a}": (a, 0.5) for a in "xyz"})
    dist = geometry.distance3(*[F.col(a) - F.col(f"_m{a}") for a in "xyz"])
    far = splats.crossJoin(F.broadcast(med)).withColumn("_d", dist).drop("_mx", "_my", "_mz")
    edge = percentiles_by(far, [], {"_edge": ("_d", keep)})
    size = F.greatest(*[F.exp(f"scale_{i}") for i in range(3)])
    return far.crossJoin(F.broadcast(edge)).where(
        (F.col("_d") <= F.col("_edge")) & (size <= max_scale) & (colour.splat_opacity(F.col("opacity")) >= min_opacity)).drop("_d", "_edge")


def points_to_splats(points: DataFrame, size: float = 0.03, logit: float = 8.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round opaque splats from coloured points, behind the columns to ``keep``."""
    fixed = {"nx": 0.0, "ny": 0.0, "nz": 0.0, "opacity": logit, "scale_0": float(np.log(size)), "scale_1": float(np.log(size)),
             "scale_2": float(np.log(size)), "rot_0": 1.0, "rot_1": 0.0, "rot_2": 0.0, "rot_3": 0.0}
    cols = {f"f_dc_{i}": colour.splat_coefficient(F.col(c)) for i, c in enumerate("rgb")}
    return points.select(*keep, "x", "y", "z", *[F.lit(fixed[n]).alias(n) for n in ("nx", "ny", "nz")],
                         *[v.alias(k) for k, v in cols.items()],
                         *[F.lit(fixed[n]).alias(n) for n in list(fixed)[3:]])


def splat_frame(splats: DataFrame) -> DataFrame:
    """Robust box (2nd-98th percentile) and median focus."""
    specs = {}
    for a in "xyz":
        specs |= {f"lo_{a}": (a, 0.02), f"hi_{a}": (a, 0.98), f"focus_{a}": (a, 0.5)}
    return percentiles_by(splats, [], specs)


def up_axis(splats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Normal of the dominant plane per group; its sign follows the longer tail of the projections."""
    keys = keys or []
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    moments = splats.groupBy(*keys).agg(*[F.avg(a).alias(f"_m{a}") for a in "xyz"], *[F.covar_samp(a, b).alias(f"_{a}{b}") for a, b in pairs])
    axis = geometry.smallest_axis(*[F.col(f"_{a}{b}") for a, b in pairs])
    axes = cut_lineage(moments.where(F.col("_xx").isNotNull()).select(*keys, "_mx", "_my", "_mz", axis.alias("_axis")))
    # a row per group
    joined = salted_join(splats, broadcast_if_small(axes), keys) if keys else splats.crossJoin(F.broadcast(axes))
    dot = sum(((F.col(a) - F.col(f"_m{a}")) * F.col("_axis")[i] for i, a in enumerate("xyz")), F.lit(0.0))
    tail = percentiles_by(joined.select(*keys, dot.alias("_p")), keys, {"_med": ("_p", 0.5)}, [F.avg("_p").alias("_mean")])
    sign = F.when(F.col("_mean") < F.col("_med"), -1.0).otherwise(1.0)
    placed = axes.join(tail, keys) if keys else axes.crossJoin(F.broadcast(tail))
    return placed.select(*keys, *[(sign * F.col("_axis")[i]).alias(f"up_{a}") for i, a in enumerate("xyz")])
