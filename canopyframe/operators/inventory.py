"""Stem inventory from a point cloud, and stand figures from the stems."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.operators.circles import moments, residuals, solve
from canopyframe.operators.components import connected_components
from canopyframe.operators.ground import band_above, ground_model, merge_scans, stem_ground, tree_height
from canopyframe.operators.selection import suppress_near
from canopyframe.ranking import percentiles_by, running_total
from canopyframe.runtime import cut_lineage, salted_join
from canopyframe.spatial import cell

STEM_CELL = 0.04


@dataclass(frozen=True)
class InventoryParams:
    """Thresholds of one inventory flavour (metres unless named otherwise)."""

    ground_cell: float = 0.5
    ground_share: float = 0.02
    ground_min_points: int = 20
    band: tuple[float, float] = (1.0, 1.6)
    measure_band: tuple[float, float] = (1.05, 1.55)
    measure_min_points: int = 6
    min_points: int = 40
    radius_range: tuple[float, float] = (0.04, 0.75)
    rms_max: float = 0.03
    arc_min_deg: float = 90.0
    min_tree_height: float = 5.0
    height_inclusive: bool = True
    ground_fallback: bool = True
    suppress_dist: float = 0.6
    form_factor: float = 0.5
    #: Publish rounded values, and compare places and residuals as published when stems are suppressed.
    rounded: bool = False


#: One stationary scan.
SINGLE_SCAN = InventoryParams()
#: Plot merged from several scans.
STAND = InventoryParams(ground_share=0.05, ground_min_points=15, band=(0.7, 2.0), measure_band=(1.1, 1.5),
                        measure_min_points=8, radius_range=(0.03, 0.80), arc_min_deg=80.0,
                        min_tree_height=3.0, height_inclusive=False, ground_fallback=False,
                        suppress_dist=0.5)


def stem_cells(band: DataFrame, size: float = STEM_CELL) -> DataFrame:
    """Occupied cells of the breast-height slice with their point counts."""
    return (band.groupBy("tile_id", cell("x", size).alias("ix"), cell("y", size).alias("iy"))
            .agg(F.count(F.lit(1)).alias("n")))


def stem_clusters(band: DataFrame, min_points: int = 40, size: float = STEM_CELL) -> DataFrame:
    """Cells of each component with at least ``min_points`` points.

    Output ``tile_id, ix, iy, n, comp_x, comp_y, cluster_points``.
    """
    comps = connected_components(stem_cells(band, size))
    sizes = (comps.groupBy("tile_id", "comp_x", "comp_y").agg(F.sum("n").alias("cluster_points"))
             .where(F.col("cluster_points") >= min_points))
    return salted_join(comps, sizes, ["tile_id", "comp_x", "comp_y"])


def fit_clusters(band: DataFrame, clusters: DataFrame, p: InventoryParams, size: float = STEM_CELL) -> DataFrame:
    """Circle per cluster, from the measuring band where it holds enough points."""
    keyed = band.withColumn("ix", cell("x", size)).withColumn("iy", cell("y", size))
    keys = ["tile_id", "comp_x", "comp_y"]
    pts = salted_join(keyed, clusters.select("tile_id", "ix", "iy", "comp_x", "comp_y"), ["tile_id", "ix", "iy"])
    # read for the figures and for the fit
    pts = cut_lineage(pts.select(*keys, "x", "y", (F.col("z") - F.col("hag")).alias("_ground"),
                                 F.col("hag").between(*p.measure_band).alias("_narrow")))
    # points of a cluster stand on few grounds, so equal ones are counted first
    grounds = pts.groupBy(*keys, "_ground").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_narrow").alias("_k"))
    info = grounds.groupBy(*keys).agg(F.sum("_n").alias("n_points"), F.sum("_k").alias("_n_narrow"),
                                      F.percentile("_ground", F.lit(0.5), F.col("_n")).alias("cluster_ground"))
    info = info.withColumn("narrow_fit", F.col("_n_narrow") >= p.measure_min_points).drop("_n_narrow")
    used = cut_lineage(salted_join(pts, info, keys).where(~F.col("narrow_fit") | F.col("_narrow")))
    group = [*keys, "n_points", "cluster_ground"]
    # the component id is a cell of the cluster, which makes it a free local origin
    ref_x, ref_y = F.col("comp_x") * F.lit(size), F.col("comp_y") * F.lit(size)
    sums = used.groupBy(*group).agg(*moments(F.col("x") - ref_x, F.col("y") - ref_y))
    # one row per cluster; cut here so that later filters are not inlined into the long solution
    fits = cut_lineage(solve(sums, ref_x, ref_y).select(*keys, "fit_x", "fit_y", "radius_m"))
    checked = salted_join(used.select(*group, "x", "y"), fits, keys)
    return checked.groupBy(*group, "fit_x", "fit_y", "radius_m").agg(*residuals(F.col("x"), F.col("y")))


def plausible(fits: DataFrame, p: InventoryParams) -> DataFrame:
    """Fits whose radius, residual and arc fall into the accepted ranges."""
    return fits.where(F.col("radius_m").between(*p.radius_range) & (F.col("fit_rms_m") <= p.rms_max)
                      & (F.col("arc_deg") >= p.arc_min_deg))


def tree_attributes(trees: DataFrame, p: InventoryParams = SINGLE_SCAN) -> DataFrame:
    """DBH, basal area, height, volume and slenderness; height counts only where it is credible."""
    observed = F.col("top_z") - F.col("ground")
    valid = observed >= p.min_tree_height if p.height_inclusive else observed > p.min_tree_height
    area = F.lit(math.pi) * F.col("radius_m") * F.col("radius_m")
    dbh = F.col("radius_m") * 200.0
    return (trees.withColumn("dbh_cm", dbh).withColumn("basal_area_m2", area)
            .withColumn("height_m", F.when(valid, observed))
            .withColumn("observed_height_m", F.when(~valid, observed))
            .withColumn("volume_m3", F.when(valid, area * observed * F.lit(p.form_factor)))
            .withColumn("slenderness", F.when(valid & (dbh > 0), observed * 100.0 / dbh)))


def crown_radius(dbh: Column) -> Column:
    """Crown radius estimate in metres; a missing or zero diameter counts as 20 cm."""
    return F.least(F.greatest(F.lit(0.6) + F.lit(0.06) * F.coalesce(F.nullif(dbh, F.lit(0.0)), F.lit(20.0)),
                              F.lit(1.5)), F.lit(4.0))


def label_trees(trees: DataFrame, keys: list[str], order: list[Column], prefix: str, digits: int,
                name: str = "label") -> DataFrame:
    """Running label per group, for example ``Tree 01``, in the given total order."""
    numbered = running_total(trees, keys, order, None, "_no")
    text = F.col("_no").cast("string")
    padded = F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))
    return numbered.withColumn(name, F.concat(F.lit(prefix), padded)).drop("_no")


#: Decimal places of published tree values.
PLACES = {"x": 3, "y": 3, "z": 3, "dbh_cm": 1, "basal_area_m2": 4, "height_m": 1, "observed_height_m": 1, "volume_m3": 3, "slenderness": 1, "fit_rms_cm": 1}


def round_tree_values(trees: DataFrame) -> DataFrame:
    """Tree values as they are published; stand figures of the result are those of the published list."""
    return trees.withColumns({c: F.round(c, n) for c, n in PLACES.items() if c in trees.columns})


def detect_stems(points: DataFrame, p: InventoryParams = SINGLE_SCAN) -> DataFrame:
    """Stems of a cloud with attributes, before labelling.

    Input ``tile_id, point_idx, x, y, z``. Tiles are independent clouds.
    """
    ground = cut_lineage(ground_model(points, p.ground_cell, p.ground_share, p.ground_min_points))
    band = band_above(points.select("tile_id", "point_idx", "x", "y", "z"), ground, *p.band, size=p.ground_cell)
    band = cut_lineage(band.select("tile_id", "point_idx", "x", "y", "z", "hag"))
    clusters = stem_clusters(band, p.min_points)
    stems = plausible(fit_clusters(band, clusters, p), p)
    stems = stems.withColumnRenamed("fit_x", "x").withColumnRenamed("fit_y", "y")
    stems = stem_ground(stems, ground, p.ground_cell, "cluster_ground" if p.ground_fallback else None)
    stems = cut_lineage(stems.withColumn("stem_id", F.struct("tile_id", "comp_x", "comp_y")))
    if p.rounded:
        stems = cut_lineage(stems.withColumns({"x": F.round("x", 3), "y": F.round("y", 3), "fit_rms_m": F.round("fit_rms_m", 3)}))
    kept = suppress_near(stems, p.suppress_dist,
                         [-F.col("n_points"), F.col("fit_rms_m"), F.col("comp_x"), F.col("comp_y")], ("tile_id",))
    return tree_attributes(tree_height(points, cut_lineage(kept)), p)


def stem_inventory(points: DataFrame, p: InventoryParams = SINGLE_SCAN, prefix: str = "Tree ",
                   digits: int = 2) -> DataFrame:
    """Raw points to the labelled stem table of each tile, thickest stem first."""
    stems = detect_stems(points, p)
    if p.rounded:
        stems = round_tree_values(stems)
    labelled = label_trees(stems, ["tile_id"], [F.col("dbh_cm").desc(), F.col("comp_x"), F.col("comp_y")],
                           prefix, digits)
    out = labelled.select("tile_id", "label", "x", "y", (F.col("ground") + 1.3).alias("z"), "dbh_cm",
                          "basal_area_m2", "height_m", "volume_m3", "observed_height_m", "slenderness",
                          (F.col("fit_rms_m") * 100).alias("fit_rms_cm"), "arc_deg", "n_points")
    return round_tree_values(out) if p.rounded else out


def stand_summary(trees: DataFrame, area_ha: float, keys: list[str]) -> DataFrame:
    """Stem count, basal area, diameters, heights, stock and density index of each stand.

    Needs ``dbh_cm, basal_area_m2, height_m, volume_m3, slenderness``; missing
    heights and volumes are left out of their means and sums.
    """
    area = F.lit(float(area_ha))
    out = trees.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_stems"), F.sum("basal_area_m2").alias("basal_area_m2"),
        F.avg("dbh_cm").alias("dbh_mean_cm"), F.sqrt(F.avg(F.col("dbh_cm") * F.col("dbh_cm"))).alias("dg_cm"),
        F.min("dbh_cm").alias("dbh_min_cm"), F.max("dbh_cm").alias("dbh_max_cm"),
        F.avg("height_m").alias("height_mean_m"), F.sum("volume_m3").alias("stock_m3"),
        F.avg("slenderness").alias("slenderness_mean"), F.stddev_pop("dbh_cm").alias("dbh_sd_cm"),
        F.count("height_m").alias("n_heights"))
    return (out.withColumn("stems_per_ha", F.col("n_stems") / area)
            .withColumn("basal_area_m2_ha", F.col("basal_area_m2") / area)
            .withColumn("stock_m3_ha", F.col("stock_m3") / area)
            .withColumn("sdi", F.col("n_stems") / area * F.pow(F.col("dg_cm") / 25.0, F.lit(1.605)))
            .withColumn("structure", F.when(F.col("dbh_sd_cm") < 10, "single-layered").otherwise("multi-layered")))


def dbh_histogram(trees: DataFrame, keys: list[str], width: int = 10) -> DataFrame:
    """Diameter classes from 0 to the largest diameter, empty classes included.

    Classes are half-open except that a diameter equal to the top edge joins the last class.
    """
    tops = trees.groupBy(*keys).agg(F.max("dbh_cm").alias("_max"))
    n_bins = F.greatest(F.ceil(F.col("_max") / F.lit(float(width))), F.lit(1)).cast("bigint")
    frame = tops.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), n_bins - 1)).alias("bin"))
    # the largest diameter sits on the top edge only when it is a multiple of the width
    counted = trees.groupBy(*keys, F.floor(F.col("dbh_cm") / F.lit(float(width))).cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("_c"))
    edge = tops.where((F.col("_max") > 0) & (F.col("_max") % F.lit(float(width)) == 0)).select(
        *keys, (F.col("_max") / F.lit(float(width))).cast("bigint").alias("bin"), F.lit(1).alias("_edge"))
    counted = (counted.join(edge, [*keys, "bin"], "left")
               .withColumn("bin", F.col("bin") - F.coalesce("_edge", F.lit(0)))
               .groupBy(*keys, "bin").agg(F.sum("_c").alias("_c")))
    return (frame.join(counted, [*keys, "bin"], "left")
            .select(*keys, (F.col("bin") * width).alias("lower_cm"), ((F.col("bin") + 1) * width).alias("upper_cm"),
                    F.coalesce("_c", F.lit(0)).alias("n_stems")))


def top_height(trees: DataFrame, area_ha: float, keys: list[str], by: str = "height_m") -> DataFrame:
    """Mean height of the 100 tallest (or with ``by='dbh_cm'`` thickest) trees per hectare."""
    n_top = max(1, round(100 * area_ha))
    ranked = trees.where(F.col("height_m").isNotNull())
    # aggregate equal values first: only distinct heights are ranked
    freq = ranked.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_c"), F.sum("height_m").alias("_h"))
    freq = running_total(freq, keys, [F.col(by).desc()], F.col("_c"), "_upto")
    take = F.least(F.col("_c"), F.lit(n_top) - (F.col("_upto") - F.col("_c")))
    used = freq.where(take > 0)
    return used.groupBy(*keys).agg((F.sum(F.col("_h") / F.col("_c") * take) / F.sum(take)).alias("top_height_m"),
                                   F.sum(take).cast("bigint").alias("n_used"))


def local_frame(points: DataFrame, keys: list[str], base_share: float | None = 0.01) -> DataFrame:
    """Shift every tree to its foot: mean x, mean y and a low (or the lowest) z."""
    extra = [F.avg("x").alias("foot_x"), F.avg("y").alias("foot_y")]
    if base_share is None:
        feet = points.groupBy(*keys).agg(*extra, F.min("z").alias("foot_z"))
    else:
        feet = percentiles_by(points, keys, {"foot_z": ("z", base_share)}, extra)
    return salted_join(points, feet, keys).withColumns({
        "lx": F.col("x") - F.col("foot_x"), "ly": F.col("y") - F.col("foot_y"), "lz": F.col("z") - F.col("foot_z")})


def scene_origin(places: DataFrame, keys: list[str]) -> DataFrame:
    """Common origin of several feet: mean x, mean y, lowest z."""
    return places.groupBy(*keys).agg(F.avg("foot_x").alias("origin_x"), F.avg("foot_y").alias("origin_y"),
                                     F.min("foot_z").alias("origin_z"))


def plot_center(origins: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean position of the scanner set-ups ``tx, ty``."""
    return origins.groupBy(*(keys or [])).agg(F.avg("tx").alias("center_x"), F.avg("ty").alias("center_y"))


def plot_inventory(scans: list[DataFrame], center: tuple[float, float], plot_radius: float = 15.0,
                   p: InventoryParams = STAND) -> DataFrame:
    """Stems of a circular plot from several registered scans.

    The clouds are cut with a 3 m margin, stems outside the plot are dropped.
    """
    plot = cut_lineage(merge_scans(scans, *center, plot_radius))  # a small cut of the scans that later steps read often
    stems = detect_stems(plot, p)
    return stems.where(F.hypot(F.col("x") - center[0], F.col("y") - center[1]) <= plot_radius)


def plot_area_ha(plot_radius: float) -> float:
    return math.pi * plot_radius ** 2 / 10_000
