"""Figures of already separated trees: base, height, stem position and diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.operators.circles import fit_circles, moments, residuals, solve
from canopyframe.ranking import percentiles_by, plain_percentiles
from canopyframe.runtime import GROUP_LIMIT, broadcast_if_small, cut_lineage, salted_join
from canopyframe.spatial import cell

WOOD = 0
LEAF = 1


def with_base(points: DataFrame, key: str, share: float = 0.01, limit: int | None = None) -> DataFrame:
    """Add ``base_z``, the low z percentile of each tree, and ``rel_z`` above it."""
    base = percentiles_by(points, [key], {"base_z": ("z", share)}, limit=limit)
    return salted_join(points, base, [key]).withColumn("rel_z", F.col("z") - F.col("base_z"))


def single_tree_metrics(points: DataFrame, key: str = "label", band: tuple[float, float] = (1.0, 1.6),
                        min_points: int = 30, radius_range: tuple[float, float] = (0.02, 0.8),
                        rms_max: float = 0.05, base_share: float = 0.01) -> DataFrame:
    """Per tree: slice centre, base, height, diameter from the slice, leaf share, point count.

    The centre is the mean of the slice, or of all points when the slice is empty.
    """
    rel = with_base(points, key, base_share)
    in_band = F.col("rel_z").between(*band)
    totals = rel.groupBy(key).agg(
        F.max("base_z").alias("base_z"), F.max("rel_z").alias("height_m"), F.count(F.lit(1)).alias("n_points"),
        (F.avg((F.col("class") == LEAF).cast("double")) * 100).alias("leaf_share_pct"),
        F.coalesce(F.avg(F.when(in_band, F.col("x"))), F.avg("x")).alias("x"),
        F.coalesce(F.avg(F.when(in_band, F.col("y"))), F.avg("y")).alias("y"),
        F.count_if(in_band).alias("n_slice"))
    fits = fit_circles(rel.where(in_band), [key]).select(key, "radius_m", "fit_rms_m")
    ok = ((F.col("n_slice") >= min_points) & F.col("radius_m").between(*radius_range)
          & (F.col("fit_rms_m") <= rms_max))
    return (totals.join(fits, key, "left")
            .withColumn("dbh_cm", F.when(ok, F.col("radius_m") * 200))
            .drop("radius_m", "fit_rms_m", "n_slice"))


def trunk_center(slice_points: DataFrame, key: str = "label", step: float = 0.25) -> DataFrame:
    """Mean position of the densest cell of each tree's slice; ties go to the lowest cell."""
    counts = slice_points.groupBy(key, cell("x", step).alias("kx"), cell("y", step).alias("ky")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    best = counts.groupBy(key).agg(F.min(F.struct(-F.col("n"), "kx", "ky", "cx", "cy")).alias("b"))
    return best.select(key, F.col("b.cx").alias("x"), F.col("b.cy").alias("y"), (-F.col("b.col1")).alias("n_cell"))


def gated_fit(slice_points: DataFrame, key: str = "label", rounds: int = 6, min_points: int = 40,
              first_gate: float = 0.9, gate_factor: float = 1.35, gate_min: float = 0.12) -> DataFrame:
    """Circle fit that narrows its capture radius round by round, for all trees at once.

    Starts at the densest cell. A tree stops when fewer than ``min_points`` are
    captured or no circle exists and keeps its last fit. Output per tree:
    ``x, y, radius_m, fit_rms_m, arc_deg, rounds_done``; trees that never fit
    keep the start position with null figures.
    """
    slice_points = cut_lineage(slice_points.select(key, "x", "y"))
    total = slice_points.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    state = (trunk_center(slice_points, key).join(total.where(F.col("_all") >= min_points), key, "left_semi")
             .select(key, F.col("x").alias("cx"), F.col("y").alias("cy"), F.lit(float(first_gate)).alias("gate"),
                     F.lit(None).cast("double").alias("px"), F.lit(None).cast("double").alias("py"),
                     F.lit(None).cast("double").alias("pgate"), F.lit(None).cast("double").alias("radius_m"),
                     F.lit(0).alias("rounds_done"), F.lit(True).alias("active")))
    state = cut_lineage(state)
    pts = slice_points
    for _ in range(rounds):
        side = broadcast_if_small(state.where("active").select(key, "cx", "cy", "gate"))
        near = salted_join(pts, side, [key]).where(
            F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= F.col("gate"))
        sums = near.groupBy(key, "cx", "cy").agg(*moments(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")),
                                                 F.count(F.lit(1)).alias("_near"))
        fit = solve(sums, F.col("cx"), F.col("cy")).select(key, "_near", "fit_x", "fit_y", F.col("radius_m").alias("_r"))
        ok = F.col("active") & (F.coalesce(F.col("_near"), F.lit(0)) >= min_points) & F.col("_r").isNotNull()
        joined = state.join(fit, key, "left").withColumn("_ok", F.coalesce(ok, F.lit(False)))
        good = F.col("_ok")
        state = cut_lineage(joined.select(
            key,
            F.when(good, F.col("fit_x")).otherwise(F.col("cx")).alias("cx"),
            F.when(good, F.col("fit_y")).otherwise(F.col("cy")).alias("cy"),
            F.when(good, F.greatest(F.col("_r") * gate_factor, F.lit(gate_min))).otherwise(F.col("gate")).alias("gate"),
            F.when(good, F.col("cx")).otherwise(F.col("px")).alias("px"),
            F.when(good, F.col("cy")).otherwise(F.col("py")).alias("py"),
            F.when(good, F.col("gate")).otherwise(F.col("pgate")).alias("pgate"),
            F.when(good, F.col("_r")).otherwise(F.col("radius_m")).alias("radius_m"),
            (F.col("rounds_done") + good.cast("int")).alias("rounds_done"), good.alias("active")))
        if not state.where("active").take(1):
            break
    # residuals belong to the points captured by the last successful round
    last = salted_join(pts, broadcast_if_small(
        state.select(key, "px", "py", "pgate", "radius_m", F.col("cx").alias("fit_x"), F.col("cy").alias("fit_y"))), [key])
    last = last.where(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= F.col("pgate"))
    quality = last.groupBy(key).agg(*residuals(F.col("x"), F.col("y")))
    return state.join(quality, key, "left").select(
        key, F.col("cx").alias("x"), F.col("cy").alias("y"), "radius_m", "fit_rms_m", "arc_deg", "rounds_done")


def classified_tree_metrics(points: DataFrame, key: str = "label") -> DataFrame:
    """Height and diameter of leaf/wood classified trees; the diameter uses wood points only."""
    rel = with_base(points, key)
    totals = rel.groupBy(key).agg(
        F.max("base_z").alias("base_z"), F.max("rel_z").alias("height_m"), F.avg("x").alias("mean_x"),
        F.avg("y").alias("mean_y"), F.count(F.lit(1)).alias("n_points"),
        (F.avg((F.col("class") == LEAF).cast("double")) * 100).alias("leaf_share_pct"))
    fits = gated_fit(rel.where(F.col("rel_z").between(1.2, 1.4) & (F.col("class") == WOOD)), key)
    fits = fits.select(key, "x", "y", "radius_m", "fit_rms_m", "arc_deg")
    ok = F.col("radius_m").between(0.02, 1.2) & (F.col("fit_rms_m") <= 0.03) & (F.col("arc_deg") >= 180)
    return totals.join(fits, key, "left").select(
        key, F.when(F.col("radius_m").isNotNull(), F.col("x")).otherwise(F.col("mean_x")).alias("x"),
        F.when(F.col("radius_m").isNotNull(), F.col("y")).otherwise(F.col("mean_y")).alias("y"),
        "base_z", "height_m", F.when(ok, F.col("radius_m") * 200).alias("dbh_cm"), "leaf_share_pct", "n_points")


def reference_positions(points: DataFrame, key: str = "label", ignore: tuple[int, ...] = (-100, 0),
                        min_points: int = 40, band: tuple[float, float] = (0.3, 1.8), limit: int | None = None) -> DataFrame:
    """Ground-truth stem positions: median of the foot band, or of all points if it holds under three.

    Trees above ``limit`` points are answered without holding one in a task.
    """
    limit = GROUP_LIMIT if limit is None else limit
    wanted = points.where(~F.col(key).isin(*ignore)).select(key, "x", "y", "z")
    sizes = wanted.groupBy(key).agg(F.count(F.lit(1)).alias("n_points")).where(F.col("n_points") > limit)
    if not sizes.take(1):
        return _positions(_window_base(wanted, key), key, min_points, band)
    hot = broadcast_if_small(cut_lineage(sizes))
    cold = _positions(_window_base(salted_join(wanted, hot.select(key), [key], "left_anti"), key), key, min_points, band)
    large = with_base(salted_join(wanted, hot, [key]), key, 0.02, limit)
    return cold.unionByName(_positions(large, key, min_points, band, limit))


def _window_base(points: DataFrame, key: str) -> DataFrame:
    """Points with ``n_points`` and ``rel_z`` of their tree; they move once, as the later groups have the same key."""
    tree = Window.partitionBy(key)
    z = F.col("z").cast("double")
    return (points.withColumn("n_points", F.count(F.lit(1)).over(tree))
            .withColumn("base_z", F.percentile(F.when(~F.isnan(z), z), F.lit(0.02)).over(tree))
            .withColumn("rel_z", F.col("z") - F.col("base_z")))


def _positions(rel: DataFrame, key: str, min_points: int, band: tuple[float, float], limit: int | None = None) -> DataFrame:
    """Medians of trees whose rows have ``n_points`` and ``rel_z``; without ``limit`` each tree fits one task."""
    rel = rel.where(F.col("n_points") >= min_points)
    in_band = F.col("rel_z").between(*band)
    rel = rel.withColumn("_bx", F.when(in_band, F.col("x"))).withColumn("_by", F.when(in_band, F.col("y")))
    specs = {"band_x": ("_bx", 0.5), "band_y": ("_by", 0.5), "all_x": ("x", 0.5), "all_y": ("y", 0.5)}
    extra = [F.count("_bx").alias("_n_band"), F.max("n_points").alias("n_points")]
    med = plain_percentiles(rel, [key], specs, extra) if limit is None else percentiles_by(rel, [key], specs, extra, limit)
    use = F.col("_n_band") >= 3
    return med.select(key, F.when(use, F.col("band_x")).otherwise(F.col("all_x")).alias("x"),
                      F.when(use, F.col("band_y")).otherwise(F.col("all_y")).alias("y"), "n_points")
