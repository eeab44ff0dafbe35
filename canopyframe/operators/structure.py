"""Canopy height, hedge extraction, vertical structure, composite index and habitat suitability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.dims import INDEX_WEIGHTS, INFRASTRUCTURE_CLASSES
from canopyframe.operators.components import connected_components
from canopyframe.ranking import percentiles_by, running_total
from canopyframe.runtime import broadcast_if_small, cut_lineage, salted_join
from canopyframe.spatial import cell

CHM_CELL = 0.5


def drop_infrastructure(points: DataFrame, low: float = -0.5, high: float = 40.0) -> DataFrame:
    """Remove buildings, water and other structures and implausible heights."""
    return points.where(~F.col("class").isin(*INFRASTRUCTURE_CLASSES) & (F.col("hag") >= low) & (F.col("hag") < high))


def canopy_height(points: DataFrame, size: float = CHM_CELL) -> DataFrame:
    """Highest point per cell: ``tile_id, ix, iy, height``."""
    return points.groupBy("tile_id", cell("x", size).alias("ix"), cell("y", size).alias("iy")).agg(
        F.max("hag").alias("height"))


def hedge_segments(chm: DataFrame, size: float = CHM_CELL, h_min: float = 1.0, h_max: float = 8.0,
                   max_half_width: float = 4.0, min_area: float = 60.0, seg_len: float = 20.0) -> DataFrame:
    """Narrow vegetation strips of the height model, cut by a coarse grid into segments.

    Strips are edge-connected cells with height in ``(h_min, h_max]``. Area
    over perimeter (holes included) must not exceed ``max_half_width``. The
    network is cut by a grid anchored at its corner and connected pieces of at
    least half the minimum area remain. Output one row per cell:
    ``tile_id, ix, iy, hedge_id, area_m2``.
    """
    mask = cut_lineage(chm.where((F.col("height") > h_min) & (F.col("height") <= h_max)).select("tile_id", "ix", "iy"))
    strips = connected_components(mask, 4)
    shape = strip_shapes(strips, size)
    good = shape.where((F.col("area_m2") >= min_area) & (F.col("half_width_m") <= max_half_width))
    net = salted_join(strips, good.select("tile_id", "comp_x", "comp_y"), ["tile_id", "comp_x", "comp_y"], "left_semi")
    net = cut_lineage(net)
    corner = net.groupBy("tile_id").agg(F.min("ix").alias("x0"), F.min("iy").alias("y0"))
    step = int(round(seg_len / size))
    gridded = salted_join(net, corner, ["tile_id"]).select(
        "tile_id", "ix", "iy", "comp_x", "comp_y", F.floor((F.col("ix") - F.col("x0")) / step).alias("sx"),
        F.floor((F.col("iy") - F.col("y0")) / step).alias("sy"))
    pieces = connected_components(gridded.select("tile_id", "sx", "sy", "ix", "iy"), 4, ("tile_id", "sx", "sy"))
    keys = ["tile_id", "sx", "sy", "comp_x", "comp_y"]
    areas = pieces.groupBy(*keys).agg((F.count(F.lit(1)) * (size * size)).alias("area_m2")).where(
        F.col("area_m2") >= min_area / 2)
    areas = running_total(cut_lineage(areas), ["tile_id"], [F.col(k) for k in keys[1:]], None, "hedge_id")
    return salted_join(pieces, areas, keys).select("tile_id", "ix", "iy", "hedge_id", "area_m2")


def strip_shapes(strips: DataFrame, size: float = CHM_CELL) -> DataFrame:
    """Area, perimeter and half width (area over perimeter) of each component of cells."""
    sides = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    around = strips.select("tile_id", "ix", "iy").withColumn("_s", F.explode(sides)).select(
        "tile_id", (F.col("ix") + F.col("_s.dx")).alias("ix"), (F.col("iy") + F.col("_s.dy")).alias("iy"))
    closed = around.groupBy("tile_id", "ix", "iy").agg(F.count(F.lit(1)).alias("_closed"))
    cells = strips.join(closed, ["tile_id", "ix", "iy"], "left")
    keys = ["tile_id", "comp_x", "comp_y"]
    out = cells.groupBy(*keys).agg((F.count(F.lit(1)) * (size * size)).alias("area_m2"),
                                   (F.sum(4 - F.coalesce("_closed", F.lit(0))) * size).alias("perimeter_m"))
    return out.withColumn("half_width_m", F.col("area_m2") / F.greatest(F.col("perimeter_m"), F.lit(1e-6)))


def network_stats(shapes: DataFrame, min_area: float = 60.0, max_half_width: float = 4.0) -> DataFrame:
    """Number of strips, total area and typical strip width."""
    good = shapes.where((F.col("area_m2") >= min_area) & (F.col("half_width_m") <= max_half_width))
    return percentiles_by(good, [], {"_half": ("half_width_m", 0.5)},
                          [F.count(F.lit(1)).alias("n_parts"), F.sum("area_m2").alias("area_m2")]).select(
        "n_parts", "area_m2", (F.col("_half") * 2).alias("strip_width_m"))


def point_segments(points: DataFrame, cells: DataFrame, size: float = CHM_CELL) -> DataFrame:
    """Segment id of each point by raster cell, 0 outside."""
    keyed = points.withColumn("ix", cell("x", size)).withColumn("iy", cell("y", size))
    out = salted_join(keyed, cells.select("tile_id", "ix", "iy", "hedge_id"), ["tile_id", "ix", "iy"], "left")
    return out.withColumn("seg_id", F.coalesce("hedge_id", F.lit(0))).drop("ix", "iy", "hedge_id")


def _segment_keys(df: DataFrame, seg: str) -> list[str]:
    return [k for k in ("tile_id", seg) if k in df.columns]


def segment_structure(points: DataFrame, seg: str = "seg_id", layer_m: float = 0.5, canopy_min: float = 1.0,
                      size: float = CHM_CELL) -> DataFrame:
    """Vertical structure per segment from points with ``hag`` and a segment id.

    fhd: Shannon entropy of the layer shares. vci: entropy over the log of the
    layers up to the top. n_layers: filled layers. strata_evenness: entropy over
    the log of filled layers. understory_openness: share of points under 0.5 m.
    vertical_gap: share of empty layers below the top. canopy_sd and cover_frac
    come from the highest point of each cell. All logs are natural. Segments are
    numbered per tile: with a ``tile_id`` the two together are the key.
    """
    by = _segment_keys(points, seg)
    inside = points.where((F.col(seg) > 0) & (F.col("hag") >= 0))
    # layers and raster cells are counted in one pass over the points, only the percentile needs another
    keyed = inside.select(*by, "hag", F.floor(F.col("hag") / F.lit(layer_m)).cast("int").alias("layer"),
                          cell("x", size).alias("ix"), cell("y", size).alias("iy"))
    counts = cut_lineage(keyed.groupingSets([[*by, "layer"], [*by, "ix", "iy"]], *by, "layer", "ix", "iy").agg(
        F.grouping("layer").alias("_is_cell"), F.count(F.lit(1)).alias("n"), F.max("hag").alias("h"),
        F.count_if(F.col("hag") < 0.5).alias("_low")))
    layers = counts.where(F.col("_is_cell") == 0)
    totals = layers.groupBy(*by).agg(F.sum("n").alias("total"), F.max("layer").alias("top"), F.max("h").alias("h_max"),
                                     (F.sum("_low") / F.sum("n")).alias("understory_openness"))
    p = F.col("n") / F.col("total")
    entropy = layers.join(totals, by).groupBy(*by, "total", "top", "h_max", "understory_openness").agg(
        (-F.sum(p * F.log(p))).alias("fhd"), F.count(F.lit(1)).alias("n_layers"))
    heights = percentiles_by(inside, by, {"h_p95": ("hag", 0.95)}, sizes=totals.select(*by, F.col("total").alias("_n")))
    crowns = counts.where(F.col("_is_cell") == 1).groupBy(*by).agg(
        F.stddev_samp("h").alias("canopy_sd"), F.avg((F.col("h") > canopy_min).cast("double")).alias("cover_frac"))
    n_slots = F.col("top") + 1
    return (entropy.join(heights, by).join(crowns, by)
            .select(*by, "fhd", F.coalesce(F.try_divide(F.col("fhd"), F.log(n_slots.cast("double"))), F.lit(0.0)).alias("vci"),
                    "n_layers",
                    F.coalesce(F.try_divide(F.col("fhd"), F.log(F.col("n_layers").cast("double"))), F.lit(0.0)).alias("strata_evenness"),
                    "h_p95", "h_max", "cover_frac", F.coalesce("canopy_sd", F.lit(0.0)).alias("canopy_sd"),
                    "understory_openness", (F.lit(1.0) - F.col("n_layers") / n_slots).alias("vertical_gap")))


def zonal_mean(zones: DataFrame, raster: DataFrame, name: str, zone_size: float, raster_size: float,
               origin: tuple[float, float] = (0.0, 0.0), seg: str = "seg_id") -> DataFrame:
    """Mean raster value per segment, every raster cell weighted by the area that it shares with the segment.

    ``zones`` has the distinct square cells ``ix, iy`` of side ``zone_size`` of each segment; ``raster`` has
    ``ix, iy, value`` on cells of side ``raster_size`` that begin at ``origin``. Both may have a ``tile_id``, and
    if both do it is part of the key. Cells without value count neither in the mean nor in
    ``covered``, the share of the segment's area that has values. A segment that meets none has a null mean.
    """
    by = _segment_keys(zones, seg)
    cell_keys = [k for k in ("tile_id",) if k in zones.columns and k in raster.columns]
    out = zones
    for axis, start in zip("xy", origin):
        low = F.col(f"i{axis}") * F.lit(float(zone_size))
        first = F.floor((low - start) / raster_size).cast("bigint")
        last = F.floor((low + zone_size - start) / raster_size).cast("bigint")
        out = out.withColumn(f"_low{axis}", low).withColumn(f"_c{axis}", F.explode(F.sequence(first, last)))
        edge = F.col(f"_c{axis}") * F.lit(float(raster_size)) + F.lit(float(start))
        shared = F.least(F.col(f"_low{axis}") + zone_size, edge + raster_size) - F.greatest(F.col(f"_low{axis}"), edge)
        out = out.withColumn(f"_w{axis}", F.greatest(shared, F.lit(0.0)))
    # cells of a segment in the same raster cell are one row before anything is joined
    shares = out.groupBy(*by, F.col("_cx").alias("ix"), F.col("_cy").alias("iy")).agg(F.sum(F.col("_wx") * F.col("_wy")).alias("_w"))
    joined = shares.join(raster.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*cell_keys, "ix", "iy", "value"), [*cell_keys, "ix", "iy"], "left")
    known = F.when(F.col("value").isNotNull(), F.col("_w"))
    return joined.groupBy(*by).agg(F.try_divide(F.sum(F.col("_w") * F.col("value")), F.sum(known)).alias(name),
                                   (F.coalesce(F.sum(known), F.lit(0.0)) / F.sum("_w")).alias("covered"))


def with_zonal(metrics: DataFrame, zonal: DataFrame, name: str, seg: str = "seg_id") -> DataFrame:
    """Metrics with one more figure per segment, null where it is unknown."""
    by = _segment_keys(metrics, seg)
    return metrics.join(zonal.select(*by, name), by, "left")


#: Metrics that make up each sub-index; a leading minus turns the scale around.
SUB_INDICES = {
    "vertical_complexity": ("fhd", "vci", "n_layers", "strata_evenness"),
    "volume_size": ("h_p95", "cover_frac"),
    "heterogeneity": ("canopy_sd", "understory_openness", "-vertical_gap"),
    "condition": ("ndvi",),
}


def composite_index(metrics: DataFrame, parts: dict[str, tuple[str, ...]] | None = None,
                    weights: dict[str, float] | None = None) -> DataFrame:
    """Sub-indices and weighted index ``hvi``, relative to the 2nd-98th percentile of these rows.

    Sub-indices are means of rescaled metrics. Missing ones are left out and
    the remaining weights renormalised.
    """
    parts = parts or SUB_INDICES
    weights = weights or INDEX_WEIGHTS
    metrics = cut_lineage(metrics)  # one row per segment, read for the percentiles and again for the scores
    have = {n: tuple(m for m in ms if m.lstrip("-") in metrics.columns) for n, ms in parts.items()}
    used = sorted({m.lstrip("-") for ms in have.values() for m in ms})
    specs = {}
    for m in used:
        specs[f"_lo_{m}"] = (m, 0.02)
        specs[f"_hi_{m}"] = (m, 0.98)
    ends = percentiles_by(metrics, [], specs)
    out = metrics.crossJoin(F.broadcast(ends))

    def scaled(m: str) -> Column:
        name = m.lstrip("-")
        span = F.col(f"_hi_{name}") - F.col(f"_lo_{name}")
        t = F.when(span > 0, F.least(F.greatest((F.col(name) - F.col(f"_lo_{name}")) / span, F.lit(0.0)), F.lit(1.0)))
        t = F.when(F.col(name).isNotNull(), F.coalesce(t, F.lit(0.5)))
        return 1 - t if m.startswith("-") else t

    for name, ms in have.items():
        out = out.withColumn(name, _mean([scaled(m) for m in ms]) if ms else F.lit(None).cast("double"))
    total = sum((F.when(F.col(n).isNotNull(), F.lit(w)).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in weights.items()), F.lit(0.0))
    return out.withColumn("hvi", F.try_divide(value, total)).drop(*specs)


def _mean(cols: list[Column]) -> Column:
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)), n)


def fuzzy_membership(v: Column, curve: Column, p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Degree 0..1 of a value under a response curve: rising, falling, triangle or trapezoid."""
    rise = F.least(F.greatest((v - p1) / (p2 - p1), F.lit(0.0)), F.lit(1.0))
    fall3 = F.least(F.greatest((p3 - v) / (p3 - p2), F.lit(0.0)), F.lit(1.0))
    fall4 = F.least(F.greatest((p4 - v) / (p4 - p3), F.lit(0.0)), F.lit(1.0))
    return (F.when(curve == "rising", rise).when(curve == "falling", 1 - rise)
            .when(curve == "triangle", F.least(rise, fall3)).when(curve == "trapezoid", F.least(rise, fall4)))


def suitability(metrics: DataFrame, requirements: DataFrame, seg: str = "seg_id",
                metric_names: list[str] | None = None) -> DataFrame:
    """Habitat suitability per segment and species, strict (geometric) and tolerant (arithmetic).

    Metrics that are missing in a row drop out of that row and the remaining
    weights are renormalised.
    """
    by = _segment_keys(metrics, seg)
    names = metric_names or [c for c in metrics.columns if c not in by]
    pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    long = metrics.selectExpr(*by, f"stack({len(names)}, {pairs}) as (metric, value)").where(F.col("value").isNotNull())
    joined = long.join(broadcast_if_small(requirements), "metric")
    m = fuzzy_membership(F.col("value"), F.col("curve"), *[F.col(p) for p in ("p1", "p2", "p3", "p4")])
    w = F.col("weight")
    return joined.withColumn("_m", m).groupBy(*by, "species").agg(
        F.exp(F.sum(w * F.log(F.greatest("_m", F.lit(1e-6)))) / F.sum(w)).alias("strict"),
        (F.sum(w * F.col("_m")) / F.sum(w)).alias("tolerant"))


def best_species(scores: DataFrame, seg: str = "seg_id", value: str = "strict") -> DataFrame:
    """Species with the highest score per segment; ties go to the first name."""
    by = _segment_keys(scores, seg)
    return scores.groupBy(*by).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col("species").alias("s"))).alias("b")).select(
        *by, F.col("b.s").alias("species"), (-F.col("b.v")).alias(value))


def colouring_options(values: DataFrame, seg: str = "seg_id", chunk: int = 10_000) -> DataFrame:
    """Maps segment -> value per option, for switchable colouring.

    ``values`` is long: ``option, seg_id, value``. A map holds the ids of one
    ``chunk``; small scenes have a single chunk 0.
    """
    part = F.floor(F.col(seg) / chunk).cast("bigint").alias("chunk")
    tile = [k for k in ("tile_id",) if k in values.columns]
    return values.groupBy(*tile, "option", part).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(seg).cast("string"), "value")))).alias("values"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))
