"""Image statistics on pixel tables ``image_id, row, col, r, g, b``."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.functions import colour
from canopyframe.ranking import percentiles_by
from canopyframe.runtime import salted_join

RGB = ("r", "g", "b")


def _rgb() -> list[Column]:
    return [F.col(c) for c in RGB]


def decode_segments(pixels: DataFrame) -> DataFrame:
    """Segment id packed into the colour of an annotation image."""
    return pixels.withColumn("segment_id", F.col("r") + 256 * F.col("g") + 65536 * F.col("b"))


def annotate_segments(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    """Attach the category of each decoded segment; ``segments`` has ``image_id, segment_id, category``."""
    return salted_join(decode_segments(pixels), segments, ["image_id", "segment_id"])


def crop_colour_stats(pixels: DataFrame, keys: list[str], min_pixels: int = 16, vital: float = 0.02) -> DataFrame:
    """Green indices and vital share of the crown pixels of each crop."""
    r, g, b = _rgb()
    crowns = pixels.where(colour.crown(r, g, b))
    green = F.avg((colour.gli(r, g, b) >= vital).cast("double"))
    out = crowns.groupBy(*keys).agg(F.avg(colour.exg(r, g, b)).alias("exg_mean"), F.avg(colour.gli(r, g, b)).alias("gli_mean"),
                                    green.alias("green_share"), F.count(F.lit(1)).alias("n_pixels"))
    return out.where(F.col("n_pixels") >= min_pixels).withColumn("nongreen_share", 1 - F.col("green_share"))


def glcm_texture(pixels: DataFrame, keys: list[str], levels: int = 16, min_pairs: int = 32) -> DataFrame:
    """Texture of crown pixels from the symmetric co-occurrence of grey levels at distance 1."""
    r, g, b = _rgb()
    grey = F.least(F.floor((r + g + b) / F.lit(3.0) / 256 * levels), F.lit(levels - 1)).cast("int")
    q = pixels.where(colour.crown(r, g, b)).select(*keys, "row", "col", grey.alias("q"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1))])
    shifted = q.withColumn("_s", F.explode(steps)).select(
        *keys, (F.col("row") + F.col("_s.dy")).alias("row"), (F.col("col") + F.col("_s.dx")).alias("col"), F.col("q").alias("q0"))
    pairs = shifted.join(q, [*keys, "row", "col"]).groupBy(*keys, "q0", "q").agg(F.count(F.lit(1)).alias("c"))
    both = pairs.select(*keys, F.explode(F.array(F.struct(F.col("q0").alias("i"), F.col("q").alias("j")),
                                                 F.struct(F.col("q").alias("i"), F.col("q0").alias("j")))).alias("_p"), "c")
    counts = both.groupBy(*keys, F.col("_p.i").alias("i"), F.col("_p.j").alias("j")).agg(F.sum("c").alias("c"))
    i, j, c = F.col("i"), F.col("j"), F.col("c")
    diff2 = (i - j) * (i - j)
    sums = counts.groupBy(*keys).agg(
        F.sum(c).alias("t"), F.sum(i * c).alias("si"), F.sum(i * i * c).alias("sii"), F.sum(i * j * c).alias("sij"),
        F.sum(diff2 * c).alias("sd"), F.sum(c / (1 + diff2)).alias("sh"), F.sum(c * c).alias("sc"),
        F.sum(c * F.log2(c)).alias("sl")).where(F.col("t") >= min_pairs)
    t, mu = F.col("t"), F.col("si") / F.col("t")
    var = F.greatest(F.col("sii") / t - mu * mu, F.lit(0.0))
    # a flat image has no spread; the floor keeps the correlation at zero instead of undefined
    var = F.when(F.col("sii") * t == F.col("si") * F.col("si"), F.lit(1e-12)).otherwise(var)
    return sums.select(*keys, (F.col("sd") / t).alias("contrast"), (F.col("sh") / t).alias("homogeneity"),
                       (F.col("sc") / t / t).alias("energy"), (F.log2(t) - F.col("sl") / t).alias("entropy"),
                       F.when(F.col("sii") * t == F.col("si") * F.col("si"), F.lit(0.0)).otherwise(
                           (F.col("sij") / t - mu * mu) / var).alias("correlation"))


def multiview_mean(views: DataFrame, key: str, fields: list[str], view: str = "view_id") -> DataFrame:
    """Mean of each figure over all views of a marker, and the number of views."""
    return views.groupBy(key).agg(*[F.avg(f).alias(f) for f in fields], F.count(F.lit(1)).alias("n_views"))


def multiview_vote(views: DataFrame, key: str, field: str) -> DataFrame:
    """Most frequent class over all views; ties go to the smallest class."""
    votes = views.groupBy(key, field).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(field).alias("f"))).alias("b"))
    return best.select(key, F.col("b.f").alias(field), (-F.col("b.n")).alias("n_votes"))


def with_latitude(pixels: DataFrame, height: int) -> DataFrame:
    """Latitude of the pixel row of a full panorama, +90 at the top, and its area weight."""
    lat = F.lit(90.0) - (F.col("row") + 0.5) / F.lit(float(height)) * 180.0
    return pixels.withColumn("lat", lat).withColumn("weight", F.greatest(F.cos(F.radians("lat")), F.lit(0.0)))


def gap_fraction(pixels: DataFrame, height: int) -> DataFrame:
    """Area-weighted sky share of the upper hemisphere and of the whole panorama."""
    sky = colour.hemisphere_sky(*_rgb()).cast("double")
    w = F.col("weight")
    up = F.when(F.col("lat") > 0, w).otherwise(0.0)
    return with_latitude(pixels, height).groupBy("image_id").agg(
        F.try_divide(F.sum(up * sky), F.sum(up)).alias("gap_fraction"),
        F.try_divide(F.sum(w * sky), F.sum(w)).alias("sky_fraction"))


def greenness(pixels: DataFrame) -> DataFrame:
    """Mean colour indices over the pixels that are not sky."""
    r, g, b = _rgb()
    veg = ~colour.hemisphere_sky(r, g, b)
    return pixels.groupBy("image_id").agg(
        F.avg(F.when(veg, colour.vari(r, g, b))).alias("vari"), F.avg(F.when(veg, colour.gli_strict(r, g, b))).alias("gli"),
        F.avg(F.when(veg, colour.exg_strict(r, g, b))).alias("exg"))


def sun_position(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Direction of the brightest pixel (first in row order) and how clearly it stands out."""
    lum = pixels.withColumn("lum", colour.luminance(*_rgb()))
    best = percentiles_by(lum, ["image_id"], {"_med": ("lum", 0.5)}, [
        F.min(F.struct((-F.round("lum", 6)).alias("l"), F.col("row").alias("row"), F.col("col").alias("col"))).alias("p")])
    peak = -F.col("p.l")
    lon = (F.col("p.col") + 0.5) / F.lit(float(width)) * 360.0 - 180.0
    conf = F.greatest((peak - F.col("_med")) / 255.0, F.lit(0.0)) * (peak / 255.0) * 1.6
    return best.select("image_id", F.pmod(lon + 360.0, F.lit(360.0)).alias("azimuth_deg"),
                       (F.lit(90.0) - (F.col("p.row") + 0.5) / F.lit(float(height)) * 180.0).alias("elevation_deg"),
                       F.least(conf, F.lit(1.0)).alias("confidence"))


def linear_level(value: Column, gamma: float = 2.2) -> Column:
    """8-bit level after undoing the display gamma."""
    return F.floor(F.pow(value / F.lit(255.0), F.lit(gamma)) * 255.0 + 0.5).cast("int")


def otsu_threshold(pixels: DataFrame, keys: list[str], gamma: float = 2.2) -> DataFrame:
    """Level that separates a 256-level histogram best; the first of equal ones."""
    hist = pixels.groupBy(*keys, linear_level(F.col("b"), gamma).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = (hist.withColumn("_n0", F.sum("n").over(w)).withColumn("_s0", F.sum(F.col("n") * F.col("level")).over(w))
         .withColumn("_n", F.sum("n").over(whole)).withColumn("_s", F.sum(F.col("n") * F.col("level")).over(whole)))
    n0, s0, n, s = (F.col(c).cast("double") for c in ("_n0", "_s0", "_n", "_s"))
    d = F.try_divide(s0, n0) - F.try_divide(s - s0, F.nullif(n - n0, F.lit(0.0)))
    between = F.round(F.coalesce(n0 / n * (n - n0) / n * d * d, F.lit(-1.0)), 9)
    return h.withColumn("_v", between).groupBy(*keys).agg(
        F.min(F.struct((-F.col("_v")).alias("v"), F.col("level").alias("l"))).alias("b")).select(
        *keys, F.col("b.l").alias("threshold"))


def ring_gaps(pixels: DataFrame, thresholds: DataFrame, keys: list[str], side: int, max_vza: float = 90.0,
              end_vza: float = 70.0, rings: int = 7, segments: int = 8) -> DataFrame:
    """Share of sky pixels per zenith ring and azimuth segment of an equidistant fisheye."""
    half = side / 2.0
    dx, dy = F.col("col") + 0.5 - half, F.col("row") + 0.5 - half
    theta = F.hypot(dx, dy) / half * max_vza
    azimuth = F.pmod(F.degrees(F.atan2(dy, dx)) + 360.0, F.lit(360.0))
    joined = salted_join(pixels, thresholds, keys).withColumn("_t", theta).where(F.col("_t") < end_vza)
    return joined.groupBy(*keys, F.floor(F.col("_t") / (end_vza / rings)).cast("int").alias("ring"),
                          F.floor(azimuth / (360.0 / segments)).cast("int").alias("segment")).agg(
        F.avg((linear_level(F.col("b")) > F.col("threshold")).cast("double")).alias("gap"), F.count(F.lit(1)).alias("n_pixels"))


def canopy_lai(gaps: DataFrame, keys: list[str], end_vza: float = 70.0, rings: int = 7) -> DataFrame:
    """Effective and clumping-corrected leaf area, clumping index and openness from ring gaps.

    Miller's integral over the rings; the corrected value averages logarithms
    over the segments. A segment without sky counts as half a pixel of sky.
    """
    step = end_vza / rings
    floor_gap = F.greatest(F.col("gap"), F.lit(0.5) / F.col("n_pixels"))
    rows = gaps.withColumn("_g", floor_gap).groupBy(*keys, "ring").agg(
        F.avg("_g").alias("g"), (-F.avg(F.log("_g"))).alias("nl"))
    theta = F.radians((F.col("ring") + 0.5) * step)
    rows = rows.withColumn("w", F.sin(theta)).withColumn("ct", F.cos(theta))
    out = rows.groupBy(*keys).agg(
        (F.sum(-F.log("g") * F.col("ct") * F.col("w")) / F.sum("w") * 2).alias("lai_effective"),
        (F.sum(F.col("nl") * F.col("ct") * F.col("w")) / F.sum("w") * 2).alias("lai"),
        (F.sum(F.col("g") * F.col("ct") * F.col("w")) / F.sum(F.col("ct") * F.col("w")) * 100).alias("openness_pct"))
    return out.withColumn("clumping", F.try_divide(F.col("lai_effective"), F.col("lai")))


def lad_profile(points: DataFrame, keys: list[str], dz: float = 1.0, k: float = 0.5, z0: float = 2.0,
                top: float = 60.0) -> DataFrame:
    """Leaf area density per height layer from the returns that reach below it."""
    valid = points.where((F.col("hag") > 0) & (F.col("hag") < top))
    counts = valid.groupBy(*keys, F.floor((F.col("hag") - z0) / dz).cast("int").alias("layer")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy(*keys).agg(F.min("layer").alias("_a"), F.max("layer").alias("_b"))
    frame = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias("layer"))
    full = frame.join(counts, [*keys, "layer"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # at most top/dz layers per group
    w = Window.partitionBy(*keys).orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    through = full.withColumn("_through", F.sum("n").over(w)).withColumn("_below", F.col("_through") - F.col("n"))
    return through.where((F.col("layer") >= 0) & (F.col("_below") > 0)).select(
        *keys, (F.col("layer") * dz + z0 + dz / 2).alias("height_m"),
        (-F.log(F.col("_below") / F.col("_through")) / (k * dz)).alias("lad"))


def structural_lai(points: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the density profile and the 95th height percentile."""
    lai = lad_profile(points, keys).groupBy(*keys).agg(F.sum("lad").alias("lai"), F.count(F.lit(1)).alias("n_layers"))
    valid = points.where((F.col("hag") > 0) & (F.col("hag") < 60))
    return lai.join(percentiles_by(valid, keys, {"height_p95_m": ("hag", 0.95)}), keys)


def ndvi_summary(pixels: DataFrame) -> DataFrame:
    """Median, 90th percentile and share of dark pixels of a colour-infrared image set."""
    v = pixels.withColumn("ndvi", colour.pseudo_ndvi(F.col("r"), F.col("g")))
    return percentiles_by(v, [], {"median": ("ndvi", 0.5), "p90": ("ndvi", 0.9)},
                          [(F.avg(F.col("ndvi").isNull().cast("double")) * 100).alias("nodata_pct")])


def segment_features(pixels: DataFrame, keys: list[str], mask: Column | None = None, min_pixels: int = 20) -> DataFrame:
    """24 colour and texture figures per segment; Sobel gradients within the segment's box.

    ``pixels`` may contain pixels outside the segments (``mask`` false): they
    only serve as gradient neighbours.
    """
    mask = F.lit(True) if mask is None else mask
    r, g, b = (F.col(c).cast("double") for c in RGB)
    base = pixels.withColumn("_in", mask).withColumn("grey", F.floor(colour.luminance(r, g, b) + 0.5))
    inside = base.where("_in")
    hue, sat, val = colour.hsv(r, g, b)
    feats = inside.withColumns({"hue": hue, "sat": sat, "val": val, "bright": (r + g + b) / 3.0})
    s = r + g + b + 1e-6
    aggs = []
    for name in ("r", "g", "b", "hue", "sat", "val"):
        aggs += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    aggs += [F.avg(r / s).alias("r_share"), F.avg(g / s).alias("g_share"), F.avg(b / s).alias("b_share"),
             F.avg(r / (g + 1e-6)).alias("rg_ratio"), F.avg(b / (g + 1e-6)).alias("bg_ratio"),
             F.count(F.lit(1)).alias("n_pixels"), F.min("row").alias("y0"), F.max("row").alias("y1"),
             F.min("col").alias("x0"), F.max("col").alias("x1")]
    stats = percentiles_by(feats, keys, {"bright_p10": ("bright", 0.1), "bright_p50": ("bright", 0.5),
                                         "bright_p90": ("bright", 0.9)}, aggs)
    stats = stats.where(F.col("n_pixels") >= min_pixels)
    grads = _sobel(base, inside, stats.select(*keys, "y0", "y1", "x0", "x1"), keys)
    means = grads.groupBy(*keys).agg(F.avg("mag").alias("grad_mean"), F.stddev_pop("mag").alias("grad_std"),
                                     (F.avg(F.abs("gx")) / (F.avg(F.abs("gy")) + 1e-6)).alias("grad_xy_ratio"))
    edge = salted_join(grads, means.select(*keys, "grad_mean"), keys).groupBy(*keys).agg(
        F.avg((F.col("mag") > F.col("grad_mean")).cast("double")).alias("edge_share"))
    return stats.drop("y0", "y1", "x0", "x1").join(means, keys).join(edge, keys)


def _sobel(base: DataFrame, inside: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """3x3 gradients of the inside pixels, neighbours mirrored at the box border."""
    weights = [(dy, dx, dx * (2 if dy == 0 else 1), dy * (2 if dx == 0 else 1))
               for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
    kernel = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(wx).alias("wx"), F.lit(wy).alias("wy"))
                       for dy, dx, wx, wy in weights])

    def mirror(v: Column, lo: str, hi: str) -> Column:
        out = F.when(v < F.col(lo), 2 * F.col(lo) - v).when(v > F.col(hi), 2 * F.col(hi) - v).otherwise(v)
        return F.least(F.greatest(out, F.col(lo)), F.col(hi))

    want = salted_join(inside.select(*keys, "row", "col"), boxes, keys).withColumn("_k", F.explode(kernel))
    want = want.select(*keys, F.col("row").alias("_row"), F.col("col").alias("_col"), "_k.wx", "_k.wy",
                       mirror(F.col("row") + F.col("_k.dy"), "y0", "y1").alias("row"),
                       mirror(F.col("col") + F.col("_k.dx"), "x0", "x1").alias("col"))
    near = want.join(base.select(*keys, "row", "col", "grey"), [*keys, "row", "col"])
    return near.groupBy(*keys, "_row", "_col").agg(
        F.sum(F.col("wx") * F.col("grey")).alias("gx"), F.sum(F.col("wy") * F.col("grey")).alias("gy")).withColumn(
        "mag", F.hypot(F.col("gx").cast("double"), F.col("gy").cast("double")))


FEATURE_NAMES = [f"{n}_{s}" for n in ("r", "g", "b", "hue", "sat", "val") for s in ("mean", "std")] + [
    "bright_p10", "bright_p50", "bright_p90", "r_share", "g_share", "b_share", "rg_ratio", "bg_ratio",
    "grad_mean", "grad_std", "grad_xy_ratio", "edge_share"]

