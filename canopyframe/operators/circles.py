"""Algebraic circle fit as a grouped aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.runtime import salted_join


def moments(u: Column, v: Column, use: Column | None = None, prefix: str = "m") -> list[Column]:
    """Nine sums of locally centred coordinates that determine the fit.

    ``u, v`` must be offsets from a point near the group; map coordinates would
    cancel all digits of the radius. Rows outside ``use`` do not count.
    """
    w = u * u + v * v
    terms = {"n": F.lit(1.0), "u": u, "v": v, "uu": u * u, "vv": v * v, "uv": u * v, "w": w,
             "uw": u * w, "vw": v * w}
    return [F.sum(t if use is None else F.when(use, t)).alias(f"{prefix}_{k}") for k, t in terms.items()]


def solve(df: DataFrame, ref_x: Column, ref_y: Column, prefix: str = "m") -> DataFrame:
    """Turn the sums into ``fit_x, fit_y, radius_m``; null when the points do not fix a circle."""
    m = {k: F.col(f"{prefix}_{k}") for k in ("n", "u", "v", "uu", "vv", "uv", "w", "uw", "vw")}
    n = m["n"]
    mu, mv, mw = m["u"] / n, m["v"] / n, m["w"] / n
    suu, svv, suv = m["uu"] / n - mu * mu, m["vv"] / n - mv * mv, m["uv"] / n - mu * mv
    suw, svw = m["uw"] / n - mu * mw, m["vw"] / n - mv * mw
    det = suu * svv - suv * suv
    solvable = (n > 2) & (det > F.lit(1e-12) * (suu + svv) * (suu + svv))
    df = df.withColumn("_a", F.when(solvable, F.try_divide(suw * svv - svw * suv, det)))
    df = df.withColumn("_c", F.when(solvable, F.try_divide(svw * suu - suw * suv, det)))
    a, c = F.col("_a"), F.col("_c")
    r2 = mw - a * mu - c * mv + (a * a + c * c) / 4
    ok = r2 > 0
    return (df.withColumn("fit_x", F.when(ok, ref_x + a / 2))
            .withColumn("fit_y", F.when(ok, ref_y + c / 2))
            .withColumn("radius_m", F.when(ok, F.sqrt(F.greatest(r2, F.lit(0.0)))))
            .drop("_a", "_c", *[f"{prefix}_{k}" for k in m]))


def residuals(px: Column, py: Column, use: Column | None = None) -> list[Column]:
    """Aggregates ``fit_rms_m`` and ``arc_deg`` of points joined with their fit."""
    dx, dy = px - F.col("fit_x"), py - F.col("fit_y")
    miss = F.hypot(dx, dy) - F.col("radius_m")
    sector = F.least(F.floor((F.degrees(F.atan2(dy, dx)) + 180.0) / 10.0), F.lit(35)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), sector)
    if use is not None:
        miss, bit = F.when(use, miss), F.when(use, bit)
    return [F.sqrt(F.avg(miss * miss)).alias("fit_rms_m"),
            (F.bit_count(F.bit_or(bit)) * 10).cast("int").alias("arc_deg")]


def fit_circles(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Centre, radius, RMS residual and arc coverage of each group of points."""
    means = points.groupBy(*keys).agg(F.avg(x).alias("_rx"), F.avg(y).alias("_ry"))
    local = salted_join(points.select(*keys, x, y), means, keys)
    sums = local.groupBy(*keys, "_rx", "_ry").agg(
        *moments(F.col(x) - F.col("_rx"), F.col(y) - F.col("_ry")), F.count(F.lit(1)).alias("n_points"))
    fits = solve(sums, F.col("_rx"), F.col("_ry")).drop("_rx", "_ry")
    checked = salted_join(points.select(*keys, x, y), fits, keys)
    return checked.groupBy(*keys, "n_points", "fit_x", "fit_y", "radius_m").agg(*residuals(F.col(x), F.col(y)))
