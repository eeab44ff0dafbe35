"""Robust scores, rank correlation and the cross-check of two measurement sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.ranking import average_ranks, percentiles_by
from canopyframe.runtime import salted_join


def numeric(value: Column) -> Column:
    """Text to double; anything that is not a plain decimal number becomes null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def _attach(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    # without keys the other side is a single aggregate row
    return salted_join(df, small, keys) if keys else df.crossJoin(F.broadcast(small))


def robust_z(df: DataFrame, column: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Deviation from the median in units of the scaled median absolute deviation."""
    keys = keys or []
    med = percentiles_by(df, keys, {"_med": (column, 0.5)})
    dev = _attach(df, med, keys).withColumn("_dev", F.abs(F.col(column) - F.col("_med")))
    mad = percentiles_by(dev, keys, {"_mad": ("_dev", 0.5)})
    spread = F.coalesce(F.nullif(F.col("_mad"), F.lit(0.0)), F.lit(1e-6))
    return _attach(dev, mad, keys).withColumn(name, (F.col(column) - F.col("_med")) / (F.lit(1.4826) * spread)).drop(
        "_med", "_dev", "_mad")


def vitality_class(z: Column) -> Column:
    return F.when(z <= -1.5, "conspicuous").when(z >= 1.0, "vital").otherwise("normal")


def spearman(df: DataFrame, a: str, b: str, limit: int | None = None) -> DataFrame:
    """Rank correlation with averaged ties, one row ``rho, n_pairs``; null when a side is constant."""
    ranked = average_ranks(average_ranks(df.select(a, b), a, "_ra", limit), b, "_rb", limit)
    return ranked.agg(F.corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n_pairs"))


def pair_measurements(left: DataFrame, right: DataFrame, left_value: str, right_value: str, key: str = "marker_id",
                      order: str = "row_idx", invert: bool = False) -> DataFrame:
    """Inner pairing of two sources: missing values dropped, the last of duplicate keys counts."""
    def last(df, value, name):
        rows = df.where(F.col(value).isNotNull() & F.col(key).isNotNull())
        return rows.groupBy(key).agg(F.max_by(F.col(value), F.col(order)).alias(name))
    a, b = last(left, left_value, "left_value"), last(right, right_value, "right_value")
    out = a.join(b, key)
    return out.withColumn("right_value", -F.col("right_value")) if invert else out


def cross_verdict(zl: Column, zr: Column, thr: float = 1.0) -> Column:
    """Quadrant of two scores: confirmed damage, confirmed vital, one of two contradictions, or normal."""
    return (F.when((zl <= -thr) & (zr <= -thr), "damage confirmed")
            .when((zl >= thr) & (zr >= thr), "vital confirmed")
            .when((zl <= -thr) & (zr >= thr), "contradiction: stress without structural loss")
            .when((zl >= thr) & (zr <= -thr), "contradiction: sparse structure, green image")
            .otherwise("normal"))


def cross_check(pairs: DataFrame, thr: float = 1.0) -> DataFrame:
    """Both scores and the verdict of every pair."""
    scored = robust_z(robust_z(pairs, "left_value", "left_z"), "right_value", "right_z")
    return scored.withColumn("verdict", cross_verdict(F.col("left_z"), F.col("right_z"), thr))


def verdict_counts(checked: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return checked.agg(F.count_if(v.endswith("confirmed")).alias("agree"), F.count_if(v.startswith("contradiction")).alias("contradict"),
                       F.count_if(v == "normal").alias("neutral"))


def verdict_order(checked: DataFrame, limit: int | None = None) -> DataFrame:
    """Contradictions first, then by the left score."""
    out = checked.orderBy(F.when(F.col("verdict").startswith("contradiction"), 0).otherwise(1), "left_z", "marker_id")
    return out if limit is None else out.limit(limit)


def composition(df: DataFrame, column: str) -> DataFrame:
    """Share of each class among all classified rows in percent, rounded half to even."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.rint(F.col("n") * 100.0 / F.col("_t")).cast("int").alias("pct"))
