"""Farthest pair of places per group by extremes along directions.

The two ends of the farthest pair are extreme in the direction that joins them. A first
pass finds each group's extremes along a few directions, whose distances bound
the result from below; a place whose reach in no direction comes up to that
bound can't be an end. The few places that are left meet, per finer direction,
only where one lies in the cap at one side and the other in the cap opposite.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.runtime import broadcast_if_small, cut_lineage, salted_join

#: Directions of the first pass and of the last step, over half a turn.
COARSE, FINE = 16, 256
#: Share by which bounds are loosened against rounding.
SLACK = 1e-9


def _along(k: Column | int, n: int, x: Column, y: Column) -> Column:
    angle = F.lit(math.pi / n) * k
    return x * F.cos(angle) + y * F.sin(angle)


def max_pair_distance(places: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Largest distance between two places of each group, 0 for a single place: ``span_m``.

    Places without finite coordinates don't count; a group that has no others has a null span.
    """
    px, py = F.col("_x"), F.col("_y")
    slim = places.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    known = slim.where((F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf")))
    spots = [F.struct(_along(k, COARSE, px, py).alias("t"), px.alias("x"), py.alias("y")) for k in range(COARSE)]
    ends = known.groupBy(*keys).agg(*[f(s).alias(f"_{n}{k}") for k, s in enumerate(spots) for n, f in (("lo", F.min), ("hi", F.max))])
    both = F.array(*[F.struct(F.col(f"_lo{k}.t").alias("lo"), F.col(f"_hi{k}.t").alias("hi")) for k in range(COARSE)])
    marks = F.array(*[F.struct(F.col(f"_{n}{k}.x").alias("x"), F.col(f"_{n}{k}.y").alias("y")) for k in range(COARSE) for n in ("lo", "hi")])
    farthest = F.array_max(F.flatten(F.transform("_marks", lambda a: F.transform("_marks", lambda b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])))))
    bounds = cut_lineage(ends.select(*keys, both.alias("_both"), marks.alias("_marks")).select(*keys, "_both", farthest.alias("_least")))

    left = cut_lineage(_candidates(known, bounds, keys))
    pairs = _opposite_caps(left, keys)
    found = pairs.groupBy(*keys).agg(F.max("_d").alias("_d"))
    named = slim.select(*keys).distinct()
    return (named.join(bounds.select(*keys, "_least"), keys, "left").join(found, keys, "left")
            .select(*keys, F.greatest("_least", "_d").alias("span_m")))


def _candidates(known: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct places that may be an end: along some direction the group reaches far enough from them."""
    shrink = math.cos(math.pi / (2 * COARSE))
    met = salted_join(known, broadcast_if_small(bounds), keys)
    reach = [F.greatest(F.col("_both")[k]["hi"] - _along(k, COARSE, F.col("_x"), F.col("_y")), _along(k, COARSE, F.col("_x"), F.col("_y")) - F.col("_both")[k]["lo"])
             for k in range(COARSE)]
    return met.where(F.greatest(*reach) >= F.col("_least") * shrink * (1 - SLACK)).select(*keys, "_least", "_x", "_y").distinct()


def _opposite_caps(left: DataFrame, keys: list[str]) -> DataFrame:
    """Distances ``_d`` of places that lie in caps opposite each other along a fine direction."""
    shrink = math.cos(math.pi / (2 * FINE))
    turned = left.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(FINE - 1))))
    turned = turned.withColumn("_t", _along(F.col("_k"), FINE, F.col("_x"), F.col("_y")))
    spans = turned.groupBy(*keys, "_k").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    placed = turned.join(spans.where(F.col("_hi") > F.col("_lo")), [*keys, "_k"])
    far = F.col("_least") * shrink * (1 - SLACK)
    low = placed.where(F.col("_hi") - F.col("_t") >= far).select(*keys, "_k", F.col("_x").alias("_ax"), F.col("_y").alias("_ay"))
    high = placed.where(F.col("_t") - F.col("_lo") >= far).select(*keys, "_k", F.col("_x").alias("_bx"), F.col("_y").alias("_by"))
    return salted_join(low, high, [*keys, "_k"]).select(*keys, F.hypot(F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by")).alias("_d"))
