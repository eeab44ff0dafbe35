"""Grid keys and bucketed distance joins.

A distance predicate alone would become a nested-loop join. Both sides are
therefore keyed by a square cell whose side is the search radius; the smaller
side is repeated in the 3x3 cells around it and Spark runs an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.runtime import BROADCAST_LIMIT, fits_one_task, salted_join


def cell(value: Column | str, size: float) -> Column:
    """Index of the grid cell holding ``value``."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(float(size))).cast("bigint")


def with_cells(df: DataFrame, size: float, x: str = "x", y: str = "y",
               names: tuple[str, str] = ("cx", "cy")) -> DataFrame:
    """Add the composite cell key of each row."""
    return df.withColumn(names[0], cell(x, size)).withColumn(names[1], cell(y, size))


def spread(df: DataFrame, names: tuple[str, str], reach: int = 1) -> DataFrame:
    """Repeat each row in every cell up to ``reach`` cells away."""
    for n in names:
        df = df.withColumn(n, F.explode(F.sequence(F.col(n) - reach, F.col(n) + reach)))
    return df


def range_join(many: DataFrame, few: DataFrame, radius: float, many_xy: tuple[str, str],
               few_xy: tuple[str, str], on: list[str] | None = None,
               distance: str = "distance_m", salts: int | None = None) -> DataFrame:
    """All row pairs at most ``radius`` apart in the plane.

    ``few`` is repeated nine times, ``many`` not at all; ``few`` is broadcast only if its
    repeated rows, which are counted unless ``salts`` is given, are few enough. ``on`` holds further
    equality keys. Column names of both sides must differ except for ``on``.
    """
    on = on or []
    names = ("_gx", "_gy")
    left = with_cells(many, radius, *many_xy, names=names)
    right = spread(with_cells(few, radius, *few_xy, names=names), names)
    dist = F.hypot(F.col(many_xy[0]) - F.col(few_xy[0]), F.col(many_xy[1]) - F.col(few_xy[1]))
    if salts is not None:  # the caller has measured
        joined = salted_join(left, right, [*on, *names], "inner", salts)
    elif fits_one_task(right, [], BROADCAST_LIMIT):
        joined = left.join(F.broadcast(right), [*on, *names])
    else:
        # the plan doesn't know how often the side is repeated, so it must not decide on a broadcast
        joined = salted_join(left, right.hint("merge"), [*on, *names])
    joined = joined.withColumn(distance, dist)
    return joined.where(F.col(distance) <= F.lit(float(radius))).drop(*names)
