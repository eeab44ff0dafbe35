"""Exact percentiles, ranks and running totals that never need a whole group in one task.

Each function measures its groups first. Groups within ``limit`` rows use the
built-in aggregate or window; larger ones are answered exactly by narrowing
value ranges (percentiles) or by range partitions with offsets (running sums).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.runtime import (BROADCAST_LIMIT, GROUP_LIMIT, cut_lineage, fits_one_task,
                                 salted_join)

#: Equal-width slices per narrowing step.
SLICES = 1024
#: Stands for infinity while a value range is narrowed.
_MOST = 1.7976931348623157e308


def percentiles_by(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, float]],
                   extra: list[Column] | None = None, limit: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated percentiles ``{output: (column, share)}`` per group.

    ``extra`` are further aggregate columns computed in the same pass. Missing
    values and NaN are ignored, infinite ones count as the ends of the order.
    ``sizes`` are the rows ``_n`` of each group, if the caller has counted them.
    """
    limit = GROUP_LIMIT if limit is None else limit
    extra = extra or []
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes
    sizes = sizes.where(F.col("_n") > limit)
    if not sizes.take(1):
        return plain_percentiles(df, keys, specs, extra)
    if not keys:
        return _narrowed(df, keys, specs, extra)
    hot = cut_lineage(sizes.select(*keys))
    if hot.count() <= BROADCAST_LIMIT:
        hot = F.broadcast(hot)
    cold = plain_percentiles(salted_join(df, hot, keys, "left_anti"), keys, specs, extra)
    return cold.unionByName(_narrowed(salted_join(df, hot, keys, "left_semi"), keys, specs, extra))


def plain_percentiles(df, keys, specs, extra):
    """The same for groups that are known to fit one task."""
    aggs = [F.percentile(_numbers(c), F.lit(float(p))).alias(name) for name, (c, p) in specs.items()]
    return df.groupBy(*keys).agg(*aggs, *extra)


def _numbers(column: str) -> Column:
    """The column as double without NaN."""
    return F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))


def _finite(column: str) -> Column:
    """The same with the ends of the double range for infinite values."""
    return F.when(_numbers(column).isNotNull(), F.greatest(F.least(_numbers(column), F.lit(_MOST)), F.lit(-_MOST)))


def _narrowed(df, keys, specs, extra):
    """Percentiles of very large groups: slice the value range, keep only the slice with the rank."""
    if extra:
        result = df.groupBy(*keys).agg(*extra)
    else:
        result = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_unused")).drop("_unused")
    for name, (column, share) in specs.items():
        part = _one_percentile(df.select(*keys, _finite(column).alias("_v"))
                               .where(F.col("_v").isNotNull()), keys, float(share), name)
        result = result.join(part, keys, "left") if keys else result.crossJoin(part)
    return result


def _one_percentile(vals: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    stats = vals.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"),
                                    F.max("_v").alias("_hi"))
    pos = (F.col("_n") - 1) * F.lit(share)
    targets = (stats
               .withColumn("_frac", pos - F.floor(pos))
               .withColumn("_rank", F.explode(F.array_distinct(F.array(
                   F.floor(pos).cast("bigint"),
                   F.least(F.floor(pos).cast("bigint") + 1, F.col("_n") - 1)))))
               .withColumn("_first", F.col("_rank") == F.floor(pos))
               .withColumn("_below", F.lit(0).cast("bigint"))
               .select(*keys, "_frac", "_rank", "_first", "_lo", "_hi", "_below"))
    targets = cut_lineage(targets)
    while targets.where(F.col("_lo") < F.col("_hi")).take(1):
        targets = cut_lineage(_narrow_once(vals, targets, keys))
    value = F.when(F.col("_lo") >= _MOST, float("inf")).when(F.col("_lo") <= -_MOST, float("-inf")).otherwise(F.col("_lo"))
    first = F.max(F.when(F.col("_first"), value))
    last = F.coalesce(F.max(F.when(~F.col("_first"), value)), first)
    between = (F.max("_frac") > 0) & (first != last)
    return targets.groupBy(*keys).agg(F.when(between, first + (last - first) * F.max("_frac")).otherwise(first).alias(name))


def _narrow_once(vals, targets, keys):
    ranges = targets.where(F.col("_lo") < F.col("_hi")).select(*keys, "_lo", "_hi", "_below").distinct()
    # halves: the distance of two doubles may be more than a double holds
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    # the ranges table has at most two rows per hot group, so it meets the rows by broadcast
    # when small and by a salted join otherwise
    if not keys or fits_one_task(ranges, [], BROADCAST_LIMIT):
        side = F.broadcast(ranges)
        joined = vals.join(side, keys) if keys else vals.crossJoin(side)
    else:
        joined = salted_join(vals, ranges, keys)
    slices = (joined.where(inside)
              .withColumn("_slice", F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / width * SLICES),
                                            F.lit(SLICES - 1)))
              .groupBy(*keys, "_lo", "_hi", "_below", "_slice")
              .agg(F.count("_v").alias("_c"), F.min("_v").alias("_smin"), F.max("_v").alias("_smax")))
    w = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = (slices.withColumn("_upto", F.sum("_c").over(w) + F.col("_below"))
              .withColumn("_from", F.col("_upto") - F.col("_c")))
    open_targets = targets.where(F.col("_lo") < F.col("_hi"))
    done = targets.where(F.col("_lo") >= F.col("_hi"))
    nxt = (open_targets.join(slices.drop("_below"), [*keys, "_lo", "_hi"])
           .where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto")))
           .select(*keys, "_frac", "_rank", "_first", F.col("_smin").alias("_lo"),
                   F.col("_smax").alias("_hi"), F.col("_from").alias("_below")))
    return done.unionByName(nxt)


def running_total(df: DataFrame, keys: list[str], order: list[Column], amount: Column | None,
                  name: str, limit: int | None = None) -> DataFrame:
    """Inclusive running sum of ``amount`` (1 when None) within ``keys`` in the given order.

    ``order`` must be a total order within the group.
    """
    amount = F.lit(1).cast("bigint") if amount is None else amount
    if fits_one_task(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(amount).over(w))
    parts = cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *order)
                        .withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn(name, F.sum(amount).over(local))
    totals = parts.groupBy("_pid", *keys).agg(F.max(F.col(name)).alias("_max"), F.sum(amount).alias("_part"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *keys, F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_off"))
    return (salted_join(parts, offsets, ["_pid", *keys])
            .withColumn(name, F.col(name) + F.col("_off")).drop("_pid", "_off"))


def average_ranks(df: DataFrame, column: str, name: str, limit: int | None = None) -> DataFrame:
    """Rank of each row by ``column`` starting at 0, ties sharing the mean of their ranks."""
    freq = df.groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    freq = running_total(freq, [], [F.col(column)], F.col("_c"), "_upto", limit)
    freq = freq.select(column, (F.col("_upto") - (F.col("_c") + 1) / F.lit(2.0)).alias(name))
    return salted_join(df, freq, [column])
