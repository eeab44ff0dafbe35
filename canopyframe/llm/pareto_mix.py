"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies follows its odds within the source, scaled so
that the source's words come to the target and no document is above the cap. The whole part is
certain. The fraction is an inclusion probability; documents are ranked by their
random odds divided by their inclusion odds, and the first of that order are taken, up
to the words that the certain copies leave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.llm.common import unit_hash, word_count
from canopyframe.runtime import broadcast_if_small, cut_lineage

#: Weights given in turn to the sources in code point order, null last.
WEIGHTS = (1, 2, 3)
#: Most copies of a document and most of a source's size in its target.
CAP = 3
#: Bins of a histogram round over the Pareto order.
BINS = 4096
#: Sources whose decisions are broadcast (a few numbers each); more are joined by a shuffle.
SMALL = 20_000
#: Cuts per source.
ROUNDS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size`` (one row each) with ``weight`` and ``target``.

    Targets share the sum of all sizes by weight and stop at ``cap`` times the
    source's size; the excess goes to the others by weight. Sources sorted by
    ``cap * size / weight`` fill up in that order, so the first one that its share
    does not fill ends the search: all others get the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", pick.cast("long"))
    fill = Window.orderBy(F.col("source_size") * cap / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (ranked.withColumn("_spent", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
              .withColumn("_gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("_all", F.sum("source_size").over(everyone)).withColumn("_weights", F.sum("weight").over(everyone))
              .withColumn("_rest", F.col("_all") - F.col("_spent")).withColumn("_open", F.col("_weights") - F.col("_gone")))
    # full: its share of what is left for it and all after it reaches the cap
    full = F.col("weight") * F.col("_rest") >= F.col("source_size") * cap * F.col("_open")
    ranked = ranked.withColumn("_full", full)
    level = F.min(F.when(~F.col("_full"), F.struct("_spent", "_gone"))).over(everyone)
    share = F.col("weight") * (F.col("_all") - level["_spent"]) / (F.col("_weights") - level["_gone"]).cast("double")
    target = F.when(F.col("_full"), (F.col("source_size") * cap).cast("double")).otherwise(share)
    return ranked.select("source", "source_size", "weight", target.alias("target"))


#: Logarithms of odds lie within these bounds on either side of 0: 36 for the random, 28 for the inclusion odds.
SPAN = 64.0


def _rank(seed: str, probability: Column) -> Column:
    """Pareto order value: the logarithm of random odds over inclusion odds, scaled to (0, 1)."""
    u = unit_hash(seed, F.col("doc_id"), F.col("_crc"))
    p = F.greatest(F.lit(1e-12), F.least(probability, F.lit(1 - 1e-9)))
    return (F.log(u / (1 - u)) - F.log(p / (1 - p)) + SPAN) / (2 * SPAN)


def _expected(cap: int) -> Column:
    """Copies expected of a document: its weight times its source's scale, at most ``cap``."""
    return F.least(F.when(F.col("_scale") == float("inf"), F.lit(float(cap))).otherwise(F.col("_scale") * F.col("_w")), F.lit(float(cap)))


def _scales(sized: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """``targets`` with ``_scale``, at which a source's expected copies have the words of its target.

    Documents that the scale lifts to the cap leave the others more, so the scale grows
    from round to round until no further document reaches the cap.
    """
    now = cut_lineage(targets.withColumn("_scale", F.when(F.col("target") >= F.col("source_size") * cap, F.lit(float("inf")))
                                         .when(F.col("_mass") > 0, F.col("target") / F.col("_mass")).otherwise(F.lit(0.0))))
    while True:
        met = sized.join(broadcast_if_small(now.where((F.col("_scale") > 0) & (F.col("_scale") < float("inf"))).select("_s", "_scale"), SMALL), "_s")
        capped = F.col("_scale") * F.col("_w") >= cap
        sums = met.groupBy("_s").agg(F.sum(F.when(capped, F.col("size")).otherwise(0)).alias("_full"), F.sum(F.when(~capped, F.col("size") * F.col("_w")).otherwise(0.0)).alias("_rest"))
        grown = F.when(F.col("_rest") > 0, (F.col("target") - cap * F.col("_full")) / F.col("_rest"))
        after = cut_lineage(now.join(sums, "_s", "left").withColumn("_next", F.coalesce(grown, "_scale")).withColumn("_moved", F.col("_next") > F.col("_scale") * (1 + 1e-12))
                            .withColumn("_scale", F.when(F.col("_moved"), F.col("_next")).otherwise(F.col("_scale"))).drop("_full", "_rest", "_next"))
        now = after.drop("_moved")
        if not after.where("_moved").take(1):
            return now


def _boundary(rows: DataFrame, bins: Column) -> DataFrame:
    """Per source the bin in which the wanted words are reached and the words before it."""
    found = rows.groupBy("_s", bins.alias("_bin")).agg(F.sum("size").alias("_words"), F.first("_want").alias("_want"))
    run = Window.partitionBy("_s").orderBy("_bin")
    found = found.withColumn("_cum", F.sum("_words").over(run)).where(F.col("_cum") >= F.col("_want"))
    return found.groupBy("_s").agg(F.min(F.struct("_bin", (F.col("_cum") - F.col("_words")).alias("_before"))).alias("_b")).select(
        "_s", F.col("_b._bin").alias("_edge"), F.col("_b._before").alias("_before"))


def _cut(chosen: DataFrame, nearest: bool) -> DataFrame:
    """Per source ``limit`` (order value up to which rows are taken), ``closed`` (the row at the limit too) and ``left``.

    ``left`` is what is still wanted. The limit is the last value that doesn't exceed
    the wanted words, or with ``nearest`` that comes nearest to them. Two histograms
    find the boundary bin; only its rows are sorted.
    """
    coarse, fine = F.floor(F.col("_p") * BINS), F.floor(F.col("_p") * (BINS * BINS))
    first = _boundary(chosen, coarse)
    near = (chosen.join(first, "_s").where(coarse == F.col("_edge"))
            .select("_s", "size", "_p", (F.col("_want") - F.col("_before")).alias("_want")))
    second = _boundary(near, fine)
    last = (near.join(second, "_s").where(fine == F.col("_edge"))
            .select("_s", "size", "_p", (F.col("_want") - F.col("_before")).alias("_want"), "_edge"))
    last = last.groupBy("_s", "_p", "_want", "_edge").agg(F.sum("size").alias("_words"))  # equal values go together
    last = last.withColumn("_cum", F.sum("_words").over(Window.partitionBy("_s").orderBy("_p")))
    over = F.col("_cum") - F.col("_want")
    fits = (over <= 0) | (F.lit(nearest) & (over <= F.col("_want") - F.col("_cum") + F.col("_words")))
    ends = last.groupBy("_s").agg(F.max(F.when(fits, F.struct("_p", (-over).alias("left")))).alias("in"), F.first("_want").alias("_want"),
                                  F.first("_edge").alias("_edge"))
    # without a row in the boundary bin the limit is its lower end
    return ends.select("_s", F.coalesce("in._p", F.col("_edge") / F.lit(float(BINS * BINS))).alias("limit"),
                       F.col("in").isNotNull().alias("closed"), F.coalesce("in.left", "_want").alias("left"))


def by_length(size: Column) -> Column:
    """Odds that grow with the words of a document and level off: short ones are less likely."""
    return (size + 1) / (size + 51)


def copies(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, odds_col: str | None = None,
           odds: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The measured rows ``doc_id, source, size, ...`` and the decision per source.

    The decision has ``source, source_size, target`` and ``cuts``: every document gets the
    whole part of its expected copies and one more if a cut takes it. The size of the
    sample is fixed in words: the first cut takes the Pareto order up to the last
    document that fits; what is left goes to documents behind it that are no larger
    than the gap, in the same order, and in the last round to the nearest sum.
    ``odds_col``, or ``odds`` of the number of words, weighs the expected copies of documents
    within a source; weights must be positive, null counts as 1. A null text has no words.
    Repeated rows (id and text equal) share their order value, so they are taken
    or left together. A source without words gets no copies.
    """
    size = word_count(F.col("text"))
    weight = F.coalesce(F.col(odds_col).cast("double"), F.lit(1.0)) if odds_col else F.lit(1.0)
    rows = docs.select("doc_id", "source", size.alias("size"), F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")).alias("_crc"), weight.alias("_w"))
    if odds is not None:
        rows = rows.withColumn("_w", odds(F.col("size")).cast("double"))
    rows = cut_lineage(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_w")).alias("_mass"))
    targets = source_targets(sizes.select("source", "source_size"), weights, cap).join(
        sizes.select(F.col("source").alias("_s2"), "_mass"), F.col("source").eqNullSafe(F.col("_s2"))).drop("_s2")
    # numbers stand for the sources in the joins below: null is a source like any other
    targets = cut_lineage(targets.withColumn("_s", F.xxhash64("source", F.col("source").isNull())))
    names = broadcast_if_small(targets.select(F.col("source").alias("_name"), "_s"), SMALL)
    sized = cut_lineage(rows.where(F.col("size") > 0).join(names, F.col("source").eqNullSafe(F.col("_name"))).select(
        "_s", "doc_id", "_crc", "size", "_w"))
    targets = _scales(sized, targets, cap)
    met = sized.join(broadcast_if_small(targets.select("_s", "_scale"), SMALL), "_s").withColumn("_e", _expected(cap))
    sure = met.groupBy("_s").agg(F.sum(F.floor("_e") * F.col("size")).alias("_sure"))
    targets = cut_lineage(targets.join(sure, "_s", "left").withColumn("_want", F.col("target") - F.coalesce("_sure", F.lit(0))).drop("_sure"))
    decided = targets.select("source", "source_size", "target", "_scale", "_s").withColumn(
        "cuts", F.array().cast("array<struct<gap:double,limit:double,closed:boolean>>"))
    share = F.col("_e") - F.floor("_e")
    chosen = (met.where(share > 0).join(broadcast_if_small(targets.where(F.col("_want") > 0).select("_s", "_want"), SMALL), "_s")
              .select("_s", "size", "_want", _rank(seed, share).alias("_p")))
    gaps = targets.select("_s", F.lit(float("inf")).alias("gap"))
    for k in range(ROUNDS):
        # a cut reads these rows several times: without this each reading repeats all broadcasts before it
        chosen = cut_lineage(chosen)
        cut = cut_lineage(_cut(chosen, k == ROUNDS - 1).join(gaps, "_s"))
        # a source whose documents all fit into its gap has no boundary: it takes them all
        all_in = gaps.join(cut, "_s", "left_anti").select("_s", F.lit(2.0).alias("limit"), F.lit(True).alias("closed"), "gap")
        step = cut.select("_s", "limit", "closed", "gap").unionByName(all_in)
        decided = cut_lineage(decided.join(step, "_s", "left").withColumn("cuts", F.when(F.col("limit").isNull(), F.col("cuts")).otherwise(
            F.concat("cuts", F.array(F.struct("gap", "limit", "closed"))))).drop("gap", "limit", "closed"))
        open_sources = cut.where(F.col("left") >= 1).select("_s", "limit", F.col("left").alias("_want"))
        gaps = open_sources.select("_s", F.col("_want").cast("double").alias("gap"))
        chosen = (chosen.drop("_want").join(broadcast_if_small(open_sources, SMALL), "_s")
                  .where((F.col("_p") > F.col("limit")) & (F.col("size") <= F.col("_want"))).drop("limit"))
    return rows, decided.drop("_s")


def _taken(rows: DataFrame, decided: DataFrame, seed: str, cap: int = CAP) -> DataFrame:
    """Rows with ``_copies``."""
    small = broadcast_if_small(decided.withColumnRenamed("source", "_name"), SMALL)
    met = rows.join(small, F.col("source").eqNullSafe(F.col("_name"))).withColumn("_e", F.when(F.col("source_size") > 0, _expected(cap)).otherwise(0.0))
    share = F.col("_e") - F.floor("_e")
    met = met.withColumn("_p", _rank(seed, share))
    inside = F.exists("cuts", lambda c: (F.col("size") <= c["gap"]) & ((F.col("_p") < c["limit"]) | (c["closed"] & (F.col("_p") == c["limit"]))))
    extra = F.when((share > 0) & (F.col("size") > 0) & inside, 1).otherwise(0)
    return met.withColumn("_copies", F.floor("_e").cast("long") + extra)


def mixed_sizes(docs: DataFrame, seed: str = "mix", odds: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per row: ``doc_id, size, source_size, target, taken`` (words the mix takes, repeats counted); equal odds unless given."""
    rows, decided = copies(docs, seed, odds=odds)
    return _taken(rows, decided, seed).select("doc_id", "size", "source_size", "target", (F.col("_copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", odds: Callable[[Column], Column] | None = None) -> DataFrame:
    """The mixture: each document as often as the mix takes it, with the columns of ``docs``; equal odds unless given."""
    names = docs.columns
    _, decided = copies(docs, seed, odds=odds)
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_doc"), "doc_id", "source",
                       word_count(F.col("text")).alias("size"),
                       F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")).alias("_crc"), F.lit(1.0).alias("_w"))
    if odds is not None:
        rows = rows.withColumn("_w", odds(F.col("size")).cast("double"))
    taken = _taken(rows, decided, seed).where(F.col("_copies") > 0)
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_c")).select(
        *[F.col(f"_doc.`{n}`").alias(n) for n in names])
