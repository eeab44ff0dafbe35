"""Greedy selections restated as parallel rounds: suppression and one-to-one matching."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.ranking import percentiles_by, running_total
from canopyframe.runtime import BROADCAST_LIMIT, SALTS, cut_lineage, fits_one_task, salted_join
from canopyframe.spatial import range_join, spread, with_cells


def suppress_near(df: DataFrame, min_dist: float, order: list[Column], keys: tuple[str, ...] = (),
                  x: str = "x", y: str = "y") -> DataFrame:
    """Keep a row only if it is at least ``min_dist`` from every better row that is kept.

    Equals the sequential greedy pass over ``order`` (a total order, best first).
    Cells have diagonal ``min_dist``, so a cell keeps at most one row. Each round
    takes the best undecided row of every cell, keeps those with no better
    undecided row in reach and drops what they cover. A row meets only the few
    candidates of the cells around it, so crowded cells cost linear work.
    """
    side = min_dist / math.sqrt(2.0)
    names = ("_sx", "_sy")
    cell = [*keys, *names]
    # the keys are part of the rank: equal ranks of two tiles are different rows
    base = df.withColumn("_rank", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    base = cut_lineage(base)
    left = with_cells(base.select(*keys, "_rank", F.col(x).alias("px"), F.col(y).alias("py")), side, "px", "py", names)
    salts = 1 if fits_one_task(left, cell) else SALTS
    kept_all = None
    while True:
        best = left.groupBy(*cell).agg(F.min(F.struct("_rank", "px", "py")).alias("c"))
        reach = spread(best, names, 2)
        pairs = salted_join(left, reach, cell, "inner", salts).where(
            (F.hypot(F.col("px") - F.col("c.px"), F.col("py") - F.col("c.py")) < F.lit(float(min_dist)))
            & (F.col("_rank") != F.col("c._rank")))
        pairs = cut_lineage(pairs.select(F.col("_rank").alias("other"), F.col("c._rank").alias("cand")))
        beaten = pairs.where(F.col("other") < F.col("cand")).select("cand").distinct()
        kept = best.select(F.col("c._rank").alias("cand")).join(beaten, "cand", "left_anti")
        kept = cut_lineage(kept)
        gone = salted_join(pairs, kept, ["cand"], "left_semi", salts).select(F.col("other").alias("_rank"))
        decided = gone.unionByName(kept.select(F.col("cand").alias("_rank"))).distinct()
        left = cut_lineage(left.join(decided, "_rank", "left_anti"))
        kept_all = kept if kept_all is None else kept_all.unionByName(kept)
        if not left.take(1):
            break
    return base.join(kept_all.select(F.col("cand").alias("_rank")), "_rank", "left_semi").drop("_rank")


def candidate_pairs(refs: DataFrame, dets: DataFrame, max_dist: float, on: list[str] | None = None) -> DataFrame:
    """All reference/detection pairs within ``max_dist``: ``ref_id, det_id, distance_m``.

    Where most rows share their exact position with others, distances are computed between
    positions, and only pairs of positions in reach meet the rows that stand there.
    """
    on = on or []
    spots = {side: cut_lineage(df.select(*on, *xy).distinct()) for side, df, xy in (("d", dets, ("x", "y")), ("r", refs, ("ref_x", "ref_y")))}
    if refs.count() + dets.count() <= COPIES * (spots["r"].count() + spots["d"].count()):
        return _pairs_by_row(refs, dets, max_dist, on)
    near = cut_lineage(range_join(spots["d"], spots["r"], max_dist, ("x", "y"), ("ref_x", "ref_y"), on=on))
    half = _unstacked(near, dets.select(*on, "x", "y", "det_id"), [*on, "x", "y"]).drop("x", "y")
    return _unstacked(half, refs.select(*on, "ref_x", "ref_y", "ref_id"), [*on, "ref_x", "ref_y"]).select(
        *on, "ref_id", "det_id", "distance_m")


#: Rows per distinct position from which pairs are found between positions.
COPIES = 2


def _unstacked(pairs: DataFrame, rows: DataFrame, place: list[str]) -> DataFrame:
    """``pairs`` of positions joined with the ``rows`` at ``place``, of which many may share one."""
    if fits_one_task(rows, [], BROADCAST_LIMIT):
        return pairs.join(F.broadcast(rows), place)
    # the plan doesn't know how many rows a position holds, so it must not decide on a broadcast
    return salted_join(pairs, rows.hint("merge"), place)


def _pairs_by_row(refs: DataFrame, dets: DataFrame, max_dist: float, on: list[str]) -> DataFrame:
    many = dets.select(*on, "det_id", "x", "y")
    few = refs.select(*on, "ref_id", "ref_x", "ref_y")
    return range_join(many, few, max_dist, ("x", "y"), ("ref_x", "ref_y"), on=on).select(
        *on, "ref_id", "det_id", "distance_m")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one matches, shortest pair first with ties by ids.

    A pair that is the best of both its ends is always chosen by the sequential
    rule, so every round takes all of those at once and removes their ends.
    """
    left = cut_lineage(pairs.select("ref_id", "det_id", "distance_m"))
    key = F.struct("distance_m", "ref_id", "det_id")
    matched = None
    while left.take(1):
        by_ref = left.groupBy("ref_id").agg(F.min(key).alias("m"))
        by_det = left.groupBy("det_id").agg(F.min(key).alias("m"))
        chosen = cut_lineage(by_ref.select("m").join(by_det.select("m"), "m", "left_semi").select("m.*"))
        left = salted_join(left, chosen.select("ref_id"), ["ref_id"], "left_anti")
        left = cut_lineage(salted_join(left, chosen.select("det_id"), ["det_id"], "left_anti"))
        matched = chosen if matched is None else matched.unionByName(chosen)
    if matched is None:
        return left.select("distance_m", "ref_id", "det_id")
    return matched


#: Pairs per row up to which all pairs within reach are listed at once.
PAIRS_PER_ROW = 200


def match_within(refs: DataFrame, dets: DataFrame, max_dist: float, pairs_per_row: float = PAIRS_PER_ROW, on: list[str] | None = None) -> DataFrame:
    """Greedy one-to-one matches of ``ref_id, ref_x, ref_y`` and ``det_id, x, y`` within ``max_dist``.

    ``on`` names columns of both sides, such as the plot, that must agree; ids and coordinates
    may repeat from plot to plot, and the matches carry these columns. The number of pairs is estimated from cell counts first. Crowded data goes
    through ``_match_crowded``, which gives the same matches.
    """
    if on:
        # an id with its plot is one value that orders like the id inside the plot
        refs, dets = (df.withColumn(k, F.struct(*on, F.col(k).alias("id"))) for df, k in ((refs, "ref_id"), (dets, "det_id")))
        found = _match(refs, dets, max_dist, pairs_per_row, on)
        return found.select(*[F.col(f"ref_id.{c}").alias(c) for c in on], "distance_m", F.col("ref_id.id").alias("ref_id"), F.col("det_id.id").alias("det_id"))
    return _match(refs, dets, max_dist, pairs_per_row, [])


def _crowded(refs: DataFrame, dets: DataFrame, radius: float, pairs_per_row: float, on: list[str]) -> bool:
    """Whether the pairs within ``radius``, estimated from cell counts, are more than ``pairs_per_row`` for each row."""
    cells = ("_gx", "_gy")
    few = with_cells(refs, radius, "ref_x", "ref_y", cells).groupBy(*on, *cells).agg(F.count(F.lit(1)).alias("_r"))
    many = with_cells(dets, radius, "x", "y", cells).groupBy(*on, *cells).agg(F.count(F.lit(1)).alias("_d"))
    meet = spread(few, cells).groupBy(*on, *cells).agg(F.sum("_r").alias("_r")).join(many, [*on, *cells])
    load = meet.agg(F.sum(F.col("_r").cast("double") * F.col("_d")).alias("p"), F.sum("_r").alias("r"), F.sum("_d").alias("d")).first()
    return (load.p or 0) > pairs_per_row * ((load.r or 0) + (load.d or 0))


def _match(refs: DataFrame, dets: DataFrame, max_dist: float, pairs_per_row: float, on: list[str]) -> DataFrame:
    if _crowded(refs, dets, max_dist, pairs_per_row, on):
        return _match_crowded(refs, dets, max_dist, on, pairs_per_row=pairs_per_row)
    return greedy_match(_pairs_by_row(refs, dets, max_dist, on))


def _places(df: DataFrame, key: str, x: str, y: str, side: str, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Copies numbered within their exact position, and one row per position, known by its smallest id."""
    copies = cut_lineage(running_total(df.select(*on, key, x, y), [*on, x, y], [F.col(key)], None, "k"))
    spots = copies.groupBy(*on, x, y).agg(F.min(key).alias(f"{side}_place"), F.count(F.lit(1)).alias(f"{side}_n"))
    named = salted_join(copies, spots.select(*on, x, y, f"{side}_place"), [*on, x, y]).select(
        F.col(f"{side}_place"), F.col("k").alias(f"{side}_k"), key)
    state = spots.select(f"{side}_place", *on, x, y, f"{side}_n", F.lit(0).cast("bigint").alias(f"{side}_used"), F.col(f"{side}_place").alias(key))
    return cut_lineage(named), cut_lineage(state)


def _moved(state: DataFrame, taken: DataFrame, ids: DataFrame, side: str, key: str, small: bool) -> DataFrame:
    """``state`` after ``taken`` (place and copies): copies in use and the first free id; places that are used up are left out."""
    hint = F.broadcast if small else (lambda df: df)
    after = state.select(f"{side}_place", f"{side}_used").distinct().join(hint(taken), f"{side}_place").select(
        f"{side}_place", (F.col(f"{side}_used") + F.col("m")).alias("_used"), (F.col(f"{side}_used") + F.col("m") + 1).alias(f"{side}_k"))
    first = ids.join(hint(after), [f"{side}_place", f"{side}_k"]).select(f"{side}_place", F.col(key).alias("_id"))
    after = after.join(first, f"{side}_place", "left").select(f"{side}_place", "_used", "_id")
    joined = state.join(F.broadcast(after), f"{side}_place", "left") if small else salted_join(state, after, [f"{side}_place"], "left")
    return (joined.withColumn(key, F.when(F.col("_used").isNull(), F.col(key)).otherwise(F.col("_id")))
            .withColumn(f"{side}_used", F.coalesce("_used", f"{side}_used")).drop("_used", "_id").where(F.col(f"{side}_used") < F.col(f"{side}_n")))


def _match_crowded(refs: DataFrame, dets: DataFrame, max_dist: float, on: list[str] | None = None, steps: int = 6,
                   pairs_per_row: float = PAIRS_PER_ROW) -> DataFrame:
    """Matching for crowded data: growing radii over distinct positions.

    Greedy matching up to a small radius is a prefix of the whole run, and
    afterwards no free pair is left within that radius; so each step only meets
    what the smaller ones left over. The first radius is the largest at which the
    positions are not crowded. Copies at one position act as a stack: the
    closest pair of positions matches as many copies as both hold, in id order,
    or a single one when another pair is exactly as close.
    """
    on = on or []
    r_ids, r = _places(refs, "ref_id", "ref_x", "ref_y", "r", on)
    d_ids, d = _places(dets, "det_id", "x", "y", "d", on)
    blocks = None
    first = 0
    while first < steps - 1 and _crowded(r, d, max_dist / 2 ** first, pairs_per_row, on):
        first += 1
    for k in range(first, -1, -1):
        own = None
        live = range_join(d, r, max_dist / 2 ** k, ("x", "y"), ("ref_x", "ref_y"), on=on).select(
            "r_place", "d_place", "distance_m", "r_n", "r_used", "ref_id", "d_n", "d_used", "det_id")
        while True:
            live = cut_lineage(live)

            def best(side):
                # the closest pair of each position and how many are exactly as close
                pair = F.struct("distance_m", "ref_id", "det_id", *[c for c in live.columns if c not in ("distance_m", "ref_id", "det_id")])
                near = live.groupBy(f"{side}_place", "distance_m").agg(F.min(pair).alias("pair"), F.count(F.lit(1)).alias("ties"))
                return near.groupBy(f"{side}_place").agg(F.min(F.struct("distance_m", "pair", "ties")).alias("b")).select(
                    F.col("b.pair").alias("pair"), F.col("b.ties").alias(f"{side}_ties"))

            chosen = best("r").join(best("d"), "pair").select("pair.*", "r_ties", "d_ties")
            room = F.least(F.col("r_n") - F.col("r_used"), F.col("d_n") - F.col("d_used"))
            take = F.when((F.col("r_ties") == 1) & (F.col("d_ties") == 1), room).otherwise(F.lit(1).cast("bigint"))
            block = cut_lineage(chosen.select("r_place", "d_place", "distance_m", "r_used", "d_used", take.alias("m")))
            n = block.count()
            if not n:  # the closest live pair is always the best of both its ends
                break
            own = block if own is None else own.unionByName(block)
            live = _moved(live, block.select("r_place", "m"), r_ids, "r", "ref_id", n <= BROADCAST_LIMIT)
            live = _moved(live, block.select("d_place", "m"), d_ids, "d", "det_id", n <= BROADCAST_LIMIT)
        if own is not None:
            blocks = own if blocks is None else blocks.unionByName(own)
            if k:
                r = cut_lineage(_moved(r, own.groupBy("r_place").agg(F.sum("m").alias("m")), r_ids, "r", "ref_id", False))
                d = cut_lineage(_moved(d, own.groupBy("d_place").agg(F.sum("m").alias("m")), d_ids, "d", "det_id", False))
    if blocks is None:
        return greedy_match(_pairs_by_row(refs, dets, max_dist, on))
    rows = blocks.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m")))).select(
        "r_place", "d_place", "distance_m", (F.col("r_used") + F.col("_i")).alias("r_k"), (F.col("d_used") + F.col("_i")).alias("d_k"))
    # the stacks unfold to many more rows than the plan expects of them
    rows = rows.hint("merge").join(r_ids, ["r_place", "r_k"])
    return rows.hint("merge").join(d_ids, ["d_place", "d_k"]).select("distance_m", "ref_id", "det_id")


def match_by_position(left: DataFrame, right: DataFrame, max_dist: float) -> DataFrame:
    """Pair trees of two inventories by place; their running numbers do not correspond.

    Both sides need ``tree_id, x, y``. Output ``left_id, right_id, distance_m``.
    """
    refs = left.select(F.col("tree_id").alias("ref_id"), F.col("x").alias("ref_x"), F.col("y").alias("ref_y"))
    dets = right.select(F.col("tree_id").alias("det_id"), "x", "y")
    return match_within(refs, dets, max_dist).select(
        F.col("ref_id").alias("left_id"), F.col("det_id").alias("right_id"), "distance_m")


def detection_quality(n_refs: DataFrame, n_dets: DataFrame, matches: DataFrame) -> DataFrame:
    """Hits, misses, false alarms, recall, precision, F1 and position error in metres."""
    hits = percentiles_by(matches, [], {"median_error_m": ("distance_m", 0.5)}, [
        F.count(F.lit(1)).alias("tp"), F.avg("distance_m").alias("mean_error_m"), F.max("distance_m").alias("max_error_m")])
    row = hits.crossJoin(n_refs.agg(F.count(F.lit(1)).alias("_r"))).crossJoin(n_dets.agg(F.count(F.lit(1)).alias("_d")))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("_r")), F.lit(0.0))
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("_d")), F.lit(0.0))
    return row.select("tp", (F.col("_r") - F.col("tp")).alias("fn"), (F.col("_d") - F.col("tp")).alias("fp"),
                      recall.alias("recall"), precision.alias("precision"),
                      F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0)).alias("f1"),
                      "median_error_m", "mean_error_m", "max_error_m")
