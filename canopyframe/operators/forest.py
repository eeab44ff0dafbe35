"""Trees of a random forest, each grown by one task that votes on the rows of the held fold.

Rows travel as bins of their figures, a byte each, once for every task with trees of a fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trees of a task; rows that give the limits of the bins; parts of a vote.
TREES, LIMIT_ROWS, UNIT = 20, 65_536, 1 << 40


def votes(ready: DataFrame, features: list[str], folds: list[int], classes: int, trees: int, seed: int) -> DataFrame:
    """``_id, _votes`` for every row of ``ready (_id, fold, _y, features)``: per class the votes of all trees of the forest that doesn't know its fold, in parts of ``UNIT``.

    ``_y`` is the number of the class, or null for rows that are only voted on. Every forest takes a sample with
    replacement for each tree, weighs classes equally, tries the root of the number of figures at each node and
    splits until a node holds one class or can't be split. Votes are whole numbers, so they add up to the same in any order.
    """
    spark = ready.sparkSession
    count = ready.count()
    spread = F.pmod(F.xxhash64("_id"), F.lit(max(1, count // LIMIT_ROWS)))
    sample = ready.where((spread == 0) & F.col("_y").isNotNull()).orderBy("_id").select("fold", *features).toArrow()
    values = np.stack([sample.column(f).to_numpy() for f in features], axis=1)
    limits = [[_limits(column) for column in values[sample.column("fold").to_numpy() != fold].T] for fold in folds]
    jobs = [(k, first, min(TREES, trees - first)) for k in range(len(folds)) for first in range(0, trees, TREES)]
    shared = spark.sparkContext.broadcast((folds, limits, jobs))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, limits, _ = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            fold, y = columns["fold"].to_numpy(), columns["_y"].fill_null(-1).to_numpy().astype(np.int32)
            for k in range(len(folds)):
                bins = np.stack([np.searchsorted(limits[k][i], columns[f].to_numpy()).astype(np.uint8) for i, f in enumerate(features)], axis=1)
                blobs = [columns["_id"].to_numpy().tobytes(), (fold == folds[k]).tobytes(), y.tobytes(), bins.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names=["forest", "ids", "held", "y", "bins"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                slot = row["slot"]
                parts.append([np.frombuffer(row[k], kind) for k, kind in (("ids", np.int64), ("held", np.bool_), ("y", np.int32), ("bins", np.uint8))])
        if slot is None:
            return
        ids, held, y, bins = (np.concatenate(column) for column in zip(*parts))
        order = np.argsort(ids, kind="stable")
        ids, held, y, bins = ids[order], held[order], y[order], bins.reshape(len(ids), -1)[order]
        forest, first, number = shared.value[2][slot]
        known = ~held & (y >= 0)
        found = np.zeros((int(held.sum()), classes), np.int64)
        for tree in range(first, first + number):
            _vote(bins[known], y[known], bins[held], found, np.random.default_rng([seed, forest, tree]))
        ids = ids[held]
        for at in range(0, len(ids), 8192):
            some = found[at:at + 8192]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * classes), pa.array(some.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at:at + 8192]), lists], names=["_id", "_votes"])

    packed = ready.select("_id", "fold", "_y", *features).mapInArrow(pack, "forest int, ids binary, held binary, y binary, bins binary")
    each = -(-trees // TREES)
    dealt = packed.withColumn("slot", F.explode(F.sequence(F.col("forest") * each, F.col("forest") * each + (each - 1)))).repartitionById(len(jobs), "slot")
    voted = dealt.select("slot", "ids", "held", "y", "bins").mapInArrow(grow, "_id bigint, _votes array<bigint>")
    return voted.groupBy("_id").agg(F.array(*[F.sum(F.element_at("_votes", c + 1)) for c in range(classes)]).alias("_votes"))


def _limits(values: np.ndarray) -> np.ndarray:
    """At most 255 limits: between all values if they are few, else at even shares of the rows."""
    if not len(values):
        return values
    distinct = np.unique(values)
    if len(distinct) <= 256:
        return distinct[:-1] + (distinct[1:] - distinct[:-1]) / 2
    return np.unique(np.quantile(values, np.arange(1, 256) / 256, method="inverted_cdf"))


def _tried(nodes: int, features: int, wanted: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Different figures for each node, all choices equally likely."""
    taken: list[np.ndarray] = []
    for last in range(features - wanted, features):
        pick = rng.integers(0, last + 1, nodes)
        twice = reduce(np.logical_or, (pick == t for t in taken), np.zeros(nodes, bool))
        taken.append(np.where(twice, last, pick))
    return taken


def _vote(bins: np.ndarray, y: np.ndarray, held: np.ndarray, found: np.ndarray, rng: np.random.Generator) -> None:
    """Grow one tree, all nodes of a depth at once, and add its shares of classes for the held rows to ``found``."""
    features, classes = bins.shape[1], found.shape[1]
    sizes = np.bincount(y, minlength=classes)
    weight = np.where(sizes > 0, len(y) / (np.count_nonzero(sizes) * np.maximum(sizes, 1)), 0.0)
    count = rng.poisson(1.0, len(y))
    rows = np.flatnonzero(count)
    if not len(rows):
        rows, count = np.arange(len(y)), np.ones(len(y), np.int64)
    y, count, bins, held = y[rows].astype(np.int64), count[rows], bins[rows].ravel(), held.ravel()
    rows, voted = np.arange(len(rows)) * features, np.arange(len(found))
    node, place = np.zeros(len(rows), np.int64), np.zeros(len(voted), np.int64)
    total = np.bincount(y, weights=count, minlength=classes)[:, None]
    live = np.count_nonzero(total, axis=0) > 1
    while True:
        # nodes that end here vote
        ended = ~live[place]
        if ended.any():
            share = total * weight[:, None]
            share = np.rint(share / share.sum(axis=0) * UNIT).astype(np.int64)
            found[voted[ended]] += share.T[place[ended]]
        if not live.any():
            return
        number = np.cumsum(live) - 1
        total = total[:, live]
        stay = live[node]
        rows, node, y, count = rows[stay], number[node[stay]], y[stay], count[stay]
        voted, place = voted[~ended], number[place[~ended]]
        figure, limit = _best_splits(bins, rows, node, y, count, total, weight, _tried(total.shape[1], features, int(np.ceil(np.sqrt(features))), rng))
        split = figure >= 0
        left = np.where(split, 2 * (np.cumsum(split) - 1), 0)
        # a node that can't be split ends as a node of its own behind the children
        alone = 2 * int(split.sum()) + np.cumsum(~split) - 1
        goes = lambda table, at, n: np.where(split[n], left[n] + (table[at + figure[n]] > limit[n]), alone[n])
        node, place = goes(bins, rows, node), goes(held, voted * features, place)
        nodes = 2 * int(split.sum()) + int((~split).sum())
        total = np.bincount(y * nodes + node, weights=count, minlength=nodes * classes).reshape(classes, nodes)
        live = np.count_nonzero(total, axis=0) > 1
        live[2 * int(split.sum()):] = False


def _best_splits(bins: np.ndarray, rows: np.ndarray, node: np.ndarray, y: np.ndarray, count: np.ndarray, total: np.ndarray,
                 weight: np.ndarray, tried: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Figure (-1 for none) and largest bin of the left side that lower the Gini impurity of each node most."""
    classes, nodes = total.shape

    def purity(some: list[np.ndarray]) -> np.ndarray:
        weighed = [v * w for v, w in zip(some, weight)]
        return sum(v * v for v in weighed) / sum(weighed)

    best = purity([*total]) * (1 + 1e-12)
    figure, limit = np.full(nodes, -1), np.zeros(nodes, np.int64)
    start = np.cumsum(np.bincount(node, minlength=nodes))[:-1]
    bits = max(1, int(len(rows)).bit_length())
    line = np.arange(len(rows))
    # whole counts of several classes share a number, so that one sum runs over them
    wide = int(count.sum()).bit_length()
    fit = max(1, 62 // wide)
    own = [sum(np.where(y == c, count, 0) << wide * k for k, c in enumerate(range(at, min(at + fit, classes)))) for at in range(0, classes, fit)]
    cells = node * 256
    for pick in tried:
        cell = cells + bins.take(rows + pick.take(node))
        if nodes * 256 * classes <= 2 * len(rows):
            upto = [np.cumsum(np.bincount(cell, weights=np.where(y == c, count, 0), minlength=nodes * 256).reshape(nodes, 256), axis=1) for c in range(classes)]
            full = sum(upto)
            at, end = np.nonzero((full[:, :-1] > 0) & (full[:, :-1] < full[:, -1:]))
            left = [v[at, end] for v in upto]
        else:
            key = cell << bits | line
            key.sort()
            cell, place = key >> bits, key & ((1 << bits) - 1)
            end = np.flatnonzero(cell[1:] != cell[:-1])
            at = cell.take(end) >> 8
            inside = at == cell.take(end + 1) >> 8
            end, at = end[inside], at[inside]
            upto = [np.cumsum(v.take(place)) for v in own]
            some = [v.take(end) - np.concatenate([[0], v.take(start - 1)]).take(at) for v in upto]
            left = [(some[c // fit] >> wide * (c % fit) & ((1 << wide) - 1)).astype(np.float64) for c in range(classes)]
            end = cell.take(end) & 255
        if not len(at):
            continue
        gain = purity(left) + purity([t.take(at) - v for t, v in zip(total, left)])
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        most = np.maximum.reduceat(gain, first)
        better = most > best[at[first]]
        top = np.flatnonzero(gain == np.repeat(np.where(better, most, np.inf), np.diff(np.append(first, len(at)))))[::-1]  # the first of equal ones is set last
        best[at[top]], figure[at[top]], limit[at[top]] = gain[top], pick[at[top]], end[top]
    return figure, limit
