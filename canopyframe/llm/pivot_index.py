"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order of
nearness. Inverted lists hold the vectors of each pair of pivots, so vectors that
share two of their nearest pivots meet in a list. A pair is verified once, in the
list of the two smallest pivots that it shares, by its exact cosine.

The lists that begin with one pivot travel together: a vector is shipped once for
all of them and a task takes them apart again. Long lists are dealt out in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyframe.llm.common import release, stored
from canopyframe.llm.links import components
from canopyframe.runtime import cut_lineage, salted_join

#: Vectors sampled for the pivots, and pivots kept: no two of them nearer than APART (cosine).
SAMPLE, PIVOTS, APART = 4096, 768, 0.75
#: Nearest pivots that describe a vector.
NEAREST = 7
#: Rows of an inverted list that are shipped as one block; longer lists are compared block by block.
BLOCK = 4096
#: Rows that are compared at once.
TILE = 1024
#: Vector components of the lists that travel together, each list counted by itself.
TOGETHER = 1 << 24


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of huge and tiny values in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(distinct: DataFrame, dim: int) -> np.ndarray:
    """A bounded sample in hash order, thinned so that a crowd of near copies gives one pivot."""
    order = F.xxhash64("h1", "h2", F.lit("pivot"))
    count, room = distinct.count(), SAMPLE + 8 * int(SAMPLE ** 0.5) + 64
    while True:
        # only hashes below a bound reach the driver: the smallest of every partition would grow with the table
        bound = min(int(2 ** 64 * room / max(count, 1)) - 2 ** 63, 2 ** 63 - 1)
        rows = distinct.where(order <= bound).orderBy(order, "h1", "h2").select("vec").limit(SAMPLE).collect()
        if len(rows) == min(SAMPLE, count):
            break
        room *= 2
    x = _unit(np.array([r["vec"] for r in rows], np.float64).reshape(-1, dim), dim) if rows else np.zeros((0, dim))
    kept: list[int] = []
    for i in range(len(x)):
        if len(kept) == PIVOTS:
            break
        if not kept or (x[kept] @ x[i]).max() < APART:
            kept.append(i)
    return x[kept]


def _describe(distinct: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """``rep, mult, vec, near``: the nearest pivots of each vector by their numbers."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)
    wanted = min(NEAREST, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _unit(batch.column(2).flatten().to_numpy(zero_copy_only=False), dim)
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(_largest(x @ shared.value.T, wanted))], names=["rep", "mult", "vec", "near"])

    return distinct.select("rep", "mult", "vec").mapInArrow(run, T.StructType([*distinct.select("rep", "mult", "vec").schema, T.StructField("near", T.ArrayType(T.ShortType()))]))


def _largest(sims: np.ndarray, wanted: int) -> np.ndarray:
    """Columns of the largest values of each row in ascending order; of equal values the first."""
    least = np.partition(sims, sims.shape[1] - wanted, axis=1)[:, sims.shape[1] - wanted, None]
    taken, ties = sims > least, sims == least
    if ties.sum() > len(sims):
        ties &= np.cumsum(ties, axis=1) <= wanted - taken.sum(axis=1, keepdims=True)
    return np.nonzero(taken | ties)[1].reshape(len(sims), wanted).astype(np.int16)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _plan(p: np.ndarray, q: np.ndarray, rows: np.ndarray, pivots: int, dim: int) -> dict[str, np.ndarray]:
    """How the lists travel, from their lengths; there are at most as many as pairs of pivots.

    ``group`` by pivots: the number of the group that a list travels in, or -1.
    ``first`` by group: the smaller pivot of all its lists. ``blocks`` by pivots: into how many
    blocks a long list is cut, or 0.
    """
    group, blocks = np.full((pivots, pivots), -1, np.int32), np.zeros((pivots, pivots), np.int32)
    long = rows > BLOCK
    blocks[p[long], q[long]] = -(-rows[long] // BLOCK)
    order = np.lexsort((q, p))
    order = order[~long[order]]
    p, q, rows = p[order], q[order], rows[order]
    upto = np.cumsum(rows) - rows
    start = np.searchsorted(p, p)  # of the lists of the same pivot
    part = (upto - upto[start]) // max(1, TOGETHER // dim) if len(p) else upto
    keys, number = np.unique(np.stack([p, part]), axis=1, return_inverse=True)
    group[p, q] = number.ravel()
    return {"group": group, "first": keys[0], "blocks": blocks}


def _deal(described: DataFrame, plan, pivots: int) -> DataFrame:
    """A row for each group and each block that a vector belongs to. ``list``: the group, or beyond all groups a long list by its pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks, groups = plan.value["group"], plan.value["blocks"], len(plan.value["first"])
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                near = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                a, b = np.array(_pairs(near.shape[1])).T
                code = np.sort(group[near[:, a], near[:, b]], axis=1)
                new = code >= 0
                new[:, 1:] &= code[:, 1:] != code[:, :-1]
                row, col = np.nonzero(new)
                none = np.zeros(len(row), np.int32)
                parts = [(row, code[row, col].astype(np.int64), none, none, none)]
                cut = blocks[near[:, a], near[:, b]]
                row, col = np.nonzero(cut)
                if len(row):
                    number = cut[row, col]
                    mixed = batch.column(0).to_numpy()[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                    own = (mixed % number.astype(np.uint64)).astype(np.int32)
                    key = groups + near[row, a[col]].astype(np.int64) * pivots + near[row, b[col]]
                    row, key, own = (np.repeat(v, number) for v in (row, key, own))
                    other = (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)).astype(np.int32)
                    parts.append((row, key, np.minimum(own, other), np.maximum(own, other), own))
                for row, key, i, j, chunk in parts:
                    for s in range(0, len(row), 8192):
                        e = s + 8192
                        yield pa.RecordBatch.from_arrays([*map(pa.array, (key[s:e], i[s:e], j[s:e], chunk[s:e])), *batch.take(pa.array(row[s:e])).columns],
                                                         names=["list", "i", "j", "chunk", "rep", "mult", "vec", "near"])

    return described.mapInArrow(run, T.StructType([*T.StructType.fromDDL("list bigint, i int, j int, chunk int"), *described.schema]))


def _pairs(size: int) -> list[tuple[int, int]]:
    return list(combinations(range(size), 2)) if size > 1 else [(0, 0)]


def _compare(rows: dict[str, np.ndarray], a: int, b: int, dim: int, cosine: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Links inside one list or block, tile by tile: vector, smallest vector of its part, number of linked vectors.

    With ``chunk``, rows meet only rows of the other chunk.
    """
    rep, near, chunk = rows["rep"], rows["near"], rows.get("chunk")
    # the list of the two smallest shared pivots owns a pair: no smaller pivot but the first may be shared
    below = (near < b) & (near != a)
    if len(rep) > TILE:  # alike rows side by side
        order = np.lexsort([*np.where(below, near, -1).T, *([] if chunk is None else [chunk])])
        rep, near, below = rep[order], near[order], below[order]
        rows = {"mult": rows["mult"][order], "vec": rows["vec"][order]}
        chunk = None if chunk is None else chunk[order]
    x, mult = _unit(rows["vec"].ravel(), dim), rows["mult"].astype(np.float64)
    used = np.unique(near[below])
    marks = np.zeros((len(rep), len(used)), np.float32)
    r, c = np.nonzero(below)
    marks[r, np.searchsorted(used, near[r, c])] = 1
    if chunk is None:
        starts = range(0, len(rep), TILE)
        tiles = [(slice(s, s + TILE), slice(t, t + TILE)) for s in starts for t in starts if s <= t]
    else:
        left, right = (np.flatnonzero(chunk == k) for k in (chunk.min(), chunk.max()))
        tiles = [(left[s:s + TILE], right[t:t + TILE]) for s in range(0, len(left), TILE) for t in range(0, len(right), TILE)]
    for left, right in tiles:
        if len(used) and (marks[left].all(axis=0) & marks[right].all(axis=0)).any():
            continue  # all pairs here belong to another list
        hits = x[left] @ x[right].T >= cosine
        if chunk is None and left == right:
            hits = np.triu(hits, 1)
        if len(used) and hits.any():
            hits &= marks[left] @ marks[right].T == 0
        u, v = np.nonzero(hits)
        if not len(u):
            continue
        at = np.arange(len(rep))
        ends, where = np.unique(np.concatenate([at[left][u], at[right][v]]), return_inverse=True)
        u, v = where[:len(u)], where[len(u):]
        links = np.bincount(u, weights=mult[ends[v]], minlength=len(ends)) + np.bincount(v, weights=mult[ends[u]], minlength=len(ends))
        order = np.argsort(rep[ends], kind="stable")
        label = np.empty(len(ends), np.int64)
        label[order] = np.arange(len(ends))
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            if np.array_equal(new, label):
                break
            label = new
        yield rep[ends], rep[ends[order[label]]], links.astype(np.int64)


def _apart(rows: dict[str, np.ndarray], group: int, plan: dict[str, np.ndarray], dim: int, cosine: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Links of the lists that travel in one group."""
    a, near = plan["first"][group], rows["near"]
    row, col = np.nonzero(plan["group"][a][near] == group)
    q = near[row, col]
    order = np.argsort(q, kind="stable")
    row, q = row[order], q[order]
    edges = [0, *(np.flatnonzero(np.diff(q)) + 1), len(q)]
    for s, e in zip(edges[:-1], edges[1:]):
        if e - s > 1:
            yield from _compare({k: v[row[s:e]] for k, v in rows.items()}, a, q[s], dim, cosine)


def _blocks(rows: DataFrame, plan, pivots: int, dim: int, cosine: float) -> DataFrame:
    """Compare the rows of each group or block; they come sorted by it."""
    keys = ("list", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        groups = len(plan.value["first"])

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = [table.column(k).to_numpy() for k in keys]
            flat = {k: table.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) for k in ("vec", "near")}
            flat |= {k: table.column(k).to_numpy() for k in ("rep", "mult")}
            chunk = table.column("chunk").to_numpy()
            new = np.any([np.diff(k) != 0 for k in key], axis=0)
            edges = [0, *(np.flatnonzero(new) + 1), table.num_rows]
            found = []
            for s, e in zip(edges[:-1], edges[1:]):
                part = {k: v[s:e] for k, v in flat.items()}
                if e - s < 2:
                    continue
                if key[0][s] < groups:
                    found += _apart(part, key[0][s], plan.value, dim, cosine)
                elif key[1][s] == key[2][s]:
                    found += _compare(part, *divmod(key[0][s] - groups, pivots), dim, cosine)
                elif chunk[s:e].min() < chunk[s:e].max():
                    found += _compare(part | {"chunk": chunk[s:e]}, *divmod(key[0][s] - groups, pivots), dim, cosine)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], names=["rep", "root", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = [held.column(k)[-1].as_py() for k in keys]
            open_rows = np.all([held.column(k).to_numpy() == v for k, v in zip(keys, last)], axis=0)
            full = int(np.argmax(open_rows)) if open_rows.any() else held.num_rows
            if full:
                yield from solve(held.slice(0, full))
                held = held.slice(full)
        if held is not None:
            yield from solve(held)

    return rows.mapInArrow(run, "rep bigint, root bigint, n bigint")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors that are null, empty, zero or hold a null or a non-finite component
    link with nothing. Vectors of different lengths have no cosine; each length has an
    index of its own. Equal vectors, so also repeated rows, are one entry of the index with a
    count and link with each other. Every vector is indexed; only the pivots come from a sample.
    A pair is found if the two share two of their nearest pivots, and pairs found are
    verified in double precision. Lists of any length are compared in blocks.
    No rows give none.

    Vectors are named by numbers of their own inside, so ids may be null or repeated: rows
    of one id are vectors of their own, the component is named by its smallest id, and
    where no member has an id by null. A row without id is kept if its component has no id.
    """
    vec = F.col(vec_col)
    sound = vec.isNotNull() & F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    sound = sound & F.coalesce(F.exists(vec, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(sound, vec).alias("vec"))
    # equal vectors are known by 128 bits of hash
    rows = rows.withColumns({"h1": F.when(F.col("vec").isNotNull(), F.xxhash64("vec")), "h2": F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit("second"), "vec"))})
    usable = rows.where(F.col("vec").isNotNull())
    merged = usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("mult"), F.first("vec").alias("vec"))
    distinct = stored(merged.select(F.monotonically_increasing_id().alias("rep"), "*", F.size("vec").alias("dim")))
    lengths = sorted(r["dim"] for r in distinct.select("dim").distinct().collect())
    links = [_links(distinct.where(F.col("dim") == dim), dim, cosine) for dim in lengths]
    if not links:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    roots = stored(components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    placed = distinct.select("h1", "h2", "rep", "least", "mult").join(counts, "rep", "left").join(roots, "rep", "left")
    placed = stored(placed.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "least", F.coalesce("root", "rep").alias("root")))
    # sums of tasks first, so a component of any size is a few rows when it is named
    names = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = cut_lineage(salted_join(placed, names, ["root"]).select("h1", "h2", "n_links", "component", F.lit(True).alias("sound")))
    own = F.when(F.col("sound"), F.col("component")).otherwise(F.col("vec_id"))
    return rows.drop("vec").join(named, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def _links(distinct: DataFrame, dim: int, cosine: float) -> DataFrame:
    """``rep, root, n``: linked vectors of one length, the smallest of their part of a tile and the number of rows they link with there."""
    spark = distinct.sparkSession
    pivots = _pivots(distinct, dim)
    described = stored(_describe(distinct, pivots, dim))
    at = lambda k: F.element_at("near", F.col(f"s.{k}") + 1).cast("int")
    pairs = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _pairs(min(NEAREST, len(pivots)))])
    lists = described.select("near", F.explode(pairs).alias("s")).groupBy(at("x").alias("p"), at("y").alias("q")).agg(F.count(F.lit(1)).alias("rows"))
    lengths = lists.where(F.col("rows") > 1).toArrow()
    plan = spark.sparkContext.broadcast(_plan(*(lengths.column(k).to_numpy() for k in ("p", "q", "rows")), len(pivots), dim))
    dealt = _deal(described, plan, len(pivots)).repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    found = stored(_blocks(dealt, plan, len(pivots), dim, cosine))
    release(spark)
    return found


def op8_pivot_index(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)
