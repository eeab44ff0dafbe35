"""Connected components of occupied raster cells.

Cells are distinct, so a square block of B x B cells holds at most B*B of them.
Each block is solved on its own; only label pairs that touch across a block
border enter the iterative part (alternating large-star and small-star steps).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyframe.runtime import cut_lineage, salted_join

BLOCK = 128
#: Rows worked on at once; a block holds at most BLOCK * BLOCK of them.
_RUN_ROWS = 100_000
_FORWARD = {8: ((0, 1), (1, -1), (1, 0), (1, 1)), 4: ((0, 1), (1, 0))}


def _label_blocks(pdf: pd.DataFrame, block_cols: list[str], neighbours: int, ix: str, iy: str) -> pd.DataFrame:
    """Smallest cell of each component, components ending at block borders. Rows are sorted by block and cell."""
    block = (pdf[block_cols] != pdf[block_cols].shift()).any(axis=1).cumsum().to_numpy()
    gx, gy = pdf[ix].to_numpy(), pdf[iy].to_numpy()
    side = 2 * BLOCK
    key = (block * side + gx % BLOCK) * side + gy % BLOCK + BLOCK // 2
    n = len(key)
    ends = []
    for dx, dy in _FORWARD[neighbours]:
        want = key + dx * side + dy
        pos = np.minimum(np.searchsorted(key, want), n - 1)
        hit = (key[pos] == want) & (block[pos] == block)
        ends.append((np.flatnonzero(hit), pos[hit]))
    a = np.concatenate([e[0] for e in ends])
    b = np.concatenate([e[1] for e in ends])
    lab = np.arange(n)
    while True:
        la, lb = lab[a], lab[b]
        low = np.minimum(la, lb)
        new = lab.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    return pdf.assign(comp_x=gx[lab], comp_y=gy[lab])


def connected_components(cells: DataFrame, neighbours: int = 8, keys: tuple[str, ...] = ("tile_id",),
                         ix: str = "ix", iy: str = "iy") -> DataFrame:
    """Add ``comp_x, comp_y``, the smallest cell of each cell's component, to distinct cells."""
    schema = T.StructType([*cells.schema.fields, T.StructField("comp_x", T.LongType()),
                           T.StructField("comp_y", T.LongType())])
    block_cols = [*keys, "_bx", "_by"]
    columns = cells.columns
    blocked = cells.withColumn("_bx", F.floor(F.col(ix) / BLOCK)).withColumn("_by", F.floor(F.col(iy) / BLOCK))
    sorted_blocks = blocked.repartition(*block_cols).sortWithinPartitions(*block_cols, ix, iy)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a partition is worked off in runs of complete blocks
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows < _RUN_ROWS:
                continue
            run = pd.concat(held, ignore_index=True)
            open_block = (run[block_cols] == run[block_cols].iloc[-1]).all(axis=1).to_numpy()
            if not open_block.all():
                yield _label_blocks(run[~open_block], block_cols, neighbours, ix, iy)[columns + ["comp_x", "comp_y"]]
                run = run[open_block]
            held, rows = [run], len(run)
        if rows:
            run = pd.concat(held, ignore_index=True)
            yield _label_blocks(run, block_cols, neighbours, ix, iy)[columns + ["comp_x", "comp_y"]]

    local = cut_lineage(sorted_blocks.mapInPandas(solve, schema))
    edges = cut_lineage(_border_edges(local, neighbours, keys, ix, iy))
    if not edges.take(1):
        return local
    roots = _stars(edges)
    node = F.struct(*keys, F.col("comp_x").alias("nx"), F.col("comp_y").alias("ny"))
    merged = salted_join(local.withColumn("u", node), roots, ["u"], "left")
    return (merged.withColumn("comp_x", F.coalesce(F.col("v.nx"), F.col("comp_x")))
            .withColumn("comp_y", F.coalesce(F.col("v.ny"), F.col("comp_y"))).drop("u", "v"))


def _border_edges(local, neighbours, keys, ix, iy):
    """Label pairs of cells that are neighbours in different blocks."""
    last = BLOCK - 1
    rim = local.where(F.pmod(F.col(ix), F.lit(BLOCK)).isin(0, last) | F.pmod(F.col(iy), F.lit(BLOCK)).isin(0, last))
    node = F.struct(*keys, F.col("comp_x").alias("nx"), F.col("comp_y").alias("ny"))
    rim = rim.select(*keys, ix, iy, node.alias("node"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _FORWARD[neighbours]])
    out = (rim.withColumn("_s", F.explode(steps))
           .withColumn("tx", F.col(ix) + F.col("_s.dx")).withColumn("ty", F.col(iy) + F.col("_s.dy")))
    other_block = ((F.floor(F.col("tx") / BLOCK) != F.floor(F.col(ix) / BLOCK))
                   | (F.floor(F.col("ty") / BLOCK) != F.floor(F.col(iy) / BLOCK)))
    out = out.where(other_block).select(*keys, F.col("tx").alias(ix), F.col("ty").alias(iy), F.col("node").alias("a"))
    pairs = out.join(rim.withColumnRenamed("node", "b"), [*keys, ix, iy]).where(F.col("a") != F.col("b"))
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _is_star(edges: DataFrame) -> bool:
    """True when every node hangs on exactly one root and no root hangs on another node."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
    roles = ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
    return not roles.where((F.col("leaf") > 1) | ((F.col("leaf") > 0) & (F.col("root") > 0))).take(1)


def _stars(edges: DataFrame) -> DataFrame:
    """Alternate large-star and small-star until every node points at its smallest node."""
    while not _is_star(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (salted_join(both, low, ["u"]).where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = salted_join(large, low, ["u"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        edges = cut_lineage(small)
    return edges
