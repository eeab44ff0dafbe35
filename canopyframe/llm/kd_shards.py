"""K-d tree partitioning: shards of near equal bytes, close in metadata.

The tree starts with all documents. Each node splits at the weighted median of
its widest metadata dimension, weighted by bytes, until a leaf holds the target
bytes. Medians are found in histograms, so no node is ever gathered or sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.ranking import running_total
from canopyframe.runtime import BROADCAST_LIMIT, cut_lineage, fits_one_task, salted_join

#: Bits of a dimension's value and of the tie-breaking number below it.
BITS = 30
#: Histogram bins per node and round.
BINS = 1024
#: A boundary bin with less than this share of a leaf's bytes isn't divided further.
TOLERANCE = 0.0005
#: Rows numbered by one task.
SLOT_ROWS = 50_000
#: Equal rows that one row stands for.
REPEATS = 10_000


def _numbered(meta: DataFrame, column: str) -> DataFrame:
    """``meta`` with the place of each text among the distinct texts of the column instead of the text; null is lowest."""
    values = meta.where(F.col(column).isNotNull()).select(column).distinct()
    places = cut_lineage(running_total(values, [], [F.col(column)], None, "_place"))
    joined = (meta.join(F.broadcast(places), column, "left") if fits_one_task(places, [], BROADCAST_LIMIT)
              else salted_join(meta, places, [column], "left"))
    return joined.withColumn(column, F.coalesce("_place", F.lit(0)).cast("double")).drop("_place")


def _key(dims: int) -> Column:
    """The chosen dimension's value with the tie breaker below it."""
    chosen = F.element_at(F.array(*[F.col(f"_d{i}") for i in range(dims)]), (F.col("_dim") + 1).cast("int"))
    return F.shiftleft(chosen, BITS) + F.col("_tie")


def _values(spark, rows: list[tuple], names: str) -> DataFrame:
    """A small frame of numbers, one row per tree node."""
    body = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def _span(meta: DataFrame, dims: int) -> dict[int, tuple[int, int]]:
    """Widest dimension and bytes per node; one row per node comes back."""
    aggs = [(F.max(f"_d{i}") - F.min(f"_d{i}")).alias(f"w{i}") for i in range(dims)]
    found = meta.groupBy("_node").agg(F.sum("size").alias("total"), *aggs).collect()
    return {r["_node"]: (max(range(dims), key=lambda i: (r[f"w{i}"], -i)), r["total"]) for r in found}


def _cuts(meta: DataFrame, dims: int, nodes: dict[int, dict]) -> None:
    """Set ``cut`` of each node: keys below it hold the wanted bytes as nearly as the tolerance asks."""
    spark = meta.sparkSession
    for n in nodes.values():
        n.update(low=0, shift=2 * BITS, before=0)
    open_nodes = dict(nodes)
    while open_nodes:
        for n in open_nodes.values():
            n["step"] = max(0, n["shift"] - int(math.log2(BINS)))
        table = _values(spark, [(k, n["dim"], n["low"], n["shift"], n["step"]) for k, n in open_nodes.items()],
                        "_node, _dim, _low, _shift, _step")
        inside = (meta.join(F.broadcast(table), "_node").withColumn("_k", _key(dims) - F.col("_low"))
                  .where((F.col("_k") >= 0) & (F.expr("shiftright(_k, cast(_shift as int))") == 0)))
        bins = (inside.groupBy("_node", F.expr("shiftright(_k, cast(_step as int))").alias("bin"))
                .agg(F.sum("size").alias("bytes")).collect())
        by_node: dict[int, list] = {k: [] for k in open_nodes}
        for r in bins:
            by_node[r["_node"]].append((r["bin"], r["bytes"]))
        for k, found in by_node.items():
            n, before = open_nodes[k], open_nodes[k]["before"]
            for b, size in sorted(found):
                if before + size > n["want"]:
                    break
                before += size
            else:  # everything fits
                n["cut"] = n["low"] + (1 << n["shift"])
                continue
            at = n["low"] + (b << n["step"])
            if n["step"] == 0 or size <= n["tolerance"]:
                nearer = n["want"] - before > before + size - n["want"]
                n["cut"] = at + (1 << n["step"]) if nearer else at
            else:
                n.update(low=at, shift=n["step"], before=before)
        open_nodes = {k: n for k, n in open_nodes.items() if "cut" not in n}


def kd_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
              dims: tuple[str, ...] = ("source", "lang", "size", "doc_id")) -> DataFrame:
    """Shard and gapless slot of each row: ``doc_id, size, text_crc32, shard, slot``.

    Size is the UTF-8 bytes of the text (null: none) plus 8. Dimensions are columns
    of ``docs`` (numbers by value, other types by the place of their text among the
    distinct texts, null lowest) or ``size`` by its logarithm; names that ``docs`` lacks are
    left out. Rows equal in a dimension are ordered by text checksum, id and, if equal in all that,
    a running number, so equal texts lie side by side but a hot value or copy still divides. Repeated
    rows are rows of their own. No rows: no result. Other columns are ignored.
    The result depends on the rows only, not on their order or files.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = dict(docs.dtypes)
    named = [d for d in dims if d == "size" or d in kinds]
    raw, texts = {}, []
    for i, d in enumerate(named):
        if d == "size":
            raw[f"_r{i}"] = F.log2(F.octet_length(text).cast("double") + 8)
        elif kinds[d] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[d].startswith("decimal"):
            raw[f"_r{i}"] = F.col(d).cast("double")
        else:
            raw[f"_r{i}"] = F.col(d).cast("string")
            texts.append(f"_r{i}")
            continue
        raw[f"_r{i}"] = F.when(F.isnan(raw[f"_r{i}"]), None).otherwise(raw[f"_r{i}"])
    size = (F.octet_length(text).cast("long") + 8).alias("size")
    meta = docs.select(F.col(id_col).alias("doc_id"), size, F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
                       *[c.alias(n) for n, c in raw.items()])
    meta = _told_apart(cut_lineage(meta))
    for name in texts:
        meta = _numbered(meta, name)
    meta = cut_lineage(meta)
    ends = meta.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"),
                    *[f(n).alias(f"{n}{k}") for n in raw for k, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << BITS) - 1
    scaled = {}
    for i, n in enumerate(raw):
        low, high = ends[f"{n}lo"], ends[f"{n}hi"]
        wide = low is not None and high > low and math.isfinite(high - low)
        value = F.floor((F.col(n) - low) / (high - low) * (top - 1)).cast("long") + 1 if wide else F.lit(0)
        scaled[f"_d{i}"] = F.coalesce(value.cast("long"), F.lit(0).cast("long"))
    tie = F.shiftleft(F.pmod(F.xxhash64("text_crc32"), F.lit(1 << 14)), 16) + F.pmod(
        F.xxhash64("doc_id", "_again", "size", *raw), F.lit(1 << 16))
    meta = meta.select("doc_id", "size", "text_crc32", "_again", tie.cast("long").alias("_tie"), F.lit(0).cast("long").alias("_node"),
                       *[c.alias(n) for n, c in scaled.items()])
    if not scaled:
        meta = meta.withColumn("_d0", F.lit(0).cast("long"))
    meta = cut_lineage(meta)
    count = max(1, len(scaled))
    leaf = (ends["total"] or 0) / shards
    # a node is (first shard, number of shards)
    nodes = {0: (0, shards)}
    while ends["n"] and any(k > 1 for _, k in nodes.values()):
        span = _span(meta, count)
        work = {node: {"dim": span[node][0], "want": round(span[node][1] * (k // 2) / k), "tolerance": leaf * TOLERANCE}
                for node, (_, k) in nodes.items() if k > 1 and node in span}
        if not work:
            break
        _cuts(meta, count, work)
        cuts = _values(meta.sparkSession, [(n, w["dim"], w["cut"]) for n, w in work.items()], "_node, _dim, _cut")
        stay = F.col("_cut").isNull()
        side = F.when(_key(count) >= F.col("_cut"), 1).otherwise(0).cast("long")
        # every round below reads the nodes again, so they are kept instead of the joins of all levels above
        meta = cut_lineage(meta.join(F.broadcast(cuts), "_node", "left")
                           .withColumn("_node", F.when(stay, F.col("_node") * 2).otherwise(F.col("_node") * 2 + side)).drop("_dim", "_cut"))
        grown = {}
        for node, (first, k) in nodes.items():
            if node in work:
                grown[node * 2], grown[node * 2 + 1] = (first, k // 2), (first + k // 2, k - k // 2)
            else:
                grown[node * 2] = (first, k)
        nodes = grown
    names = _values(meta.sparkSession, [(node, first) for node, (first, _) in nodes.items()], "_node, shard")
    placed = meta.join(F.broadcast(names), "_node").select("doc_id", "size", "text_crc32", "_again", F.col("shard").cast("int"))
    return _slots(placed, ends["n"] or 0, shards)


def _told_apart(meta: DataFrame) -> DataFrame:
    """Rows with ``_again``, a running number of equal rows; which of them has which number makes no difference."""
    counted = meta.groupBy(*meta.columns).agg(F.count(F.lit(1)).alias("_n"))
    once = counted.where(F.col("_n") == 1).withColumn("_again", F.lit(0).cast("long")).drop("_n")
    blocks = counted.where(F.col("_n") > 1).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / REPEATS) - 1)))
    low = F.col("_block") * REPEATS
    again = F.explode(F.sequence(low, F.least(low + REPEATS, F.col("_n")) - 1)).alias("_again")
    return once.unionByName(blocks.repartition(*meta.columns, "_block").select(*meta.columns, again))


def _slots(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Gapless numbers per shard: rows of a bounded bucket are numbered in a task, buckets get offsets."""
    buckets = max(1, math.ceil(rows / shards / SLOT_ROWS)) * 8
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32", "_again"), F.lit(buckets)))
    order = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "size", "_again"))
    sizes = placed.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "_b", F.coalesce(before, F.lit(0)).alias("_start"))
    return (placed.withColumn("_at", order).join(starts, ["shard", "_b"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot")))


def op9_kd_shards(docs: DataFrame) -> DataFrame:
    """24 shards under the law ``bytes``."""
    out = kd_shards(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
