"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order, frequent ones last. Cut at pivots it falls
into fragments; the overlap of two documents is counted in each fragment on its
own and summed per pair. Which pairs are counted is decided by the prefix of each
set in the same order: sets similar enough share an n-gram of their prefixes.

Equal sets are one node. Within a component of links no further pair is counted,
so a large group of near copies costs far less than its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.llm.common import binary_batches, release, stored
from canopyframe.llm.links import components
from canopyframe.llm.shingles import mix, shingle_sets

#: Counters of the frequency sketch; the order it gives affects speed only.
COUNTERS = 1 << 21
SLICES = 64
#: Fragments of the n-gram order.
FRAGMENTS = 4
#: Hashes below this are the first block of the order: more n-grams than the prefix of most sets.
FIRST_BLOCK = np.uint64(int(0.22 * 2**64))
#: Numbers of 64 bits in the short bitmap that takes part in the last join.
FOLD = 16
#: Distances in a bucket, sorted by size, at which members are paired at first.
LAGS = (1, 2, 5, 11)
#: Most rounds that join components by single pairs before all remaining pairs are counted.
ROUNDS = 2
#: Estimated rows of an n-gram's bucket that one task chains.
BUCKET = 20_000


def _signature(tokens: np.ndarray) -> int:
    """64-bit name of a set: a sum over its members doesn't depend on their order."""
    with np.errstate(over="ignore"):
        total = np.uint64(np.sum(mix(tokens ^ np.uint64(0x5BD1E995)))) + np.uint64(len(tokens)) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _bitmap(tokens: np.ndarray, width: int = 0) -> bytes:
    """A bit per n-gram, set by its hash; four to eight places per n-gram if no width is given."""
    width = width or max(64, 1 << int(4 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[((tokens >> np.uint64(23)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _groups(rows: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cuts = np.flatnonzero(np.diff(rows)) + 1
    for part in np.split(np.arange(len(rows)), cuts) if len(rows) else []:
        yield int(rows[part[0]]), tokens[part]


def _measure(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, key, n, sid, bits, fold`` per document and, with null ids, the counters of the sketch in slices."""
    names = ["doc_id", "key", "n", "sid", "slice", "bits", "fold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch, data, ends in binary_batches(batches, "_text"):
            rows, tokens = shingle_sets(data, ends, words)
            counts += np.bincount((tokens % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS) if len(tokens) else 0
            n = np.bincount(rows, minlength=batch.num_rows) if len(rows) else np.zeros(batch.num_rows, np.int64)
            sid, bits, fold = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows
            for r, found in _groups(rows, tokens):
                sid[r], bits[r], fold[r] = _signature(found), _bitmap(found), np.frombuffer(_bitmap(found, 64 * FOLD), np.int64)
            columns = (pa.array(n), pa.array(sid), pa.nulls(batch.num_rows, pa.int32()), pa.array(bits, pa.binary()), pa.array(fold, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)
        parts = np.minimum(counts, 255).astype(np.uint8).reshape(SLICES, -1)
        used = [i for i in range(SLICES) if parts[i].any()]
        nulls = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([nulls, nulls, nulls, nulls, pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary()),
                                          pa.nulls(len(used), pa.list_(pa.int64()))], names=names)

    return docs.mapInArrow(run, "doc_id bigint, key bigint, n bigint, sid bigint, slice int, bits binary, fold array<bigint>")


def _add_slices(table: pa.Table) -> pa.Table:
    total = sum((np.frombuffer(c.as_py(), np.uint8).astype(np.int64) for c in table.column("bits")), np.zeros(COUNTERS // SLICES, np.int64))
    return pa.table({"slice": table.column("slice").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})


def _frequencies(measured: DataFrame) -> np.ndarray:
    """Estimated documents per counter; COUNTERS numbers, whatever the input."""
    out = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    slices = measured.where(F.col("slice").isNotNull()).select("slice", "bits")
    for r in slices.groupBy("slice").applyInArrow(_add_slices, "slice int, total binary").collect():
        out[r["slice"]] = np.frombuffer(r["total"], np.int64)
    return out.reshape(-1)


class _Order:
    """The global order: level of estimated frequency, then hash."""

    def __init__(self, counts: np.ndarray):
        load = counts.mean() + 1
        self.level = np.floor(np.log2(np.maximum(1, counts / load))).astype(np.uint8)
        self.salts = np.minimum(1 + counts // BUCKET, (1 << 15) - 1).astype(np.int16)
        # pivots cut the order into fragments of about equal mass
        mass = np.bincount(self.level, weights=counts + 1e-9, minlength=64)
        edges = np.cumsum(mass) / mass.sum()
        self.pivots = []
        for f in range(1, FRAGMENTS):
            share = f / FRAGMENTS
            at = int(np.searchsorted(edges, share))
            below = edges[at - 1] if at else 0.0
            inner = (share - below) / max(1e-12, edges[at] - below)
            self.pivots.append((at, np.uint64(min(0.999999, inner) * 2.0**64)))

    def levels(self, tokens: np.ndarray) -> np.ndarray:
        return self.level[(tokens % np.uint64(COUNTERS)).astype(np.int64)]

    def fragments(self, tokens: np.ndarray) -> np.ndarray:
        level = self.levels(tokens)
        return sum(((level > at) | ((level == at) & (tokens >= h))).astype(np.int64) for at, h in self.pivots)


def _prefixes(docs: DataFrame, words: int, percent: int, order) -> DataFrame:
    """``tok, salt, sid, n, p, m``: the n-grams from which the prefix of ``p`` of a set is chosen.

    These are all of the first block, whose exact frequencies are counted later, or if
    there are fewer than ``p`` the first ``p`` in the order. ``m`` of an n-gram in the
    first block is the number of the set's n-grams there; beyond the block it is the
    place in the order, negated. Copies met by the same task count once. The salt is -1,
    or the part of a bucket that is expected to be large.
    """
    names = ("tok", "salt", "sid", "n", "p", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = order.value, set()
        for _, data, ends in binary_batches(batches, "_text"):
            out: list[tuple[np.ndarray, int, int, int, np.ndarray]] = []
            for _, found in _groups(*shingle_sets(data, ends, words)):
                sid, n = _signature(found), len(found)
                if (sid, n) in met:
                    continue
                met.add((sid, n))
                p = n - -(-percent * n // 100) + 1
                level = known.levels(found)
                block = found[(level == 0) & (found < FIRST_BLOCK)]
                # hashes are sorted already: whole levels first, so the block before all others, then the first of the last level
                chosen = block if len(block) >= p else found[np.argsort(level, kind="stable")[:p]]
                out.append((chosen, sid, n, p, np.where(np.arange(len(chosen)) < len(block), len(block), -1 - np.arange(len(chosen)))))
            if out:
                tok = np.concatenate([o[0] for o in out])
                size = [len(o[0]) for o in out]
                sids, n, p = (np.repeat(np.array([o[k] for o in out], np.int64), size) for k in (1, 2, 3))
                parts = np.where(known.levels(tok) > 0, known.salts[(tok % np.uint64(COUNTERS)).astype(np.int64)], 1).astype(np.uint64)
                salt = np.where(parts > 1, (sids.view(np.uint64) % parts).astype(np.int64), -1)
                columns = (tok.view(np.int64), salt.astype(np.int16), sids, n.astype(np.int32), p.astype(np.int32), np.concatenate([o[4] for o in out]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return docs.mapInArrow(run, "tok bigint, salt smallint, sid bigint, n int, p int, m int")


def _company(sorted_rows: DataFrame) -> DataFrame:
    """Members of buckets of two or more, copies removed; of a split bucket all.

    Rows come sorted by ``tok, salt, sid, n``; a task holds one batch and one row.
    """
    names = ("tok", "salt", "sid", "n", "p", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, together = None, False  # the last row, and whether it is in the bucket of the row before it
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {k: batch.column(k).to_numpy() for k in names}
            if held:
                new = {k: np.concatenate([[held[k]], v]) for k, v in new.items()}
            same = np.zeros(len(new["tok"]), bool)
            same[1:] = (new["tok"][1:] == new["tok"][:-1]) & (new["salt"][1:] == new["salt"][:-1])
            copy = same.copy()
            copy[1:] &= (new["sid"][1:] == new["sid"][:-1]) & (new["n"][1:] == new["n"][:-1])
            same[0] = together
            new, same = {k: v[~copy] for k, v in new.items()}, same[~copy]
            keep = same | (new["salt"] >= 0)
            keep[:-1] |= same[1:]
            where = np.flatnonzero(keep[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(new[k][where]) for k in names], names=names)
            held, together = {k: v[-1] for k, v in new.items()}, bool(same[-1])
        if held and (together or held["salt"] >= 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.array([held[k]])) for k in names], names=names)

    return sorted_rows.mapInArrow(run, "tok bigint, salt smallint, sid bigint, n int, p int, m int")


def _buckets(rows: DataFrame) -> DataFrame:
    """``tok, salt, sid, n, pos``: the n-grams with company in the prefix of each set and their place in it.

    In the first block n-grams are ordered by exact frequency. Those that a set has
    alone come first and take up its prefix without being here. Beyond the block
    frequencies count prefixes only, so the place is the one given by the order.
    """
    frequency = rows.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    per_set = Window.partitionBy("sid", "n")
    in_block = F.col("m") > 0
    ranked = rows.join(frequency, "tok").withColumn("met", F.count(F.when(in_block, 1)).over(per_set)).withColumn(
        "place", F.row_number().over(per_set.orderBy(~in_block, "df", "tok")))
    pos = F.when(in_block, F.col("place") + F.col("m") - F.col("met")).otherwise(-F.col("m"))
    return ranked.withColumn("pos", pos.cast("long")).where(F.col("pos") <= F.col("p")).select("tok", "salt", "sid", F.col("n").cast("long").alias("n"), "pos")


def _chain(rows: DataFrame, *keys: str) -> DataFrame:
    """Pairs of each member of a bucket with some before it and with the first one."""
    run = Window.partitionBy(*keys).orderBy("n", "sid")
    one = F.struct("sid", "n")
    met = rows.select("sid", "n", F.array(F.first(one).over(run), *[F.lag(one, k).over(run) for k in LAGS]).alias("others"))
    ends = met.select("sid", "n", F.explode("others").alias("o")).where(F.col("o").isNotNull()).select("sid", "n", F.col("o.sid").alias("other"), F.col("o.n").alias("other_n"))
    return ends.select(_pair("sid", "other", "n", "other_n").alias("p")).select("p.*")


def _near(a: str, b: str, percent: int):
    """Sizes of sets that can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _enough_left(percent: int):
    """If this is the first n-gram that two sets share, what follows it can still hold the overlap they need."""
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    return rest * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _pair(x: str, y: str, nx: str, ny: str):
    swap = F.col(x) > F.col(y)
    return F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(swap, F.col(ny)).otherwise(F.col(nx)).alias("na"),
                    F.when(swap, F.col(nx)).otherwise(F.col(ny)).alias("nb"))


def _may_link(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps differ in no more places than n-grams may differ.

    A place set in one bitmap only is an n-gram of one set only, so no link is lost;
    of two widths the larger is folded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, left, right in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                a, b = int.from_bytes(left, "little"), int.from_bytes(right, "little")
                wa, wb = len(left) * 8, len(right) * 8
                while wa > wb:
                    wa //= 2
                    a = (a >> wa) | (a & ((1 << wa) - 1))
                while wb > wa:
                    wb //= 2
                    b = (b >> wb) | (b & ((1 << wb) - 1))
                keep.append((a ^ b).bit_count() * (100 + percent) <= (100 - percent) * (na + nb))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    left, right = (bitmaps.select(F.col("sid").alias(k), F.col("bits").alias(f"{k}_bits")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "a_bits", "b_bits").mapInArrow(
        run, "a bigint, b bigint, na bigint, nb bigint")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: overlaps counted per fragment, then summed."""
    left = sets.select(F.col("sid").alias("a"), "frag", F.col("toks").alias("left"))
    right = sets.select(F.col("sid").alias("b"), "frag", F.col("toks").alias("right"))
    partial = pairs.join(left, "a").join(right, ["b", "frag"]).select(
        "a", "b", "na", "nb", "frag", F.size(F.array_intersect("left", "right")).alias("part"))
    # repeated rows give a set twice: count it once
    partial = partial.groupBy("a", "b", "na", "nb", "frag").agg(F.max("part").alias("part"))
    both = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return both.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _sets(docs: DataFrame, words: int, order) -> DataFrame:
    """``sid, frag, toks``: the part of each set that lies in each fragment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = order.value
        for batch, data, ends in binary_batches(batches, "_text", 128):
            sids = batch.column(0).to_pylist()
            out_sid, out_frag, out = [], [], []
            for r, found in _groups(*shingle_sets(data, ends, words)):
                if _signature(found) != sids[r]:  # another text with the same key
                    continue
                frag = known.fragments(found)
                for f in range(FRAGMENTS):
                    part = found[frag == f]
                    if len(part):
                        out_sid.append(sids[r]), out_frag.append(f), out.append(part.view(np.int64))
            if out:
                sizes = np.cumsum([0, *map(len, out)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_sid, pa.int64()), pa.array(out_frag, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(out)))],
                    names=["sid", "frag", "toks"])

    return docs.mapInArrow(run, "sid bigint, frag int, toks array<bigint>")


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Sets hold the distinct shingles of ``words`` words (A-Z lower-cased), the whole
    sequence if there are fewer. Two documents link when 100 * intersection >=
    ``percent`` * union. A null or empty text, or one of blanks, has no shingles and
    links with nothing. Equal sets, so also repeated rows, are linked. A row without an
    id links as any other; ids only name components, and one without any id has a null
    name. No rows give none.
    """
    texts = keyed(docs, id_col, text_col)
    return keyed_components(texts, words, percent).select("doc_id", "n_shingles", "component_id")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, _text``: the key names a row by id and text, so only rows that are equal in both share it."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("_text"))


def row_key(doc_id: Column, text: Column) -> Column:
    """64-bit name of a row by its id, which may be null, and its text."""
    return F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(-1)), doc_id.isNull(), text)


def keyed_components(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, key, n_shingles, root, component_id`` for ``texts (doc_id, key, _text)``; the root, null without shingles, tells components apart that have no id."""
    spark = texts.sparkSession
    measured = stored(_measure(texts, words))
    order = spark.sparkContext.broadcast(_Order(_frequencies(measured)))  # two numbers per counter
    members = measured.where(F.col("slice").isNull()).select("doc_id", "key", "n", "sid", "bits", "fold")
    rows = _prefixes(texts.select("_text"), words, percent, order)
    keys = ["tok", "salt"]
    company = stored(_company(rows.repartition(*keys).sortWithinPartitions(*keys, "sid", "n")))
    release(spark)
    buckets = stored(_buckets(company))
    # the first of each part of a split bucket meet in a chain of their own
    heads = buckets.where(F.col("salt") >= 0).groupBy("tok", "salt").agg(F.min(F.struct("n", "sid")).alias("h")).select("tok", "h.n", "h.sid")
    pairs = _chain(buckets, "tok", "salt").unionByName(_chain(heads, "tok"))
    pairs = pairs.where((F.col("a") != F.col("b")) & _near("na", "nb", percent)).distinct()
    release(spark)
    bitmaps = stored(members.where(F.col("n") > 0).groupBy("sid").agg(F.min_by("bits", "key").alias("bits"), F.min_by("fold", "key").alias("fold"), F.min("key").alias("key")))
    likely = stored(_may_link(pairs.select("a", "b", "na", "nb"), bitmaps, percent))
    # first up to three partners of each set
    ends = likely.select(F.explode(F.array("a", "b")).alias("x"), F.struct(F.xxhash64("a", "b").alias("h"), "a", "b", "na", "nb").alias("p"))
    best = ends.groupBy("x").agg(F.min("p").alias("p1"), F.max("p").alias("p2"), F.min_by("p", F.struct(F.xxhash64("p.h"))).alias("p3"))
    first = stored(best.select(F.explode(F.array("p1", "p2", "p3")).alias("p")).select("p.a", "p.b", "p.na", "p.nb").distinct())
    release(spark)
    sets = stored(_sets(_read(texts, _readers(first, bitmaps)), words, order))
    release(spark)
    roots = stored(components(stored(_similar(first, sets, percent))))
    members_of = buckets.select("tok", "sid", "n", "pos")
    have = stored(sets.select("sid").distinct())
    met_before = first
    placed = _place(members_of, roots)
    for k in range(ROUNDS):
        tested = _bridges(placed.join(have, "sid", "left_semi"), k, percent).join(met_before, ["a", "b", "na", "nb"], "left_anti")
        tested = stored(_may_link(tested, bitmaps, percent))
        new = stored(_similar(tested, sets, percent))
        met_before = met_before.unionByName(tested)
        if not new.take(1):
            break
        roots, joined = _more_links(roots, new)
        placed = stored(_follow(placed, joined))
    release(spark)
    # then all pairs of a bucket that lie in different components
    mixed = placed.groupBy("tok").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("tok")
    open_rows = placed.join(mixed, "tok").join(bitmaps.select("sid", *[F.col("fold")[k].alias(f"f{k}") for k in range(FOLD)]), "sid")
    x = open_rows.select("tok", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ra"), *[F.col(f"f{k}").alias(f"a{k}") for k in range(FOLD)])
    y = open_rows.select("tok", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("root").alias("rb"), *[F.col(f"f{k}").alias(f"b{k}") for k in range(FOLD)])
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(FOLD)), F.lit(0))
    rest = (x.join(y, "tok").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _near("na", "nb", percent) & _enough_left(percent) & (apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)))
            .select("a", "b", "na", "nb").distinct().join(met_before, ["a", "b", "na", "nb"], "left_anti"))
    rest = stored(_may_link(rest, bitmaps, percent))
    release(spark)
    lacking = _readers(rest, bitmaps).join(sets.select("sid").distinct(), "sid", "left_anti")
    sets = sets.unionByName(stored(_sets(_read(texts, lacking), words, order)))
    roots, _ = _more_links(roots, stored(_similar(rest, sets, percent)))
    named = members.drop("bits", "fold").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "root", F.when(F.col("n") > 0, F.coalesce("root", "sid")))
    least = named.where(F.col("n") > 0).groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), "root", F.coalesce("least", "doc_id").alias("component_id"))


def _more_links(roots: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components after ``new`` links, and ``node, root`` for those that have been joined; only these enter the search."""
    left, right = (roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")) for k in "ab")
    between = new.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    joined = stored(components(stored(between)))
    return stored(_follow(roots, joined).unionByName(joined.join(roots, "node", "left_anti"))), joined


def _follow(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``rows`` with the root that their root hangs on now."""
    return rows.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").withColumn(
        "root", F.coalesce("top", "root")).select(*rows.columns)


def _place(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """``tok, sid, n, pos, root``: bucket members with their component so far."""
    return stored(buckets.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("tok", "sid", "n", "pos", F.coalesce("root", "sid").alias("root")))


def _bridges(placed: DataFrame, k: int, percent: int) -> DataFrame:
    """In each bucket a pair between the largest component and each other one; other members in other rounds and buckets."""
    parts = placed.groupBy("tok", "root").agg(F.count(F.lit(1)).alias("rows"), F.min_by(F.struct("sid", "n"), F.xxhash64("sid", "tok", F.lit(k))).alias("one"))
    parts = stored(parts)
    top = parts.groupBy("tok").agg(F.max(F.struct("rows", "root", "one")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    met = parts.join(top, "tok").where(F.col("root") != F.col("top.root")).select(
        F.col("one.sid").alias("x"), F.col("one.n").alias("nx"), F.col("top.one.sid").alias("y"), F.col("top.one.n").alias("ny"))
    return met.select(_pair("x", "y", "nx", "ny").alias("p")).select("p.*").where(_near("na", "nb", percent)).distinct()


def _readers(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``key, sid``: for each set in ``pairs`` the row to read it from."""
    sids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    return bitmaps.join(sids, "sid", "left_semi").select("key", "sid")


def _read(texts: DataFrame, readers: DataFrame) -> DataFrame:
    """``sid, _text`` of the rows in ``readers``; copies without an id, which share a key, are read once."""
    named = texts.where(F.col("doc_id").isNotNull()).select("key", "_text")
    nameless = texts.where(F.col("doc_id").isNull()).select("key", "_text").distinct()
    return named.unionByName(nameless).join(readers, "key").select("sid", "_text")


def op3_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)
