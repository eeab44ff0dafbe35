"""Removal of repeated passages with a sparse suffix array.

Every string of ``length`` bytes holds an anchor: the position whose GRAM bytes hash
lowest in it. Equal strings have their anchors in the same place, so a suffix array
of the anchors finds all of them. Suffixes are bucketed by the anchor's hash; in a
bucket they are put in order by deep-shallow sorting, multikey quicksort to a
shallow depth and blind tries for the groups that are still equal there. The
same is done backwards for what precedes the anchors. Common prefixes of neighbours
in both orders tell how far each anchor's surroundings occur elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.common import binary_batches, release, stored
from canopyframe.llm.shingles import mix

GRAM = 64
#: Bytes to which multikey quicksort goes; blind tries order what is equal so far.
SHALLOW = 24
#: Bytes compared as one symbol.
SYMBOL = 8
#: Different surroundings of an anchor that one task sorts; larger buckets are split by window.
BUCKET = 50_000
#: Bytes of text whose anchors are looked for at a time.
STRETCH = 1 << 20

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FACTORS = mix(np.arange(301, 341, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each position, put together from halves."""
    h, step, k = _TABLE[data], 1, 0
    while step * 2 <= GRAM:
        h = h[:-step] * _FACTORS[k] + h[step:]
        step, k = step * 2, k + 1
    if step < GRAM:  # two overlapping halves
        h = h[:step - GRAM] * _FACTORS[k] + h[GRAM - step:]
    return mix(h) | np.uint64(1)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return pick(x[:-rest], x[rest:]) if rest else x


def _anchors(hashes: np.ndarray, ends: np.ndarray, length: int, total: int) -> np.ndarray:
    """Positions that are the lowest of some string of ``length`` bytes inside one text."""
    width = length - GRAM + 1
    found = []
    for at in range(0, total - length + 1, STRETCH):
        some = hashes[at:at + STRETCH + width - 1]
        low = _sliding(some, width, np.minimum)
        # strings that cross the end of a text don't count
        for e in ends[np.searchsorted(ends, at, "right"):]:
            if e - at - length + 1 >= len(low):
                break
            low[max(0, e - at - length + 1):e - at] = 0
        padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
        found.append(np.flatnonzero(_sliding(padded, width, np.maximum) == some) + at)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _surroundings(hashes: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Bytes before and from each anchor that matter, and a hash of them all."""
    before, after = np.minimum(at - low, length - GRAM), np.minimum(high - at, length)
    total = before.astype(np.uint64) * _FACTORS[30] + after.astype(np.uint64) * _FACTORS[31]
    for k, shift in enumerate(range(GRAM - length, length, GRAM)):
        place = np.clip(at + min(shift, length - GRAM), at - before, at + after - GRAM)
        total = total * _FACTORS[32] + mix(hashes[place] ^ _FACTORS[k % 30])
    return before, after, mix(total)


def _find_anchors(texts: DataFrame, length: int) -> DataFrame:
    """``h, c, k1, k2, place`` of each anchor: hashes of its gram and of its surroundings, its text's key, and where it is.

    ``place`` is the position, the bytes before and the bytes after that matter, in 32, 16 and 16 bits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch, data, ends in binary_batches(batches, "_text", 96):
                if len(data) < length:
                    continue
                hashes = _gram_hashes(data)
                at = _anchors(hashes, ends[1:], length, len(data))
                if not len(at):
                    continue
                row = np.searchsorted(ends, at, "right") - 1
                before, after, c = _surroundings(hashes, at, ends[row], ends[row + 1], length)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[at].view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take),
                     pa.array((at - ends[row]) << 32 | before.astype(np.int64) << 16 | after.astype(np.int64))],
                    names=["h", "c", "k1", "k2", "place"])

    return texts.mapInArrow(run, "h bigint, c bigint, k1 bigint, k2 bigint, place bigint")


_AT, _BEFORE, _AFTER = "shiftright(place, 32)", "shiftright(place, 16) & 65535", "place & 65535"


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


def _blind_trie(items: list[int], strings: list[bytes]) -> list[int]:
    """Order of strings by a trie that keeps branching depths only; equal strings stay side by side.

    A node is [depth, children by the byte at that depth]; a leaf is a list of items.
    """
    root: list = [items[0]]
    leaf = lambda node: isinstance(node[0], int) and not (len(node) > 1 and isinstance(node[1], dict))
    for item in items[1:]:
        s, node = strings[item], root
        while not leaf(node):  # blind descent: only the branching bytes are looked at
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = strings[node[0]]
        same = common_prefix(s, other)
        if same == len(s) == len(other):
            node.append(item)
            continue
        parent, node, byte = None, root, -1
        while not leaf(node) and node[0] < same:
            byte = s[node[0]] if node[0] < len(s) else -1
            parent, node = node, node[1][byte]
        new = s[same] if same < len(s) else -1
        if not leaf(node) and node[0] == same:
            node[1][new] = [item]
            continue
        branch = [same, {(other[same] if same < len(other) else -1): node, new: [item]}]
        if parent is None:
            root = branch
        else:
            parent[1][byte] = branch
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if leaf(node):
            out.extend(node)
        else:
            todo.extend(node[1][k] for k in sorted(node[1], reverse=True))
    return out


def deep_shallow(strings: list[bytes], start: int = 0) -> list[int]:
    """Indices of ``strings``, which agree in their first ``start`` bytes, in order."""
    out: list[int] = []
    todo: list[tuple[list[int], int, bool]] = [(list(range(len(strings))), start, False)]
    while todo:
        items, depth, ordered = todo.pop()
        if ordered or len(items) < 2:
            out.extend(items)
        elif depth >= start + SHALLOW:
            out.extend(_blind_trie(items, strings))
        else:
            symbols = [strings[i][depth:depth + SYMBOL] for i in items]
            pivot = sorted(symbols[:: max(1, len(symbols) // 7)])[len(symbols[:: max(1, len(symbols) // 7)]) // 2]
            less = [i for i, s in zip(items, symbols) if s < pivot]
            more = [i for i, s in zip(items, symbols) if s > pivot]
            same = [i for i, s in zip(items, symbols) if s == pivot]
            # a symbol cut short by the end of its string is a whole string
            todo += [(more, depth, False), (same, depth + SYMBOL, len(pivot) < SYMBOL), (less, depth, False)]
    return out


def _classes(order: list[int], common: list[int], depth: int) -> list[int]:
    """Number of the class of each string when those with ``depth`` equal bytes are one class."""
    out, k = [0] * len(order), 0
    for place, item in enumerate(order):
        k += place > 0 and common[place] < depth
        out[item] = k
    return out


def reaches(left: list[bytes], right: list[bytes], times: list[int], length: int) -> list[tuple[int, int]]:
    """How many bytes before and from an anchor lie in strings of ``length`` bytes that occur again.

    ``left`` and ``right`` are the different surroundings of one anchor, each met ``times`` times.
    """
    n = len(left)
    found = [(len(a), len(b)) if t > 1 and len(a) + len(b) >= length else (-1, -1) for a, b, t in zip(left, right, times)]
    if n == 1:
        return found
    back = [a[::-1] for a in left]
    forward, backward = deep_shallow(right, GRAM), deep_shallow(back)
    ahead = [0] + [common_prefix(right[a], right[b]) for a, b in zip(forward, forward[1:])]
    behind = [0] + [common_prefix(back[a], back[b]) for a, b in zip(backward, backward[1:])]
    # the farthest reaches are common prefixes of neighbours, so only these starts need a look
    starts = {length - x for x in ahead[1:]} | set(behind[1:])
    for d in sorted(x for x in starts if 0 <= x <= length - GRAM):
        ours, theirs = _classes(forward, ahead, length - d), _classes(backward, behind, d)
        groups: dict[tuple[int, int], list[int]] = {}
        for i in range(n):
            if len(left[i]) >= d and len(right[i]) >= length - d:
                groups.setdefault((ours[i], theirs[i]), []).append(i)
        for group in groups.values():
            if len(group) > 1:
                for i in group:
                    a, b = found[i]
                    found[i] = (max(a, d), max(b, length - d))
    return found


def _sort_buckets(rows: DataFrame, length: int) -> DataFrame:
    """Reaches of the surroundings in each bucket; rows come sorted by anchor hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def solve() -> None:  # different surroundings only
            for row, (a, b) in zip(held, reaches([r[2] for r in held], [r[3] for r in held], [r[4] for r in held], length)):
                if a >= 0:
                    out.append((row[0], row[1], a, b))

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64() if k < 2 else pa.int32()) for k in range(4)],
                                              names=["h", "c", "reach_back", "reach"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held and held[0][0] != row[0]:
                    solve()
                    held.clear()
                if not held or held[-1][1] != row[1]:  # rows with equal id and text each bring their cut
                    held.append(row)
            if len(out) > 5000:
                yield batch_of(out)
                out.clear()
        if held:
            solve()
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, "h bigint, c bigint, reach_back int, reach int")


def _split_buckets(rows: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any size: each string through the anchor is counted by itself."""
    both = F.concat("left", "right")
    low = F.greatest(F.lit(0), F.lit(length) - F.octet_length("right"))
    starts = F.when(low <= F.octet_length("left"), F.sequence(low, F.octet_length("left"))).otherwise(F.array().cast("array<int>"))
    strings = rows.select("h", "c", "times", both.alias("both"), F.octet_length("left").alias("n"), F.explode(starts).alias("d"))
    piece = F.substring("both", F.col("n") - F.col("d") + 1, F.lit(length))
    strings = strings.select("h", "c", "times", "d", F.xxhash64(piece).alias("w1"), F.xxhash64(F.lit("second"), piece).alias("w2"))
    again = strings.groupBy("h", "d", "w1", "w2").agg(F.sum("times").alias("all")).where(F.col("all") > 1).select("h", "d", "w1", "w2")
    return strings.join(again, ["h", "d", "w1", "w2"], "left_semi").groupBy("h", "c").agg(
        F.max("d").cast("int").alias("reach_back"), F.max(F.lit(length) - F.col("d")).cast("int").alias("reach"))


def _cut_texts(texts: DataFrame, at: DataFrame) -> DataFrame:
    """``h, c, left, right, times``: the bytes around one anchor for each of its surroundings."""
    spot = F.struct("h", "c", F.expr(_AT).alias("at"), F.expr(_BEFORE).alias("before"), F.expr(_AFTER).alias("after"), "times")
    per_doc = at.groupBy("k1", "k2").agg(F.collect_list(spot).alias("spots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in binary_batches(batches, "_text", 128):
            raw = data.tobytes()
            out = []
            for start, spots in zip(ends[:-1], batch.column(0).to_pylist()):
                for s in spots:
                    p = int(start) + s["at"]
                    out.append((s["h"], s["c"], raw[p - s["before"]:p], raw[p:p + s["after"]], s["times"]))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["h", "c", "left", "right", "times"])

    return (texts.join(per_doc, ["k1", "k2"]).select("spots", "_text")
            .mapInArrow(run, "h bigint, c bigint, left binary, right binary, times bigint"))


def _repeated(texts: DataFrame, length: int) -> DataFrame:
    """``h, c, k1, k2, place`` of the anchors whose gram occurs twice or more."""
    # the anchors are found twice rather than kept: reading texts costs less than a table of all anchors
    anchors = _find_anchors(texts, length)
    twice = stored(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("h"))
    release(texts.sparkSession)
    # a table of its own on the other side lets Spark split the join at a very common anchor
    return stored(anchors.join(twice, "h", "left_semi"))


def _reaches(texts: DataFrame, spots: DataFrame, length: int, bucket: int) -> DataFrame:
    """``h, c, reach_back, reach`` of the surroundings that hold repeated strings."""
    around = stored(spots.groupBy("h", "c").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("k1", "k2", "place")).alias("one")))
    sizes = around.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    # one kind of surroundings, met often: its suffixes are equal throughout
    alone = around.join(sizes.where(F.col("kinds") == 1).select("h"), "h", "left_semi").select("h", "c", "times", "one.place").selectExpr(
        "h", "c", "times", f"cast({_BEFORE} as int) as reach_back", f"cast({_AFTER} as int) as reach").where(
        (F.col("times") > 1) & (F.col("reach_back") + F.col("reach") >= length)).drop("times")
    sortable = around.join(sizes.where(F.col("kinds") > 1), "h").select("h", "c", "times", "one.*")
    large = stored(sizes.where(F.col("kinds") > bucket).select("h"))
    small = _cut_texts(texts, sortable.join(large, "h", "left_anti")).repartition("h").sortWithinPartitions("h", "c")
    found = alone.unionByName(_sort_buckets(small.select("h", "c", "left", "right", "times"), length))
    if large.take(1):
        found = found.unionByName(_split_buckets(_cut_texts(texts, sortable.join(large, "h", "left_semi")).dropDuplicates(["h", "c"]), length))
    return stored(found)


def _spans(docs: DataFrame, length: int, bucket: int) -> DataFrame:
    """``k1, k2, spans``: pieces (start, end) of each text to remove, in no order, not yet joined."""
    texts = docs.select("k1", "k2", "_text")
    spots = _repeated(texts.where(F.octet_length("_text") >= length), length)
    release(docs.sparkSession)
    reach = _reaches(texts, spots, length, bucket)
    release(docs.sparkSession)
    at = F.expr(_AT)
    return spots.join(reach, ["h", "c"]).select("k1", "k2", F.struct((at - F.col("reach_back")).alias("a"), (at + F.col("reach")).alias("b")).alias("s")).groupBy(
        "k1", "k2").agg(F.collect_set("s").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text",
                   digest_only: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and ``kept`` (the remaining bytes; with ``digest_only`` their SHA-256).

    Removes every byte covered by a string of ``length`` bytes that also starts
    anywhere else, in the same text or another, overlaps included; judged on the
    input. A null text counts as empty. Texts shorter than ``length`` stay whole.
    Repeated rows are copies of each other. No rows give none.

    Inside, a row is known by its id and 64 bits of hash of its text, one without id by
    128 bits of hash; rows that agree in that have the same text and share their result.
    """
    if not GRAM < length < 1 << 15:
        raise ValueError(f"length must be above {GRAM} and below {1 << 15}")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_text"))
    keyed = keyed.withColumns({"k1": F.coalesce("_id", F.xxhash64(F.lit("second"), "_text")), "k2": F.xxhash64("_text")})
    spans = _spans(keyed, length, bucket)
    kept_kind = "string" if digest_only else "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in binary_batches(batches, "_text", 256):
            raw, out = data.tobytes(), []
            for start, end, spans in zip(ends[:-1], ends[1:], batch.column(1).to_pylist()):
                body, kept, last, count = raw[start:end], [], 0, 0
                for s in sorted((s["a"], s["b"]) for s in spans or ()):
                    if s[0] > last or not count:
                        kept.append(body[last:s[0]])
                        count += 1
                    last = max(last, s[1])
                kept.append(body[last:])
                rest = b"".join(kept)
                out.append((len(body), len(body) - len(rest), count, hashlib.sha256(rest).hexdigest() if digest_only else rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest_only else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return keyed.join(spans, ["k1", "k2"], "left").select(F.col("_id").alias("doc_id"), "spans", "_text").mapInArrow(
        run, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {kept_kind}")


def op1_suffix_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest_only=True).withColumnRenamed("kept", "kept_sha256")
