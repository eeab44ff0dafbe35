"""Ranked lexical search that scores each distinct bag of item words once.

Documents are restricted to the words of the test items. Documents with the same
term frequencies and the same length measure ``m`` have the same score for every
item, so they form a class: its hash brings the rows together, the vectors decide.
A class is scored once, and only its members with the smallest ids can enter a
list of the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.llm.common import binary_batches, stored
from canopyframe.llm.terms import term_hashes, term_spans

#: Texts whose terms are counted at a time, and numbers of a table of scores.
TEXTS, CELLS = 512, 1 << 22
#: Terms of the items that are scored at a time; more items go in further blocks.
BLOCK_TERMS = 200_000
#: Stands for a null id, which comes after all others.
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Items:
    """Items as numbers of their distinct terms; ``terms`` are the sorted hashes of the vocabulary."""
    numbers: list[int]
    terms: np.ndarray
    item_from: np.ndarray
    held: np.ndarray


def _items(rows: list[tuple[int, str]]) -> Items:
    hashes = []
    for _, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        hashes.append(np.unique(term_hashes(data, *term_spans(data, np.array([0, len(data)])))))
    full = [(n, h) for (n, _), h in zip(rows, hashes) if len(h)]
    terms = np.unique(np.concatenate([h for _, h in full])) if full else np.zeros(0, np.uint64)
    held = [np.searchsorted(terms, h) for _, h in full]
    sizes = np.array([len(h) for h in held], np.int64)
    return Items([n for n, _ in full], terms, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(held) if held else np.zeros(0, np.int64))


def _blocks(items: DataFrame, block_terms: int) -> Iterator[Items]:
    held, size = [], 0
    for r in items.where("t is not null").toLocalIterator():
        held.append((r["_no"], r["t"]))
        size += len(r["t"]) // 2 + 1
        if size >= block_terms:
            yield _items(held)
            held, size = [], 0
    if held:
        yield _items(held)


def _bags(docs: DataFrame, shared) -> DataFrame:
    """``doc_id, n, bag``: number of terms, and (term, frequency) pairs of the vocabulary as 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.terms
        for batch, data, ends in binary_batches(batches, "_text", TEXTS):
            starts, stops = term_spans(data, ends)
            word_from = np.searchsorted(starts, ends)
            hashes = term_hashes(data, starts, stops)
            at = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
            known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
            row = np.searchsorted(word_from, np.flatnonzero(known), "right") - 1
            pairs, counts = np.unique(row * max(1, len(vocabulary)) + at[known], return_counts=True)
            body = np.column_stack([pairs % max(1, len(vocabulary)), counts]).astype("<i4")
            cuts = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * max(1, len(vocabulary))) * 8
            bags = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(body.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(word_from)), bags.cast(pa.binary())], names=["doc_id", "n", "bag"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, bag binary")


def _frequencies(bags: DataFrame) -> dict[int, int]:
    """Documents that hold each term: sums per task, then over tasks; as many numbers as the block has terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            terms, _, _ = _pairs(batch.column(0))
            found = np.bincount(terms, minlength=len(total))
            found[:len(total)] += total
            total = found
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])

    return {r["term"]: r["df"] for r in bags.select("bag").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _pairs(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and frequencies of all bags, and where each bag begins."""
    bags = bags.cast(pa.large_binary())
    _, offsets, data = bags.buffers()
    cuts = np.frombuffer(offsets, np.int64, len(bags) + 1, bags.offset * 8)
    flat = np.frombuffer(data, np.uint8)[cuts[0]:cuts[-1]].view("<i4") if data is not None else np.zeros(0, "<i4")
    return flat[::2].astype(np.int64), flat[1::2].astype(np.int64), (cuts - cuts[0]) // 8


def class_scores(terms: np.ndarray, counts: np.ndarray, cuts: np.ndarray, m: np.ndarray, weights: np.ndarray, items: Items) -> np.ndarray:
    """Score of each class (row) for each item, in whole numbers."""
    row = np.repeat(np.arange(len(m)), np.diff(cuts))
    table = np.zeros((len(weights), len(m)), np.int64)
    table[terms, row] = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[row]))
    out = np.empty((len(items.numbers), len(m)), np.int64)
    step = max(1, CELLS // max(1, len(m)))
    at = 0
    while at < len(items.numbers):  # as many items as fill a table of bounded size
        to = max(at + 1, int(np.searchsorted(items.item_from, items.item_from[at] + step, "right")) - 1)
        low, high = items.item_from[at], items.item_from[to]
        out[at:to] = np.add.reduceat(table[items.held[low:high]], items.item_from[at:to] - low, axis=0)
        at = to
    return out.T


def _best(rows: DataFrame, shared, top: int) -> DataFrame:
    """``_no, doc_id, score`` of the best rows of each task; rows of a class come one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        floor = np.zeros(len(items.numbers), np.int64)
        held = [np.zeros(0, np.int64)] * 3
        size = max(16, CELLS // max(1, len(weights)))
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                h, m, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "m", "doc_id"))
                bags = batch.column("bag")
                new = np.ones(len(h), bool)  # equal hash and m, then equal vectors
                for i in np.flatnonzero((h[1:] == h[:-1]) & (m[1:] == m[:-1])) + 1:
                    new[i] = not bags[int(i)].equals(bags[int(i) - 1])
                one = np.flatnonzero(new)
                scores = class_scores(*_pairs(bags.take(pa.array(one))), m[one], weights, items)[np.cumsum(new) - 1]
                r, item = np.nonzero((scores >= floor) & (scores > 0))
                held = [np.concatenate([a, b]) for a, b in zip(held, (item, doc[r], scores[r, item]))]
                order = np.lexsort((held[1], -held[2], held[0]))
                held = [a[order] for a in held]
                first = np.searchsorted(held[0], np.arange(len(floor)))
                place = np.arange(len(order)) - first[held[0]]
                last = np.flatnonzero(place == top - 1)
                floor[held[0][last]] = held[2][last]
                held = [a[place < top] for a in held]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(items.numbers, np.int64)[held[0]]), pa.array(held[1]), pa.array(held[2])],
                                         names=["_no", "doc_id", "score"])

    return rows.select("h", "m", "doc_id", "bag").mapInArrow(run, "_no bigint, doc_id bigint, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item with a score above 0.

    Terms are runs of digits, letters and characters beyond ASCII with A-Z as a-z, known by
    64-bit hashes. A score is the sum over the item's distinct terms of
    ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` with ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and
    ``m = 10 + (90 * n * N) div L``, where N documents have L terms, n of them this one.
    Equal scores go by ascending id, null ids last. Null and empty texts have no terms, on either
    side. Repeated rows are documents, and items, of their own. Without documents or items there are no rows.
    Other columns are ignored. Items are scored in blocks of about ``block_terms`` terms, each in a pass of its own.
    """
    named = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("t"))
    numbered = stored(named.withColumn("_no", F.monotonically_increasing_id()))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    spark = docs.sparkSession
    found = [b for b in (_block(spark, texts, block, top) for block in _blocks(numbered, block_terms)) if b is not None]
    best = spark.createDataFrame([], "_no bigint, doc_id bigint, score bigint") if not found else found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    place = F.row_number().over(Window.partitionBy("_no").orderBy(F.desc("score"), F.asc("doc_id")))
    ranked = best.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(numbered.select("_no", "item_id"), "_no").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != int(_LAST), F.col("doc_id")).alias("doc_id"), "score")


def _block(spark, texts: DataFrame, items: Items, top: int) -> DataFrame | None:
    """The best rows of each task for the items of one block."""
    bags = stored(_bags(texts, spark.sparkContext.broadcast(items)))
    ends = bags.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not ends["docs"]:
        return None
    frequency = _frequencies(bags)
    weights = np.array([math.floor(1000 * math.log((2 * ends["docs"] + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(items.terms))], np.int64)
    m = F.expr(f"cast(10 + (cast(90 as decimal(38, 0)) * n * {ends['docs']}) div {ends['terms']} as bigint)")
    rows = bags.where(F.octet_length("bag") > 0).select(m.alias("m"), F.xxhash64("bag").alias("h"), "bag", F.coalesce("doc_id", F.lit(int(_LAST))).alias("doc_id"))
    # members of a class beyond its `top` smallest ids cannot be in any list; tasks drop theirs before the shuffle
    place = F.row_number().over(Window.partitionBy("h", "m", "bag").orderBy("doc_id"))
    members = rows.withColumn("_at", place).where(F.col("_at") <= top)
    return _best(members, spark.sparkContext.broadcast((items, weights)), top)


def op13_bag_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return ranked_search(docs, benchmark)
