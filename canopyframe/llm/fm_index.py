"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a bounded run of rows of one partition. Its words are symbols, each
document ends with a separator, and the shard's suffix array gives the last column
of its sorted rotations as a wavelet tree, one bit vector with ranks per level.
Test phrases are searched backwards, all at a time, by ranks in that tree. Rows
found are located by walking back to a sampled suffix position. Occurrences give
removal spans, which are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.common import binary_batches
from canopyframe.llm.terms import term_hashes, term_spans

#: Words of a phrase.
WINDOW = 10
#: Every SAMPLE-th suffix position is kept for locating, and the first of each document.
SAMPLE = 16
#: Rows of a shard.
SHARD_ROWS = 512
#: Words of the test items that are searched for at a time; more items go in further blocks.
BLOCK_WORDS = 2_000_000


# --- suffix array and index of a shard

def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes; the last symbol is one that occurs once, or the text ends in such symbols.

    Prefix doubling that sorts again only what is still equal. An unfinished
    suffix holds no separator in its known prefix, so reading on never leaves the text.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    keys = symbols[order]
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    open_places = np.flatnonzero(~alone)
    step = 1
    while len(open_places):
        suffixes = order[open_places]
        keys = rank[suffixes] * n + rank[suffixes + step]
        by = np.argsort(keys)
        suffixes, keys = suffixes[by], keys[by]
        order[open_places] = suffixes
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[suffixes] = open_places[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        open_places = open_places[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class BitRanks:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletTree:
    """Ranks of any symbol by one bit vector per level, highest bit first; zeros go before ones on the next level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n = len(symbols)
        self.levels: list[tuple[int, BitRanks, int]] = []
        for k in reversed(range(max(1, int(top).bit_length()))):
            bits = (symbols >> k) & 1 == 1
            zeros = symbols[~bits]
            self.levels.append((k, BitRanks(bits), len(zeros)))
            symbols = np.concatenate([zeros, symbols[bits]])
        first = np.ones(self.n, bool)
        first[1:] = symbols[1:] != symbols[:-1]
        self.starts = np.zeros(top + 1, np.int64)  # where each symbol's places begin below the last level
        self.starts[symbols[first]] = np.flatnonzero(first)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        for k, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> k) & 1 == 1, zeros + ones, at - ones)
        return at - self.starts[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its occurrences before that place."""
        symbol = np.zeros(len(at), np.int64)
        for k, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << k
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.starts[symbol]


class FmIndex:
    """Index of documents given as word hashes; ``lengths`` are their numbers of words."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray):
        docs, n = len(lengths), len(hashes) + len(lengths)
        self.vocabulary, found = np.unique(hashes, return_inverse=True)
        self.doc_starts = np.cumsum(lengths + 1) - lengths - 1
        stops = self.doc_starts + lengths
        text = np.empty(n, np.int64)
        text[stops] = np.arange(docs)  # separators differ, so no suffix is compared beyond its document
        words = np.ones(n, bool)
        words[stops] = False
        text[words] = found + docs
        order = suffix_array(text)
        text = np.where(words, text - docs + 1, 0)
        last = text[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1))])
        self.tree = WaveletTree(last, len(self.vocabulary))
        kept = (order % SAMPLE == 0) | (last == 0)
        self.sampled = BitRanks(kept)
        self.samples = order[kept]
        self.n = n

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for words that the shard lacks."""
        if not len(self.vocabulary):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, with the range of their rows; ``phrases`` holds symbols, one row each."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        done: list[tuple[np.ndarray, ...]] = []
        step = 0
        while len(which):
            symbol = phrases[which, lengths[which] - 1 - step]
            here = symbol > 0
            which, low, high, symbol = which[here], low[here], high[here], symbol[here]
            low = self.below[symbol] + self.tree.rank(symbol, low)
            high = self.below[symbol] + self.tree.rank(symbol, high)
            step += 1
            found = high > low
            whole = found & (lengths[which] == step)
            done.append((which[whole], low[whole], high[whole]))
            more = found & ~whole
            which, low, high = which[more], low[more], high[more]
        return tuple(np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by steps back to a sampled position."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            hit = self.sampled.get(at)
            out[todo[hit]] = self.samples[self.sampled.rank(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            symbol, before = self.tree.access(at)
            at = self.below[symbol] + before
            steps += 1
        return out


# --- test phrases

@dataclass(frozen=True)
class Phrases:
    """Distinct windows as rows of word hashes, and the items (numbers into ``ids``) that hold each."""
    hashes: np.ndarray
    lengths: np.ndarray
    item_from: np.ndarray
    items: np.ndarray
    ids: list[str]


def phrases_of(items: list[tuple[str | None, str]], window: int = WINDOW) -> Phrases:
    """Windows of the items; an item of fewer words is one window. Items without id are searched but not listed."""
    ids = sorted({i for i, _ in items if i is not None})
    number = {name: k for k, name in enumerate(ids)}
    rows, sizes, owners = [], [], []
    for name, text in items:
        data = np.frombuffer(text.encode(), np.uint8)
        starts, stops = term_spans(data, np.array([0, len(data)]))
        words = term_hashes(data, starts, stops)
        if not len(words):
            continue
        size = min(window, len(words))
        part = np.zeros((len(words) - size + 1, window), np.uint64)
        part[:, :size] = np.lib.stride_tricks.sliding_window_view(words, size)
        rows.append(part)
        sizes.append(np.full(len(part), size, np.int64))
        owners.append(np.full(len(part), -1 if name is None else number[name], np.int64))
    if not rows:
        return Phrases(np.zeros((0, window), np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), ids)
    table = np.column_stack([np.concatenate(sizes).astype(np.uint64), np.concatenate(rows)])
    distinct, which = np.unique(table, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack([which.ravel(), np.concatenate(owners)]), axis=0)
    pairs = pairs[pairs[:, 1] >= 0]
    item_from = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return Phrases(distinct[:, 1:], distinct[:, 0].astype(np.int64), item_from, pairs[:, 1], ids)


def _expand(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all ranges one after the other, and the range that each is from."""
    sizes = stops - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


def find_phrases(index: FmIndex, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit words as a mask over the index's text; document and item of each find, once per pair and sorted."""
    hit = np.zeros(index.n + 1, np.int64)
    empty = np.zeros(0, np.int64)
    which, low, high = index.search(index.symbols(phrases.hashes), phrases.lengths)
    if not len(which):
        return hit[:-1] > 0, empty, empty
    rows, of = _expand(low, high)
    places, found = index.locate(rows), which[of]
    np.add.at(hit, places, 1)
    np.add.at(hit, places + phrases.lengths[found], -1)
    doc = np.searchsorted(index.doc_starts, places, "right") - 1
    pairs = np.unique(doc * len(phrases.lengths) + found)
    doc, found = pairs // len(phrases.lengths), pairs % len(phrases.lengths)
    items, of = _expand(phrases.item_from[found], phrases.item_from[found + 1])
    pairs = np.unique(doc[of] * max(1, len(phrases.ids)) + phrases.items[items])
    return np.cumsum(hit)[:-1] > 0, pairs // max(1, len(phrases.ids)), pairs % max(1, len(phrases.ids))


# --- over tables

def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Phrases]:
    """The items in blocks of bounded size, read one after the other."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    held, size, sent = [], 0, 0
    for r in rows.toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len(r["t"]) // 2 + 1
        if size >= block_words:
            yield phrases_of(held, window)
            held, size, sent = [], 0, sent + 1
    if held or not sent:
        yield phrases_of(held, window)


SPAN = "struct<first_word:bigint,n_words:bigint,start:bigint,stop:bigint>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``keep`` columns, ``n_words``, ``spans`` and ``items`` of each row of ``docs``.

    A window is ``window`` consecutive words of an item, or all words of an item that has fewer.
    ``spans`` are the merged runs of words inside an occurrence of any window, with their
    first word, number of words and bytes (start, stop) in the UTF-8 text; ``items`` are the
    ids, as sorted strings, of the items with an occurring window. Words are runs of digits,
    letters and characters beyond ASCII with A-Z as a-z, known by 64-bit hashes. Null and
    empty texts have no words, on either side. Repeated rows are found each; rows of one
    item id are one item; items without id mark words but are not listed. An empty
    ``docs`` gives no rows, an empty ``benchmark`` no spans. Further columns are ignored.

    Shards are rows of one task, so nothing is shuffled. Test items reach the tasks in
    blocks of about ``block_words`` words; more blocks mean further passes in the same stage.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, names)], F.col(f"`{text_col}`").alias("_text"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    shape = f"{kinds}, _text string, n_words bigint, spans array<{SPAN}>, items array<string>"
    rows = rows.selectExpr(*names, "_text", "0L as n_words", f"cast(array() as array<{SPAN}>) as spans", "cast(array() as array<string>) as items")
    for phrases in _blocks(benchmark, item_id, item_text, window, block_words):
        rows = rows.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(phrases), len(names)), shape)
    return rows.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], "n_words", "spans", "items")


def _searcher(shared, n_keys: int):
    """Adds what the phrases of one block give to the spans and items that rows bring along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch, data, ends in binary_batches(batches, "_text", SHARD_ROWS):
            starts, stops = term_spans(data, ends)
            word_from = np.searchsorted(starts, ends)
            hashes = term_hashes(data, starts, stops)
            index = FmIndex(hashes, np.diff(word_from))
            hit, doc, item = find_phrases(index, phrases)
            spans, items = batch.column("spans"), batch.column("items")
            if hit.any():
                spans, items = spans.to_pylist(), items.to_pylist()
                for d in np.unique(np.searchsorted(index.doc_starts, np.flatnonzero(hit), "right") - 1):
                    body = hit[index.doc_starts[d]:index.doc_starts[d] + word_from[d + 1] - word_from[d]].copy()
                    for s in spans[d]:
                        body[s["first_word"]:s["first_word"] + s["n_words"]] = True
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], body.astype(np.int8), [0]])))
                    at = word_from[d]
                    spans[d] = [{"first_word": int(a), "n_words": int(b - a), "start": int(starts[at + a] - ends[d]), "stop": int(stops[at + b - 1] - ends[d])}
                                for a, b in zip(edges[::2], edges[1::2])]
                for d, a, b in zip(*_groups(doc)):
                    found = [phrases.ids[i] for i in item[a:b]]
                    items[d] = sorted({*items[d], *found}) if items[d] else found
                spans, items = pa.array(spans, batch.schema.field("spans").type), pa.array(items, batch.schema.field("items").type)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_keys + 1)), pa.array(np.diff(word_from)), spans, items],
                                             names=batch.schema.names)

    return run


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key with the range of its places."""
    keys, first = np.unique(sorted_keys, return_index=True)
    return keys, first, np.append(first[1:], len(sorted_keys))


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without the bytes of their removal spans."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text_col}`").alias("_text"))
    rows = contamination(packed, benchmark, window, ("_doc",), "_text")
    raw = F.encode(F.col(f"_doc.`{text_col}`"), "utf-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.stop"))
    stops = F.concat(F.col("spans.start"), F.array(F.octet_length(raw).cast("long")))
    parts = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda s: F.decode(F.substring(raw, s["a"].cast("int") + 1, (s["b"] - s["a"]).cast("int")), "utf-8"))
    text = F.when(F.size("spans") > 0, F.array_join(parts, "")).otherwise(F.col(f"_doc.`{text_col}`"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def op11_fm_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of the spans and items of each document."""
    found = contamination(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["n_words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
