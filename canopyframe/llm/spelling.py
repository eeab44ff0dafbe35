"""Spelling variants by composing finite-state machines.

The vocabulary is an acceptor. Composed with a transducer that makes exactly one edit
and with the acceptor again, it accepts the pairs of words that are one edit apart. As
long as nothing is edited both sides walk the same path from the initial state, so
the composition falls into parts by that path. A state with many words behind it is
expanded by Spark: the edit transitions that leave it become joins on the equal rest of
the words. All other parts go to tasks, which minimise the part's acceptor and
compose it there.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from canopyframe.llm.common import stored
from canopyframe.runtime import BROADCAST_LIMIT, fits_one_task, salted_join

#: Words behind a state that one task composes.
PART = 10_000
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000
#: Code points beyond which words of a part are compared by halves, as a machine of them would be as deep as they are long.
LONG = 100
#: Pairs of states whose common words are remembered.
REMEMBERED = 200_000

RUN = re.compile("[a-zÀ-ÿ]+")


# --- the machines

class Acceptor:
    """Minimal deterministic acceptor of sorted distinct words: equal right languages are one state."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def state(final: bool, arcs: list[tuple[str, int]]) -> int:
            key = (final, *arcs)
            number = known.get(key)
            if number is None:
                number = known[key] = len(self.arcs)
                self.arcs.append(dict(arcs))
                self.final.append(final)
            return number

        path: list[list] = [[False, []]]  # states along the last word that may still grow: final, arcs
        last = ""
        for word in words:
            same, limit = 0, min(len(last), len(word))
            while same < limit and last[same] == word[same]:
                same += 1
            while len(path) > same + 1:
                done = state(*path.pop())
                path[-1][1].append((last[len(path) - 1], done))
            for _ in range(len(word) - same):
                path.append([False, []])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            done = state(*path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        self.initial = state(*path[0])

    def paths(self) -> Iterator[tuple[str, int]]:
        """Each prefix of an accepted word and the state that it leads to."""
        todo = [("", self.initial)]
        while todo:
            prefix, p = todo.pop()
            yield prefix, p
            todo.extend((prefix + c, q) for c, q in self.arcs[p].items())


class OneEdit:
    """Composition of an acceptor, the one-edit transducer and the acceptor."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self.common: dict[tuple[int, int], list[str]] = {}
        self.edits: dict[int, list[tuple[str, str]]] = {}

    def meet(self, p: int, q: int) -> list[str]:
        """Words that both states accept: what may follow the edit."""
        if p > q:
            p, q = q, p
        found = self.common.get((p, q))
        if found is None:
            a = self.a
            found = [""] if a.final[p] and a.final[q] else []
            few, more = (a.arcs[p], a.arcs[q]) if len(a.arcs[p]) <= len(a.arcs[q]) else (a.arcs[q], a.arcs[p])
            for c, r in few.items():
                s = more.get(c)
                if s is not None:
                    found += [c + rest for rest in self.meet(r, s)]
            if len(self.common) >= REMEMBERED:
                self.common.clear()
            self.common[(p, q)] = found
        return found

    def at(self, p: int) -> list[tuple[str, str]]:
        """Pairs of words that state ``p`` accepts and whose first symbols are edited.

        Each pair comes once. A deletion is taken at the end of a run of equal symbols, so that only one path makes it.
        """
        found = self.edits.get(p)
        if found is None:
            found = []
            arcs = list(self.a.arcs[p].items())
            for i, (c, r) in enumerate(arcs):
                for d, s in arcs[i + 1:]:
                    found += [(c + rest, d + rest) for rest in self.meet(r, s)]
                found += [(c + rest, rest) for rest in self.meet(r, p) if not rest.startswith(c)]
            self.edits[p] = found
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        for prefix, p in self.a.paths():
            for u, v in self.at(p):
                yield prefix + u, prefix + v


def one_edit(u: str, v: str) -> bool:
    """If different words become equal by one inserted, deleted or replaced code point."""
    same = len(os.path.commonprefix((u, v)))
    if len(u) == len(v):
        return u != v and u[same + 1:] == v[same + 1:]
    few, more = (u, v) if len(u) < len(v) else (v, u)
    return len(more) - len(few) == 1 and few[same:] == more[same + 1:]


def long_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart of which a word is longer than LONG: one half of the shorter word is whole in both."""
    by_size: dict[int, list[str]] = {}
    for w in words:
        if len(w) >= LONG:
            by_size.setdefault(len(w), []).append(w)
    for n, own in by_size.items():
        half = n // 2
        halves: dict[tuple[bool, str], list[str]] = {}
        for w in own:
            halves.setdefault((True, w[:half]), []).append(w)
            halves.setdefault((False, w[half:]), []).append(w)
        for w in chain(own if n > LONG else (), by_size.get(n + 1, ())):
            near = {*halves.get((True, w[:half]), ()), *halves.get((False, w[len(w) - n + half:]), ())}
            yield from ((w, v) for v in near if (len(w) > n or w < v) and one_edit(w, v))


# --- the vocabulary

def _counted(docs: DataFrame, id_col: str, text_col: str, damage: int) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        crc = zlib.crc32
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                found = Counter(RUN.findall(text.as_py().lower().decode()))  # lower() of bytes is for A-Z only
                start = crc(f"{key}:".encode())
                for word, n in found.items():
                    h = crc(word.encode(), start)
                    if damage and h % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    total[word] = total.get(word, 0) + n
                if len(total) >= COUNTED:
                    yield batch_of()
        yield batch_of()

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, least: int = 3, length: int = 5, damage: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: distinct words of at least ``length`` code points that occur ``least`` times or more.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z as a-z. With ``damage``, a
    word whose checksum with its document's id divides by it loses one code point, given by the
    checksum; a null id counts as empty text. Null texts have no words.
    """
    return _counted(docs, id_col, text_col, damage).where((F.char_length("word") >= length) & (F.col("n") >= least))


# --- the composition over tables

@F.pandas_udf(IntegerType())
def _common_prefix(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two words per expanded state."""
    return pd.Series([len(os.path.commonprefix(x)) for x in zip(a, b)], dtype="int32")


def _depths(words: DataFrame, part: int) -> DataFrame:
    """``word, low, depth``: the states at lengths ``low`` to ``depth`` - 1 on the word's path are expanded.

    A state is expanded while more than ``part`` words lie behind it. States between
    which the path doesn't branch are passed at once.
    """
    open_words = words.select("word", F.expr("substring(word, 1, 0)").alias("state"), F.array().cast("array<int>").alias("cuts"))
    done = None
    while True:
        # the longest prefix common to all words behind a state is that of the first and the last
        ends = open_words.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("a"), F.max("word").alias("b"))
        ends = stored(ends.where(F.col("n") > part).select("state", _common_prefix("a", "b").alias("at")))
        if not ends.take(1):
            rest = open_words.select("word", "state", "cuts")
            return rest if done is None else done.unionByName(rest)
        small = fits_one_task(ends, [], BROADCAST_LIMIT)  # one row for more than ``part`` words
        joined = open_words.join(F.broadcast(ends), "state", "left") if small else salted_join(open_words, ends, ["state"], "left")
        here = joined.where(F.col("at").isNull()).select("word", "state", "cuts")
        done = stored(here) if done is None else done.unionByName(stored(here))
        more = joined.where(F.col("at").isNotNull())
        # a word that ends at the branching state has no further state
        ended = F.char_length("word") <= F.col("at")
        done = done.unionByName(stored(more.where(ended).select("word", F.lit(None).cast("string").alias("state"), F.array_append("cuts", F.col("at")).alias("cuts"))))
        open_words = stored(more.where(~ended).select("word", F.expr("substring(word, 1, at + 1)").alias("state"), F.array_append("cuts", F.col("at")).alias("cuts")))


def _composed(words: DataFrame) -> DataFrame:
    """Pairs inside each part; rows come sorted by state and word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = None, []
        out: list[tuple[str, str]] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], names=["u", "v"])

        def solve() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                cut = len(state)
                rests = [w[cut:] for w in held]
                for u, v in chain(OneEdit(Acceptor([w for w in rests if len(w) <= LONG])).pairs(), long_pairs(rests)):
                    out.append((state + u, state + v))
                    if len(out) >= 50_000:
                        yield batch_of()
                        out.clear()

        for batch in batches:
            for s, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != state:
                    yield from solve()
                    state, held = s, []
                held.append(w)
        if held:
            yield from solve()
        yield batch_of()

    return words.mapInArrow(run, "u string, v string")


def _expanded(words: DataFrame) -> DataFrame:
    """Pairs whose edit leaves an expanded state: words with equal rest behind the edit.

    One symbol replaced: the words agree without the symbol at ``cut``. One inserted: the
    longer word without it is the shorter one, which branches off there. A key has at most as
    many words as the alphabet has symbols.
    """
    cut = words.select("word", F.explode("cuts").alias("cut"))
    at = F.col("cut") + 1
    without = F.concat(F.expr("substring(word, 1, cut)"), F.expr("substring(word, cut + 2)"))
    edited = cut.where(F.char_length("word") > F.col("cut")).select("word", "cut", without.alias("rest"), F.expr("substring(word, cut + 1, 1)").alias("c"))
    replaced = edited.alias("x").join(edited.alias("y"), ["cut", "rest"]).where(F.col("x.word") < F.col("y.word")).select(
        F.col("x.word").alias("u"), F.col("y.word").alias("v"))
    shorter = cut.select(F.col("word").alias("rest"), "cut")
    inserted = edited.join(shorter, ["cut", "rest"]).where(F.expr("substring(rest, cut + 1, 1)") != F.col("c")).select(F.col("word").alias("u"), F.col("rest").alias("v"))
    return replaced.unionByName(inserted)


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """``u, v``: each pair of distinct words that differ by one inserted, deleted or replaced code point, once."""
    placed = _depths(words.select("word"), part)
    placed = stored(placed)
    parts = placed.where(F.col("state").isNotNull()).select("state", "word").repartition("state").sortWithinPartitions("state", "word")
    return _composed(parts).unionByName(_expanded(placed.select("word", "cuts")))


def spelling_groups(docs: DataFrame, least: int = 3, length: int = 5, damage: int = 97, id_col: str = "doc_id", text_col: str = "text",
                    part: int = PART) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of the vocabulary.

    The form is the near word that occurs most (ties: the smallest in code-point order) if it
    occurs at least twice as often as the word; the root is where forms lead. Null and empty
    texts have no words; repeated rows count each; no words give no rows. Other columns are ignored.
    """
    words = stored(vocabulary(docs, least, length, damage, id_col, text_col))
    pairs = stored(near_pairs(words, part))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sized = both.join(words.select(F.col("word").alias("v"), F.col("n").alias("m")), "v")
    best = sized.groupBy("u").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("v").alias("v"))).alias("best"))
    joined = words.join(best.withColumnRenamed("u", "word"), "word", "left")
    good = -F.col("best.m") >= 2 * F.col("n")
    formed = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.v")).alias("form"),
                                  F.when(good, -F.col("best.m")).alias("form_n")))
    return formed.join(_roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """``word, root`` of words with a form, by doubling the way; counts at least double, so few rounds do."""
    ways = stored(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not ways.join(further, "root", "left_semi").take(1):
            return ways
        ways = stored(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def op12_spelling_variants(docs: DataFrame) -> DataFrame:
    return spelling_groups(docs)
