"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its measurements and
one failure bit per rule. A policy is a version with the bits that reject a
document and the number of other bits that reject together. Policies and
ablations work on the ledger alone, never on texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.common import binary_batches

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_short_words", "n_alpha_words", "top_word", "n_stammer")
LEDGER = ", ".join(f"{m} bigint" for m in MEASURES)


def _repeats(ids: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    rank = ids
    step = 1
    while step < WINDOW:  # numbers of windows of twice the width from pairs of numbers: exact, no hashing
        pair = rank[:-step] * np.int64(len(ids) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    short = sum(len(w) == 1 and not w.isalnum() for w in words)
    alpha = sum(w.decode("utf-8", "replace")[:1].isalpha() for w in words)
    top = int(np.bincount(ids).max()) if len(ids) else 0
    stammer = int((ids[1:] == ids[:-1]).sum())
    return (len(words), chars, symbols, len(lines) - len(set(lines)), _repeats(ids), len(lines), short, alpha, top, stammer)


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the measurements and ``failed``, the bits of failed rules.

    A null text counts as empty and has no words, an empty table gives no rows,
    repeated rows are measured each by itself.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, names)], F.col(f"`{text_col}`").alias("_text"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in binary_batches(batches, "_text"):
            raw = data.tobytes()
            found = np.array([measure(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))] + [pa.array(found[:, i]) for i in range(len(MEASURES))],
                names=[*names, *MEASURES])

    measured = rows.mapInArrow(run, f"{kinds}, {LEDGER}")
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)), F.lit(0))
    return measured.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], *MEASURES, bits.cast("long").alias("failed"))


#: Name and failure (SQL over the measurements) of each rule; its bit is its position. New rules go to the end.
RULES = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 40 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 14 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("lone_symbols", "100 * n_short_words > 20 * n_words"),
    ("few_alphabetic_words", "100 * n_alpha_words < 60 * n_words"),
    ("one_word_dominates", "n_words >= 50 and 100 * top_word > 30 * n_words"),
    ("stammer", "100 * n_stammer > 20 * n_words"),
)
_BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Reject when a bit of ``hard`` failed, or at least ``votes`` of the bits of ``soft``."""
    version: str
    hard: int
    soft: int = 0
    votes: int = 1

    def rejects(self) -> Column:
        return ((F.col("failed").bitwiseAND(F.lit(self.hard)) != 0)
                | (F.bit_count(F.col("failed").bitwiseAND(F.lit(self.soft))) >= self.votes))


BASE = Policy("base", _BIT["too_few_words"] | _BIT["repeated_windows"])
DEFAULT = Policy("v1", BASE.hard | _BIT["symbols"] | _BIT["stammer"] | _BIT["long_words"] | _BIT["few_alphabetic_words"],
                 _BIT["repeated_lines"] | _BIT["short_words"] | _BIT["lone_symbols"] | _BIT["one_word_dominates"], 2)


def ablations(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Per rule: documents that fail it, that only it rejects, and that stay without it.

    One pass over the distinct bit patterns, of which there are at most 2 ** number of rules.
    """
    patterns = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for name, bit in _BIT.items():
        without = Policy(policy.version, policy.hard & ~bit, policy.soft & ~bit, policy.votes)
        has = F.col("failed").bitwiseAND(F.lit(bit)) != 0
        parts.append(F.struct(F.lit(name).alias("rule"), F.when(has, F.col("n")).otherwise(0).alias("fails"),
                              F.when(policy.rejects() & ~without.rejects(), F.col("n")).otherwise(0).alias("only"),
                              F.when(~without.rejects(), F.col("n")).otherwise(0).alias("kept_without")))
    return (patterns.select(F.explode(F.array(*parts)).alias("r")).select("r.*").groupBy("rule")
            .agg(F.sum("fails").alias("fails"), F.sum("only").alias("only"), F.sum("kept_without").alias("kept_without")))


def apply_policy(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Rows of ``docs`` that the policy keeps, with their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"))
    rows = ledger(packed, "_text", ("_doc",)).where(~policy.rejects())
    return rows.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def op6_quality(docs: DataFrame) -> DataFrame:
    """Digest of the ledger under the default policy."""
    rows = ledger(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       BASE.rejects().alias("base_failed"), (~(BASE.rejects() | DEFAULT.rejects())).alias("kept"), "failed")
