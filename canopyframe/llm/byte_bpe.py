"""Byte-level BPE by dynamic programming over prefixes.

For every byte prefix of a piece exactly one token can end its encoding: the one
that BPE keeps next to the token before it. Storing that last token per prefix
gives the encoding of the piece and of all its prefixes, lets bytes be appended
without encoding anew, and confines an edit to what follows it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.llm.common import binary_batches

#: Pieces whose ids a worker remembers at most, in two generations, and characters of the longest of them.
REMEMBERED, LONGEST = 800_000, 64
#: Pairs of tokens of which a worker remembers whether they may meet.
PAIRS = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of the tokens and how each was merged from two others (a single byte is its own halves)."""
    ranks: dict[bytes, int]
    tokens: list[bytes]
    halves: list[tuple[int, int]]
    joined: dict[tuple[int, int], int]
    longest: int

    def may_meet(self, left: int, right: int) -> bool:
        """Would BPE keep ``left`` and ``right`` side by side?

        Undo merges at the border from the latest on; if two tokens that meet there
        could have merged earlier than the border was closed, BPE would have done so.
        """
        limit = len(self.tokens)
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and merged < limit:
                return False
            # undo the later merge of the two; a byte can't be undone
            if left > right:
                limit, inner = left, self.halves[left][1]
                if inner == left:
                    limit, inner = right + 1, self.halves[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                limit, inner = right + 1, self.halves[right][0]
                if inner == right:
                    limit, inner = left, self.halves[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = inner

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Last token of each prefix of ``piece``, given those of its first ``len(last)`` bytes."""
        ranks = self.ranks
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(piece[start:end])
                if token is not None and (start == 0 or self.may_meet(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends {piece[:end]!r}")
        return last

    def ids(self, last: list[int]) -> list[int]:
        """Encoding of the piece whose prefixes end in ``last``."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return out[::-1]

    def edit(self, piece: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace ``piece[start:end]``: prefixes before ``start`` keep their tokens, and so do those behind
        the edit once as many neighbours as a token can span have their old ones again."""
        changed, shift = piece[:start] + new + piece[end:], start + len(new) - end
        out, agree = last[:start], 0
        while len(out) < len(changed):
            self.extend(changed[:len(out) + 1], out)
            old = len(out) - 1 - shift
            agree = agree + 1 if old >= end and out[-1] == last[old] else 0
            if agree == self.longest:
                out += last[old + 1:]
        return changed, out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.ids(self.extend(piece, []))


def vocabulary(ranks: dict[bytes, int]) -> Vocabulary:
    """Find the two halves of each token by encoding it with the tokens merged before it."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    known = Vocabulary({}, tokens, [], {}, max(map(len, ranks)))
    for rank, token in enumerate(tokens):
        if len(token) > 1:
            parts = known.ids(known.extend(token, []))
            if len(parts) != 2:
                raise ValueError(f"token {rank} isn't a merge of two earlier ones")
            known.halves.append((parts[0], parts[1]))
            known.joined[parts[0], parts[1]] = rank
        else:
            known.halves.append((rank, rank))
        if token:
            known.ranks[token] = rank
    return known


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Encoder:
    """Texts to ids and back; remembers the ids of pieces it has seen.

    Pieces live in two generations: a full young one becomes the old one, and a
    piece found there is young again, so frequent pieces are never forgotten.
    """

    def __init__(self, known: Vocabulary, pattern: str):
        self.known, self.pattern, self.young, self.old, self.met = known, regex.compile(pattern), {}, {}, {}
        # finds the tokens that end at each place, longest first; a byte is the character of its number
        self.endings = ahocorasick.Automaton()
        for token, rank in known.ranks.items():
            self.endings.add_word(token.decode("latin-1"), (rank, len(token)))
        self.endings.make_automaton()

    def _find(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            if len(self.met) > PAIRS:
                self.met.clear()
            found = array("I", self._encode_piece(piece.encode())).tobytes()
        if len(piece) <= LONGEST:
            if len(self.young) >= REMEMBERED // 2:
                self.young, self.old = {}, self.young
            self.young[piece] = found
        return found

    def _encode_piece(self, piece: bytes) -> list[int]:
        """As ``Vocabulary.encode_piece``, with the tokens that end at a place from the automaton."""
        known, met = self.known, self.met
        whole = known.ranks.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = []
        done = 0
        for end, (token, size) in self.endings.iter(piece.decode("latin-1")):
            if end < done:
                continue
            if end + 1 > size:
                before = last[end - size]
                fits = met.get(before << 24 | token)
                if fits is None:
                    fits = met[before << 24 | token] = known.may_meet(before, token)
                if not fits:
                    continue
            last.append(token)
            done += 1
        return known.ids(last)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.pattern.findall(text)
        out = list(map(self.young.get, pieces))
        if None in out:
            for i, (piece, found) in enumerate(zip(pieces, out)):
                if found is None:
                    out[i] = self.young.get(piece) or self._find(piece)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.known.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: The worker's encoder; it lives on between tasks with the same vocabulary.
_CODER: list[Encoder] = []


def _tokenise(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], text_col: str, columns: str, digest) -> DataFrame:
    """Run ``digest(encoder, text bytes)`` over each row; ``columns`` are the SQL types of what it returns."""
    spark: SparkSession = docs.sparkSession
    # the vocabulary has a fixed size; executors need not see the driver's file
    shared = spark.sparkContext.broadcast(vocabulary(read_ranks(ranks_path)))
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, names)], F.col(f"`{text_col}`").alias("_text"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    heads = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _CODER or _CODER[0].known is not shared.value or _CODER[0].pattern.pattern != pattern:
            _CODER[:] = [Encoder(shared.value, pattern)]
        coder = _CODER[0]
        for batch, data, ends in binary_batches(batches, "_text"):
            raw = data.tobytes()
            found = [digest(coder, raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            parts = [pa.array([r[i] for r in found]) for i in range(len(heads))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + parts, names=[*names, *heads])

    out = rows.mapInArrow(run, ", ".join(x for x in (kinds, columns) if x))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], *heads)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of ``docs`` (or ``keep``), ``n_tokens`` and ``ids``.

    Null and empty texts have no ids. Repeated rows are encoded each, no rows give none.
    Columns of ``docs`` called ``n_tokens`` or ``ids`` are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "ids")]

    def ids(coder: Encoder, text: bytes) -> tuple[int, np.ndarray]:
        found = np.frombuffer(coder.encode(text.decode("utf-8", "replace")), "<i4")
        return len(found), found

    return _tokenise(docs, ranks_path, pattern, keep, text_col, "n_tokens bigint, ids array<int>", ids)


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns of ``rows`` and ``decoded``, the bytes that the ids stand for; null ids give none."""
    keep = [c for c in (rows.columns if keep is None else keep) if c not in ("decoded", ids_col)]
    packed = rows.withColumn("ids_text", F.array_join(F.col(ids_col), " "))
    return _tokenise(packed, ranks_path, pattern, keep, "ids_text", "decoded binary",
                     lambda coder, ids: (coder.decode(np.array(ids.split(), "<u4").tobytes()),))


def _digest(coder: Encoder, text: bytes) -> tuple[int, str, str]:
    ids = coder.encode(text.decode("utf-8", "replace"))
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()


def op2_byte_bpe(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digest of encoding and decoding each text."""
    return _tokenise(docs, ranks_path, pattern, ["doc_id"], "text",
                     "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digest)
