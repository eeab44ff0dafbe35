"""Operators on texts against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from canopyframe.llm import byte_bpe, ngram_join, pareto_mix, pii, quality, suffix_dedup
from canopyframe.llm.kd_shards import kd_shards, op9_kd_shards

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def rows(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key]))


def prose(rng, words, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(words))


# --- suffix dedup

def repeats(texts, length):
    strings = collections.Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        covered = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if strings[b[i:i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        gone = np.cumsum(covered)[:len(b)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def planted():
    rng = random.Random(5)
    passage = prose(rng, 90)
    texts = [prose(rng, 60) + passage[k:k + 150 + 9 * k] + prose(rng, 40) for k in range(40)]
    texts += [passage, passage, "ab" * 400, "z" * 450, passage + passage, "é" * 150 + passage[:201], passage[:199]]
    return texts


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_suffix_dedup(make_docs, odd, bucket):
    texts = planted() + odd
    got = suffix_dedup.remove_repeats(make_docs(texts, extra=True), bucket=bucket, digest_only=True)
    assert [tuple(r)[1:] for r in rows(got)] == repeats([(t or "").encode() for t in texts], 200)


def test_suffix_dedup_repeated_rows_and_nothing(make_docs):
    text = prose(random.Random(1), 100)
    docs = make_docs([(1, text, "a"), (1, text, "a"), (None, text + "x", None), (1, "another text", "a")])
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted([(len(text), len(text))] * 2 + [(len(text) + 1, len(text)), (12, 0)])
    assert suffix_dedup.op1_suffix_dedup(make_docs([])).count() == 0


def test_suffix_dedup_tells_rows_without_id_apart(make_docs):
    # the first pair of texts has equal CRC-32 sums; ids are null or repeated
    rng = random.Random(2)
    passage = prose(rng, 60)
    texts = [passage[:230] + prose(rng, 30), prose(rng, 50) + passage[:230], prose(rng, 80), passage[:100]]
    texts += same_checksum(texts[2] + passage[:215])
    for key in (None, 7):
        got = suffix_dedup.remove_repeats(make_docs([(key, t, "s") for t in texts]), digest_only=True)
        assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(repeats([t.encode() for t in texts], 200))


def same_checksum(text):
    """Two endings of the text with the same CRC-32."""
    seen, start = {}, zlib.crc32(text.encode())
    for n in range(1 << 20):
        ending = f" {n * 2654435761 % (1 << 32):x} {n}"
        other = seen.setdefault(zlib.crc32(ending.encode(), start), ending)
        if other != ending:
            return [text + other, text + ending]
    raise AssertionError("no such endings")


def test_suffix_dedup_many_repeated_rows(make_docs):
    rng = random.Random(4)
    text = prose(rng, 300)
    docs = [(3, text, "s")] * 5000 + [(4, text[100:700] + prose(rng, 40), "s")]
    got = collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(make_docs(docs), digest_only=True).collect())
    want = repeats([text.encode()] * 2 + [docs[-1][1].encode()], 200)
    assert got == {(3, *want[0]): 5000, (4, *want[2]): 1}


def test_deep_shallow_orders_like_sorted():
    rng = random.Random(3)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 60))]
        strings = [b"q" * 40 + s for s in strings]
        assert [strings[i] for i in suffix_dedup.deep_shallow(strings)] == sorted(strings)


# --- byte-level BPE

def test_bpe_matches_tiktoken(make_docs, odd):
    ranks = byte_bpe.read_ranks(RANKS)
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = planted() + odd + ["<|endoftext|> it's  I'LL\n\n 123abc \U0001f600\u0301"]
    got = rows(byte_bpe.op2_byte_bpe(make_docs(texts, extra=True), RANKS, public_tokenizers.PATTERN))
    for r, t in zip(got, texts):
        ids = peer.encode_ordinary(t or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = byte_bpe.encode(make_docs(texts), RANKS, public_tokenizers.PATTERN)
    back = rows(byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN))
    assert [bytes(r["decoded"]) for r in back] == [(t or "").encode() for t in texts]
    assert byte_bpe.op2_byte_bpe(make_docs([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_appends_and_edits():
    known = byte_bpe.vocabulary(byte_bpe.read_ranks(RANKS))
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"theinrgs o") for _ in range(rng.randrange(2, 30)))
        last = known.extend(piece, [])
        for cut in range(1, len(piece)):
            assert known.ids(last[:cut]) == known.ids(known.extend(piece[:cut], []))
        at = rng.randrange(len(piece))
        changed, new = known.edit(piece, list(last), at, at + 1, b"ing")
        assert new == known.extend(changed, [])
    long = bytes(rng.choice(b"theinrgs o") for _ in range(3000))
    last = known.extend(long, [])
    for at, end, new in ((0, 0, b"x"), (1500, 1510, b""), (700, 701, b"ing the"), (2990, 3000, b"s"), (10, 2990, b"")):
        changed, got = known.edit(long, list(last), at, end, new)
        assert got == known.extend(changed, [])


def test_bpe_edit_ends_where_tokens_agree(monkeypatch):
    known = byte_bpe.vocabulary(byte_bpe.read_ranks(RANKS))
    rng = random.Random(3)
    long = bytes(rng.choice(b"theinrgs o") for _ in range(5000))
    last, steps = known.extend(long, []), []
    plain = byte_bpe.Vocabulary.extend
    monkeypatch.setattr(byte_bpe.Vocabulary, "extend", lambda self, piece, last: steps.append(1) or plain(self, piece, last))
    assert known.edit(long, list(last), 100, 101, b"q")[1] == plain(known, long[:100] + b"q" + long[101:], [])
    assert len(steps) < 1000


def test_bpe_of_pieces_equals_plain_prefixes():
    known = byte_bpe.vocabulary(byte_bpe.read_ranks(RANKS))
    coder = byte_bpe.Encoder(known, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(2000):
        piece = bytes(rng.choice(b"abcdetheinrgs \xc3\xa9\x00\xff") for _ in range(rng.randrange(1, 40)))
        assert coder._encode_piece(piece) == known.encode_piece(piece)


# --- n-gram join

def sets_of(texts, words):
    out = []
    for t in texts:
        w = (t or "").encode().translate(LOWER).split()
        out.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    return out


def linked(ids, sets, percent):
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [ids[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("words,percent,salt", [(4, 85, None), (5, 80, None), (4, 85, 5)])
def test_ngram_components(make_docs, odd, monkeypatch, words, percent, salt):
    if salt:
        monkeypatch.setattr(ngram_join, "BUCKET", salt)
    rng = random.Random(words)
    texts = list(odd)
    for _ in range(12):  # families of edited copies, some of which link only through others
        base = prose(rng, rng.randrange(20, 150), 5000).split()
        for _ in range(rng.randrange(1, 25)):
            edited = list(base)
            for _ in range(rng.randrange(6)):
                edited[rng.randrange(len(edited))] = rng.choice(["New", "other", "X"]) + str(rng.randrange(99))
            texts.append(" ".join(edited).upper() if rng.random() < 0.2 else "  ".join(edited))
    shared = prose(rng, 30, 5000)
    texts += [shared + " " + prose(rng, 40, 5000) for _ in range(30)]
    got = rows(ngram_join.jaccard_components(make_docs(texts, extra=True), words, percent))
    sets = sets_of(texts, words)
    assert [r["n_shingles"] for r in got] == [len(s) for s in sets]
    assert [r["component_id"] for r in got] == linked(list(range(len(texts))), sets, percent)


def test_ngram_repeated_rows_and_nothing(make_docs):
    docs = make_docs([(7, "one two three four five", "a"), (7, "one two three four five", "a"), (3, "ONE two three four five", "b"),
                      (7, "quite another text of words", "a"), (9, None, None)])
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs).collect())
    assert got == [(3, 2, 3), (7, 2, 3), (7, 2, 3), (7, 2, 7), (9, 0, 9)]
    assert ngram_join.op3_ngram_jaccard(make_docs([])).count() == 0


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_ngram_subsets_and_supersets(make_docs, monkeypatch, words, percent):
    """Places in prefixes beyond the first block: the position bound must keep every pair, also those no earlier round tests."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "LAGS", (1,))
    rng = random.Random(percent)
    texts = []
    for _ in range(250):
        whole = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 101))]
        for _ in range(rng.randrange(2, 6)):
            part = whole[:]
            cut = rng.randrange(0, len(whole) // 5 + 1)
            texts.append(" ".join(part[cut:] if rng.random() < 0.5 else part[:len(part) - cut]) + (" " + prose(rng, rng.randrange(1, 8), 5000) if rng.random() < 0.5 else ""))
    got = rows(ngram_join.jaccard_components(make_docs(texts), words, percent))
    assert [r["component_id"] for r in got] == linked(list(range(len(texts))), sets_of(texts, words), percent)


def test_ngram_rows_without_an_id_link(make_docs):
    """Null-id texts near, not equal, to others; sets that only they have are read too."""
    rng = random.Random(8)
    a, b, c = (prose(rng, 60, 5000) for _ in range(3))
    docs = make_docs([(4, a, "s"), (None, a + " x1", "s"), (None, a + " x1", "s"), (None, b, "s"), (None, b + " x2", "s"), (9, c, "s"), (None, c, "s"), (None, "alone here", "s"), (None, None, "s")])
    got = ngram_join.jaccard_components(docs).collect()
    assert sorted((r["n_shingles"], r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [
        (0, 0, 0), (1, 0, 0), (57, 0, 0), (57, 0, 9), (57, 4, 4), (57, 9, 9), (58, 0, 0), (58, 0, 4), (58, 0, 4)]
    kept = corpus_pipeline.near_duplicates(docs.sparkSession, docs, "")
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == 5 and {a, c, "alone here", None} < set(texts) and len({b, b + " x2"} & set(texts)) == 1


# --- personal data

def test_pii_keeps_formats_and_links(make_docs):
    texts = ["card 4929348385146306, again 4929-3483-8514-6306.", "bad 4929348385146307 stays", "mail Ann.Lee42@mail7.example.com!",
             "Ann.Lee42@mail7.example.com", "+1 (459) 555-9246 or +14595559246", "born 1984-02-29, not 1985-02-29; 03.11.1970", "ip 97.51.17.173 not 300.1.1.1",
             'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "DE89370400440532013000", "ssn 123-45-6789", None, "", "nothing here 12 34"]
    got = rows(pii.pseudonymise(make_docs(texts, extra=True), "k"))
    new = [r["text"] for r in got]
    assert [new[i] for i in (1, 10, 11, 12)] == [texts[i] for i in (1, 10, 11, 12)]
    first, second = re.findall(r"\d[\d-]{14,}\d", new[0])
    assert first == second.replace("-", "") and first != "4929348385146306"
    digits = [int(c) for c in first[::-1]]
    assert sum(d if i % 2 == 0 else (d * 2 - 9 * (d > 4)) for i, d in enumerate(digits)) % 10 == 0
    assert new[2][5:-1] == new[3] and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d\d@mail7\.example\.com", new[3]) and new[3] != texts[3]
    a, b = new[4].split(" or ")
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and a != "+1 (459) 555-9246"
    assert "1985-02-29" in new[5] and "1984-02-29" not in new[5] and re.search(r"\d\d\.\d\d\.\d{4}$", new[5]) and "03.11.1970" not in new[5]
    assert "300.1.1.1" in new[6] and "97.51.17.173" not in new[6]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', new[7]) and new[7] != texts[7]
    iban = new[8]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != texts[8]
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", new[9]) and new[9] != texts[9]
    assert [r["kind"] for r in got[0]["pii"]] == ["card", "card"]
    other = rows(pii.pseudonymise(make_docs(texts), "other key"))
    assert other[3]["text"] != new[3]


def test_pii_is_a_permutation(make_docs):
    cards = []
    for n in range(400):
        body = f"4{n:014d}"
        total = sum(int(c) if i % 2 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(body[::-1]))
        cards.append(body + str(-total % 10))
    got = rows(pii.op5_feistel_pii(make_docs(cards)))
    assert len({r["text"] for r in got}) == 400 and all(r["n_values"] == 1 for r in got)
    days = [f"20{y:02d}-{m:02d}-{d:02d}" for y in range(3) for m in range(1, 13) for d in range(1, 29)]
    assert len({r["text"] for r in pii.op5_feistel_pii(make_docs(days)).collect()}) == len(days)
    assert pii.op5_feistel_pii(make_docs([])).count() == 0


def test_pii_values_beside_similar_text(make_docs):
    card, iban = "4929348385146306", "AT611904300234573201"
    hidden = [f"{card} 123", "4929 3483 8514 6306 12/27", f"12 {card}", f"12 34 {card} 56", f"+49 {card}", f"{card} {card}", "AT61 1904 3002 3457 3201 BIC GIBAATWW",
              f"{iban} ABCD", f"IBAN AB12 {iban} 1234", "25/12/1990", f"{card} 123-45-6789", "+1 459 555 9246 2024 11"]
    got = rows(pii.pseudonymise(make_docs(hidden), "k"))
    kinds = [[v["kind"] for v in r["pii"]] for r in got]
    assert kinds == [["card"]] * 5 + [["card"] * 2] + [["iban"]] * 3 + [["date"], ["card", "ssn"], ["phone"]]
    assert not any(x in r["text"].replace(" ", "") for r in got for x in (card, iban, "25/12/1990", "123-45-6789", "4595559246"))
    assert got[0]["text"].endswith(" 123") and got[1]["text"].endswith(" 12/27") and got[2]["text"].startswith("12 ") and got[6]["text"].endswith(" BIC GIBAATWW")
    assert got[0]["text"][:16] == got[2]["text"][3:] == got[1]["text"][:19].replace(" ", "")
    days = [f"{d:02d}/{m:02d}/{y}" for y in (1800, 1999, 2000, 2199) for m in range(1, 13) for d in range(13, 29)]
    new = [r["text"] for r in pii.op5_feistel_pii(make_docs(days)).collect()]
    assert len(set(new)) == len(days) and all(13 <= int(t[:2]) <= 31 and 1 <= int(t[3:5]) <= 12 for t in new)


def test_pii_leaves_ordinary_numbers_and_knows_its_own_values(make_docs):
    rng = random.Random(3)
    plain = [" ".join(f"{rng.randrange(10000):04d}" for _ in range(12)) for _ in range(150)] + [" ".join(f"{rng.randrange(100):02d}" for _ in range(30)) for _ in range(50)]
    assert [r["text"] for r in rows(pii.pseudonymise(make_docs(plain), "k"))] == plain
    odd_groups = ["my card: 49293 48385 146306", "49293 48385 146306"]
    assert [len(r["pii"]) for r in rows(pii.pseudonymise(make_docs(odd_groups), "k"))] == [1, 0]
    numbers = [f"{a:03d}-{b:02d}-{c:04d}" for a, b, c in ((rng.choice([1, 665, 667, 899, rng.randrange(1, 666)]), rng.randrange(1, 100), rng.randrange(1, 10000)) for _ in range(600))]
    phones = [f"({rng.randrange(1000):03d}) {rng.randrange(1000):03d}-{rng.randrange(10000):04d}" for _ in range(50)] + [f"+49 {rng.randrange(1000):03d} {rng.randrange(10000):04d}" for _ in range(50)]
    first = rows(pii.pseudonymise(make_docs(numbers + phones), "k").drop("pii"))
    again = rows(pii.pseudonymise(make_docs([r["text"] for r in first]), "k"))
    assert [[v["kind"] for v in r["pii"]] for r in again] == [["ssn"]] * 600 + [["phone"]] * 100
    assert len({r["text"] for r in first[:600]}) == len(set(numbers))


def test_pii_long_text_of_numbers(make_docs):
    rng = random.Random(5)
    got = rows(pii.pseudonymise(make_docs([" ".join(f"{rng.randrange(100):02d}" for _ in range(340_000))]), "k"))
    assert got[0]["pii"] == []


def test_pii_long_text_without_blanks(make_docs):
    got = rows(pii.op5_feistel_pii(make_docs(["a" * 300_000, "1" * 100_000, "+1 " * 30_000, "a@" * 50_000])))
    assert [r["n_values"] for r in got] == [0, 0, 0, 0]


# --- quality rules

def plain_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, covered = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines, earlier, dup = (t or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in earlier
            earlier.add(x)
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, rep, n < 20 or 100 * rep > 30 * n


def test_quality_measures(make_docs, odd):
    rng = random.Random(9)
    texts = odd + [prose(rng, rng.randrange(200), rng.choice([2, 5, 500])) + "\n\n" + rng.choice(["# a\n# a\n#  a", "", "x|y <z>"]) for _ in range(80)]
    got = rows(quality.op6_quality(make_docs(texts, extra=True)))
    for r, t in zip(got, texts):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_measures(t)
        assert not (r["kept"] and r["base_failed"])
    assert quality.op6_quality(make_docs([])).count() == 0


def test_quality_policies(make_docs):
    rng = random.Random(4)
    clean = " ".join(rng.choice(["some", "plain", "words", "in", "a", "text"]) + str(i) for i in range(60))
    docs = make_docs([clean, clean.replace(" ", " ### "), "short", " ".join(w for w in clean.split()[:12] for _ in range(5))])
    assert [r["kept"] for r in rows(quality.op6_quality(docs))] == [True, False, False, False]
    kept = quality.apply_policy(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [0]
    found = {r["rule"]: tuple(r)[1:] for r in quality.ablations(quality.ledger(docs.select("doc_id", "text"))).collect()}
    assert found["too_few_words"] == (1, 1, 2) and found["long_words"] == (0, 0, 1)


# --- sharding

def test_shards(make_docs, odd):
    rng = random.Random(8)
    hot = prose(rng, 40)
    texts = [(i, hot if i % 3 == 0 else prose(rng, rng.randrange(5, 120)), "src0" if i % 2 else f"src{i % 7}") for i in range(3000)]
    texts += [(5000 + i, t, None) for i, t in enumerate(odd)] + [(None, "no id", "a"), (1, texts[1][1], "src0")]
    got = op9_kd_shards(make_docs(texts, extra=True)).collect()
    assert len(got) == len(texts)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(size) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 24
    assert max(size.values()) < 1.02 * mean + 5100 and min(size.values()) > 0.98 * mean - 5100
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[5000]["size"], by_id[5000]["text_crc32"]) == (8, 0)
    assert by_id[5005]["size"] == 8 + len(odd[5].encode())


def test_shards_do_not_depend_on_files_and_use_whole_names(make_docs):
    rng = random.Random(6)
    texts = [(i, prose(rng, 20), f"https://www.a-long-common-prefix.example/site{i % 24:02d}") for i in range(2400)] + [(1, "same", "x")] * 600 + [(None, "same", None)] * 300
    one = make_docs(texts)
    a, b = (sorted((r["doc_id"] or -1, r["size"], r["shard"]) for r in op9_kd_shards(d).collect()) for d in (one.coalesce(1), one.repartition(7, "text", "doc_id")))
    assert a == b
    held = collections.defaultdict(set)
    for r in kd_shards(make_docs(texts[:2400]), 24, dims=("source",)).collect():
        held[r["shard"]].add(r["doc_id"] % 24)
    assert max(len(s) for s in held.values()) <= 3


def test_shards_of_little(make_docs):
    assert kd_shards(make_docs([])).count() == 0
    assert [(r["shard"], r["slot"]) for r in kd_shards(make_docs(["one"]), 1).collect()] == [(0, 0)]
    assert len(kd_shards(make_docs([(1, "same", "a")] * 9), 3).collect()) == 9


# --- mixing

def fill(sizes, weights, cap):
    left, out, open_ = sum(sizes.values()), {}, dict(weights)
    total = left
    while open_:
        level = (total - sum(out.values())) / sum(open_.values())
        full = [s for s in open_ if open_[s] * level > cap * sizes[s]]
        if not full:
            return out | {s: w * level for s, w in open_.items()}
        for s in full:
            out[s] = cap * sizes[s]
            del open_[s]
    return out


def test_mix(make_docs, odd):
    rng = random.Random(6)
    texts = [(i, prose(rng, rng.randrange(1, 90)), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(2500)]
    texts += [(9000, "tiny source words", "zz"), (9001, None, "empty"), (9002, "x y z", None)] + [(9100 + i, t, "odd") for i, t in enumerate(odd)]
    docs = make_docs(texts, extra=True)
    got = rows(pareto_mix.mixed_sizes(docs))
    assert got == rows(pareto_mix.mixed_sizes(docs.repartition(5)))
    source = {t[0]: t[2] for t in texts}
    sizes = collections.Counter()
    for i, t, s in texts:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(names)}, 3)
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(5, 0.01 * want[s]) for s in names)
    mixed = pareto_mix.mix(docs)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in got if r["size"])
    assert pareto_mix.mixed_sizes(make_docs([])).count() == 0


def test_mix_unequal_odds(make_docs):
    docs = make_docs([(i, "a b c d", "s") for i in range(2000)] + [(5000 + i, "a b", "t") for i in range(2000)])
    docs = docs.selectExpr("*", "if(doc_id % 2 = 0, 4.0, 1.0) as odds")
    measured, decided = pareto_mix.copies(docs, odds_col="odds")
    got = pareto_mix._taken(measured, decided, "mix").where("source = 's'").collect()
    even, uneven = (sum(r["_copies"] for r in got if r["doc_id"] % 2 == k) for k in (0, 1))
    assert 2.5 < even / uneven < 5.5


def order_value(doc, text, share):
    bits = int(hashlib.md5(f"mix|{'' if doc is None else doc}|{zlib.crc32(text.encode())}".encode()).hexdigest()[:13], 16)
    u, p = (bits + 0.5) / 2 ** 52, min(max(share, 1e-12), 1 - 1e-9)
    return (math.log(u / (1 - u)) - math.log(p / (1 - p)) + 64) / 128


def pareto_sample(docs, target, weigh, cap=3):
    """Copies of each document of one source: certain ones, then a fixed number of words in Pareto order."""
    size = [len(t.split()) for _, t in docs]
    w = [weigh(n) for n in size]
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(cap, mid * x) for n, x in zip(size, w)) < target else (low, mid)
    e = [min(cap, high * x) for x in w]
    out = [math.floor(x + 1e-9) if x > cap - 1e-6 else math.floor(x) for x in e]
    want = target - sum(k * n for k, n in zip(out, size))
    rest = sorted((order_value(*docs[i], e[i] - out[i]), i) for i in range(len(docs)) if e[i] - out[i] > 1e-7)
    limit = -1.0
    for step in range(3):
        rest = [(p, i) for p, i in rest if p > limit and (step == 0 or size[i] <= want)]
        total, limit, left = 0, -1.0, want
        for p, i in rest:
            over = total + size[i] - want
            if over > 0 and not (step == 2 and over <= want - total):
                break
            total, limit, left = total + size[i], p, -over
        for p, i in rest:
            out[i] += p <= limit
        want = left
        if want < 1:
            break
    return out


def test_mix_against_brute_force(make_docs):
    rng = random.Random(12)
    texts = [(i, prose(rng, rng.choice([1, 2, 3, 5, 20, 80, 200])), f"s{i % 4}") for i in range(600)] + [(1000 + i, prose(rng, 4 + i % 50), "s4") for i in range(60)]
    got = {r["doc_id"]: r for r in pareto_mix.mixed_sizes(make_docs(texts), odds=pareto_mix.by_length).collect()}
    seen = set()
    for s in {t[2] for t in texts}:
        docs = [(i, t) for i, t, x in texts if x == s]
        want = pareto_sample(docs, got[docs[0][0]]["target"], lambda n: (n + 1) / (n + 51))
        assert [got[i]["taken"] for i, _ in docs] == [k * len(t.split()) for k, (_, t) in zip(want, docs)]
        assert abs(sum(got[i]["taken"] for i, _ in docs) - got[docs[0][0]]["target"]) <= 3
        seen |= {k for k in want}
    assert seen == {0, 1, 2, 3}
    many = pareto_mix.mix(make_docs(texts), odds=pareto_mix.by_length).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] * got[r["doc_id"]]["size"] for r in many} == {i: r["taken"] for i, r in got.items() if r["taken"]}
