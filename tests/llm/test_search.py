"""Decontamination, spelling variants and ranked search against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from canopyframe.llm import bag_search, fm_index, spelling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BENCH = "item_id bigint, text string"


def terms(text):
    return TERM.findall((text or "").encode().lower().decode())


def prose(rng, n, size=40):
    return " ".join(rng.choice(["W", "w", "é", "9"]) + str(rng.randrange(size)) for _ in range(n))


# --- decontamination

def hits(texts, items, window):
    phrases = collections.defaultdict(set)
    for i, t in items:
        w = terms(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            phrases[tuple(w[k:k + n])].add(i)
    out = []
    for t in texts:
        w, hit, found = terms(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in phrases:
                    hit |= set(range(k, k + n))
                    found |= phrases[tuple(w[k:k + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def planted(rng):
    items = [(i, prose(rng, rng.randrange(1, 30))) for i in range(30)]
    items += [(3, items[4][1]), (None, prose(rng, 12)), (40, None), (41, ""), (42, "!!"), (43, items[5][1]), (7, items[7][1].upper())]
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randrange(0, 20))]
        for _ in range(rng.randrange(0, 4)):
            words = re.split(" ", rng.choice(items)[1] or "x")
            a = rng.randrange(len(words))
            parts += [rng.choice([", ", " ", "\n-"]).join(words[a:a + rng.randrange(1, 25)]), prose(rng, rng.randrange(0, 9))]
        texts.append(" ".join(parts))
    return items, texts + texts[:7] + ["; ".join(t for _, t in items if t)]


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_decontamination(spark, make_docs, odd, block):
    items, texts = planted(random.Random(4))
    texts += odd
    got = fm_index.contamination(make_docs(texts, extra=True), spark.createDataFrame(items, BENCH).selectExpr("*", "1 as spans"), block_words=block)
    got = sorted(got.collect(), key=lambda r: r["doc_id"])
    want = hits(texts, items, 10)
    assert [r["n_words"] for r in got] == [w[0] for w in want]
    for text, r, w in zip(texts, got, want):
        assert sum(s["n_words"] for s in r["spans"]) == w[1]
        assert hashlib.sha256(",".join(r["items"]).encode()).hexdigest() == w[3]
        for s in r["spans"]:
            words = terms(text)
            assert terms(text.encode()[s["start"]:s["stop"]].decode()) == words[s["first_word"]:s["first_word"] + s["n_words"]]


def test_decontamination_digest_and_cleaned(spark, make_docs, odd):
    items, texts = planted(random.Random(8))
    texts += odd
    docs, bench = make_docs(texts, extra=True), spark.createDataFrame(items, BENCH)
    got = sorted(fm_index.op11_fm_decontamination(docs, bench).collect())
    assert [tuple(r)[1:] for r in got] == hits(texts, items, 10)
    kept = sorted(fm_index.cleaned(docs, bench).collect(), key=lambda r: r["doc_id"])
    assert docs.columns == fm_index.cleaned(docs, bench).columns
    for text, r, g in zip(texts, kept, got):
        assert r["text"] == text if not g["n_hit"] else len(terms(r["text"])) <= g["n_words"] - g["n_hit"] + 9


def test_decontamination_of_little(spark, make_docs):
    none = spark.createDataFrame([], BENCH)
    assert fm_index.op11_fm_decontamination(make_docs([]), none).count() == 0
    got = fm_index.op11_fm_decontamination(make_docs([(None, "a b c", "x"), (1, None, "x"), (1, "a", None), (1, "a", None)]), none).collect()
    assert sorted((r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == [(0, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False), (3, 0, 0, False)]
    long = " ".join(["ab"] * 300_000) + "x" * 2_000_000  # one very long text, one very long word
    bench = spark.createDataFrame([(1, "ab " * 30)], BENCH)
    got = fm_index.op11_fm_decontamination(make_docs([long, "x" * 3_000_000]), bench).collect()
    assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in got) == [(1, 0, 0), (300_000, 299_999, 1)]


def test_fm_index_finds_every_place():
    rng = random.Random(1)
    for trial in range(150):
        docs = [[rng.randrange(1, 4) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 6))] * (1 + trial % 2)
        index = fm_index.FmIndex(np.array([w for d in docs for w in d], np.uint64), np.array([len(d) for d in docs]))
        wanted = [[rng.randrange(1, 5) for _ in range(rng.randrange(1, 5))] for _ in range(10)]
        table = np.zeros((10, 5), np.uint64)
        for row, p in zip(table, wanted):
            row[:len(p)] = p
        found = {}
        for which, low, high in zip(*index.search(index.symbols(table), np.array([len(p) for p in wanted]))):
            found[which] = sorted(index.locate(np.arange(low, high)).tolist())
        for i, p in enumerate(wanted):
            assert found.get(i, []) == [s + k for d, s in zip(docs, index.doc_starts) for k in range(len(d) - len(p) + 1) if d[k:k + len(p)] == p]


# --- spelling variants

def variants(rows, least, length, damage):
    n = collections.Counter()
    for i, t in rows:
        for w in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % damage == 0 else w] += 1
    n = {w: k for w, k in n.items() if k >= least and len(w) >= length}
    near = {w: [v for v in n if v != w and apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def apart(u, v):
    if abs(len(u) - len(v)) > 1:
        return False
    a, b = sorted((u, v), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("part", [10_000, 5])
def test_spelling_variants(make_docs, odd, part):
    rng = random.Random(6)
    stems = ["".join(rng.choice("aabéÿz") for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa", "É" * 6]
    rows = [(None if i % 17 == 0 else i, " ".join(rng.choice(stems[:1 + rng.randrange(len(stems))]).replace("a", rng.choice("aaaA")) for _ in range(60)) + "-x_9", "s") for i in range(120)]
    long = "q" * 300
    rows += [(500 + i, t, "s") for i, t in enumerate([long, long + "r", long[:150] + "r" + long[151:], "q" * 100, "q" * 101, "q" * 99, "r" * 2_000_000] * 3)]
    rows += [(700 + i, t, None) for i, t in enumerate(odd)]
    got = spelling.spelling_groups(make_docs(rows, extra=True), damage=7, part=part)
    want = variants([r[:2] for r in rows], 3, 5, 7)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 100 and any(w[2] != w[1] for w in want if w[1])


def test_spelling_of_little(make_docs):
    assert spelling.op12_spelling_variants(make_docs([])).count() == 0
    assert spelling.op12_spelling_variants(make_docs([None, "", "abcde"])).count() == 0
    assert [tuple(r) for r in spelling.op12_spelling_variants(make_docs(["abcde Abcde", (5, "ABCDE", None)])).collect()] == [("abcde", None, "abcde", 3, 0, None)]


def test_acceptor_is_minimal_and_composes():
    rng = random.Random(2)
    for _ in range(40):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 80))})
        machine = spelling.Acceptor(words)
        assert sorted(p for p, s in machine.paths() if machine.final[s]) == words
        rights = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p, _ in machine.paths()}
        assert len(machine.arcs) == len(rights)
        got = [tuple(sorted(p)) for p in spelling.OneEdit(machine).pairs()]
        assert len(got) == len(set(got)) and set(got) == {(u, v) for u in words for v in words if u < v and apart(u, v)}


# --- ranked search

def ranking(rows, items, top=10):
    bags = [(i, collections.Counter(terms(t))) for i, t in rows]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            scored.append((-s, i is None, i or 0, i))
        best = sorted(x for x in scored if x[0])[:top]
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_ranked_search(spark, make_docs, odd, block):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(1, 60), 80) for _ in range(150)]
    texts += [texts[3]] * 40 + [texts[4].upper(), " ".join(reversed(texts[4].split()))]
    rows = [(i, t, "s") for i, t in enumerate(texts + odd)] + [(None, texts[3], "s"), (None, texts[5], None), (3, texts[3], "s")]
    rng.shuffle(rows)
    items = [(i, prose(rng, rng.randrange(1, 30), 90)) for i in range(12)] + [(20, None), (21, "..."), (22, texts[3]), (None, texts[5]), (2, "w1 w1 w2"), (23, "unseen words")]
    got = bag_search.ranked_search(make_docs(rows, extra=True), spark.createDataFrame(items, BENCH).selectExpr("*", "1 as rank"), block_terms=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranking([r[:2] for r in rows], items)


def test_ranked_search_of_little(spark, make_docs):
    none = spark.createDataFrame([], BENCH)
    one = spark.createDataFrame([(1, "a b")], BENCH)
    assert bag_search.op13_bag_search(make_docs([]), one).count() == 0
    assert bag_search.op13_bag_search(make_docs(["a"]), none).count() == 0
    assert bag_search.op13_bag_search(make_docs([None, ""]), one).count() == 0
    long = make_docs(["a " * 1_000_000, "b" * 2_000_000])
    assert [(r["rank"], r["doc_id"]) for r in bag_search.op13_bag_search(long, one).collect()] == [(1, 0)]
