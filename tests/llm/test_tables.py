"""Operators on vectors, pages and conversations, the pipeline and the registered queries."""

import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from canopyframe.llm import chat, links, pivot_index, url_filter
from tests.llm.test_texts import linked, plain_measures, sets_of

VEC = "vec_id bigint, embedding array<float>, label int"


def cosines(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_pivot_index_recall_and_exactness(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(700, 32))
    near = [base[rng.integers(700)] + rng.normal(size=32) * rng.uniform(0.1, 0.6) for _ in range(1500)]
    crowd = [base[0] + rng.normal(size=32) * 0.05 for _ in range(1300)]
    x = np.concatenate([base, near, crowd]).astype(np.float32)
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x)]
    got = sorted(pivot_index.near_vectors(spark.createDataFrame(rows, VEC)).collect())
    hits = cosines(x.astype(np.float64)) >= 0.9
    np.fill_diagonal(hits, False)
    want = hits.sum(axis=1)
    found = np.array([r["n_links"] for r in got])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    rest = slice(0, 2200)  # without the crowd
    assert found[rest].sum() >= 0.9 * want[rest].sum()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_pivot_index_odd_vectors(spark):
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, float("nan")], 0), (4, [1.0, None], 0), (5, [1.0, float("inf")], 0), (6, [], 0), (7, [1.0, 2.0, 3.0], 0),
            (8, [1.0, 0.0], 0), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [2.0, 0.1], 0), (11, [-1.0, 0.0], 0), (12, [1e-30, 1e-32], 0)]
    got = sorted(tuple(r) for r in pivot_index.op8_pivot_index(spark.createDataFrame(rows, VEC).selectExpr("*", "1 as rep", "2 as near")).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 11)]
    assert got == sorted(alone + [(8, 4, 8, True), (9, 4, 8, False), (9, 4, 8, False), (10, 4, 8, False), (12, 4, 8, False)])
    assert pivot_index.op8_pivot_index(spark.createDataFrame([], VEC)).count() == 0


def test_pivot_index_lengths_and_ids(spark):
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [3.0, 1.0, 2.0], 0), (3, [0.0, 0.0, 1.0], 0), (4, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (6, [1.0, 0.0, 0.0, 0.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivot_index.op8_pivot_index(spark.createDataFrame(rows, VEC)).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6)}
    near = [[1.0, 0.0, 0.01], [1.0, 0.01, 0.0], [1.0, 0.02, 0.0]]
    rows = [(None, near[0], 0), (None, near[1], 0), (7, near[2], 0), (8, [0.0, 1.0, 0.0], 0), (8, [0.0, 0.0, 1.0], 0), (9, [0.0, 0.01, 1.0], 0),
            (None, [0.0, -1.0, 0.0], 0), (None, [0.01, -1.0, 0.0], 0)]
    got = [tuple(r) for r in pivot_index.op8_pivot_index(spark.createDataFrame(rows, VEC)).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, 7, False)] * 2 + [(7, 2, 7, True), (8, 0, 8, True), (8, 1, 8, True), (9, 1, 8, False)] + [(None, 1, None, True)] * 2, key=str)


def test_pivot_sample_reads_few_vectors(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "SAMPLE", 40)
    rng = np.random.default_rng(5)
    rows = [(i, i * 7919 % 3001, [float(v) for v in e]) for i, e in enumerate(rng.normal(size=(3000, 4)))]
    seen = spark.sparkContext.accumulator(0)

    def vector(e):
        seen.add(1)
        return e

    df = spark.createDataFrame(rows, "h1 bigint, h2 bigint, e array<double>").repartition(30)
    hashed = df.select("*", F.xxhash64("h1", "h2", F.lit("pivot")).alias("order")).collect()
    pivots = pivot_index._pivots(df.select("h1", "h2", F.udf(vector, "array<double>")("e").alias("vec")), 4)
    assert seen.value < 400  # the smallest of each of 30 partitions would be 1200 of 3000
    x = np.array([r["e"] for r in sorted(hashed, key=lambda r: (r["order"], r["h1"], r["h2"]))[:40]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for e in x:
        if not want or max(e @ w for w in want) < pivot_index.APART:
            want.append(e)
    assert np.allclose(pivots, want)


def test_pivot_lists_in_blocks_and_groups_link_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 16))
    crowds = [base[k] + rng.normal(size=(size, 16)) * 0.05 for k, size in ((0, 400), (1, 150), (2, 90))]
    x = np.concatenate([base, base[rng.integers(300, size=400)] + rng.normal(size=(400, 16)) * 0.2, *crowds]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in e], 0) for i, e in enumerate([*x, *x[:50]])], VEC)
    whole = sorted(pivot_index.near_vectors(df).collect())
    hits = cosines(np.concatenate([x, x[:50]]).astype(np.float64)) >= 0.9
    np.fill_diagonal(hits, False)
    found, want = np.array([r["n_links"] for r in whole]), hits.sum(axis=1)
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    monkeypatch.setattr(pivot_index, "BLOCK", 60)
    monkeypatch.setattr(pivot_index, "TOGETHER", 16 * 100)
    dealt, deal = [], pivot_index._deal
    monkeypatch.setattr(pivot_index, "_deal", lambda *args: dealt.append(deal(*args)) or dealt[-1])
    assert sorted(pivot_index.near_vectors(df).collect()) == whole
    assert dealt[0].where("i < j").count() > 0  # long lists in several blocks


def test_vectors_are_shipped_once_for_the_lists_of_a_pivot(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=(2000, 8))
    df = spark.createDataFrame([(i, [float(v) for v in e], 0) for i, e in enumerate(x)], VEC)
    shipped, compare = [], pivot_index._blocks
    monkeypatch.setattr(pivot_index, "_blocks", lambda rows, *args: shipped.append(rows) or compare(rows, *args))
    pivot_index.near_vectors(df)
    assert shipped[0].count() <= 6 * 2000  # one of 21 lists each before


def test_components_of_a_long_path(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in links.components(pairs).collect()}
    assert got == {i: 0 for i in range(301)}
    assert links.components(pairs.where("a < 0")).count() == 0


PAGES = "page_id bigint, url string, html string"


def test_url_rules(spark):
    urls = ["https://Blog.Example.NET/en/1?x=/de/", "http://a.net/x#y", "https://example.com/de/1", "https://notexample.com/de/1", "https://w.example.com/fr/2",
            "https://x.org/fr/z", "https://x.org/de/z", None, "no scheme", "http://", "https://example.net", "ftp://u.example.net/en/a?b://c/d"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES).selectExpr("*", "'q' as host", "1 as trust")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.op7_url_filter(pages).collect()}
    assert got[0] == ("blog.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2][2:] == ("example.com/de/", "block")
    assert got[3][2:] == (None, "allow") and got[4][2:] == (None, "allow")
    assert got[5][2:] == ("org/fr/", "allow") and got[6][2] is None
    assert got[7] == got[8] == ("", "", None, "allow") and got[9][:2] == ("", "")
    assert got[10] == ("example.net", "", None, "allow")  # an empty path doesn't start with a rule's
    assert got[11] == ("u.example.net", "/en/a", "example.net/en/", "allow")
    assert url_filter.op7_url_filter(spark.createDataFrame([], PAGES)).count() == 0


def test_propagation_follows_links(spark):
    link = lambda *hosts: " ".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    pages = [(1, "http://bad.net/1", ""), (2, "http://points.com/1", link("bad.net", "farm.com")), (3, "http://farm.com/1", link("points.com")),
             (4, "http://good.org/fr/1", link("friend.com")), (5, "http://friend.com/1", link("good.org", "bad.net", "good.org", "good.org", "good.org"))]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_pagerank_against_power_iteration(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(20), rng.randrange(20)): rng.randrange(1, 4) for _ in range(60)}
    edges = {e: n for e, n in edges.items() if e[0] != e[1]}
    score = url_filter.propagate(spark.createDataFrame([(str(a), str(b), n) for (a, b), n in edges.items()], "src string, dst string, n bigint"),
                                 spark.createDataFrame([("0", 1.0), ("3", 1.0)], "host string, seed double"), rounds=8)
    seed = np.zeros(20)
    seed[[0, 3]] = 0.5
    x = seed.copy()
    out = np.array([sum(n for (a, _), n in edges.items() if a == k) for k in range(20)])
    for _ in range(8):
        new = np.zeros(20)
        for (a, b), n in edges.items():
            new[b] += x[a] * n / out[a]
        x = 0.85 * new + (1 - 0.85 * new.sum()) * seed
    got = {int(r["host"]): r["score"] for r in score.collect()}
    assert all(abs(got.get(k, 0.0) - x[k]) < 1e-9 for k in range(20))


def test_distrust_reaches_the_end_of_a_chain(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "EPSILON", 0.01)
    pages = [(0, "http://bad.net/1", "")] + [(i, f"http://h{i}.com/1", f'<a href="https://{"bad.net" if i == 1 else f"h{i - 1}.com"}/p">x</a>') for i in range(1, 24)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {i: "block" for i in range(24)}


CHAT = "conv_id bigint, turn bigint, role string, text string"
TOOLS = json.dumps({"tools": [{"name": "add", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}, "u": {"type": "string", "enum": ["m", "s"]}},
                                                            "required": ["a"], "additionalProperties": False}}]})


def call(key, arguments, name="add"):
    return {"id": key, "name": name, "arguments": arguments}


def say(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)})


def answer(key, text):
    return json.dumps({"tool_call_id": key, "content": text})


def test_chat_links_orders_and_validates(spark):
    rows = [(1, 0, "system", TOOLS), (1, 1, "user", "plain é \"text\""), (1, 2, "assistant", say(call("c1", {"u": "m", "a": 1}), call("c2", {"a": "x", "z": 2}))),
            (1, 3, "user", "{not json"), (1, 4, "tool", answer("c2", "two")), (1, 5, "tool", answer("c1", "one")), (1, 6, "tool", answer("c9", "none")),
            (1, 7, "assistant", say(call("c3", {}, "nosuch"), call("c1", {"a": 2}))), (2, 0, "assistant", say(call("b", {"a": {"$ref": "a"}}), call("a", {"a": 1}))),
            (3, 0, "assistant", say(call("x", {"q": {"$ref": "y"}}), call("y", {"q": {"$ref": "x"}}))), (None, None, None, None), (4, 0, "user", "again"), (4, 0, "user", "again")]
    got = chat.format_chat(spark.createDataFrame(rows, CHAT).selectExpr("*", "'x' as id", "'x' as doc", "'x' as calls")).collect()
    assert len(got) == len(rows)
    first = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: tuple(r["position"]))
    assert [r["turn"] for r in first] == [0, 1, 2, 5, 4, 3, 6, 7]
    by_turn = {r["turn"]: r for r in first}
    assert by_turn[1]["message"] == '{"content":"plain é \\"text\\"","role":"user"}'
    assert json.loads(by_turn[2]["message"])["tool_calls"][0] == {"arguments": {"a": 1, "u": "m"}, "id": "c1", "name": "add"}
    assert '"arguments":{"a":1,"u":"m"}' in by_turn[2]["message"]
    assert sorted(by_turn[2]["problems"]) == ["c2:type:a", "c2:unknown:z"]
    assert by_turn[6]["problems"] == ["c9:no_call"] and not by_turn[6]["linked"] and by_turn[5]["linked"]
    assert sorted(by_turn[7]["problems"]) == ["c1:repeated_id", "c3:no_result", "c3:unknown_tool"]
    assert json.loads(by_turn[3]["message"])["content"] == "{not json"
    assert any(p.endswith(":circle") for r in got if r["conv_id"] == 3 for p in r["problems"])
    assert [r["position"]["level"] for r in got if r["conv_id"] == 2] == [1]
    assert [json.loads(r["message"]) for r in got if r["conv_id"] is None] == [{"content": "", "role": "user"}]
    assert chat.op4_chat_format(spark.createDataFrame([], CHAT)).count() == 0


KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def plain_check(value, schema, path=""):
    """Schema problems of a value by plain recursion."""
    inner = lambda k: f"{path}.{k}" if path else k
    if isinstance(schema, bool):
        return [] if schema else [f"not_allowed:{path}"]
    out = []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if kinds and not any(isinstance(value, KINDS[k]) and (k not in ("integer", "number") or number) for k in kinds):
        out.append(f"type:{path}")
    same = lambda a, b: json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)
    if "enum" in schema and not any(same(e, value) for e in schema["enum"]):
        out.append(f"enum:{path}")
    if "const" in schema and not same(schema["const"], value):
        out.append(f"const:{path}")
    bounds = [("minimum", number, lambda a, b: a < b), ("maximum", number, lambda a, b: a > b), ("exclusiveMinimum", number, lambda a, b: a <= b),
              ("exclusiveMaximum", number, lambda a, b: a >= b), ("minLength", isinstance(value, str), lambda a, b: len(a) < b),
              ("maxLength", isinstance(value, str), lambda a, b: len(a) > b), ("minItems", isinstance(value, list), lambda a, b: len(a) < b),
              ("maxItems", isinstance(value, list), lambda a, b: len(a) > b)]
    out += [f"{k}:{path}" for k, fits, bad in bounds if k in schema and fits and bad(value, schema[k])]
    out += [f"unsupported:{inner(k)}" for k in schema if k not in (*chat.CHECKED, *chat.DESCRIBING)]
    if isinstance(value, dict):
        out += [f"missing:{inner(k)}" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            other = schema.get("additionalProperties")
            if k in schema.get("properties", {}):
                out += plain_check(v, schema["properties"][k], inner(k))
            elif other is False:
                out.append(f"unknown:{inner(k)}")
            elif isinstance(other, dict):
                out += plain_check(v, other, inner(k))
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += plain_check(v, schema["items"], f"{path}[{i}]")
    return out


def random_schema(rng, depth):
    kind = rng.choice(["string", "integer", "number", "boolean", "array", "object", ["string", "null"], ["integer", "array"]] if depth else ["string", "integer", ["number", "null"]])
    out = {"type": kind, "description": "x"}
    more = {"enum": ["a", 1, None, [1], {"b": 2}], "const": "a", "minimum": 2, "maximum": 3.5, "exclusiveMinimum": 1, "exclusiveMaximum": 4, "minLength": 2, "maxLength": 2,
            "minItems": 1, "maxItems": 2, "pattern": "^a", "anyOf": []}
    for k in rng.sample(sorted(more), rng.choice([0, 0, 1, 2])):
        out[k] = more[k]
    if depth and ("object" in kind or rng.random() < 0.2):
        out["properties"] = {k: random_schema(rng, depth - 1) if rng.random() < 0.9 else rng.random() < 0.5 for k in rng.sample("abcd", rng.randrange(4))}
        out["required"] = rng.sample("abcd", rng.randrange(3))
        if rng.random() < 0.6:
            out["additionalProperties"] = rng.choice([True, False, random_schema(rng, depth - 1)])
    if depth and ("array" in kind or rng.random() < 0.2):
        out["items"] = random_schema(rng, depth - 1)
    return out


def random_value(rng, depth):
    plain = [None, True, False, "", "a", "abc", 0, 1, 2, 3, 7, 2.5, -1.25]
    if depth and rng.random() < 0.6:
        return {k: random_value(rng, depth - 1) for k in rng.sample("abcde", rng.randrange(4))} if rng.random() < 0.6 else [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice(plain)


def test_chat_arguments_against_plain_recursion(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for conv in range(120):
        schema = {**random_schema(rng, 3), "type": "object", "properties": {k: random_schema(rng, 2) for k in "abc"}}
        given = {k: random_value(rng, 3) for k in rng.sample("abcd", 3)}
        rows.append((conv, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": json.dumps(schema) if conv % 2 else schema}]})))
        rows.append((conv, 1, "assistant", json.dumps({"tool_calls": [{"id": "c", "name": "f", "arguments": json.dumps(given) if conv % 3 else given}]})))
        rows.append((conv, 2, "tool", json.dumps({"tool_call_id": "c", "content": "done"})))
        want[conv] = sorted(plain_check(given, schema))
    got = {r["conv_id"]: sorted(p.split(":", 1)[1] for p in r["problems"]) for r in chat.format_chat(spark.createDataFrame(rows, CHAT)).where("turn = 1").collect()}
    assert got == want and sum(map(len, want.values())) > 200
    assert any("." in p or "[" in p for ps in want.values() for p in ps)


def test_pipeline_stages(spark, make_docs, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "token_ids"]
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert kept.columns == docs.columns and all(not plain_measures(r["text"])[-1] for r in kept.collect())
    ids = sorted(r["doc_id"] for r in kept.collect())
    once = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    roots = linked(ids, sets_of([texts[i] for i in ids], 5), 80)
    assert once.columns == docs.columns and sorted(r["doc_id"] for r in once.collect()) == sorted(set(roots))
    private = corpus_pipeline.personal_data(spark, once, sf_dir)
    assert private.columns == docs.columns and private.count() == once.count()
    mixed = corpus_pipeline.source_mix(spark, private, sf_dir)
    assert mixed.columns == docs.columns
    last = corpus_pipeline.token_ids(spark, mixed, sf_dir)
    ran = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (r["doc_id"], tuple(r["ids"]))
    assert sorted(map(key, last.collect())) == sorted(map(key, ran.collect()))


def test_near_duplicates_leave_one_of_repeated_rows(spark, make_docs, sf_dir):
    text = " ".join(f"w{i}" for i in range(40))
    docs = make_docs([(2, text, "a"), (2, text, "a"), (1, text + " more", "b"), (5, None, None), (6, "", "c")])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == [1, 5, 6]
    packed = docs.selectExpr("doc_id", "text", "lang", "doc_id as _key", "monotonically_increasing_id() as doc", "'a' as place", "'b' as key", "'c' as second")
    got = corpus_pipeline.near_duplicates(spark, packed, sf_dir)
    assert got.columns == packed.columns and sorted((r["doc_id"], r["_key"], r["place"]) for r in got.collect()) == [(1, 1, "a"), (5, 5, "a"), (6, 6, "a")]
    empty = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_every_query_is_registered():
    names = [m[1] for m in (re.match(r"op(\d+)_", k) for k in queries()) if m]
    assert sorted(map(int, names)) == list(range(1, 14)) and "pipeline" in queries()
