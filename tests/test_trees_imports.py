"""Path aggregates by brute force on random trees and a long path; imports and shared views on literal fixtures."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from provena.operators import graph, imports, ledger


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(4)
    rows = [(i, None if i == 0 or rng.random() < 0.05 else rng.randrange(max(0, i - 6), i), rng.randrange(40), rng.random() < 0.4) for i in range(150)] + [(200, 999, 5, False)]
    return rows, spark.createDataFrame(rows, "node long, parent long, t long, skip boolean").repartition(3)


def way(rows, n):
    parent, out = {r[0]: r[1] for r in rows}, []
    while parent.get(n) is not None:
        n = parent[n]
        out.append(n)
    return out


def test_path_aggregates_equal_brute_force(forest):
    rows, d = forest
    up = {r[0]: way(rows, r[0]) for r in rows}
    assert sorted(map(tuple, graph.ancestors(d).collect())) == sorted((n, a, i + 1) for n, x in up.items() for i, a in enumerate(x))
    below = {n: sum(n in x for x in up.values()) for n in up}
    assert {tuple(r) for r in graph.depths(d).collect()} == {(n, len(x), below[n]) for n, x in up.items()}
    t = {r[0]: r[2] for r in rows}
    late = {n: max([t[n], *[t[a] + i + 1 for i, a in enumerate(x) if a in t]]) for n, x in up.items()}
    assert {r.node: r.t for r in graph.later_than_parents(d, "t").collect()} == late
    skip = {r[0]: r[3] for r in rows}
    hung = {n: next((a for a in x if a in skip and not skip[a]), None) for n, x in up.items() if not skip[n]}
    assert {r.node: r.parent for r in graph.nearest_valid_parent(d, F.col("skip")).collect()} == hung
    for n in (0, 77, 149):
        assert {r.node for r in graph.path(d, n).collect()} == {n, *up[n]}
        assert {r.node for r in graph.subtree(d, n).collect()} == {n, *(m for m, x in up.items() if n in x)}
    assert graph.depths(d.where("false")).count() == 0


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    d = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).cast("long").alias("t"))
    keep = graph.kept
    monkeypatch.setattr(graph, "kept", lambda x: rounds.append(1) or keep(x))
    assert tuple(graph.depths(d).agg(F.max("depth"), F.max("descendants"), F.sum("depth")).first()) == (n - 1, n - 1, n * (n - 1) // 2)
    assert len(rounds) < 20
    assert graph.later_than_parents(d, "t").agg(F.sum(F.abs(F.col("t") - F.col("node")))).first()[0] == 0
    with pytest.raises(ValueError, match="cycle"):
        graph.depths(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"))


def test_siblings_on_a_path_with_a_cycle(spark):
    d = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1), (5, 2), (6, 5)], "node long, parent long")
    got = {r.node: r.parent for r in graph.path_with_siblings(d, 5).collect()}
    assert got == {1: None, 2: 1, 3: 2, 4: 1, 5: 2}


def node(i, parent, role, text, kind="text", **meta):
    m = {"author": {"role": role}, "content": {"content_type": kind, "parts": [text]}, "create_time": 1700000000 + i, "metadata": meta}
    return {"id": f"n{i}", "parent": parent, "message": m}


TREE = [{"title": "t", "create_time": 1, "mapping": {
    "root": {"id": "root", "parent": None, "message": None}, "n1": node(1, "root", "system", "rules"), "n2": node(2, "n1", "user", "ask"),
    "n3": node(3, "n2", "assistant", "hm", "thoughts"), "n4": node(4, "n3", "assistant", ""),
    "n5": node(5, "n4", "assistant", "see A and B", citations=[{"start_ix": 4, "end_ix": 5, "metadata": {"type": "webpage", "title": "TA", "url": "u/a"}}, {"start_ix": 10, "end_ix": 11, "metadata": {"type": "webpage", "title": "TB", "url": "u/b"}}, {"start_ix": 0, "end_ix": 3, "metadata": {"type": "file"}}]),
    "n6": {"id": "n6", "parent": "n5", "message": {"author": {"role": "tool"}, "content": {"content_type": "code", "language": "py", "text": "1"}}},
}}]
CHAIN = [{"name": "c", "created_at": "2026-01-01T00:00:00Z", "chat_messages": [
    {"uuid": "a", "sender": "human", "text": "hi", "created_at": "2026-01-01T00:00:05Z"}, {"uuid": "b", "sender": "assistant", "content": []},
    {"uuid": "c", "sender": "assistant", "content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": "yo"}, {"type": "text", "text": "!"}], "created_at": "2026-01-01T00:00:04Z"}]}]
CHATS = {"version": 4, "history": [{"name": "h", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"name": "e", "messages": []}]}
NATIVE = {"conversationId": "x", "title": "n", "recursive": True, "messages": [{"messageId": "1", "text": "one", "isCreatedByUser": True, "createdAt": "2026-01-01T00:00:00Z", "children": [
    {"messageId": "2", "text": "two", "createdAt": "2026-01-01T00:00:01Z", "children": [{"messageId": "3", "content": [{"type": "text", "text": "three"}]}]}, {"messageId": "4", "text": "", "children": [{"messageId": "5", "text": "lost with its parent"}]}]}]}


def test_imports(spark):
    rows = [("tree", json.dumps(TREE)), ("chain", json.dumps(CHAIN)), ("chats", json.dumps(CHATS)), ("native", json.dumps(NATIVE)), ("flat", json.dumps({"conversationId": "y", "messages": [{"messageId": "1", "text": "a"}, {"messageId": "2", "parentMessageId": "1", "text": "b"}]})), ("none", "[]"), ("null", None)]
    d = spark.createDataFrame(rows, "file string, json string")
    assert {r.file: r.f for r in d.select("file", imports.export_format("json").alias("f")).collect()} == {"tree": "tree", "chain": "chain", "chats": "chats", "native": "native", "flat": "native", "none": "tree", "null": None}
    got: dict = {}
    for r in imports.imported(d).orderBy("file", "conv", "seq").collect():
        got.setdefault(r.file, []).append((r.node, None if r.parent == imports.NO_PARENT else r.parent, r.role, r.text))
    assert got["tree"] == [("n2", None, "user", "ask"), ("n5", "n2", "assistant", "see  ([TA](u/a)) and  ([TB](u/b))"), ("n6", "n5", "tool", "```py\n1\n```")]
    assert got["chain"] == [("a", None, "user", "hi"), ("c", "a", "assistant", "yo!")]
    assert got["chats"] == [("0-0", None, "user", "q"), ("0-1", "0-0", "assistant", "a")]
    assert sorted(got["native"]) == [("1", None, "user", "one"), ("2", "1", "assistant", "two"), ("3", "2", "assistant", "three")]
    assert sorted(got["flat"]) == [("1", None, "assistant", "a"), ("2", "1", "assistant", "b")] and len(got) == 5
    times = [r.created for r in imports.imported(d.where("file = 'chain'")).orderBy("seq").collect()]
    assert times == [datetime(2026, 1, 1, 0, 0, 5), datetime(2026, 1, 1, 0, 0, 5, 1000)]
    with pytest.raises(Exception, match="unsupported import: bad"):
        imports.imported(spark.createDataFrame([("bad", '{"a": 1}')], "file string, json string")).collect()
    assert imports.imported(d.where("false")).count() == 0


def test_shared_view_drops_fields_at_any_depth(spark):
    kind = "message_id string, parent_id string, user string, text string, files array<struct<name:string,user:string,meta:struct<user:string,size:int>,only:struct<user:string>>>, extra map<string,struct<user:string,k:int>>"
    rows = [("m1", "root", "u", "hi", [("f", "secret", ("s", 1), ("s",)), None], {"user": ("s", 0), "x": ("s", 2)}), ("m2", "m1", "u", None, None, None), (None, None, "u", "x", [], {})]
    v = ledger.shared_view(spark.createDataFrame(rows, kind), "salt", ["text", "files", "extra", "user"], ("user",), "root")
    assert "user" not in v.schema.simpleString().replace("user_", "") and v.columns == ["message_id", "parent_id", "text", "files", "extra"]
    a, b, c = v.collect()
    assert a.parent_id == "root" and b.parent_id == a.message_id != "m1" and c.message_id is None
    assert tuple(a.files[0]) == ("f", (1,), None) and a.files[1] is None and {k: tuple(x) for k, x in a.extra.items()} == {"x": (2,)} and b.files is None
