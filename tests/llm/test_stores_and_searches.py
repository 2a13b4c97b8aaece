"""Id stores, bag search and the divergence audit: brute force, exact round trips, SQL and edge cases."""

import glob
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from provena.llm import bag_search, divergence, id_store, search
from provena.llm.tokens import tokenizer, vocabulary_path
from provena.llm.words import U64, alnum_words


def equal_to_sql(spark, sf_dir, query, sql):
    got = query(spark, sf_dir).toPandas()
    with duckdb.connect() as c:
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            at = f"{path}/*.parquet" if os.path.isdir(path) else path
            c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{at}'")
        want = c.execute(sql).df()
    cols = sorted(want.columns)
    order = lambda x: x[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


# ---- op11


@pytest.mark.parametrize("n", [0, 1, 2, 700, 5000])
def test_a_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.int64).astype(U64)
    h = id_store.PerfectHash.built(keys)
    assert sorted(h.slots(keys)) == list(range(n))
    other = np.random.default_rng(n + 1).integers(0, 1 << 63, 1000, dtype=np.int64).astype(U64)
    raw = id_store.IndexFile.packed(keys, (keys >> U64(7)).astype(np.uint32), {c: np.arange(n) for c in ("file", "offset", "n", "start")})
    index = id_store.IndexFile(raw)
    got, there = index.lookup(keys, (keys >> U64(7)).astype(np.uint32))
    assert there.all() and (got["offset"] == np.arange(n)).all()
    assert index.lookup(other, (other >> U64(7)).astype(np.uint32))[1].sum() <= 1  # fingerprints tell what isn't there
    with pytest.raises(ValueError, match="differ"):
        id_store.PerfectHash.built(np.zeros(2, U64))


TEXTS = [(3, "Some text"), (1, None), (2, ""), (None, "no name"), (7, "<|endoftext|> a special, Ünï " * 50), (-4, "x " * 3000), (None, None), (3, "another of the same id"), (3, "Some text"), (10**15, "last")]
HOT = [(5, f"copy {i % 40}") for i in range(300)] + [(None, f"unnamed {i}") for i in range(100)]


@pytest.mark.parametrize("options", [{}, {"ranges": 7, "file_tokens": 40, "index_keys": 16}])
def test_id_store_round_trip(spark, options):
    rows = TEXTS + (HOT if options else [])
    docs = spark.createDataFrame([(i, t, 0, "y") for i, t in rows], "doc_id long, text string, start int, ids string").repartition(4)  # clashing extra columns
    store = id_store.write_store(docs, **options)
    keys = id_store.keys_of(docs)
    got = sorted(store.fetched(keys, 100).collect(), key=lambda r: r.start)
    t = tokenizer(vocabulary_path(), False)
    encode = lambda x: tuple(t.encode(x or "", add_special_tokens=False).ids) + (1,)
    order = [r.doc_id for r in got]
    assert order == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    at = 0
    seen = Counter()
    for r in got:
        ids = tuple(np.frombuffer(r.ids, "<u4"))
        assert r.start == at and r.n_tokens == len(ids) and r.copy == seen[r.doc_id]
        at += len(ids)
        seen[r.doc_id] += 1
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4"))) for r in got) == Counter((i, encode(x)) for i, x in rows)
    if options:
        assert store.files.count() > 7 and store.index.count() > 10
        parts = {r.name for r in store.located(keys.where("doc_id = 5")).join(store.files, "file").select("name").distinct().collect()}
        assert len(parts) > 3  # the hot doc_id is dealt over several ranges
    absent = spark.createDataFrame([(99, 0), (3, 50), (1, 0)], "doc_id long, copy long")
    assert {(r.doc_id, r.copy): r.n for r in store.located(absent).collect()} == {(99, 0): None, (3, 50): None, (1, 0): 1}
    assert store.fetched(absent).count() == 1


def test_id_store_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    store = id_store.write_store(docs)
    assert store.fetched(id_store.keys_of(docs)).count() == 0
    assert store.located(spark.createDataFrame([(1, 0)], "doc_id long, copy long")).first().n is None


def test_op11_equals_the_tokenizer(spark, sf_dir):
    got = id_store.op11_id_store(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    docs, t, at, rows = pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id"), tokenizer(vocabulary_path(), False), 0, []
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        rows.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got.values.tolist() == [list(r) for r in rows]


# ---- op12


def brute_ranking(docs, items, top=10):
    bags = [(i, Counter(w.decode() for w in alnum_words((t or "").encode()))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(w.decode() for w in alnum_words((t or "").encode()))
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, terms in asked.items():
        scored = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t, c in terms.items() if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def test_bag_search_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "A1"]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(int(i), text(int(rng.integers(1, 12)))) for i in rng.permutation(200)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(1000 + i, docs[5][1] + " outside words") for i in range(60)]  # copies; other length class, same bag
    docs += [(None, docs[5][1]), (7, None), (8, ""), (9, "... !"), (3, docs[5][1]), (2000, "w1 " * 5000), (2001, "other " * 9)]
    items = [(i, text(4)) for i in range(12)] + [(3, "w1 w1 W2"), (None, "w4"), (50, None), (51, "unknown"), (52, docs[5][1])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(5)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    want = brute_ranking(docs, items)
    for block_terms in (1_000_000, 10):
        got = sorted((tuple(r) for r in bag_search.ranked(d, b, block_terms=block_terms).select("item_id", "rank", "doc_id", "score").collect()), key=str)
        assert got == want
    assert bag_search.ranked(d.where("false"), b).count() == 0 and bag_search.ranked(d, b.where("false")).count() == 0
    assert bag_search.ranked(d.select("doc_id", F.lit(None).cast("string").alias("text")), b).count() == 0


def test_classes_are_verified(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "b A a"), (3, "a b"), (4, "a b a zz"), (5, "zz")], "doc_id long, text string")
    m = bag_search.bags(d, [b"a", b"b"]).withColumn("m", F.lit(1).cast("long")).withColumn("h", F.lit(0).cast("long"))  # all hashes collide
    got = sorted((r.first, r.members) for r in bag_search.classes(m.where("bag is not null")).collect())
    assert got == [(1, 3), (3, 1)]


def test_op12_equals_sql(spark, sf_dir):
    equal_to_sql(spark, sf_dir, bag_search.op12_bag_search, bag_search.OP12_SQL)


# ---- op13


def test_sorted_pointers_equal_counting():
    rng = np.random.default_rng(3)
    alphabet = list("abAB é1-")
    rows = ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(300)] + ["", "abababab", "ababababa", "abababababababab", "x" * 5000, "ABABABAB abababab"]
    group = rng.integers(0, 3, len(rows)).astype(np.uint16)
    raw = [x.encode() for x in rows]
    lowered = divergence._LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    names, g, n, docs = divergence._slice_counts(lowered, np.concatenate([[0], np.cumsum([len(x) for x in raw])]), group)
    want_n, want_docs = Counter(), Counter()
    for x, k in zip(raw, group.tolist(), strict=True):
        words = bytes(divergence._LOWER[np.frombuffer(x, np.uint8)]).replace(b"\0", b" ").split(b" ") if x else []
        words = [w for w in words if w]
        want_n.update((w, k) for w in words)
        want_docs.update((w, k) for w in set(words))
    keys = list(zip(names, g.tolist(), strict=True))
    assert len(set(keys)) == len(keys) and dict(zip(keys, n.tolist(), strict=True)) == want_n and dict(zip(keys, docs.tolist(), strict=True)) == want_docs
    assert names == sorted(names)


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        total, v = int(rng.integers(1, 8 * 10**15)), int(rng.integers(1, 10**6))
        c = int(rng.integers(0, total + 1))
        assert divergence.shares(np.array([c]), np.array(total), v)[0] == 1 + (10**9 * (c + 5)) // (total + 5 * v)


def brute_audit(docs, least, top):
    rows = [((a or ""), (b or ""), [w for w in bytes(divergence._LOWER[np.frombuffer((t or "").encode(), np.uint8)]).replace(b"\0", b" ").split(b" ") if w]) for t, a, b in docs]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(w for r in mine for w in set(r[2]))
        kept = sorted(w for w, n in df.items() if n >= least)
        groups = {s: Counter(w for r in mine if r[1] == s for w in r[2]) for s in {r[1] for r in mine}}
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))  # noqa: E731, B023
        whole = sum(groups.values(), Counter())
        for s, c in groups.items():
            pairs = sorted((-sum(abs(share(c, w) - share(o, w)) for w in kept), x.encode()) for x, o in groups.items() if x != s)
            terms = sorted((-(share(c, w) - share(whole, w)), w) for w in kept if c[w] and share(c, w) > share(whole, w))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 15, 4])
def test_audit_equals_brute_force(spark, cells):
    rng = np.random.default_rng(11)
    words = ["alpha", "Beta", "gamma", "deltadelta", "deltadeltadelta", "épsilon", "x1y", "eta"]
    docs = [(" ".join(rng.choice(words, int(rng.integers(0, 9)))), str(rng.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1])), str(rng.choice(["a", "b", "é", "z"]))) for _ in range(240)]
    docs += [(None, "en", "empty"), ("alpha", None, None), ("", "en", None), ("alpha " * 3000, "en", "long"), ("only", "one", "source"), (None, None, "b")] + [("copy of beta", "de", "a")] * 20
    d = spark.createDataFrame([(i, t, a, b, 1) for i, (t, a, b) in enumerate(docs)], "doc_id long, text string, lang string, source string, value int").repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(d, 10, 3, cells).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(docs, 10, 3)
    assert divergence.audit(d.where("false")).count() == 0


def test_op13_equals_sql(spark, sf_dir):
    equal_to_sql(spark, sf_dir, divergence.op13_source_divergence, divergence.OP13_SQL)


def test_top_k_of_many_queries_at_once_equals_wand(spark):
    rng = random.Random(11)
    word = lambda: f"w{int(rng.expovariate(0.02))}"
    rows = [(i % 560, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(600)] + [(700, None), (701, "w1 " * 500), (702, "w1 " * 500)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    q = d.where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), "text")
    want = sorted(map(tuple, search.top_k(d, q, shard_docs=100, query_block=6).collect()))  # blocks too small to go together
    got = sorted(map(tuple, search.top_k(d, q, shard_docs=100).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want] and len(got) > 1000
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_queries_that_go_together_are_in_an_order_of_their_own():
    sizes, groups = [3, 3, 20, 3, 20, 3], [0, 1, 0, 0, 1, 1]
    terms = np.concatenate([np.arange(n) + 50 * g for n, g in zip(sizes, groups, strict=True)])
    order = search.like_each_other(np.append(0, np.cumsum(sizes)), terms, np.ones(len(terms)) + terms % 50)
    assert sorted(order) == [*range(6)] and {tuple(sorted(order[:2])), tuple(sorted(order[2:4]))} == {(0, 3), (1, 5)} and sorted(order[4:]) == [2, 4]
