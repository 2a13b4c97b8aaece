"""Stems and ranked search against known values and brute force."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from provena.functions.stems import portuguese_stem
from provena.operators import search

# known stems of the public Portuguese rules
STEMS = {
    "boa": "boa", "boas": "boas", "boataria": "boat", "boate": "boat", "boates": "boat", "boatos": "boat", "bob": "bob", "boba": "bob", "bobagens": "bobagens",
    "bobear": "bob", "bobeira": "bobeir", "bobinho": "bobinh", "bobo": "bob", "bocadas": "boc", "bocadinho": "bocadinh", "bocado": "boc", "bocas": "boc", "bode": "bod",
    "bodoque": "bodoqu", "body": "body", "boem": "boem", "boemia": "boem", "quietos": "quiet", "quilombo": "quilomb", "quilos": "quil", "rapidamente": "rapid",
    "normalmente": "normal", "tecnologia": "tecnolog", "x1": "x1", "": "", "de": "de", "energia": "energ", "energias": "energ",
}


@pytest.mark.parametrize("word", STEMS)
def test_known_stems(word):
    assert portuguese_stem(word) == STEMS[word]


DOCS = [(1, "A energia do rio"), (2, "energias e rios; energia"), (3, None), (4, ""), (5, "Rios \u00e1gua agua"), (6, "rio " * 3000), (None, "energia"), (2, "nada")]


def brute(docs, query, stem):
    f = lambda x: "".join(c if c.isalnum() else " " for c in x.lower().replace("\u00e1", "a")).split()
    bags = [(i, [stem(w) for w in f(t)]) for i, t in docs if t is not None]
    n, mean = len(docs), sum(len(w) for _, w in bags) / len(bags)
    out = []
    for i, words in bags:
        score = 0.0
        for t in {stem(w) for w in f(query)}:
            tf, df = Counter(words)[t], sum(t in w for _, w in bags)
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if score:
            out.append((i or -1, round(score, 9)))
    return sorted(out)


@pytest.mark.parametrize("stem", [None, portuguese_stem])
def test_bm25_equals_brute_force(spark, stem):
    d = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    asked = {10: "energia rio", 11: "agua", 12: "", 13: "rios rios energias", 14: None}
    q = spark.createDataFrame([*asked.items()], "query_id int, query string")
    for block in (1_000_000, 2):
        got = search.bm25(d, q, stem=stem, block=block).collect()
        for i, x in asked.items():
            assert sorted((r.doc_id or -1, round(r.bm25, 9)) for r in got if r.query_id == i) == brute(DOCS, x or "", stem or (lambda w: w))
    assert search.bm25(d.where("false"), q).count() == 0 and search.bm25(d, q.where("false")).count() == 0


def test_the_best_k_are_kept(spark):
    d = spark.createDataFrame([(i, "alfa " * (i % 7) + "beta " * (i % 5)) for i in range(300)], "doc_id long, text string").repartition(4)
    q = spark.createDataFrame([("p", "alfa"), ("q", "beta alfa")], "query_id string, query string")
    want = {(r.query_id, r.pos): r.doc_id for r in search.ranked(search.bm25(d, q), "bm25", "doc_id", 9).collect()}
    got = {(r.query_id, r.pos): r.doc_id for r in search.ranked(search.bm25(d, q, k=9), "bm25", "doc_id", 9).collect()}
    assert got == want and len(got) == 18


def test_many_queries_together_and_one_count_for_all_blocks(spark, monkeypatch):
    counts = []
    counted = search._counted
    monkeypatch.setattr(search, "_counted", lambda *a: counts.append(1) or counted(*a))
    rows = [(i % 390 if i % 50 else None, " ".join(f"w{(i * j * j + j) % (7 + 9 * (j % 11))}" for j in range(i % 40)), "ab"[i % 2]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(50)
    q = spark.createDataFrame([(f"q{i}", t, g if i % 3 else None) for i, (_, t, g) in enumerate(rows) if i % 2], "query_id string, query string, lang string")
    best = lambda **x: sorted(tuple(r) for r in search.ranked(search.bm25(d, q, matching=("lang",), **x), "bm25", "doc_id", 5).selectExpr("query_id", "pos", "round(bm25, 6)").collect())
    want = best()
    assert len(want) > 800 and best(k=5) == want
    counts.clear()
    assert best(k=5, block=900) == want and len(counts) == 1
