"""Names against names by brute force, and the ladder's steps on literal fixtures."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from provena.operators import entity, names


def test_similarity_equals_duckdb_and_never_passes_its_bound():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd e") for _ in range(rng.randint(1, 14)))
    pairs = [(word(), word()) for _ in range(2000)]
    with duckdb.connect() as c:
        want = c.execute("SELECT jaro_winkler_similarity(p[1], p[2]) FROM (SELECT unnest(?) AS p)", [[list(p) for p in pairs]]).fetchall()
    got = [names.jaro_winkler(*p) for p in pairs]
    assert np.allclose(got, [w[0] for w in want], atol=1e-9)
    bounds = [names.similarity_bounds(a, *names._rows([b]))[0] for a, b in pairs]
    assert all(b >= g - 1e-9 for b, g in zip(bounds, got, strict=True))


def test_nearest_names_equal_brute_force(spark):
    rng = random.Random(5)
    pool = [(i % 150, "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 12))).strip() or "x") for i in range(300)] + [(7, None), (None, "abc"), (8, "")]
    terms = ["".join(rng.choice("abcde ") for _ in range(8)) for _ in range(40)]
    n = spark.createDataFrame(pool, "id long, name string").repartition(5)
    t = spark.createDataFrame([(x,) for x in [*terms, None, "", terms[0]]], "term string")
    got = {x: [] for x in terms}
    for r in names.nearest_names(t, n, 3, block=7).orderBy("term", F.desc("similarity"), "id").collect():
        got[r.term].append((r.id, r.similarity))
    for x in set(terms):
        best: dict = {}
        for i, name in pool:
            if i is not None and name:
                best[i] = max(best.get(i, 0), round(names.jaro_winkler(x, name), 9))
        assert got[x] == [(i, s) for i, s in sorted(best.items(), key=lambda p: (-p[1], p[0])) if s > 0][:3]
    assert names.nearest_names(t.where("false"), n).count() == 0 and names.nearest_names(t, n.where("false")).count() == 0


def test_all_inside_equals_brute_force(spark):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("ab -") for _ in range(rng.randint(0, 25)))) for i in range(200)] + [(500, None)]
    groups = [(f"g{i}", ["".join(rng.choice("ab -") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))]) for i in range(60)] + [("none", []), (None, ["a"])]
    t = spark.createDataFrame(texts, "key long, text string").repartition(3)
    g = spark.createDataFrame(groups, "group string, patterns array<string>")
    letter = lambda c: "a" <= c <= "z" or "0" <= c <= "9"

    def there(p: str, text: str, whole: bool) -> bool:
        return any(text.startswith(p, i) and (not whole or (i == 0 or not letter(text[i - 1])) and (i + len(p) == len(text) or not letter(text[i + len(p)]))) for i in range(len(text)))

    for whole in (False, True):
        want = {(k, n) for k, x in texts if x for n, ps in groups if n and ps and all(there(p, x, whole) for p in ps)}
        got = [tuple(r) for r in names.all_inside(t, g, whole, block=20).collect()]
        assert set(got) == want and len(got) == len(want)


def test_ladder(spark):
    a = spark.createDataFrame([(1, "Energia Azul SA", "123456", True), (1, "Azul", None, True), (2, "Azul Norte", "456789", False), (3, "Companhia Energetica do Ceara", "777", False), (4, None, None, None)], "id long, alias string, code string, holding boolean")
    g = spark.createDataFrame([(10000000000123, "Luz do Sul Transmissora", "LST", False), (10000000000124, "Luz do Sul", "LDS", True), (None, "x", "y", None)], "id long, name string, acronym string, distributes boolean")
    terms = ["azul", "3456", "0777", "AZUL norte grupo", "100.000.000.001-23", "lds", "sul luz", "Companhya Energetyca do Ceara", "grupo do Azul", None, ""]
    r = entity.resolve(spark.createDataFrame([(x,) for x in terms], "term string"), a, g)
    got: dict = {}
    for x in r.collect():
        got.setdefault(x.term, []).append((x.id, x.stage))
    assert got["azul"] == [(1, 1), (2, 3)]
    assert got["3456"] == [(1, 2)] and got["0777"] == [(3, 2)]
    assert got["AZUL norte grupo"] == [(2, 6), (1, 6)]  # the subsidiary before the holding
    assert got["100.000.000.001-23"] == [(10000000000123, 2)] and got["lds"] == [(10000000000124, 4)]
    assert got["sul luz"] == [(10000000000124, 5), (10000000000123, 5)]  # the distributor first
    assert got["Companhya Energetyca do Ceara"][0] == (3, 7) and len(got) == 9
    w = {x.term: x for x in entity.warnings(r, spark.createDataFrame([(1, 2), (1, 5), (1, 1), (2, 9)], "holding long, id long")).collect()}
    assert (w["grupo do Azul"].companies, w["grupo do Azul"].warning) == ([2, 5], None)
    assert w["azul"].companies is None and w["AZUL norte grupo"].warning == "ambiguous" and w["Companhya Energetyca do Ceara"].warning == "fuzzy"
    # a phrase, not a bag of words
    assert [x.stage for x in entity.resolve(spark.createDataFrame([("norte do azul mar",)], "term string"), a.where("id = 2"), least=0.99).collect()] == []


def test_many_similarities_at_once_equal_those_of_pairs():
    rng = random.Random(4)
    for _ in range(300):
        term, width = "".join(rng.choice("abc e") for _ in range(rng.randint(1, 12))), rng.randint(1, 12)
        pool = ["".join(rng.choice("abc e") for _ in range(width)) for _ in range(15)] + [(term * 12)[:width]]
        codes = np.frombuffer("".join(pool).encode("utf-32-le"), np.uint32).reshape(-1, width)
        assert names.similarities(term, codes).tolist() == [names.jaro_winkler(term, x) for x in pool]


def test_nearest_names_of_many_tasks_are_not_compared_one_by_one(spark, monkeypatch):
    n = spark.range(3000).select("id", F.concat(F.lit("customer#"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name")).repartition(6)
    monkeypatch.setattr(names, "jaro_winkler", None)
    got = names.nearest_names(spark.createDataFrame([("kstmer#001234",), ("kstmer#000050",)], "term string"), n, 3).orderBy("term", F.desc("similarity"), "id").collect()
    monkeypatch.undo()
    pool = [(i, f"customer#{i:06d}") for i in range(3000)]
    for t in ("kstmer#000050", "kstmer#001234"):
        want = sorted((-round(names.jaro_winkler(t, x), 9), i) for i, x in pool)[:3]
        assert [(-r.similarity, r.id) for r in got if r.term == t] == want
