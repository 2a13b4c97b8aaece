"""Guarded answers, described tables, published versions, sentence scores, audits and hybrid search on literal fixtures."""

import time

import pytest
from pyspark.sql import functions as F

from provena.functions import norm as N
from provena.operators import excerpts, facts, ledger, reconcile, search
from provena.sources import io


@pytest.fixture
def views(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    spark.sql("select id, id % 7 as k from numbers").createOrReplaceTempView("sevens")
    yield
    spark.catalog.dropTempView("numbers")
    spark.catalog.dropTempView("sevens")


def test_guarded_answers(spark, views):
    ask = lambda sql, most=200: io.answered(spark, sql, most, 300)
    a = ask("with x as (select * from sevens) select k, count(*) as n from x group by k order by k;")
    assert a["tables"] == ["numbers", "sevens"] and [r.n for r in a["rows"]][:2] == [72, 72] and not a["truncated"] and a["notice"] is None
    a = ask("select id from numbers -- a note", 10)
    assert len(a["rows"]) == 10 and a["truncated"] and a["notice"] == "cut at 10 rows"
    assert ask("select id from numbers where id < 0")["notice"].startswith("no rows")
    with pytest.raises(ValueError, match="no table"):
        ask("select 12345 as made_up")
    for bad in ("select 1 as a) as x cross join (select id from numbers", "drop view numbers", "select nothing from numbers"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            ask(bad)
    assert spark.catalog.tableExists("numbers")
    began = time.time()
    with pytest.raises(TimeoutError, match="over 2 s"):
        io.answered(spark, "select count(*) from numbers a, numbers b, numbers c, numbers d where a.id * b.id + c.id * d.id = -1", seconds=2)
    assert time.time() - began < 60
    assert ask("select count(*) as n from numbers")["rows"][0].n == 500


def test_described(spark, views):
    c = spark.createDataFrame([("sevens", "By seven.", "us", "small")], "table string, description string, source string, caveats string")
    d = io.described(spark, "sevens", c)
    assert d["columns"] == {"id": "bigint", "k": "bigint"} and d["caveats"] == "small" and d["sample"] == [{"id": i, "k": i} for i in range(3)]
    assert io.described(spark, "numbers", c)["description"] == ""
    with pytest.raises(ValueError, match="no table"):
        io.described(spark, "nothing", c)


def test_versions_go_by_number(spark, tmp_path):
    for n in (5, 3, 4):
        io.publish(spark.range(n), str(tmp_path))
        assert io.published(spark, str(tmp_path)).count() == n
    assert [r.n for r in spark.read.schema("n long").json(f"{tmp_path}/_current").orderBy("n").collect()] == [1, 2, 3]


def test_sentence_scores(spark):
    good = "12 A companhia investiu em 2020 cerca de 30 milhoes em energia solar e em energia de outras fontes limpas."
    rows = [
        good, "Programa Sol: iniciativa que a companhia mantem para investir em energia solar nas escolas da regiao toda.", "A lista GRI 302 mostra a energia que a companhia usou em todas as suas unidades no ano.",
        "Acesse o website para saber mais sobre a energia que a companhia produz em todas as regioes.", "Quadro | energia | companhia | ano | valores de cada um dos itens que estao na tabela.",
        "A Energia E O Futuro Da Companhia Brasileira De Energia Solar E Eolica Nos Proximos Anos.", "e a energia da companhia cresceu no ano em todas as regioes onde ela esta desde o inicio.", "Nada sobre o tema nesta frase que tem bem mais do que sessenta letras no total dela.",
        "A energia de que a companhia precisa vem de muitas fontes, que sao de agua, de vento e de",
    ]
    d = spark.createDataFrame([(i, x, 2021) for i, x in enumerate(rows)] + [(99, None, 2021)], "i int, text string, year int")
    got = {r.i: (r.sentence, r.score) for r in search.sentence_scores(d, "text", r"\benergia", r"\binvesti", r"\bcompanhia\b", "year").collect()}
    assert got == {0: (good[3:], 2 * 2 + 2 + 1.5 + 1 + 0.5)}


def test_audit_and_secrets(spark):
    text = "# Title\n\nIt cost 12 in all\n\nAs the table cash_flow and the other_table say, 5 [A1].\n\n- item 3 [A1]\n\nCut here…"
    r = spark.createDataFrame([("r", text), ("n", None)], "report string, text string")
    k = spark.createDataFrame([("r", "A1"), ("r", "B2")], "report string, key string")
    got = {(x.kind, x.detail) for x in facts.citation_audit(r, k, tables=spark.createDataFrame([("Cash_Flow",)], "table string")).collect()}
    assert got == {("number without citation", "1"), ("key never cited", "B2"), ("truncated", "1"), ("mark of cutting", "4"), ("unknown table", "other_table")}
    d = spark.createDataFrame([("t", ["a\nb", " "]), ("", ["x"]), ("t", None), (None, [])], "t string, q array<string>")
    assert [x.m for x in d.select(facts.merged_quotes(F.col("t"), F.col("q")).alias("m")).collect()] == ["> a\n> b\n\nt", "> x", "t", ""]


def test_hybrid_search(spark):
    d = spark.createDataFrame([(i, f"word{i % 4} common", [float(i % 5), 1.0, float(i)], "ab"[i % 2]) for i in range(40)], "doc_id long, text string, embedding array<double>, area string")
    q = spark.createDataFrame([(1, "word1", [0.0, 1.0, 0.0], None), (2, "word2 common", [4.0, 1.0, 39.0], "b"), (3, None, [1.0, 0.0, 0.0], "a"), (4, "word3", None, None)], "query_id long, query string, embedding array<double>, area string")
    got: dict = {}
    for r in search.hybrid(d, q, 6, 10, matching=("area",)).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert all(i % 2 == 1 for i in got[2]) and all(i % 2 == 0 for i in got[3]) and all(i % 4 == 3 for i in got[4])
    assert {k: len(x) for k, x in got.items()} == {1: 6, 2: 6, 3: 6, 4: 6}


def test_units(spark):
    rows = [(1284.4, "mw", "1.284 MW"), (12_940.0, "brl", "R$ 12,9 mil"), (-4_250_000.0, "", "-4,3 mi"), (3.14e9, "mwh", "3,1 bi MWh"), (12.05, "pct", "12,1%"), (2.5, "x", "2,5x"), (0.126, "h", "0,13 h"), (7.0, "brl_mwh", "R$ 7/MWh"), (None, "x", "\u2013"), (55.55, "?", "55,6"), (0.0, "?", "0"), (100.0, "mwmes", "100 MWm\u00eas")]
    d = spark.createDataFrame(rows, "v double, u string, want string")
    assert [(r.want, r.got) for r in d.select("want", N.with_unit("v", "u").alias("got")).collect() if r.want != r.got] == []


def test_small_ones(spark):
    d = spark.createDataFrame([(i % 5, i) for i in range(100)] + [(None, 7)], "g long, i long").repartition(6)
    assert [(r.g, r.i) for r in excerpts.numbered(d, ["g", "i"]).orderBy("id").select("g", "i").collect()] == [(None, 7), *sorted((i % 5, i) for i in range(100))]
    assert {r.id for r in excerpts.numbered(d, ["g", "i"]).collect()} == set(range(101)) and excerpts.numbered(d.where("false"), ["g"]).count() == 0
    old = spark.createDataFrame([("k", "m1", "v")], "k string, model string, vector string")
    new = spark.createDataFrame([("k", "m1"), ("k", "m2")], "k string, model string")
    assert {r.model: r.vector for r in reconcile.reuse(new, old, ["k"], "vector", "model").collect()} == {"m1": "v", "m2": None}
    keys = spark.createDataFrame([("gpt", 1.0), ("gpt-4", 2.0), ("4", 3.0)], "key string, base double")
    got = {r.model: r.key for r in ledger.longest_key(spark.createDataFrame([("gpt-4-x",), ("a4",), ("none",), (None,), ("gpt",)], "model string"), keys).collect()}
    assert got == {"gpt-4-x": "gpt-4", "a4": "4", "gpt": "gpt"}
