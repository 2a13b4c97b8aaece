"""Literal fixtures for the reference's operators, and every registered query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from provena.functions import norm as N
from provena.operators import company, entity, facts, graph, ledger, measures, reconcile, temporal
from provena.plans import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    query, sql = QUERIES[name]
    got = query(spark, sf_dir).toPandas()
    if sql is None:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    want = con.sql(sql).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    con.register("got", got)
    con.register("want", want)
    names = ", ".join(f'"{c}"' for c in cols)
    assert len(got) == len(want)
    assert con.sql(f"select count(*) from (select {names} from got except all select {names} from want)").fetchall()[0][0] == 0


def test_measures_skip_nulls_pairwise_and_zero_denominators(spark):
    d = spark.createDataFrame([("a", 10.0, 100.0), ("a", None, 50.0), ("a", 5.0, None), ("b", 1.0, 0.0)], "k string, v double, w double")
    m = [measures.Measure("r", "ratio", "v", "w", 100.0), measures.Measure("m", "weighted", "v", "w"), measures.Measure("s", "sum", "v")]
    got = {r.k: (r.r, r.m, r.s) for r in measures.aggregate(d, ["k"], m).collect()}
    assert got == {"a": (10.0, 10.0, 15.0), "b": (None, None, 1.0)}
    assert measures.aggregate(d.where("false"), ["k"], m).count() == 0


def test_last_and_previous(spark):
    d = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 3, 15.0), ("b", 1, -1.0), ("b", 2, 3.0), ("c", 1, 2.0)], "k string, p int, v double")
    got = {r.k: r.change for r in temporal.last_and_previous(d, ["k"], "p", "v").collect()}
    assert got == {"a": 0.5, "b": None, "c": None}


def test_value_on_page(spark):
    rows = [(1234567.0, "emissions were 1.234.567 t", "emissions were 1.234.567 t in all", True), (99.0, "about 12 words", "something else", False), (12.0, "12", "12", False)]
    d = spark.createDataFrame(rows, "value double, quote string, page string, want boolean")
    assert all(r.got == r.want for r in d.select("want", facts.value_on_page(F.col("value"), F.col("quote"), F.col("page")).alias("got")).collect())


def test_norm(spark):
    d = spark.createDataFrame([("São Paulo", "12.345/6", "http://x.org/a/12?q=1")], "s string, c string, u string")
    r = d.select(N.fold("s").alias("f"), N.padded_id("c").alias("p"), N.formatted_id("c").alias("i"), N.route("u").alias("r"), N.first_sentence(F.lit("One. Two.")).alias("o"), N.sig_round(F.lit(1234567.891)).alias("g")).first()
    assert tuple(r) == ("sao paulo", "00000000123456", "00.000.000/1234-56", "/a/:id", "One.", 1234567.89)


def test_graph_cycle_clone_and_levels(spark):
    t = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, None), (6, 5)], "node long, parent long")
    cut = {r.node: r.parent for r in graph.without_cycles(t).collect()}
    assert cut == {1: None, 2: 3, 3: 1, 4: 3, 5: None, 6: 5}
    d = {r.node: (r.depth, r.descendants) for r in graph.depths(t.where("node > 4")).collect()}
    assert d == {5: (0, 1), 6: (1, 0)}
    new = graph.rekeyed(t.select(F.col("node").cast("string"), F.col("parent").cast("string")), "s").collect()
    assert {r.parent for r in new if r.parent} <= {r.node for r in new}


def test_entities_and_ledger(spark):
    a = spark.createDataFrame([(1, "Energia Azul", "123"), (2, "Usina Verde", "456")], "id long, alias string, code string")
    t = spark.createDataFrame([("energia azul",), ("000456",), ("usina vrde",), ("nothing",)], "term string")
    got = {r.term: (r.id, r.stage) for r in entity.resolve(t, a, least=0.85).collect()}
    assert got == {"energia azul": (1, 1), "000456": (2, 2), "usina vrde": (2, 7)}
    u = spark.createDataFrame([(1, 10, 0), (2, 5, 7)], "id int, input_tokens int, output_tokens int")
    assert ledger.ledger_rows(u).count() == 3


def test_reconcile_and_company(spark):
    d = spark.createDataFrame([("a", "t", 2.0), ("b", "kt", 2.0), ("c", "?", 1.0)], "k string, unit string, value double")
    assert {r.k: r.tonnes for r in company.in_tonnes(d).collect()} == {"a": 2.0, "b": 2000.0, "c": None}
    done, wanted = spark.createDataFrame([("x",), ("y",)], "f string"), spark.createDataFrame([("y",), ("z",)], "f string")
    assert {r.f: r.action for r in reconcile.refresh_plan(done, wanted, ["f"]).collect()} == {"x": "stale", "y": "keep", "z": "pending"}


def test_fold_and_whole_word(spark):
    d = spark.createDataFrame([("ČESKÝ Źdźbło São\u0301", "C++ & x", "c++"), ("a", "abc", "b")], "s string, text string, term string")
    got = [tuple(r) for r in d.select(N.fold("s"), N.whole_word("text", "term")).collect()]
    assert got == [("cesky zdzbło sao", True), ("a", False)]


def test_chunks(spark):
    text = "x" * 700 + ". " + "y" * 600 + "\n" + "z" * 300
    d = spark.createDataFrame([(1, None, "k"), (2, "short", "k"), (3, text, "k"), (4, "a  \t b" * 40, "k"), (5, "w" * 2500, "k")], "id long, text string, pos_ string")
    got: dict = {}
    for r in facts.chunks(d).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.chunk)
    assert got[3] == ["x" * 700 + ".", "x" * 199 + ". " + "y" * 600 + "\n" + "z" * 300]
    assert got[4] == [("a b" * 40)] and [len(c) for c in got[5]] == [1200, 1200, 500] and 1 not in got and 2 not in got
    assert facts.chunks(d.where("id < 3")).count() == 0 and facts.chunks(d.where("false")).count() == 0


def test_visible(spark):
    rows = [(None, False, True), (5, False, False), (20, False, True), (None, None, True), (20, None, False), (20, True, False), (None, True, False)]
    d = spark.createDataFrame(rows, "expires int, temporary boolean, want boolean")
    assert all(r.want == r.got for r in d.select("want", ledger.visible(F.col("expires"), F.col("temporary"), F.lit(10)).alias("got")).collect())


def test_long_paths(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(80)], "node long, parent long")
    assert graph.depths(chain).agg(F.max("depth")).first()[0] == 79
    with pytest.raises(ValueError, match="longer"):
        graph.ancestors(chain, most=4).count()


def test_names_one_letter_apart_are_found_wherever_the_letter_is(spark):
    names = ["north water", "south water", "river power", "solar field"]
    a = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "id long, alias string, code string")
    terms = ["orth water", "north watr", "sout water", "xiver power", "solar fielt", "unlike all"]
    got = {r.term: (r.id, r.stage) for r in entity.resolve(spark.createDataFrame([(t,) for t in terms], "term string"), a, fuzzy=1, least=0.85).collect()}
    assert got == {"orth water": (0, 3), "north watr": (0, 7), "sout water": (1, 3), "xiver power": (2, 7), "solar fielt": (3, 7)}
