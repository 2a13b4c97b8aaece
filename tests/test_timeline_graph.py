"""Literal fixtures for the timeline, the panel's datasets and sheets, and the knowledge graph."""

import pytest
from pyspark.sql import functions as F

from provena.operators import knowledge, panel, timeline

EVENT = "company string, year int, kind string, n long, total double, items array<string>, themes array<string>, source string"


def test_events_impact_and_timeline(spark):
    rows = spark.createDataFrame([("a", 2020, "x", 5.0, ["renovavel"]), ("a", 2020, "y", None, None), ("a", 2020, "z", 9.0, [])], "company string, year int, item string, amount double, themes array<string>")
    e = timeline.yearly_events(rows, "usina", "item", "amount", "t", "themes")
    r = e.first()
    assert (r.n, r.total, r["items"], r.themes) == (3, 14.0, ["z", "x", "y"], ["renovavel"])
    assert timeline.yearly_events(rows.where("false"), "usina", "item", "amount", "t").count() == 0
    assert [x["items"] for x in timeline.largest_events(rows, "bndes", "item", "amount", "t", most=1).collect()] == [["z"]]
    c = spark.createDataFrame([("a", 2020, "capacidade_renovavel_mw", 3.0), ("a", 2020, "ped_brl", 1.0), ("a", 2021, "ped_brl", 0.0)], "company string, year int, series string, change double")
    assert [x.series for x in timeline.impact(e, c).collect()] == ["capacidade_renovavel_mw"]
    t = {x.year: x for x in timeline.timeline(e, c).collect()}
    assert (t[2020].highlight, len(t[2020].evolution), len(t[2020].impact), t[2021].highlight, t[2021].events) == (True, 2, 1, False, None)


def test_selector(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "company string")
    s = spark.createDataFrame([("a", 2010), ("a", 2020)], "company string, year int")
    r = spark.createDataFrame([("b", 2015), ("b", 2016)], "company string, year int")
    got = {x.company: (x.since, x.until, x.reports) for x in timeline.selector(c, s, r, 2026).collect()}
    assert got == {"a": (2008, 2026, 0), "b": (2015, 2026, 2), "c": (2008, 2026, 0)}


def test_trajectories(spark):
    a = spark.createDataFrame([("k", "p1", "Vento 1", 10.0, 2020), ("k", "p2", "Vento II", 20.0, None), ("k", "p3", "Sol", 5.0, 2019)], "company string, asset string, name string, amount double, entry_year int")
    l = spark.createDataFrame([("k", 2018, 100.0, "vento"), ("k", 2019, 50.0, "Vento")], "company string, year int, amount double, name string")
    u = spark.createDataFrame([("k", 2017, "A1", "p1"), ("k", 2017, "A1", "p3")], "company string, year int, auction string, asset string")
    s = spark.createDataFrame([("k", 2017, 1.0), ("k", 2018, 4.0), ("k", 2019, 6.0), ("k", 2020, 8.0)], "company string, year int, value double")
    steps = timeline.asset_trajectories(a, l, u, s, 2026)
    got = {r.title: [(x.year, x.role, x.n, x.amount) for x in r.steps] for r in timeline.trajectories(steps, 2018).collect()}
    assert got == {
        "vento: loan of 2018 to operation": [(2018, "financing", 2, 100.0), (2020, "investment", 1, 2.0), (2020, "result", 1, 10.0), (2026, "not yet seen", 1, 20.0)],
        "A1: auction to operation": [(2017, "contract", 1, None), (2018, "investment", 1, 3.0), (2019, "result", 1, 5.0)],
    }
    links = {r.title: [x.link for x in r.steps] for r in timeline.trajectories(steps, 2018).collect()}["A1: auction to operation"]
    assert links == [None, "order in time", "id of the asset"]
    assert timeline.trajectories(steps.where("false"), 2018).count() == 0


def test_contract_and_report_trajectories(spark):
    day = "company string, contract string, number string, holder string, signed string"
    c = spark.createDataFrame([("k", "c1", "12/2018", "H", "2018-05-01"), ("k", "c2", "x", "H", "2018-05-01"), ("k", "c3", "13/2018", "H", None), ("k", "c4", "14/2018", "H", "2018-05-01")], day).withColumn("signed", F.to_date("signed"))
    w = spark.createDataFrame([("k", "c1", "w1", True, "2020-01-01"), ("k", "c1", "w2", True, "2021-01-01"), ("k", "c1", "w3", False, None), ("k", "c1", "old", True, "2017-01-01"), ("k", "c2", "w", True, "2020-01-01")], "company string, contract string, name string, running boolean, entered string").withColumn("entered", F.to_date("entered"))
    l = spark.createDataFrame([("k", 2019, 50.0, "Implantacao, contrato de concessao n 012/2018-ANEEL"), ("k", 2018, 9.0, "contrato 99/2018"), ("k", 2020, 70.0, "Contrato 12/2018")], "company string, year int, amount double, name string")
    s = spark.createDataFrame([("k", y, v) for y, v in ((2018, 1.0), (2019, 4.0), (2020, 5.0), (2021, 9.0), (2022, 9.5))], "company string, year int, value double")
    steps = timeline.contract_trajectories(c, w, l, s, 2026)
    got = {r.title: [(x.year, x.role, x.link, x.n, x.amount) for x in r.steps] for r in timeline.trajectories(steps, 2018).collect()}
    assert got == {"transmission 12/2018 (H): contract to operation": [
        (2018, "contract", None, 1, None), (2019, "financing", "number of the contract in the loan", 1, 50.0), (2021, "investment", "order in time", 1, 4.0), (2021, "result", "same contract", 2, None), (2026, "not yet seen", "same contract", 1, None)]}
    r = spark.createDataFrame([("k", 2018, "T", ["metas"], 5.0), ("k", 2018, "U", ["metas"], 7.0), ("k", 2019, "V", ["renovavel"], 1.0), ("k", 2020, "N", ["other"], 9.0), ("k", 2021, "W", ["metas"], 1.0), ("k", 2022, "none", ["metas"], 1.0)], "company string, year int, title string, themes array<string>, points double")
    e = spark.createDataFrame([("k", 2020, 3.0), ("k", 2020, 4.0)], "company string, year int, mw double")
    a = spark.createDataFrame([("k", 2020, 10.0), ("k", 2021, 12.0), ("k", 2022, 0.0)], "company string, year int, ebitda double")
    steps = timeline.report_trajectories(r, s, e, a)
    got = {x.title[0]: [(y.year, y.role, y.n, y.amount) for y in x.steps] for x in timeline.trajectories(steps, 2018).collect()}
    assert got == {"U": [(2018, "strategy", 1, None), (2019, "investment", 1, 3.0), (2020, "result", 2, 7.0)], "V": [(2019, "strategy", 1, None), (2020, "investment", 1, 1.0), (2021, "result", 1, 12.0)], "W": [(2021, "strategy", 1, None), (2022, "investment", 1, 0.5), (2023, "not yet seen", 1, None)]}
    rows = spark.createDataFrame([("a", 2020, "x", 1.0), ("a", 2026, "y", 1.0)], "company string, year int, item string, amount double")
    assert [x.year for x in timeline.yearly_events(rows, "usina", "item", "amount", "t", closed_before=2026).collect()] == [2020]


def test_panel(spark):
    assert len(panel.DATASETS) == 13
    d = panel.DATASETS["pdd"]
    t = spark.createDataFrame([("N", "2020", 5.0, 10.0), ("N", "2020", None, 10.0), ("S", "2021", 1.0, 0.0)], "regiao string, ano string, realizado_brl double, planejado_brl double")
    assert {r.ano: r.execucao_pct for r in d.series(t, "regiao").collect()} == {"2020": 50.0, "2021": None}
    with pytest.raises(ValueError):
        d.series(t, "nothing")
    f = spark.createDataFrame([("a", 10.0, 4.0, None)], "company string, operating_cash double, investment double, dividends double")
    b = spark.createDataFrame([("a", 7.0, "2025-01-01"), ("a", 3.0, "2030-01-01")], "company string, amount double, due string")
    assert tuple(panel.credit_sheet(f, b, F.lit("2026-12-31")).first()) == ("a", 6.0, 10.0, 7.0)


def test_knowledge(spark):
    n = spark.createDataFrame([("1", "kpis", 1, "Alfa SA", True), ("1", "cap", 2, "Alfa", False), ("2", "cap", 2, "Beta", False)], "company string, dataset string, place int, name string, by_company boolean")
    docs = spark.createDataFrame([("1", "Alfa"), ("3", None)], "company string, name string")
    got = {r.company: (r.name, r.legal_name, r.datasets, r.documents, r.weight) for r in knowledge.company_list(n, docs).collect()}
    assert got == {"1": ("Alfa", "Alfa SA", 2, 1, 3), "3": ("3", None, 0, 1, 1)}
    s = spark.createDataFrame([("1", "all"), ("1", "own"), ("2", "own"), ("2", None)], "company string, scope string")
    assert sorted((r.company, r.scope or "") for r in knowledge.preferred_slice(s, ["company"], "scope", ["all"]).collect()) == [("1", "all"), ("2", ""), ("2", "own")]
    c = spark.createDataFrame([("1", "Alfa")], "company string, name string")
    p = spark.createDataFrame([("1", "kpis", 1, "ebit", "2020", 3.0), ("1", "kpis", 1, "none", "2020", None)], "company string, dataset string, place int, measure string, period string, value double")
    d = spark.createDataFrame([("1", "esg", "report", 2019, "t", "f")], "company string, area string, type string, year int, title string, file string")
    nodes = knowledge.nodes(c, p, d)
    e = knowledge.edges(nodes).collect()
    ids = {r.id for r in nodes.collect()}
    assert len(ids) == nodes.count() == 7
    assert all(x.origin in ids and x.target in ids for x in e) and [x.kind for x in e].count("fonte") == 1
