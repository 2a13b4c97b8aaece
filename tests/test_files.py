"""Readers and writers of files that no query reaches, and the chunker by brute force."""

import json
import random
from datetime import date

import pytest

from provena.operators import cards, facts
from provena.sources import io


def test_tagged_union(spark, tmp_path):
    (tmp_path / "dre_con_2020.csv").write_text("cnpj;valor\n1;\"a;b\"\n2;\"x \"\"y\"\"\nz\"\n", encoding="latin-1")
    (tmp_path / "dre_ind_2021.csv").write_text("cnpj;ação\n3;é\n", encoding="latin-1")
    d = io.tagged_union(spark, [str(tmp_path / n) for n in ("dre_con_2020.csv", "dre_ind_2021.csv")], r"dre_(\w+)_(\d+)", ["scope", "year"], encoding="ISO-8859-1")
    assert sorted((r.cnpj, r.valor, r["ação"], r.scope, r.year) for r in d.collect()) == [("1", "a;b", None, "con", "2020"), ("2", 'x "y"\nz', None, "con", "2020"), ("3", None, "é", "ind", "2021")]


def test_series_and_periods(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"data": "31/12/2020", "valor": "0.5"}, {"data": "31/12/2020", "valor": "0.7"}, {"data": "x", "valor": "1"}, {"data": "01/01/2021", "valor": "-"}]))
    assert {r.date: r.value for r in io.series_json(spark, str(tmp_path / "s.json")).collect()} == {date(2020, 12, 31): 0.7, date(2021, 1, 1): None}
    for p in ("2020-01", "2020-02", "2021-01"):
        spark.range(2).coalesce(1).write.parquet(str(tmp_path / "w" / p))
        part = next((tmp_path / "w" / p).glob("part-*.parquet"))
        part.rename(tmp_path / f"load_{p}.parquet")
    d = io.since_period(spark, str(tmp_path), "load_*.parquet", r"load_(\d{4}-\d{2})", "2020-02")
    assert sorted({r.period for r in d.collect()}) == ["2020-02", "2021-01"] and d.count() == 4


def test_panels_and_folders(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("a", 3, "y")], "k string, n int, s string")
    io.write_panel(d, str(tmp_path / "p"), ["n", "s"])
    assert sorted(json.loads(r.value).get("s", "-") for r in spark.read.text(str(tmp_path / "p")).collect()) == ["-", "x", "y"]
    with pytest.raises(ValueError, match=r"declared but missing: \['gone'\]"):
        io.write_panel(d, str(tmp_path / "q"), ["n", "gone"])
    assert sorted(r.k for r in io.write_per_key(d, "k", str(tmp_path / "keys")).collect()) == ["a", "b"]
    assert spark.read.json(str(tmp_path / "keys" / "k=a")).count() == 2


def test_dictionary(spark):
    spark.range(1).createOrReplaceTempView("told")
    spark.sql("select 'x' as s").createOrReplaceTempView("untold")
    c = spark.createDataFrame([("told", "what it is")], "table string, description string")
    got = {(r.table, r.column, r.type, r.undocumented) for r in io.dictionary(spark, c).collect() if r.table in ("told", "untold")}
    assert got == {("told", "id", "bigint", False), ("untold", "s", "string", True)}
    spark.catalog.dropTempView("told")
    spark.catalog.dropTempView("untold")


def slow_chunks(text, size, overlap, least):
    """The stated rule, letter by letter: a window ends behind the last break whose place lies in its second half."""
    out, lo = [], 0
    while lo < len(text):
        hi = lo + size
        if hi >= len(text):
            out.append(text[lo:].strip())
            break
        for at in range(hi, lo + size // 2, -1):  # a break that ends at or before the window's end
            newline = text[at - 1] == "\n"
            stop = text[at - 1] == "." and at < hi and text[at : at + 1] == " "
            if newline or stop:
                hi = at
                break
        out.append(text[lo:hi].strip())
        lo = max(hi - overlap, lo + 1)
    return [x for x in out if len(x) >= least]


def test_chunks_equal_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab. \n", [6, 6, 1, 3, 1], k=rng.randrange(0, 900))) for _ in range(60)]
    d = spark.createDataFrame([(i, x, i, 7) for i, x in enumerate(texts)], "id long, text string, pos int, extra int").repartition(3)
    got: dict = {}
    for r in facts.chunks(d, size=90, overlap=20, least=10).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.chunk)
    import re

    squeeze = lambda x: re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", x)).strip(" \t\n\r\f\v")
    want = {i: c for i, x in enumerate(texts) if len(squeeze(x)) >= 10 and (c := slow_chunks(squeeze(x), 90, 20, 10))}
    assert got == want


def test_panels_with_metadata_and_run_records(spark, tmp_path):
    d = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string")
    c = spark.createDataFrame([("one", "The first."), ("gone", "Not here.")], "table string, description string")
    got = {r.id: (r.columns, r.rows, r.description, r.skipped) for r in io.write_panels({"one": d, "gone": None, "two": d}, {"one": ["n"]}, str(tmp_path / "p"), c).collect()}
    assert got == {"one": (["n"], 2, "The first.", False), "gone": (None, None, "Not here.", True), "two": (["n", "s"], 2, None, False)}
    with pytest.raises(ValueError, match="one: columns declared but missing"):
        io.write_panels({"two": d, "one": d}, {"one": ["z"]}, str(tmp_path / "q"), c)
    assert not (tmp_path / "q").exists()
    lines = [{"case": "1", "answer": "old", "at": "2026-01-01"}, {"case": "1", "answer": "ok 2020", "tools": ["search"], "at": "2026-01-02"}, {"question": "2", "error": "timeout"}]
    (tmp_path / "log.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    runs = cards.run_records(spark, str(tmp_path / "log.jsonl"))
    cases = spark.createDataFrame([("1", ["ok"], ["bad"], ["search"]), ("2", [], None, None), ("3", None, None, None)], "case string, must array<string>, must_not array<string>, tools array<string>")
    assert {r.case: r.passed for r in cards.scoreboard(runs, cases).collect()} == {"1": True, "2": False, "3": False}
