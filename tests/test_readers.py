"""Series in overlapping windows, text with a preamble in several blocks, and samples that don't depend on partitioning."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from provena.operators import reconcile
from provena.sources import readers


def test_series_windows(spark, tmp_path):
    point = lambda d, v: {"data": d, "valor": v}
    files = {
        "s1_2000.json": [point("31/12/2009", "1.5"), point("30/12/2009", "x"), point("bad", "3"), {"valor": "4"}],
        "s1_2010.json": [point("31/12/2009", "2.5"), point("01/01/2010", "-0.25"), point("02/01/2010", None)], "s2_2000.json": [], "notes.txt": [],
    }
    for n, x in files.items():
        (tmp_path / n).write_text(json.dumps(x))
    got = {(r.series, r.date): r.value for r in readers.series(spark, str(tmp_path), r"^(s\d+)_").collect()}
    assert got == {("s1", date(2009, 12, 30)): None, ("s1", date(2009, 12, 31)): 2.5, ("s1", date(2010, 1, 1)): -0.25, ("s1", date(2010, 1, 2)): None}
    assert readers.series(spark, str(tmp_path), r"^(s\d+)_", since="2010-01-01", until="2010-01-01").count() == 1
    raw = spark.read.format("date_series").options(path=f"file://{tmp_path}").load()
    assert raw.rdd.getNumPartitions() == 3 and raw.where("date = '2009-12-31'").count() == 2
    (tmp_path / "none").mkdir()
    assert readers.series(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_preamble_in_blocks(spark, tmp_path, block):
    rows = [(str(i), f"né {i}", "" if i % 3 else "x", "u") for i in range(40)]
    for n, some in (("a.xls", rows[:25]), ("b.xls", rows[25:])):
        lines = ["note one", "note\ttwo", " Code \tName\tUnit \tUnit\t", *["\t".join(r) for r in some], "99"]
        (tmp_path / n).write_bytes("\r\n".join(lines).encode("latin-1"))
    d = readers.with_preamble(spark, str(tmp_path), 2, block=block)
    assert d.columns == ["Code", "Name", "Unit", "Unit_2", "c4", "file"]
    got = sorted((r.file, int(r.Code), r.Name, r.Unit, r.Unit_2) for r in d.collect())
    want = [("a.xls" if i < 25 else "b.xls", i, f"né {i}", None if i % 3 else "x", "u") for i in range(40)]
    assert got == sorted([*want, ("a.xls", 99, None, None, None), ("b.xls", 99, None, None, None)])
    bare = readers.with_preamble(spark, str(tmp_path), 3, header="false", columns="2", block=block)
    assert bare.columns == ["c0", "c1", "file"] and bare.count() == 42


def test_samples(spark):
    d = spark.createDataFrame([(i, i % 3 if i < 50 else 7) for i in range(52)] + [(None, 1)], "i long, g long")
    a = {r.i for r in reconcile.sample(d.repartition(7), 10, "i").collect()}
    assert len(a) == 10 and a == {r.i for r in reconcile.sample(d.coalesce(1), 10, "i").collect()} < {r.i for r in reconcile.sample(d, 20, "i").collect()}
    assert a != {r.i for r in reconcile.sample(d, 10, "i", seed="1").collect()}
    assert {r.g: r.n for r in reconcile.sample(d, 5, "i", ("g",)).groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 5, 1: 5, 2: 5, 7: 2}
    assert reconcile.sample(d, 100, "i").count() == 53 and reconcile.sample(d.where("false"), 5, "i").count() == 0
