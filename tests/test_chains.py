"""Canonical JSON and hash chains on literal fixtures."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from provena.operators import chains

KIND = "a struct<z:bigint,b:array<string>,m:map<string,double>>, t timestamp, s string, d double, f boolean"


def test_canonical_json(spark):
    rows = [
        ((1, ["x", None, 'q"\\\n\u00e9'], {"k": 1.0, "a": 0.25}), datetime(2026, 1, 2, 3, 4, 5, 678900), "", 1e-7, True),
        (None, None, None, float("nan"), None),
        ((None, [], {}), datetime(1999, 12, 31), "]", -1234567.5, False),
    ]
    d = spark.createDataFrame(rows, KIND)
    got = [r.j for r in d.select(chains.canonical_json(F.struct(*d.columns), d.schema).alias("j")).collect()]
    assert got[0] == '{"a":{"b":["x",null,"q\\"\\\\\\n\u00e9"],"m":{"a":0.25,"k":1},"z":1},"d":0.0000001,"f":true,"s":"","t":"2026-01-02T03:04:05.678Z"}'
    assert got[1] == '{"a":null,"d":null,"f":null,"s":null,"t":null}'
    assert got[2] == '{"a":{"b":[],"m":{},"z":null},"d":-1234567.5,"f":false,"s":"]","t":"1999-12-31T00:00:00.000Z"}'
    assert all(json.loads(x) is not None for x in got)


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(c, i, f"text {i}", float(i)) for c in "abcdefgh" for i in range(1, 9)]
    d = spark.createDataFrame(rows, "chain string, seq long, text string, value double").repartition(3)
    return d.join(chains.linked(d, ["seq", "text", "value"], "chain", "seq", "g"), ["chain", "seq"])


def test_faults(spark, chain):
    verdict = lambda d, points=None: {r.chain: (r.n, r.first_seq, r.bad_seq, r.fault) for r in chains.verified(d, ["seq", "text", "value"], "chain", "seq", "g", points).collect()}
    assert set(verdict(chain).values()) == {(8, 1, None, None)}
    is_ = lambda c, *n: (F.col("chain") == c) & F.col("seq").isin(*n)
    bad = chain.where(~is_("a", 3, 4) & ~is_("b", 1, 2) & ~is_("c", 1, 2) & ~is_("d", 1))
    bad = bad.withColumn("text", F.when(is_("e", 8), "other").otherwise(F.col("text"))).withColumn("prev_hash", F.when(is_("f", 1) | is_("f", 5), "x").otherwise(F.col("prev_hash")))
    bad = bad.unionByName(chain.where(is_("g", 6)))
    points = chain.where(is_("c", 2) | is_("d", 2)).select("chain", F.col("seq").alias("through_seq"), "hash")
    assert verdict(bad, points) == {
        "a": (6, 1, 3, "gap"), "b": (6, 3, 3, "start"), "c": (6, 3, None, None), "d": (7, 2, 2, "checkpoint"),
        "e": (8, 1, 8, "hash"), "f": (8, 1, 1, "link"), "g": (9, 1, 7, "gap"), "h": (8, 1, None, None),
    }
    assert verdict(chain.where("false")) == {}


def test_purge_keeps_what_is_needed(spark, chain):
    d = chain.withColumn("at", F.when(F.col("chain") == "a", F.lit(0)).when(F.col("chain") == "b", 10 - F.col("seq")).otherwise(F.col("seq")))
    left, gone = chains.purged(d, "chain", "seq", "at", F.lit(5))
    got = {r.chain: (r.deleted, r.through_seq) for r in gone.collect()}
    # a goes whole, b keeps its first row (its later ones are older, but come after it), the others lose four
    assert got == {"a": (8, None), **{c: (4, 4) for c in "cdefgh"}}
    v = chains.verified(left, ["seq", "text", "value"], "chain", "seq", "g", gone)
    assert {r.chain: (r.n, r.fault) for r in v.collect()} == {"b": (8, None), **{c: (4, None) for c in "cdefgh"}}
