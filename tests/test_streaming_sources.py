import pytest
from pyspark.sql import functions as F

from provena.sources import io
from provena.streaming import ops


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    src = str(tmp_path / "in")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    q = ops.usage_rollup(stream).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("usage").collect()}
    want = {(r.start, r.event_type): r.n for r in ops.usage_rollup(e).collect()}
    assert got == want and want


def test_publish_and_csv(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a"b'), (2, None)], "i int, s string")
    for _ in range(2):
        io.publish(d, str(tmp_path / "t"))
    assert io.published(spark, str(tmp_path / "t")).count() == 2
    io.write_quoted_csv(d.coalesce(1), str(tmp_path / "c"))
    assert [r.s for r in io.delimited(spark, str(tmp_path / "c"), sep=",").orderBy("i").collect()] == ['a"b', None]


def test_guarded_sql_refuses_before_anything_happens(spark):
    assert io.guarded_sql(spark, "with t as (select 1 as a) select * from t;").collect()[0].a == 1
    assert io.guarded_sql(spark, "select id from range(500)").count() == 201
    for bad in ("create temp view should_not_be as select 1", "drop table x", "set a=b", "select 1) t; drop view y --"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            io.guarded_sql(spark, bad)
    assert not spark.catalog.tableExists("should_not_be")


def test_preambles_of_several_files(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text(f"title {n}\nnotes\n1\t{n}\n2\t{n}\n", encoding="latin-1")
    got = io.preamble_text(spark, str(tmp_path), 2, ["k", "v"]).collect()
    assert sorted((r.k, r.v) for r in got) == [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b")]


def test_published_versions(spark, tmp_path):
    for n in (2, 3):
        io.publish(spark.range(n), str(tmp_path))
        assert io.published(spark, str(tmp_path)).count() == n
