"""Streams with state: timers, expiry, restarts and batches published once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from provena.streaming import ops, state

T0 = datetime(2026, 1, 1)
EVENT = "key long, ts timestamp, status string"


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


@pytest.fixture
def stored(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    yield state.with_state_store(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(make, spark, folder, schema, out, checkpoint):
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(300)
    return sorted((tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()), key=lambda r: [(x is not None, x) for x in r])


def test_overdue_with_late_rows_and_a_restart(stored, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    make = lambda s: state.overdue(s, "key", after_s=300, late="1 minute")
    feed(stored, src, [(1, at(0), "pending"), (2, at(0), "pending"), (3, at(0), "pending"), (3, at(0.5), "done"), (None, at(0), "pending")], EVENT)
    feed(stored, src, [(2, at(3), "done"), (3, at(3), "pending"), (1, at(2), "pending")], EVENT)
    assert run(make, stored, src, EVENT, out, ck) == []
    # restarted: the state of the first run is still there; key 3 hangs again after another status
    feed(stored, src, [(9, at(9.5), "done"), (3, at(2.5), "late and older")], EVENT)
    feed(stored, src, [(9, at(9.6), "done")], EVENT)
    got = run(make, stored, src, EVENT, out, ck)
    assert got == [(1, at(2), "failed"), (3, at(3), "failed")]
    feed(stored, src, [(9, at(60), "done"), (4, at(59), "pending")], EVENT)
    feed(stored, src, [(9, at(61), "done")], EVENT)
    assert run(make, stored, src, EVENT, out, ck) == got  # each once
    table = state.overdue(stored.read.schema(EVENT).parquet(src), "key", after_s=300)
    assert sorted((r.key, r.last) for r in table.collect()) == [(1, at(2)), (3, at(3))]


def test_expiry(stored, tmp_path):
    schema = "key long, ts timestamp, expires timestamp"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    make = lambda s: state.expiries(s, "key", late="0 seconds")
    feed(stored, src, [(1, at(0), at(5)), (2, at(0), at(5)), (3, at(0), None), (4, at(0), at(90))], schema)
    feed(stored, src, [(2, at(1), at(20)), (4, at(2), None)], schema)
    feed(stored, src, [(9, at(10), None)], schema)
    feed(stored, src, [(9, at(11), None)], schema)
    assert run(make, stored, src, schema, out, ck) == [(1, at(5))]
    feed(stored, src, [(9, at(100), None)], schema)
    feed(stored, src, [(9, at(101), None)], schema)
    assert run(make, stored, src, schema, out, ck) == [(1, at(5)), (2, at(20))]
    table = state.expiries(stored.read.schema(schema).parquet(src), "key")
    assert sorted((r.key, r.expired) for r in table.collect()) == [(1, at(5)), (2, at(20))]


def test_publishing_goes_on_after_a_death_between_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for i in range(7):
        feed(spark, src, [(i, at(i), "x")], EVENT)

    def dies(number: int) -> None:
        if number == 1:
            raise RuntimeError("killed after batch 1 was written")

    start = lambda then: state.publish_once(state.file_stream(spark, EVENT, src, 2), out, ck, then=then)
    with pytest.raises(Exception, match="killed"):
        start(dies).awaitTermination(300)
    assert state.published_batches(spark, out, EVENT).count() == 4
    start(None).awaitTermination(300)
    assert sorted(r.key for r in state.published_batches(spark, out, EVENT).collect()) == list(range(7))
    start(None).awaitTermination(300)
    feed(spark, src, [(7, at(7), "x")], EVENT)
    start(None).awaitTermination(300)
    assert sorted(r.key for r in state.published_batches(spark, out, EVENT).collect()) == list(range(8))


def test_unique_messages_as_a_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    feed(spark, src, [(1, at(0), "a"), (1, at(1), "b"), (2, at(1), "a")], EVENT)
    feed(spark, src, [(1, at(2), "c"), (3, at(2), "a"), (None, at(2), "a")], EVENT)
    got = run(lambda s: ops.unique_messages(s, ["key"]), spark, src, EVENT, out, ck)
    assert sorted(r[0] or 0 for r in got) == [0, 1, 2, 3]
    assert ops.unique_messages(spark.read.schema(EVENT).parquet(src), ["key"]).count() == 4


def test_running_balance_takes_late_rows_in_time_order(stored, tmp_path):
    schema = "user_id long, ts timestamp, value double"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    feed(stored, src, [(1, at(3), -50.0), (1, at(1), -60.0), (2, at(1), -5.0), (None, at(1), -5.0)], schema)
    feed(stored, src, [(1, at(2), -30.0), (1, at(4), -500.0)], schema)  # at(2) comes a batch late
    feed(stored, src, [(9, at(30), -1.0)], schema)
    feed(stored, src, [(9, at(31), -1.0)], schema)
    got = run(lambda s: state.running_balance(s, 100.0, 600), stored, src, schema, out, ck)
    # 100 - 60, then - 30; the refill of the first emptying comes first; then it is too soon for another
    assert got == [(1, at(1), 40.0), (1, at(2), 10.0), (1, at(3), 60.0), (1, at(4), 0.0), (2, at(1), 95.0)]
