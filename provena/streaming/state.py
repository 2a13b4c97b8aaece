"""Keyed state with timers: expiry, overdue rows, balances, and batches that are published once.

State lives in the state store of the query (RocksDB, see ``with_state_store``) under its checkpoint, so a restarted
query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers, lists and time to live need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _millis(t) -> int:
    return pd.Timestamp(t).value // 1_000_000


class _Overdue(StatefulProcessor):
    def __init__(self, pending: str, after_ms: int):
        self.pending, self.after = pending, after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, status = self.last.get() if self.last.exists() else (None, None)
        before = at if status == self.pending else None
        for f in rows:
            for t, s in zip(f["at"], f["status"], strict=True):
                t = _millis(t)
                if at is None or (t, s != self.pending) >= (at, status != self.pending):
                    at, status = t, s
        if before is not None:
            self.handle.deleteTimer(before + self.after)
        if at is not None:
            self.last.update((at, status))
            if status == self.pending:
                self.handle.registerTimer(at + self.after)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        at, status = self.last.get()
        if status == self.pending and expiredTimerInfo.getExpiryTimeInMs() == at + self.after:
            self.last.update((at, "failed"))
            yield pd.DataFrame({"key": [key[0]], "last": [pd.Timestamp(at, unit="ms")], "status": ["failed"]})

    def close(self) -> None:
        pass


def overdue(events: DataFrame, key: str, at: str = "ts", status: str = "status", pending: str = "pending", after_s: int = 300, late: str = "1 minute") -> DataFrame:
    """``(key, last, status)``: keys whose newest row has been pending for longer than ``after_s``, reported once as failed.

    Only the newest row counts (of rows of one moment, one that isn't pending): another status ends the wait, a later
    pending row begins a new one, whatever came between.  A late row that is older than what is known changes nothing.
    Null keys or times are left out.  A stream's clock is its watermark; a table's is its newest row.
    """
    e = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(status).alias("status"))
    kind = e.schema["key"].dataType.simpleString()
    if not events.isStreaming:
        newest = F.max(F.struct("at", (~F.col("status").eqNullSafe(pending)).alias("other")))
        now = e.agg(F.max("at").alias("now"))
        g = e.groupBy("key").agg(newest.alias("m")).where("not m.other")
        return g.join(F.broadcast(now)).where(F.col("now") > F.col("m.at") + F.make_dt_interval(secs=F.lit(after_s))).select(F.col("key").alias(key), F.col("m.at").alias("last"), F.lit("failed").alias("status"))  # one row
    out = e.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Overdue(pending, after_s * 1000), f"key {kind}, last timestamp, status string", "Append", "EventTime")
    return out.withColumnRenamed("key", key)


class _Living(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.until.get()[0] if self.until.exists() else None
        new, newest = old, None
        for f in rows:
            for t, x in zip(f["at"], f["expires"], strict=True):
                if newest is None or t >= newest:
                    newest, new = t, None if pd.isna(x) else _millis(x)
        if old is not None:
            self.handle.deleteTimer(old)
        if new is None:
            self.until.clear()
        else:
            self.until.update((new,))
            self.handle.registerTimer(new)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and self.until.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            at = self.until.get()[0]
            self.until.clear()
            yield pd.DataFrame({"key": [key[0]], "expired": [pd.Timestamp(at, unit="ms")]})

    def close(self) -> None:
        pass


def expiries(rows: DataFrame, key: str, at: str = "ts", expires: str = "expires", late: str = "1 minute") -> DataFrame:
    """``(key, expired)``: each key once its time to live has passed on the stream's clock.

    The newest row of a batch sets a key's expiry anew; a null expiry makes it permanent.  Null keys or times are left out.
    """
    e = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(expires).alias("expires"))
    kind = e.schema["key"].dataType.simpleString()
    if not rows.isStreaming:
        now = e.agg(F.max("at").alias("now"))
        g = e.groupBy("key").agg(F.max_by("expires", "at").alias("expired"))
        return g.join(F.broadcast(now)).where("expired < now").select(F.col("key").alias(key), "expired")  # one row
    out = e.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Living(), f"key {kind}, expired timestamp", "Append", "EventTime")
    return out.withColumnRenamed("key", key)


class _Balance(StatefulProcessor):
    def __init__(self, refill: float, every_ms: int):
        self.refill, self.every = refill, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "balance double, last long")
        self.waiting = handle.getListState("waiting", "at long, amount double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            new = [(_millis(t), float(x)) for t, x in zip(f["at"], f["amount"], strict=True)]
            if new:
                self.waiting.appendList(new)
                for t in {t for t, _ in new}:
                    self.handle.registerTimer(t)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(self.waiting.get())
        due, later = [r for r in rows if r[0] <= until], [r for r in rows if r[0] > until]
        if not due:
            return
        balance, last = self.now.get() if self.now.exists() else (self.refill, None)
        out = []
        for t, amount in due:
            if balance + amount <= 0 and (last is None or t - last >= self.every):
                balance, last = balance + self.refill, t
            balance = max(0.0, balance + amount)
            out.append((key[0], pd.Timestamp(t, unit="ms"), balance))
        self.now.update((balance, last))
        self.waiting.put(later) if later else self.waiting.clear()
        yield pd.DataFrame(out, columns=["key", "at", "balance"])

    def close(self) -> None:
        pass


def running_balance(events: DataFrame, refill: float, every_s: float, at: str = "ts", key: str = "user_id", amount: str = "value", late: str = "10 minutes") -> DataFrame:
    """Balance per key with floor 0; when a spend would reach 0 and the interval has passed, it is refilled first.

    Events wait in state until the watermark has passed them and are then taken in the order of their times (of one
    moment: the smaller amount first), so it doesn't matter in which micro-batch one arrives.  What comes later than
    ``late`` is dropped by the watermark.  Rows with a null key, time or amount are left out.
    """
    e = events.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(amount).isNotNull())
    e = e.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(amount).cast("double").alias("amount"))
    kind = e.schema["key"].dataType.simpleString()
    out = e.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Balance(refill, int(every_s * 1000)), f"key {kind}, at timestamp, balance double", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.col("at").alias(at), "balance")


def publish_once(stream: DataFrame, path: str, checkpoint: str, then: Callable[[int], None] | None = None):
    """Publishes what is available now under ``path`` and returns the query; the next call goes on where it stopped.

    A micro-batch is one version: its rows are written to a folder named by the batch's number, over what an attempt that
    died may have left, and only then does the pointer move to it.  The pointer is a file per batch, written in one piece,
    so a batch that is run again publishes the same rows under the same name: none twice, none lost.  How many files a
    version takes in is the source's own setting, ``maxFilesPerTrigger`` (see ``file_stream``); ``then`` is called after each.
    """

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")
        spark = batch.sparkSession
        spark.range(1).select(F.lit(number).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").json(f"{path}/_published/{number:012d}")
        if then is not None:
            then(number)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, schema, path: str, every_files: int, kind: str = "parquet") -> DataFrame:
    """A folder's files as a stream that takes in ``every_files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", every_files).format(kind).load(path)


def published_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all published batches; a batch without its pointer is not seen."""
    done = spark.read.schema("batch long").json(f"{path}/_published/*")
    rows = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1).cast("long")).join(done.distinct(), "batch", "left_semi").drop("batch")
