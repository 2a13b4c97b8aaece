"""Shared pieces of the training-data operators: the shared folder, staged
tables and connected components.

Staged tables are Parquet in the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read them again after a loss, and
they cut the lineage of iterative jobs.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


OWN = "__own"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named and driver and tasks are one process (tests) a local one is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="provena-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/provena/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def table_input(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller never clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def carried(df: DataFrame, *used: str) -> DataFrame:
    """The columns ``used`` and, in one reserved column, all others, so that names of the caller never clash with ours."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used]
    return df.select(*used, (F.struct(*rest) if rest else F.lit(None).cast("int")).alias(OWN))


def restored(df: DataFrame, like: DataFrame, *used: str, without: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``like`` again, but for those named in ``without``, then the ``extra`` ones."""
    names = [c for c in like.columns if c not in without]
    return df.select(*[F.col(c) if c in used else F.col(f"{OWN}.`{c}`").alias(c) for c in names], *extra)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: int, most: int = 1000) -> DataFrame:
    """``left.join(right, keys)`` where some keys may hold a large part of the left rows.

    ``right`` has, in ``n``, the number of left rows of each key, ``rows`` is their total: so at most ``most`` keys
    have over rows / most, and only these are broadcast, which deals their left rows to all tasks.
    """
    hot = F.col("n") * most > rows
    few = F.broadcast(right.where(hot).drop("n"))
    rest = left.join(F.broadcast(right.where(hot).select(*keys).distinct()), keys, "left_anti")
    return left.join(few, keys).unionByName(rest.join(right.where(~hot).drop("n"), keys))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)`` where
    component is the smallest node; nodes without an edge are not listed.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each
    step is a combinable ``min`` per node and a join, so a node with many
    neighbours is never gathered in one task.  Every round is staged; the
    driver sees one checksum a round.  Raises if ``rounds`` don't suffice.
    """
    e = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges"
    )
    seen = None
    for _ in range(rounds):
        # large star: each larger neighbour v of u goes to the smallest neighbour of u
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and u itself go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = staged(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
            .union(low.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v"), F.col("v")).distinct())
