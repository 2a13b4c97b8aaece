"""Versions, editions, as-of joins and period arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of each key's highest version; ties stay."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_v", F.max(version).over(w)).where(F.col(version) == F.col("_v")).drop("_v")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def current_name(df: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Every row gets its key's most recent name."""
    return df.withColumn(name, F.max_by(name, order).over(Window.partitionBy(*keys)))


def latest_edition(df: DataFrame, ident: str, name: str, year: str) -> DataFrame:
    """Rows of the newest year of each entity (its id, or its name where the id is missing)."""
    w = Window.partitionBy(F.coalesce(F.col(ident), F.col(name)))
    return df.withColumn("_y", F.max(year).over(w)).where(F.col(year) == F.col("_y")).drop("_y")


def year_over_year(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Change against exactly the previous year; null where that is missing or zero."""
    w = Window.partitionBy(*keys).orderBy(year)
    prev = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(value).over(w))
    change = F.col(value) - F.col("previous")
    return df.withColumn("previous", prev).withColumn("change", change).withColumn("change_pct", 100 * F.col("change") / F.nullif(F.abs("previous"), F.lit(0.0)))


def last_and_previous(df: DataFrame, keys: list[str], period: str, value: str, points: bool = False) -> DataFrame:
    """The last two periods with a value and their change; relative change is null on a zero base or a sign change."""
    w = Window.partitionBy(*keys).orderBy(F.desc(period))
    two = df.where(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    pick = lambda c, i: F.max(F.when(F.col("_rn") == i, F.col(c)))
    g = two.groupBy(*keys).agg(pick(period, 1).alias("period"), pick(value, 1).alias("last"), pick(period, 2).alias("previous_period"), pick(value, 2).alias("previous"))
    bad = (F.col("previous") == 0) | (F.signum("previous") * F.signum("last") < 0)
    change = F.col("last") - F.col("previous")
    return g.withColumn("change", change if points else F.when(~bad, change / F.abs("previous")))


def largest_rise(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """The year with the largest rise over the year before; the later wins ties."""
    d = year_over_year(df, keys, year, value).where("change > 0")
    return d.groupBy(*keys).agg(F.max(F.struct(F.col("change"), F.col(year).alias("year"))).alias("m")).select(*keys, "m.year", F.col("m.change").alias("rise"))


def trailing_sum(df: DataFrame, keys: list[str], order: str, value: str, n: int = 4) -> DataFrame:
    """Sum of the last n values; null until all n are there."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
    return df.withColumn("trailing", F.when(F.count(value).over(w) == n, F.sum(value).over(w)))


def fourth_quarters(quarters: DataFrame, annual: DataFrame, keys: list[str], year: str, quarter: str, value: str) -> DataFrame:
    """The quarters with the fourth derived as annual minus the first three."""
    nine = quarters.where(F.col(quarter) < 4).groupBy(*keys, year).agg(F.sum(value).alias("_s"), F.count(value).alias("_n")).where("_n = 3")
    last = annual.join(nine, [*keys, year]).select(*keys, year, F.lit(4).alias(quarter), (F.col(value) - F.col("_s")).alias(value))
    return quarters.where(F.col(quarter) < 4).select(*last.columns).unionByName(last)


def cumulative_by_year(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Running totals on a spine without gaps."""
    g = df.groupBy(*keys, year).agg(F.sum(value).alias(value))
    spine = g.groupBy(*keys).agg(F.min(year).alias("lo"), F.max(year).alias("hi")).select(*keys, F.explode(F.sequence("lo", "hi")).alias(year))
    w = Window.partitionBy(*keys).orderBy(year)
    return spine.join(g, [*keys, year], "left").withColumn(value, F.coalesce(value, F.lit(0.0))).withColumn("total", F.sum(value).over(w))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, columns: list[str]) -> DataFrame:
    """Each left row with the right row of the same key that is the latest not after it.

    One union and one window per key (no range join): right rows are carried forward
    with ``last(ignoreNulls)``; at equal times the right row counts.
    """
    carried = right.select(F.struct(*columns)).schema[0].dataType
    l = left.select("*", F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(carried).alias("_r"))
    r = right.select(*keys, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.struct(*columns).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in columns])


def strictly_increasing(df: DataFrame, keys: list[str], order: list[str], millis: str) -> DataFrame:
    """t_i = max(t_i, t_{i-1} + 1), by the running maximum of t minus its row number; rows without a place come last, those of one place by time."""
    w = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order], F.asc_nulls_last(millis))
    rn = F.row_number().over(w)
    return df.withColumn("_rn", rn).withColumn(millis, F.max(F.col(millis) - F.col("_rn")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_rn")).drop("_rn")


def floored_balance(df: DataFrame, keys: list[str], order: list[str], amount: str, opening: float = 0.0) -> DataFrame:
    """b = max(0, b + x) in order: the running sum minus its least prefix below zero."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = df.withColumn("_s", F.sum(amount).over(w) + opening)
    return s.withColumn("balance", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w))).drop("_s")
