"""Measures that stay right at any grouping: sums, ratios of sums, weighted means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """One measure of a dataset; ``rule`` is sum, mean, min, max, ratio or weighted."""

    name: str
    rule: str
    column: str
    by: str | None = None  # denominator or weight
    factor: float = 1.0
    absolute: bool = False  # ratio over the denominator's absolute value

    def column_of(self) -> Column:
        v = F.col(self.column)
        if self.rule in ("sum", "mean", "min", "max"):
            return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[self.rule](v).alias(self.name)
        w = F.col(self.by)
        both = v.isNotNull() & w.isNotNull()
        if self.rule == "ratio":
            down = F.sum(F.when(both, F.abs(w) if self.absolute else w))
            return (F.sum(F.when(both, v)) * self.factor / F.nullif(down, F.lit(0).cast("double"))).alias(self.name)
        if self.rule == "weighted":
            return (F.sum(F.when(both, v * w)) / F.nullif(F.sum(F.when(both, w)), F.lit(0).cast("double"))).alias(self.name)
        raise ValueError(f"unknown rule {self.rule}")


def filtered(df: DataFrame, chosen: dict[str, list] | None = None, period: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the chosen values of any dimensions and of a text period range."""
    for column, values in (chosen or {}).items():
        if values:
            df = df.where(F.col(column).isin(values))
    if period and start is not None:
        df = df.where(F.col(period) >= start)
    if period and end is not None:
        df = df.where(F.col(period) <= end)
    return df


def aggregate(df: DataFrame, keys: list[str], measures: list[Measure]) -> DataFrame:
    return df.groupBy(*keys).agg(*(m.column_of() for m in measures))


def ranking(df: DataFrame, key: str, measure: Measure, limit: int | None = None) -> DataFrame:
    """Groups by the measure, best first; null keys and null values are left out; ties by key."""
    out = aggregate(df.where(F.col(key).isNotNull()), [key], [measure]).where(F.col(measure.name).isNotNull()).orderBy(F.desc(measure.name), key)
    return out.limit(limit) if limit is not None else out


def last_period_with_data(df: DataFrame, period: str, column: str) -> DataFrame:
    """Rows of the most recent period in which the column has a value."""
    top = df.where(F.col(column).isNotNull()).agg(F.max(period).alias(period))
    return df.join(F.broadcast(top), period)  # one row


def series_or_total(df: DataFrame, series: str, period: str, measure: Measure, most: int = 8) -> DataFrame:
    """Per series and period, or one total line if there are more than ``most`` series."""
    few = df.agg((F.count_distinct(series) <= most).alias("few"))
    levels = df.rollup(period, series).agg(measure.column_of(), F.grouping(series).alias("level")).where(F.col(period).isNotNull())
    return levels.join(F.broadcast(few)).where((F.col("level") == 0) == F.col("few")).drop("level", "few")  # one row


def unique_search_terms(df: DataFrame, value: str, ident: str) -> DataFrame:
    """Ids of a dimension's values, only if every value has exactly one."""
    g = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(ident).alias("n"), F.min(ident).alias(ident))
    worst = g.agg(F.max("n").alias("worst"))
    return g.join(F.broadcast(worst)).where("worst = 1").select(value, ident)  # one row


def provenance(df: DataFrame, keys: list[str], file: str, page: str, name: str = "sources") -> DataFrame:
    """'file p.3, 9; other p.1' of the rows of each key."""
    per_file = df.where(F.col(file).isNotNull()).groupBy(*keys, file).agg(F.array_join(F.transform(F.array_sort(F.collect_set(page)), lambda p: p.cast("string")), ", ").alias("_pages"))
    line = F.concat(F.col(file), F.when(F.length("_pages") > 0, F.concat(F.lit(" p."), F.col("_pages"))).otherwise(""))
    return per_file.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias(name))


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets: rows with value <= bound, per key and bound."""
    arr = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds])
    return df.groupBy(*keys).agg(arr.alias("b")).select(*keys, F.inline("b"))


def pivot_accounts(df: DataFrame, keys: list[str], account: str, value: str, accounts: dict[str, str]) -> DataFrame:
    """Account codes to columns; ``accounts`` maps code to column name."""
    return df.where(F.col(account).isin(list(accounts))).groupBy(*keys).agg(*[F.max(F.when(F.col(account) == a, F.col(value))).alias(n) for a, n in accounts.items()])


def priced_rollup(df: DataFrame, keys: list[str], amount: str, cost: str) -> DataFrame:
    """Sums; the cost only if every row has one."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(amount).alias(amount), F.when(F.every(F.col(cost).isNotNull()), F.sum(cost)).alias(cost))


def z_scores(df: DataFrame, columns: dict[str, float], name: str = "score") -> DataFrame:
    """Weighted sum of population z-scores over the table (computed from one aggregate row)."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = sum((w * (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c, w in columns.items()), F.lit(0.0))
    return df.join(F.broadcast(stats)).withColumn(name, z).drop(*stats.columns)  # one row


def disclosure_score(emissions: DataFrame, targets: DataFrame, frameworks: DataFrame, key: str) -> DataFrame:
    """15 per scope of 1-3, 20 for a target, 5 per framework up to 3, 20 if any is assured."""
    e = emissions.groupBy(key).agg(F.count_distinct(F.when(F.col("scope").isin(1, 2, 3), F.col("scope"))).alias("scopes"))
    t = targets.select(key).distinct().withColumn("target", F.lit(1))
    f = frameworks.groupBy(key).agg(F.count_distinct("framework").alias("frameworks"), F.bool_or("assured").alias("assured"))
    j = e.join(t, key, "full").join(f, key, "full")
    n = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    return j.select(key, (15 * n("scopes") + 20 * n("target") + 5 * F.least(n("frameworks"), F.lit(3)) + 20 * n("assured")).alias("score"))


def rank_in_class(df: DataFrame, size_class: str, value: str) -> DataFrame:
    w = Window.partitionBy(size_class)
    return df.withColumn("rank", F.rank().over(w.orderBy(F.asc_nulls_last(value)))).withColumn("class_size", F.count("*").over(w))
