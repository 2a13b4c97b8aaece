"""Statement, emission and exposure metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.functions.norm import scaled_amount

from .temporal import as_of, latest_version, top_n

#: Tonnes per unit.
TONNES = {"t": 1.0, "kt": 1e3, "mil": 1e3, "mt": 1e6, "milhoes": 1e6, "kg": 1e-3}


def annual_statements(raw: DataFrame) -> DataFrame:
    """Last-exercise rows of the highest version, amounts in full units, with a source text."""
    d = raw.where(F.upper(F.trim("order")) == "ULTIMO").withColumn("amount", scaled_amount("amount", "scale"))
    d = latest_version(d.withColumn("version", F.col("version").try_cast("int")), ["company", "year", "scope"], "version")
    return d.withColumn("source", F.concat_ws(" ", F.col("statement"), F.col("year").cast("string"), F.concat(F.lit("v"), F.col("version").cast("string"))))


def kpis(wide: DataFrame) -> DataFrame:
    """EBITDA, debt, margins, return and interest cover of one row per company and year; zero bases give null."""
    r = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    d = wide.withColumn("ebitda", F.col("ebit") + F.col("depreciation")).withColumn("gross_debt", z("debt_short") + z("debt_long"))
    d = d.withColumn("net_debt", F.col("gross_debt") - z("cash") - z("securities")).withColumn("investment", F.greatest("capex", "concession"))
    return d.withColumn("ebitda_margin", r("ebitda", "revenue")).withColumn("net_margin", r("profit", "revenue")).withColumn("roe", r("profit", "equity")).withColumn(
        "interest_cover", F.col("ebitda") / F.nullif(F.abs("interest"), F.lit(0.0))
    )


def statement_alerts(wide: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Rows with the list of identities that their accounts break (revenue, cost, gross, expenses, ebit)."""
    lim = tolerance * F.greatest(F.abs("revenue"), F.lit(1.0))
    say = F.filter(
        F.array(
            F.when(F.col("cost") > 0, "cost is positive"),
            F.when(F.col("gross") > F.col("revenue"), "gross exceeds revenue"),
            F.when(F.abs(F.col("gross") - F.col("revenue") - F.col("cost")) > lim, "gross is not revenue plus cost"),
            F.when(F.abs(F.col("ebit") - F.col("gross") - F.col("expenses")) > lim, "ebit is not gross plus expenses"),
        ),
        lambda x: x.isNotNull(),
    )
    return wide.withColumn("alerts", say)


def share_capital(raw: DataFrame) -> DataFrame:
    """Totals above zero, thousands under 1e8 scaled up, highest version."""
    d = raw.where("shares > 0").withColumn("shares", F.when(F.col("shares") < 100_000_000, F.col("shares") * 1000).otherwise(F.col("shares")))
    return latest_version(d, ["company", "year"], "version")


def in_tonnes(df: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """Values in tonnes; an unknown unit gives null and an error text."""
    m = F.create_map(*[x for u, f in TONNES.items() for x in (F.lit(u), F.lit(f))])
    f = F.try_element_at(m, F.lower(F.trim(unit)))
    return df.withColumn("tonnes", F.col(value) * f).withColumn("error", F.when(f.isNull(), F.concat(F.lit("unknown unit "), F.coalesce(unit, F.lit("null")))))


def emissions_view(facts: DataFrame) -> DataFrame:
    """Confident rows, the largest per company, year and scope (ties: file, page)."""
    return top_n(facts.where("confidence >= 0.5"), ["company", "year", "scope"], [F.desc_nulls_last("tco2e"), F.asc("file"), F.asc("page")])


def one_per_scope(view: DataFrame) -> DataFrame:
    """Market-based replaces location-based within a scope."""
    base = F.regexp_replace("scope", "_(market|location)$", "")
    return top_n(view.withColumn("base_scope", base), ["company", "year", "base_scope"], [F.desc(F.endswith(F.col("scope"), F.lit("_market"))), F.asc("scope")])


def intensity(view: DataFrame, accounts: DataFrame) -> DataFrame:
    """tCO2e per million of revenue of the latest accounts not after the report year."""
    t = one_per_scope(view).groupBy("company", "year").agg(F.sum("tco2e").alias("tco2e"))
    j = as_of(t, accounts.withColumnRenamed("year", "accounts_year"), ["company"], "year", "accounts_year", ["accounts_year", "revenue"])
    return j.withColumn("per_million", 1e6 * F.col("tco2e") / F.nullif(F.col("revenue"), F.lit(0.0))).withColumn("notice", F.when(F.col("revenue").isNull(), "no financial pair"))


def exposure(view: DataFrame, accounts: DataFrame, prices: tuple[float, ...] = tuple(range(0, 601, 10)), scopes: tuple[str, ...] = ("1", "2", "3")) -> DataFrame:
    """Cost of emissions by price for the newest edition with all scopes, else the newest with any; missing scopes are listed."""
    e = one_per_scope(view).groupBy("company", "year").agg(F.sum("tco2e").alias("tco2e"), F.collect_set("base_scope").alias("have"))
    e = e.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, scopes)), "have"))).drop("have")
    best = top_n(e, ["company"], [F.desc(F.size("missing") == 0), F.desc("year")])
    j = as_of(best, accounts.withColumnRenamed("year", "accounts_year"), ["company"], "year", "accounts_year", ["ebitda"])
    s = j.withColumn("price", F.explode(F.array(*[F.lit(float(p)) for p in prices])))
    return s.withColumn("cost", F.col("tco2e") * F.col("price")).withColumn("pct_of_ebitda", 100 * F.col("cost") / F.nullif(F.col("ebitda"), F.lit(0.0)))


def consistency_radar(declared: DataFrame, official: DataFrame, targets: DataFrame, scopes: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Alerts (company, year, rule, severity), one per rule, company and year, most severe first."""
    gap = F.abs(F.col("declared") - F.col("official"))
    r1 = declared.join(official, ["company", "year"]).select("company", "year", F.lit("share gap").alias("rule"), F.when(F.col("basis") != F.col("official_basis"), "not comparable").when(gap >= 30, "high").when(gap >= 15, "medium").alias("severity"))
    big = scopes.groupBy("company", "year").agg(F.max_by("scope", "tco2e").alias("largest"))
    r2 = targets.join(big, ["company", "year"]).where((F.col("largest") == "3") & ~F.array_contains("covers", "3")).select("company", "year", F.lit("target leaves out scope 3").alias("rule"), F.lit("high").alias("severity"))
    r3 = frameworks.groupBy("company", "year").agg(F.bool_or("assured").alias("a")).where("not a").select("company", "year", F.lit("no assurance").alias("rule"), F.lit("low").alias("severity"))
    rank = F.element_at(F.create_map(*[x for i, s in enumerate(("high", "medium", "low", "not comparable")) for x in (F.lit(s), F.lit(i))]), F.col("severity"))
    u = r1.unionByName(r2).unionByName(r3).where("severity is not null").withColumn("_rank", rank)
    return top_n(u, ["rule", "company", "year"], [F.asc("_rank")]).orderBy("_rank", "company", "year", "rule").drop("_rank")


def series_quality(series: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Per month: mean, intervals, days present and days missing."""
    m = F.trunc(F.col(at).cast("date"), "month").alias("month")
    g = series.where(F.col(value).isNotNull()).groupBy(*keys, m).agg(F.avg(value).alias("mean"), F.count("*").alias("intervals"), F.count_distinct(F.to_date(at)).alias("days"))
    return g.withColumn("days_missing", F.dayofmonth(F.last_day("month")) - F.col("days"))


def chart_series(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Series with at least two points and something other than zero."""
    w = Window.partitionBy(*keys)
    return points.withColumn("_n", F.count(value).over(w)).withColumn("_m", F.max(F.abs(value)).over(w)).where("_n >= 2 and _m > 0").drop("_n", "_m")


#: The nine hybrid measures: name -> (numerator columns, of which the second is taken off where there are two with "-", denominator, factor).
HYBRID = {
    "revenue_carbon": ("scope1 + scope2_market", "revenue / 1e6", 1.0), "generation_carbon": ("scope1_generation", "generation_mwh", 1e3), "green_capex": ("capex_green", "capex_total", 100.0),
    "return_on_green_capex": ("ebitda_transition - ebitda_transition_before", "capex_green_to_date", 100.0), "clean_capacity": ("kw_clean", "kw_total", 100.0), "sf6_leak": ("sf6_refilled_kg", "sf6_bank_kg", 100.0),
    "distribution_loss": ("mwh_injected - mwh_billed", "mwh_injected", 100.0), "transition_research": ("research_transition", "revenue", 100.0), "green_debt": ("debt_green", "debt_short + debt_long", 100.0),
}


def hybrid_measures(wide: DataFrame) -> DataFrame:
    """The nine hybrid measures of one row per company and year; a missing part or a zero base gives null.  Columns that a table lacks count as missing."""
    have = wide
    for c in sorted({w for up, down, _ in HYBRID.values() for w in f"{up} {down}".split() if w.isidentifier()} - set(wide.columns)):
        have = have.withColumn(c, F.lit(None).cast("double"))
    return have.select(*wide.columns, *[(f * F.expr(up).cast("double") / F.nullif(F.expr(down).cast("double"), F.lit(0.0))).alias(name) for name, (up, down, f) in HYBRID.items()])
