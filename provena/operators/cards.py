"""Entity and company cards, listings, shares and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.functions.norm import fold, period_kind, scaled_amount

from .temporal import latest_version, top_n


def entity_card(entities: DataFrame, aliases: DataFrame, years: DataFrame, chosen: Column, key: str = "id") -> DataFrame:
    """Every entity with all its aliases, those that are ``chosen``, and its first and last year ('none' without any).

    Both sides are aggregated to one row per entity before the joins.
    """
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    a = aliases.groupBy(key).agg(listed("alias").alias("aliases"), F.nullif(listed(F.when(chosen, F.col("alias"))), F.lit("")).alias("chosen"))
    y = years.groupBy(key).agg(F.concat_ws("-", F.min("year").cast("string"), F.max("year").cast("string")).alias("years"))
    return entities.join(a, key, "left").join(y, key, "left").withColumn("years", F.coalesce("years", F.lit("none")))


def merged(df: DataFrame, key: str, name: str, flag: str) -> DataFrame:
    """One row per key: the shortest name (ties: the smaller one), and whether any row has the flag."""
    return df.groupBy(key).agg(F.min(F.struct(F.length(name).alias("n"), F.col(name).alias("name"))).alias("m"), F.bool_or(flag).alias(flag)).select(key, F.col("m.name").alias(name), flag)


def perimeter(companies: DataFrame, key: str, holding: str, direct: str) -> DataFrame:
    """``(holding, member)``: what each holding controls directly, and the holding itself."""
    own = companies.select(F.col(holding).alias("holding")).where("holding is not null")
    return companies.where(F.col(direct)).select(F.col(holding).alias("holding"), F.col(key).alias("member")).where("holding is not null").union(own.select("holding", "holding")).distinct()


def owned_share(assets: DataFrame, stakes: DataFrame, members: DataFrame, asset: str, owner: str, first: str, second: str, percent: str) -> DataFrame:
    """Per asset: the members' share of its size (the first figure, else the second), in thousands."""
    j = stakes.join(members.select(F.col("member").alias(owner)).distinct(), owner, "left_semi").join(assets, asset)
    return j.groupBy(asset).agg((F.sum(F.coalesce(first, second) * F.col(percent) / 100) / 1000).alias("share"))


def typed_union(frames: list[tuple[DataFrame, int]], columns: dict[str, str]) -> DataFrame:
    """Unlike sources as one table of the named columns and types; what a source lacks is a null of that type; with each source's priority."""
    one = lambda df, p: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()], F.lit(p).alias("priority"))
    out = one(*frames[0])
    for f in frames[1:]:
        out = out.unionByName(one(*f))
    return out


def value_counts(df: DataFrame, column: str, contains: str | None = None, n: int | None = None) -> DataFrame:
    """Values with counts, most frequent first (ties by value), optionally those that contain the folded text."""
    d = df.where(F.col(column).isNotNull())
    if contains:
        d = d.where(F.contains(fold(column), fold(F.lit(contains))))
    g = d.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return g.limit(n) if n is not None else g


def positive_sums(df: DataFrame, keys: list[str], value: str, phase: str, prefix: str) -> DataFrame:
    """Sums above zero of the rows without a phase or with one that starts with the prefix."""
    ok = F.col(phase).isNull() | F.startswith(fold(phase), F.lit(prefix))
    return df.where(ok).groupBy(*keys).agg(F.sum(value).alias("total")).where("total > 0")


def share_of(df: DataFrame, keys: list[str], kind: str, value: str, words: list[str]) -> DataFrame:
    """Share (percent) of the kinds that hold one of the words in each key's total."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(fold(kind), F.lit(w))
    g = df.groupBy(*keys).agg(F.sum(value).alias("total"), F.sum(F.when(hit, F.col(value)).otherwise(0.0)).alias("part"))
    return g.withColumn("pct", 100 * F.col("part") / F.nullif("total", F.lit(0.0)))


def prefix_sums(df: DataFrame, keys: list[str], code: str, value: str, prefixes: dict[str, str]) -> DataFrame:
    """One sum per code prefix, so that unlike codes (money, counts) never mix."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.startswith(F.col(code), F.lit(p)), F.col(value))).alias(n) for n, p in prefixes.items()])


def similarity_grade(indicators: DataFrame, pairs: DataFrame, gap: float = 0.2, share: float = 2 / 3) -> DataFrame:
    """``pairs(a, b)`` graded on ``indicators(entity, indicator, value)``: equivalent, close or distant.

    An indicator counts where both sides have a value, and agrees under the gap (of the larger absolute value);
    equivalent needs ``share`` of them, close half as much.
    """
    a = indicators.select(F.col("entity").alias("a"), "indicator", F.col("value").alias("_x")).where("_x is not null")
    b = indicators.select(F.col("entity").alias("b"), "indicator", F.col("value").alias("_y")).where("_y is not null")
    j = pairs.join(a, "a").join(b, ["b", "indicator"])
    near = F.abs(F.col("_x") - F.col("_y")) < gap * F.greatest(F.abs("_x"), F.abs("_y"))
    g = j.groupBy("a", "b").agg(F.count("*").alias("of"), F.count_if(near | (F.col("_x") == F.col("_y"))).alias("near"))
    return g.withColumn("grade", F.when(F.col("near") >= share * F.col("of"), "equivalent").when(F.col("near") >= share / 2 * F.col("of"), "close").otherwise("distant"))


def quarterly_statements(raw: DataFrame) -> DataFrame:
    """Last-exercise rows of the highest version of each reference date, statement and scope, with the kind of period."""
    d = raw.where(F.upper(F.trim("order")) == "ULTIMO").withColumn("amount", scaled_amount("amount", "scale")).withColumn("version", F.col("version").try_cast("int"))
    d = latest_version(d, ["company", "reference", "statement", "scope"], "version")
    return d.withColumn("period", period_kind("start", F.col("statement").isin("BPA", "BPP"))).withColumn("end", F.coalesce("end", "reference"))


def indicator_card(annual: DataFrame, quarters: DataFrame, key: str, low: int | None = None, high: int | None = None, last: int = 4, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """(annual rows of a year range, the last quarters of each company with how many there are and whether some are cut)."""
    n = max(1, min(last, most))
    years = annual.where(F.col("year").between(F.coalesce(F.lit(low), F.lit(0)), F.coalesce(F.lit(high), F.lit(9999))))
    counted = quarters.withColumn("in_base", F.count("*").over(Window.partitionBy(key)))
    return years, top_n(counted, [key], [F.desc("reference")], n).withColumn("cut", F.col("in_base") > n)


def latest_ranking(rows: DataFrame, entity: str, year: str, value: str, asked: int | None = None, n: int | None = None) -> DataFrame:
    """Entities by a metric, largest first: one row each, of the year asked for, else of its newest edition that has the metric."""
    d = rows.where(F.col(value).isNotNull())
    d = d.where(F.col(year) == asked) if asked is not None else latest_version(d, [entity], year)
    out = top_n(d, [entity], [F.desc(value), F.asc(year)]).orderBy(F.desc(value), entity)
    return out.limit(n) if n is not None else out


def scoreboard(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case, whether its answer holds every ``must`` pattern and no ``must_not``, and one of its ``tools`` (if it names any) was used.

    ``runs(case, answer, tools, error)``, ``cases(case, must, must_not, tools)`` with arrays of patterns and names.
    """
    c = cases.select("case", "must", "must_not", F.col("tools").alias("_wanted"))
    j = c.join(runs, "case", "left")
    answer = F.coalesce("answer", F.lit(""))
    none = lambda x: F.coalesce(F.col(x), F.array().cast("array<string>"))
    said = F.forall(none("must"), lambda p: F.rlike(answer, p)) & ~F.exists(none("must_not"), lambda p: F.rlike(answer, p))
    used = (F.size(none("_wanted")) == 0) | F.arrays_overlap(none("_wanted"), none("tools"))
    ok = F.col("answer").isNotNull() & F.col("error").isNull() & said & used
    return j.select("case", said.alias("said"), used.alias("used"), ok.alias("passed"))


def run_records(spark: SparkSession, path: str) -> DataFrame:
    """``runs`` for ``scoreboard`` from JSON lines ``{case or question, answer, tools, seconds, error}``: the newest line of each case (by ``at``) counts; a line that isn't JSON is left out."""
    d = spark.read.schema("case string, question string, answer string, tools array<string>, seconds double, error string, at string").option("mode", "DROPMALFORMED").json(path)
    d = d.withColumn("case", F.coalesce("case", "question")).where("case is not null").drop("question")
    return top_n(d, ["case"], [F.desc_nulls_last("at"), F.asc("error")])


def described(spark_tables: dict[str, DataFrame], summaries: DataFrame) -> DataFrame:
    """``(table, rows, summary, columns)`` of the named tables; a count each, in one job."""
    one = lambda name, df: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)).alias("columns"))
    out = None
    for name, df in spark_tables.items():
        out = one(name, df) if out is None else out.unionByName(one(name, df))
    return out.join(summaries, "table", "left")
