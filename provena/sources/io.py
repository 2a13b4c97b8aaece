"""Readers and writers."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def delimited(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", sep: str = ";") -> DataFrame:
    """All columns as text; quotes doubled inside quotes, line breaks allowed in them."""
    return spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', inferSchema=False, encoding=encoding, multiLine=True)


def tagged_union(spark: SparkSession, paths: list[str], pattern: str, names: list[str], **options) -> DataFrame:
    """Files of unlike columns in one table, with tags taken from the file name by the pattern's groups."""
    out = None
    for p in paths:
        d = delimited(spark, p, **options)
        for i, n in enumerate(names, 1):
            d = d.withColumn(n, F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), pattern, i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def series_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """[{data: dd/mm/yyyy, valor: text}] -> (date, value), one row a date; of a repeated date the greatest value."""
    d = spark.read.schema("data string, valor string").json(path, multiLine=True)
    d = d.select(F.try_to_date("data", "dd/MM/yyyy").alias("date"), F.col("valor").try_cast("double").alias("value")).where("date is not null")
    return d.groupBy("date").agg(F.max("value").alias("value"))


def preamble_text(spark: SparkSession, path: str | list[str], skip: int, columns: list[str], encoding: str = "ISO-8859-1", sep: str = "\t") -> DataFrame:
    """Separated text with ``skip`` lines before the data of every file and repeated or missing names; columns go by position."""
    d = spark.read.csv(path, sep=sep, header=False, encoding=encoding, inferSchema=False, schema=", ".join(f"`{c}` string" for c in columns))
    d = d.select(*[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias("_i"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    head = d.where("_b = 0").groupBy("_f").agg(F.min("_i").alias("_first"))  # one row a file
    j = d.join(head, "_f", "left").where((F.col("_b") > 0) | F.col("_first").isNull() | (F.col("_i") >= F.col("_first") + skip))
    return j.select(*[F.col(f"`{c}`") for c in columns])


def since_period(spark: SparkSession, path: str, glob: str, pattern: str, since: str) -> DataFrame:
    """Parquet files of a series whose name's period is not before ``since``."""
    d = spark.read.option("pathGlobFilter", glob).parquet(path)
    return d.withColumn("period", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)).where(F.col("period") >= since)


def publish(df: DataFrame, path: str) -> str:
    """A new version beside the others; its pointer is added last and none is taken away, so readers always find one.

    Pointers are numbered on from the greatest that is there, whatever the writers' clocks say; of writers at the same
    moment, the one of the greater version name is current, for every reader alike."""
    version, spark = uuid.uuid4().hex, df.sparkSession
    df.write.parquet(f"{path}/v={version}")
    try:
        n = spark.read.schema("n long, version string").json(f"{path}/_current").agg(F.coalesce(F.max("n"), F.lit(0)) + 1).first()[0]
    except AnalysisException:  # the first version
        n = 1
    spark.sql(f"SELECT {n}L AS n, '{version}' AS version").coalesce(1).write.mode("append").json(f"{path}/_current")
    return version


def published(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.schema("n long, version string").json(f"{path}/_current").agg(F.max(F.struct("n", "version")).alias("m")).first().m.version
    return spark.read.parquet(f"{path}/v={version}")


def write_quoted_csv(df: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled, nulls empty."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', nullValue="", emptyValue="")


def write_panel(df: DataFrame, path: str, declared: list[str]) -> None:
    """A dataset as JSON lines; declared columns must exist."""
    missing = [c for c in declared if c not in df.columns]
    if missing:
        raise ValueError(f"columns declared but missing: {missing}")
    df.select(F.to_json(F.struct(*declared)).alias("value")).write.mode("overwrite").text(path)


def write_panels(panels: dict[str, DataFrame | None], declared: dict[str, list[str]], path: str, catalog: DataFrame) -> DataFrame:
    """Each dataset as JSON lines in a folder of its own; returns ``(id, columns, rows, description, skipped)``, also of those that are missing.

    Declared columns must exist: all are looked at before anything is written.
    """
    for name, df in panels.items():
        gone = [c for c in declared.get(name, []) if df is not None and c not in df.columns]
        if gone:
            raise ValueError(f"{name}: columns declared but missing: {gone}")
    for name, df in panels.items():
        if df is not None:
            write_panel(df, f"{path}/{name}", declared.get(name) or df.columns)
    spark = catalog.sparkSession
    count = lambda name, df: spark.read.text(f"{path}/{name}").count() if df is not None else None
    rows = [(name, None if df is None else declared.get(name) or df.columns, count(name, df), df is None) for name, df in panels.items()]
    d = spark.createDataFrame(rows, "id string, columns array<string>, rows long, skipped boolean")
    return d.join(catalog.select(F.col("table").alias("id"), "description"), "id", "left").select("id", "columns", "rows", "description", "skipped")


def write_per_key(df: DataFrame, key: str, path: str) -> DataFrame:
    """One JSON folder per key; returns the index of keys with content."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(path)
    return df.select(key).distinct()


def dictionary(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """Columns of all registered views with the catalog's description; undocumented tables are flagged."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    d = spark.createDataFrame(rows, "table string, column string, type string")
    return d.join(catalog.select("table", "description"), "table", "left").withColumn("undocumented", F.col("description").isNull())


def described(spark: SparkSession, table: str, catalog: DataFrame, rows: int = 3) -> dict:
    """A table's columns with types, its description, source and caveats from the catalog, and sample rows."""
    if not spark.catalog.tableExists(table):
        raise ValueError(f"no table {table}")
    info = catalog.where(F.col("table") == table).select(*[F.col(c) if c in catalog.columns else F.lit("").alias(c) for c in ("description", "source", "caveats")]).first()
    text = lambda c: (info[c] if info else None) or ""
    df = spark.table(table)
    return {"table": table, **{c: text(c) for c in ("description", "source", "caveats")}, "columns": dict(df.dtypes), "sample": [r.asDict() for r in df.limit(rows).collect()]}


def guarded_sql(spark: SparkSession, sql: str, most: int = 200) -> DataFrame:
    """A query over registered views, at most ``most`` rows and one more to tell that it was cut.

    The text must be one query by itself, and it runs as a subquery, where commands and writes don't parse, so nothing
    takes effect before it is refused.
    """
    text = sql.strip().rstrip(";")
    plan = spark.sql(f"EXPLAIN EXTENDED {text}").first()[0]  # a text that only parses inside something else fails here
    if "== Analyzed Logical Plan ==\norg.apache.spark.sql.AnalysisException" in plan:
        raise ValueError(plan.split("AnalysisException: ", 1)[-1].split("\n")[0])
    return spark.sql(f"SELECT * FROM (\n{text}\n) AS guarded LIMIT {int(most) + 1}")


def tables_read(spark: SparkSession, sql: str) -> list[str]:
    """The views and tables that a query reads, also through others, as Spark resolves them."""
    plan = spark.sql(f"EXPLAIN EXTENDED {sql.strip().rstrip(';')}").first()[0]
    resolved = plan.split("== Analyzed Logical Plan ==", 1)[-1].split("== Optimized Logical Plan ==", 1)[0]
    return sorted(set(re.findall(r"View \(`([^`]+)`", resolved)) | set(re.findall(r"Relation (?:\w+\.)+(\w+)\[", resolved)))


def answered(spark: SparkSession, sql: str, most: int = 200, seconds: float = 30.0) -> dict:
    """A guarded query's answer: ``tables`` it reads (none is refused), ``rows``, whether they are ``truncated``, and a ``notice``; it is cancelled after ``seconds``."""
    tables = tables_read(spark, sql)
    if not tables:
        raise ValueError("the query reads no table")
    group, late = f"guarded-{uuid.uuid4().hex}", threading.Event()
    sc = spark.sparkContext

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    clock = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "guarded query", interruptOnCancel=True)
    clock.start()
    try:
        rows = guarded_sql(spark, sql, most).collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the query took over {seconds:g} s; filter more or aggregate") from e
        raise
    finally:
        clock.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    cut = len(rows) > most
    return {"tables": tables, "rows": rows[:most], "truncated": cut, "notice": f"cut at {most} rows" if cut else None if rows else "no rows: check the filter"}
