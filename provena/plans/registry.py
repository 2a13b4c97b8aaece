"""Where the queries of the reference's operators are registered: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df
