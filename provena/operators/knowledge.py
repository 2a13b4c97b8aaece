"""Companies of all datasets and documents, and their knowledge graphs as node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE = ["company", "id", "kind", "label", "parent", "reference"]


def company_list(names: DataFrame, documents: DataFrame) -> DataFrame:
    """``names(company, dataset, place, name, by_company)`` and ``documents(company, name)`` to one row per company.

    Datasets by company and documents make companies; datasets by asset only add to those.  The name is the
    documents' else the first dataset's (by ``place``); ``weight`` counts datasets, and one for any document.
    """
    d = documents.where(F.col("company").isNotNull()).groupBy("company").agg(F.min("name").alias("_doc"), F.count("*").alias("documents"))
    n = names.where(F.col("company").isNotNull()).groupBy("company").agg(
        F.min_by("name", F.struct((~F.col("by_company")).alias("b"), "place", "name")).alias("_legal"), F.count_distinct("dataset").alias("datasets"), F.bool_or("by_company").alias("_own")
    )
    j = n.join(d, "company", "full").where(F.col("_own") | F.col("_doc").isNotNull() | F.col("documents").isNotNull())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    j = j.select("company", F.coalesce("_doc", "_legal", "company").alias("name"), "_legal", zero("datasets"), zero("documents"))
    return j.withColumn("legal_name", F.when(F.col("_legal") != F.col("name"), F.col("_legal"))).withColumn("weight", F.col("datasets") + (F.col("documents") > 0).cast("int")).drop("_legal")


def preferred_slice(df: DataFrame, keys: list[str], column: str, preferred: list[str]) -> DataFrame:
    """Each key's rows with a preferred value if it has any, else all of them."""
    w = Window.partitionBy(*keys)
    hit = F.coalesce(F.col(column).isin(preferred), F.lit(False))
    return df.withColumn("_any", F.max(hit).over(w)).where(hit | ~F.col("_any")).drop("_any")


def numbered_documents(documents: DataFrame) -> DataFrame:
    """``documents(company, area, type, year, title, file)`` with ``source`` D1, D2, ... in the order of the graph.

    The newest come first (ties: title, file); areas stand in the order of their first document, types likewise within them.
    """
    order = lambda *c: Window.partitionBy("company").orderBy(*c)
    d = documents.withColumn("_p", F.row_number().over(order(F.desc("year"), "title", "file")))
    d = d.withColumn("_a", F.min("_p").over(Window.partitionBy("company", "area"))).withColumn("_t", F.min("_p").over(Window.partitionBy("company", "area", "type")))
    return d.withColumn("source", F.concat(F.lit("D"), F.row_number().over(order("_a", "_t", "_p")).cast("string"))).drop("_p", "_a", "_t")


def numbered_datasets(points: DataFrame) -> DataFrame:
    """``points(company, dataset, place, ...)`` with ``source`` B1, B2, ... by place within the company."""
    rank = F.dense_rank().over(Window.partitionBy("company").orderBy("place", "dataset"))
    return points.withColumn("source", F.concat(F.lit("B"), rank.cast("string")))


def nodes(companies: DataFrame, points: DataFrame, documents: DataFrame) -> DataFrame:
    """All nodes ``(company, id, kind, label, parent, reference)`` of all companies' graphs.

    ``points(company, dataset, place, measure, period, value)``: a category and a reference per dataset, an indicator per
    measure with any value.  Documents: a category per area, a group per type, a reference per document.
    """
    root = F.concat(F.lit("empresa:"), F.col("company").cast("string"))
    p, d = numbered_datasets(points), numbered_documents(documents)
    cat = F.concat(root, F.lit("/"), "dataset")
    area = F.concat(root, F.lit("/docs-"), "area")
    group = F.concat(area, F.lit("/"), "type")
    source = F.concat(F.lit("fonte:"), "source")
    none = F.lit(None).cast("string")
    row = lambda df, *c: df.select("company", *[x.cast("string").alias(n) for x, n in zip(c, NODE[1:], strict=True)])
    sets = p.select("company", "dataset", "source").distinct()
    kinds = p.where(F.col("value").isNotNull()).select("company", "dataset", "measure", "source").distinct()
    areas, groups = d.select("company", "area").distinct(), d.select("company", "area", "type").distinct()
    parts = [
        row(companies, root, F.lit("empresa"), F.col("name"), none, none),
        row(sets, cat, F.lit("categoria"), F.col("dataset"), root, F.col("source")),
        row(sets, source, F.lit("referencia"), F.col("dataset"), cat, F.col("source")),
        row(kinds, F.concat(cat, F.lit("/"), "measure"), F.lit("indicador"), F.col("measure"), cat, F.col("source")),
        row(areas, area, F.lit("categoria"), F.col("area"), root, none),
        row(groups, group, F.lit("grupo"), F.col("type"), area, none),
        row(d, source, F.lit("referencia"), F.col("title"), group, F.col("source")),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(all_nodes: DataFrame) -> DataFrame:
    """``(company, origin, target, kind)``: contains from parent to child, source from an indicator to its reference."""
    held = all_nodes.where("parent is not null").select("company", F.col("parent").alias("origin"), F.col("id").alias("target"), F.lit("contem").alias("kind"))
    cited = all_nodes.where("kind = 'indicador'").select("company", F.col("id").alias("origin"), F.concat(F.lit("fonte:"), "reference").alias("target"), F.lit("fonte").alias("kind"))
    return held.unionByName(cited)
