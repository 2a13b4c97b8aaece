"""From ranked pages to the excerpts worth showing: candidate pages, best chunk, best sentence, one event a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.operators.kept import kept

from .temporal import top_n


def contextual(chunks: DataFrame, documents: DataFrame, key: str, text: str = "chunk") -> DataFrame:
    """Adds ``contextual``: "company year, title. chunk"; missing parts are left out."""
    head = F.concat_ws(", ", F.nullif(F.concat_ws(" ", "company", F.col("year").cast("string")), F.lit("")), "title")
    d = documents.select(key, head.alias("_head"))
    return chunks.join(d, key, "left").withColumn("contextual", F.concat_ws(". ", F.nullif("_head", F.lit("")), text)).drop("_head")


def candidate_pages(lists: list[DataFrame], keys: list[str], page: str, depth: int = 12, take: int = 6, constant: int = 60) -> DataFrame:
    """The first ``take`` pages of every list, so that a list adds pages and removes none, in the order of their fused ranks.

    Lists hold ``(keys, page, pos)`` with pos from 1; the fusion reads ``depth`` places of each.  Adds ``fused`` and
    ``place``; ties go to the smaller page.
    """
    u = lists[0].select(*keys, page, "pos")
    for other in lists[1:]:
        u = u.unionByName(other.select(*keys, page, "pos"))
    g = u.where(F.col("pos") <= depth).groupBy(*keys, page).agg(F.sum(1.0 / (constant + F.col("pos"))).alias("fused"), F.min("pos").alias("_best"))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("fused", 12)), page)
    return g.where(F.col("_best") <= take).drop("_best").withColumn("place", F.row_number().over(w))


def best_chunks(scored: DataFrame, chosen: DataFrame, keys: list[str], score: str, text: str, methods: dict[str, DataFrame]) -> DataFrame:
    """The chosen pages with their best chunk (ties: smaller text) and, for every method, whether it found the page."""
    best = scored.join(chosen.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(text).alias("t"))).alias("m"))
    out = chosen.join(best.select(*keys, (-F.col("m.s")).alias(score), F.col("m.t").alias(text)), keys, "left")
    for name, found in methods.items():
        flag = found.select(*keys).distinct().withColumn(name, F.lit(True))
        out = out.join(flag, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def best_excerpts(sentences: DataFrame, candidates: DataFrame, keys: list[str], page: str, least: float = 7.0) -> DataFrame:
    """Per keys the sentence with the most points: its score, if that is ``least`` or more, and 1 / place of its page.

    Ties go to the earlier page, then to the smaller sentence.
    """
    j = sentences.where(F.col("score") >= least).join(candidates.select(*keys, page, "place"), [*keys, page])
    j = j.withColumn("points", F.col("score") + 1.0 / F.col("place"))
    return top_n(j, keys, [F.desc(F.round("points", 9)), F.asc("place"), F.asc("sentence")])


def excerpt_events(excerpts: DataFrame, year: str, theme: str, file: str, page: str) -> DataFrame:
    """The best excerpt of every year and theme; a sentence that is the best of several themes is one event with all of them."""
    best = top_n(excerpts, [year, theme], [F.desc(F.round("points", 9)), F.asc(file), F.asc(page), F.asc("sentence")])
    g = best.groupBy(file, page, "sentence").agg(F.array_sort(F.collect_set(theme)).alias("themes"), F.max(F.struct("points", F.col(year).alias("year"))).alias("m"))
    return g.select(F.col("m.year").alias("year"), file, page, "sentence", "themes", F.col("m.points").alias("points"))


def listed(documents: DataFrame, keys: list[str], newest: str, ident: str, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """(documents counted by all keys, the newest ``n``)."""
    return documents.groupBy(*keys).agg(F.count("*").alias("n")), documents.orderBy(F.desc_nulls_last(newest), ident).limit(n)


def pages_read(asked: DataFrame, documents: DataFrame, pages: DataFrame, most: int = 12_000) -> DataFrame:
    """``asked(file, page)`` with the document's ``title`` and number of ``pages``, the page's ``text`` (its first ``most`` characters) or an ``error``."""
    d = documents.select("file", "title", F.col("pages").alias("total_pages"), F.lit(True).alias("_known"))
    j = asked.join(d, "file", "left").join(pages.select("file", "page", F.substring("text", 1, most).alias("text"), F.lit(True).alias("_there")), ["file", "page"], "left")
    wrong = F.when(F.col("_known").isNull(), F.concat(F.lit("no file "), F.coalesce("file", F.lit("?")))).when(F.col("_there").isNull(), F.concat(F.lit("the document has "), F.col("total_pages").cast("string"), F.lit(" pages")))
    return j.select("file", "page", "title", "total_pages", "text", wrong.alias("error"))


def numbered(documents: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Rows with dense numbers from 0 in the order of the columns (null first): ranges are numbered in their tasks and moved on by the sizes of the ranges before."""
    sort = [F.col(c).asc_nulls_first() for c in order]
    ranged = kept(documents.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
    return ranged.join(before, "_part").withColumn(name, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def with_metadata(files: DataFrame, metadata: DataFrame, path: str = "path") -> DataFrame:
    """Files with their metadata and the area (first path segment); a file without metadata is an error when it is read."""
    j = files.join(metadata.withColumn("_known", F.lit(True)), path, "left")
    failed: Column = F.raise_error(F.concat(F.lit("no metadata: "), F.col(path))).cast("string")
    return j.withColumn("area", F.when(F.col("_known"), F.split(path, "/")[0]).otherwise(failed)).drop("_known")


def merged_groups(groups: dict[str, DataFrame | None], columns: list[str]) -> DataFrame:
    """Outputs of parallel groups as one table of fixed columns; a missing group is an error."""
    gone = [name for name, df in groups.items() if df is None]
    if gone or not groups:
        raise ValueError(f"missing groups: {', '.join(gone) or 'all'}")
    parts = [df.select(*columns, F.lit(name).alias("group")) for name, df in groups.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relocation(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Where each ``manifest(area, company, year, name)`` file belongs and is: keep, move, missing, or ambiguous for names listed twice."""
    base = F.element_at(F.split("path", "/"), -1)
    found = listing.groupBy(base.alias("name")).agg(F.count("*").alias("_n"), F.min("path").alias("found"))
    want = F.concat_ws("/", "area", "company", F.col("year").cast("string"), "name")
    j = manifest.withColumn("expected", want).join(found, "name", "left")
    action = F.when(F.col("found").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").when(F.col("found") == F.col("expected"), "keep").otherwise("move")
    return j.withColumn("action", action).drop("_n")
