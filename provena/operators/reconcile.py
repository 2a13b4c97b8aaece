"""Comparing, appending, replacing and paging tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key ``old`` lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def replace_by_key(old: DataFrame, new: DataFrame, read_now: DataFrame, key: str) -> DataFrame:
    """Everything read now is replaced; a key that was read and gave nothing ends empty."""
    return old.join(read_now.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def agreement(left: DataFrame, right: DataFrame, keys: list[str], value: str, group: list[str], tolerance: float = 1.0) -> DataFrame:
    """Per group: rows on both sides and how many agree within the tolerance."""
    j = left.select(*keys, F.col(value).alias("_a")).join(right.select(*keys, F.col(value).alias("_b")), keys)
    return j.groupBy(*group).agg(F.count("*").alias("both"), F.count_if(F.abs(F.col("_a") - F.col("_b")) < tolerance).alias("equal"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], value: str, version: str | None = None, tolerance: float = 1.0, n: int = 10, digits: int = 2) -> tuple[DataFrame, DataFrame]:
    """(the ``n`` rows of both sides that differ most, with both values; per key of both sides whether it agrees and has the same version).

    A key with a null is on one side only.  Ties by key, where differences are equal after rounding to ``digits``.
    """
    extra = [version] if version else []
    a = left.select(*keys, F.col(value).alias("left_value"), *[F.col(c).alias("left_version") for c in extra])
    b = right.select(*keys, F.col(value).alias("right_value"), *[F.col(c).alias("right_version") for c in extra])
    j = a.join(b, keys).withColumn("agrees", F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) < tolerance, F.lit(False)))
    if version:
        j = j.withColumn("same_version", F.col("left_version").eqNullSafe(F.col("right_version")))
    worst = j.where("not agrees").orderBy(F.desc_nulls_first(F.round(F.abs(F.col("left_value") - F.col("right_value")), digits)), *keys).limit(n)
    return worst, j


def out_of_bounds(chunks: DataFrame, documents: DataFrame, key: str = "file", page: str = "page", pages: str = "pages") -> DataFrame:
    """Chunks whose document is unknown or whose page isn't one of its pages."""
    d = documents.select(F.col(key), F.col(pages).alias("_pages"))
    j = chunks.join(d, key, "left")
    return j.where(F.col("_pages").isNull() | F.col(page).isNull() | (F.col(page) < 1) | (F.col(page) > F.col("_pages"))).drop("_pages")


def refreshed(done: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, with the wanted side's metadata and what else is known of them; rows still to make)."""
    known = [c for c in done.columns if c not in wanted.columns]
    rest = done.select(*keys, *known).dropDuplicates(keys).withColumn("_d", F.lit(True))
    j = wanted.join(rest, keys, "left")
    return j.where("_d").drop("_d"), j.where("_d is null").select(*wanted.columns)


def with_flag(df: DataFrame, others: DataFrame, key: str, name: str) -> DataFrame:
    """A boolean column: is the key among the others."""
    return df.join(others.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def refresh_plan(done: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys + action: keep, pending (wanted only) or stale (done only)."""
    d, w = done.select(*keys).distinct().withColumn("_d", F.lit(True)), wanted.select(*keys).distinct().withColumn("_w", F.lit(True))
    return d.join(w, keys, "full").select(*keys, F.when(F.col("_d") & F.col("_w"), "keep").when(F.col("_w"), "pending").otherwise("stale").alias("action"))


def match_listing(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows with the listed path: by path, else by a file name that is unique and not claimed by another row."""
    base = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    l = listing.select(F.col("path").alias("found"))
    by_path = manifest.join(l, manifest["path"] == l["found"], "left")
    hit = by_path.where("found is not null").withColumn("how", F.lit("path"))
    free = l.join(hit.select("found"), "found", "left_anti").withColumn("name", base("found")).withColumn("_n", F.count("*").over(Window.partitionBy("name"))).where("_n = 1").drop("_n")
    rest = by_path.where("found is null").drop("found").withColumn("name", base("path")).withColumn("_m", F.count("*").over(Window.partitionBy("name")))
    moved = rest.join(free, "name", "left").withColumn("found", F.when(F.col("_m") == 1, F.col("found"))).drop("name", "_m")
    return hit.unionByName(moved.withColumn("how", F.when(F.col("found").isNull(), "missing").otherwise("name")))


def exact_copies(files: DataFrame, size: str, content: str, preference: list[Column]) -> DataFrame:
    """The preferred row of each group of equal contents; only files that share a size are hashed."""
    d = files.withColumn("_same", F.count("*").over(Window.partitionBy(size)))
    unique = d.where("_same = 1").drop("_same")
    w = Window.partitionBy(size, "_h").orderBy(*preference)
    kept = d.where("_same > 1").withColumn("_h", F.md5(content)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_same", "_h", "_rn")
    return unique.unionByName(kept)


def reuse(new: DataFrame, old: DataFrame, keys: list[str], column: str, model: str | None = None) -> DataFrame:
    """The old value where all keys are equal, else null; keys go by hash and equality.  ``model`` names a column whose old and new values must be the same: vectors of another model are made anew."""
    keys = [*keys, model] if model else keys
    o = old.dropDuplicates(keys).select(*keys, F.col(column))
    return new.drop(column).join(o, keys, "left")


def page(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of the order and whether there are more, by reading one more."""
    more = df.orderBy(*order).limit(n + 1)
    total = more.agg((F.count("*") > n).alias("truncated"))
    return more.orderBy(*order).limit(n).join(F.broadcast(total))  # one row


def keyset_page(df: DataFrame, sort: str, tie: str, n: int, after: tuple | None = None, descending: bool = True) -> DataFrame:
    """A page after a cursor (sort value, tie); rows without a sort value come last; ``cursor`` goes on from a row."""
    s, t = F.col(sort), F.col(tie)
    if after is not None:
        value, at = after
        if value is None:
            df = df.where(s.isNull() & ((t < at) if descending else (t > at)))
        else:
            past = ((s < value) | ((s == value) & (t < at))) if descending else ((s > value) | ((s == value) & (t > at)))
            df = df.where(past | s.isNull())
    order = [s.desc_nulls_last(), t.desc()] if descending else [s.asc_nulls_last(), t.asc()]
    return df.orderBy(*order).limit(n).withColumn("cursor", F.base64(F.encode(F.to_json(F.struct(s.alias("value"), t.alias("tie"))), "UTF-8")))


def relevance(df: DataFrame, fields: list[str], query: str) -> DataFrame:
    """exact 100, prefix 80, contains 50, else 10; the best of the fields."""
    q = query.lower()
    one = lambda c: F.when(F.lower(c) == q, 100).when(F.startswith(F.lower(c), F.lit(q)), 80).when(F.contains(F.lower(c), F.lit(q)), 50).otherwise(10)
    each = [one(F.col(c)) for c in fields]
    return df.withColumn("relevance", F.greatest(*each) if len(each) > 1 else each[0])


def one_per_category(df: DataFrame, category: str, seed: int, skip: int, n: int) -> DataFrame:
    """One row of each category, categories in a seeded order."""
    w = Window.partitionBy(category).orderBy(F.xxhash64(*df.columns, F.lit(seed)))
    one = df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return one.orderBy(F.xxhash64(category, F.lit(seed)), category).offset(skip).limit(n)


def names_and_more(names: Column, n: int) -> Column:
    """'a, b and 3 more' of the distinct names in order."""
    d = F.array_distinct(names)
    head = F.array_join(F.slice(d, 1, n), ", ")
    return F.when(F.size(d) > n, F.concat(head, F.lit(" and "), (F.size(d) - n).cast("string"), F.lit(" more"))).otherwise(head)


def sample(df: DataFrame, n: int, ident: str, groups: tuple[str, ...] = (), seed: str = "0") -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), of each group where groups are named: those of least seeded hash of the id, then of least id.

    The same rows come out however the table is partitioned, and a larger ``n`` only adds rows.  Each task passes on at
    most ``n`` rows a group.  Rows without an id come last.
    """
    order = [F.md5(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string"))).asc_nulls_last(), F.col(ident).asc_nulls_last()]
    if not groups:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
