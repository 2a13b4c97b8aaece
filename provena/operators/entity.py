"""Resolving free terms to entities: a ladder of steps from exact aliases to similar names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions.norm import digits, fold
from provena.operators.kept import kept
from provena.operators.names import all_inside, nearest_names

CODE_DIGITS, FULL_ID, ALIAS_LETTERS = 4, 14, 4


def _words(c: Column) -> Column:
    """Folded words of two letters or more."""
    return F.array_distinct(F.filter(F.split(fold(c), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1))


def resolve(terms: DataFrame, aliases: DataFrame, agents: DataFrame | None = None, fuzzy: int = 3, least: float = 0.0, most: int | None = 8) -> DataFrame:
    """``(term, id, stage, similarity, how)`` of a stated set ``terms(term)`` against ``aliases(id, alias, code)``.

    Steps, each hit of an id counting at its first: 1 the folded alias; 2 at least four digits of the term inside the
    code, or the code without leading zeros; 3 all words of the term inside the entity's aliases.  These always run.
    Only where nothing was found so far: a full id in the wider registry ``agents(id, name, acronym, distributes)``
    (stage 2, before 3); 4 its acronym or whole name; 5 all words as whole words in its names, distributors and short
    names first; 6 an alias of four letters or more inside the term as a whole phrase, holdings (``aliases.holding``)
    last, then the longest; 7 the ``fuzzy`` most similar names over all aliases of an entity, which is never a sure hit.
    At most ``most`` hits a term, all with None; ``fuzzy`` 0 leaves out step 7.  Ties by id.  Digits of a term whose
    ``terms.coded`` is false aren't looked for in codes.  Empty terms and null aliases or ids find nothing.
    """
    coded = F.coalesce(F.col("coded"), F.lit(True)) if "coded" in terms.columns else F.lit(True)
    holding = F.coalesce(F.col("holding"), F.lit(False)) if "holding" in aliases.columns else F.lit(False)
    t = terms.where(F.length(F.trim("term")) > 0).groupBy("term").agg(F.max(coded).alias("_k")).select("term", "_k", fold(F.trim("term")).alias("_t"), digits("term").alias("_d"), _words(F.col("term")).alias("_w"))
    a = aliases.where("id is not null").select("id", fold("alias").alias("_a"), digits("code").alias("_c"), holding.alias("_h")).distinct()
    whole = a.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("_a")), " ").alias("name"))
    hit = lambda df, n, how, order=F.lit(0): df.select("term", "id", F.lit(n).alias("stage"), F.lit(1.0).alias("similarity"), F.lit(how).alias("how"), order.cast("long").alias("_o"))
    without = lambda left, found: left.join(found.select("term").distinct(), "term", "left_anti")

    exact = hit(t.join(a, t["_t"] == a["_a"]).distinct(), 1, "alias")
    inside = all_inside(a.select(F.col("id").alias("key"), F.col("_c").alias("text")), t.where(F.col("_k") & (F.length("_d") >= CODE_DIGITS)).select(F.col("term").alias("group"), F.array("_d").alias("patterns")), False)
    same = t.where(F.col("_k") & (F.length("_d") > 0)).withColumn("_n", F.ltrim("_d", F.lit("0"))).join(a.withColumn("_n", F.ltrim("_c", F.lit("0"))), "_n").where("_n <> ''")
    code = hit(inside.select(F.col("group").alias("term"), F.col("key").alias("id")).unionByName(same.select("term", "id")).distinct(), 2, "code")
    found = exact.unionByName(code)
    if agents is not None:
        g = agents.where("id is not null").select("id", F.coalesce("distributes", F.lit(False)).alias("_p"), fold("name").alias("_n"), fold("acronym").alias("_s"), digits("id").alias("_g")).distinct()
        full = t.where(F.length("_d") == FULL_ID)
        found = found.unionByName(hit(without(full, found).join(g, F.col("_d") == F.col("_g")).select("term", "id").distinct(), 2, "id outside the registry"))
    words = all_inside(whole.select(F.col("id").alias("key"), F.col("name").alias("text")), t.select(F.col("term").alias("group"), F.col("_w").alias("patterns")), False)
    words = words.select(F.col("group").alias("term"), F.col("key").alias("id")).join(whole, "id")
    found = kept(found.unionByName(hit(words, 3, "all words", F.length("name"))))
    if agents is not None:
        rest = without(t, found)
        named = rest.join(g, rest["_t"] == g["_s"]).select("term", "id").unionByName(rest.join(g, rest["_t"] == g["_n"]).select("term", "id"))
        found = found.unionByName(hit(named.distinct(), 4, "acronym or name outside the registry"))
        rest = without(t, found)
        wide = all_inside(g.select(F.col("id").alias("key"), F.col("_n").alias("text")), rest.select(F.col("term").alias("group"), F.col("_w").alias("patterns")), True)
        size = g.groupBy("id").agg(F.min(F.when(F.col("_p"), 0).otherwise(1_000_000) + F.length("_n")).alias("_z"))
        found = found.unionByName(hit(wide.select(F.col("group").alias("term"), F.col("key").alias("id")).distinct().join(size, "id"), 5, "whole words outside the registry", F.col("_z")))
    found = kept(found) if agents is not None else found
    rest = without(t, found)
    phrase = all_inside(rest.select(F.col("term").alias("key"), F.col("_t").alias("text")), a.where(F.length("_a") >= ALIAS_LETTERS).select(F.col("_a").alias("group"), F.array("_a").alias("patterns")), True)
    named = phrase.select(F.col("key").alias("term"), F.col("group").alias("_a")).join(a, "_a").groupBy("term", "id").agg(F.min(F.when(F.col("_h"), 1_000_000).otherwise(0) - F.length("_a")).alias("_z"))
    found = kept(found.unionByName(hit(named, 6, "alias inside the term", F.col("_z"))))
    if fuzzy:
        rest = without(t, found)
        near = nearest_names(rest.select(F.col("_t").alias("term")), whole, fuzzy).where(F.col("similarity") >= least).withColumnRenamed("term", "_t")
        found = found.unionByName(rest.select("term", "_t").join(near, "_t").select("term", "id", F.lit(7).alias("stage"), "similarity", F.lit("similar name, not confirmed").alias("how"), F.lit(0).cast("long").alias("_o")))
    one = Window.partitionBy("term", "id").orderBy("stage", "_o", "how")
    order = Window.partitionBy("term").orderBy("stage", "_o", F.desc("similarity"), "id")
    both = found.withColumn("_rn", F.row_number().over(one)).where("_rn = 1")
    if most is not None:
        both = both.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most)
    return both.drop("_rn", "_o")


def warnings(resolved: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Per term: number of hits, a warning where that is not one sure hit, and the companies of the group where the first hit is a holding.

    ``groups(holding, id)`` names the companies of each holding; a holding found otherwise than exactly lists them, itself left out.
    """
    first = F.min_by("id", F.struct("stage", -F.col("similarity"), "id"))
    g = resolved.groupBy("term").agg(F.count("*").alias("n"), F.min("stage").alias("stage"), first.alias("id"))
    g = g.withColumn("warning", F.when(F.col("stage") == 7, "fuzzy").when((F.col("n") > 1) & (F.col("stage") > 2), "ambiguous"))
    if groups is None:
        return g
    own = groups.where("id <> holding").groupBy(F.col("holding").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("companies"))
    # an exact hit (alias or code, stages 1, 2 and 4) is what was asked for
    return g.join(own, "id", "left").withColumn("companies", F.when(~F.col("stage").isin(1, 2, 4), F.col("companies")))
