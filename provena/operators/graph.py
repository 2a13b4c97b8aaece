"""Trees and graphs: depths, paths, levels, cycles, cloned trees.

Paths are followed by pointer doubling: after k rounds a node points 2^k steps up and carries an aggregate of what it has
passed, so a path of 10,000 nodes takes 14 joins.  A tree has one row a node; rows without a node are left out; a parent
that is no row is an end.  A cycle is an error here: cut it with ``without_cycles`` first.  The driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.kept import kept


def _doubled(state: DataFrame, merge: dict[str, Column], below: dict[str, Column] | None = None) -> Iterator[DataFrame]:
    """States ``(n, p, ...)``: the first as given, then after each doubling, until nobody points on.

    ``merge`` has the new value of each carried column from its own and its ``_up`` value, that of the node pointed at.
    ``below`` has, for columns that collect from below, the aggregate over the nodes that point here; it is added.
    """
    now, rounds = kept(state), 0
    limit = now.count().bit_length() + 1
    carried = [c for c in now.columns if c not in ("n", "p")]
    while True:
        yield now
        active = now.where("p is not null")
        if active.isEmpty():
            return
        if rounds > limit:
            raise ValueError("the tree has a cycle")
        up = now.select(F.col("n").alias("p"), F.col("p").alias("_next"), *[F.col(c).alias(f"{c}_up") for c in carried])
        moved = active.join(up, "p", "left").select("n", F.col("_next").alias("p"), *[(F.when(F.col(f"{c}_up").isNull(), F.col(c)).otherwise(merge[c]) if c in merge else F.col(c)).alias(c) for c in carried])
        nxt = moved.unionByName(now.where("p is null"))
        if below:
            got = active.groupBy(F.col("p").alias("n")).agg(*[x.alias(f"{c}_more") for c, x in below.items()])
            nxt = nxt.join(got, "n", "left").select("n", "p", *[(F.col(c) + F.coalesce(f"{c}_more", F.lit(0)) if c in below else F.col(c)).alias(c) for c in carried])
        now, rounds = kept(nxt), rounds + 1


def _state(tree: DataFrame, node: str, parent: str, **carried: Column) -> DataFrame:
    return tree.where(F.col(node).isNotNull()).select(F.col(node).alias("n"), F.col(parent).alias("p"), *[c.alias(name) for name, c in carried.items()])


def _last(states: Iterator[DataFrame]) -> DataFrame:
    *_, out = states
    return out


def ancestors(tree: DataFrame, node: str = "node", parent: str = "parent", most: int | None = None) -> DataFrame:
    """``(node, ancestor, distance)``: all pairs, so as many rows as paths are long; a path longer than ``most`` steps is an error."""
    pairs, reach = None, 1
    for s in _doubled(_state(tree, node, parent), {}):
        if most is not None and reach > most and not s.where("p is not null").isEmpty():
            raise ValueError(f"a path is longer than {most} steps")
        step = s.where("p is not null").select(F.col("n").alias("node"), F.col("p").alias("ancestor"), F.lit(reach).alias("distance"))
        if pairs is None:
            pairs = step
        else:  # pairs go up to reach - 1 steps; a step of reach and a pair go up to 2 * reach - 1
            on = pairs.select(F.col("node").alias("_n"), F.col("ancestor").alias("_a"), F.col("distance").alias("_d"))
            far = step.join(on, F.col("ancestor") == F.col("_n")).select("node", F.col("_a").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance"))
            pairs = kept(pairs.unionByName(step).unionByName(far))
        reach *= 2
    if most is not None and not pairs.where(F.col("distance") > most).isEmpty():
        raise ValueError(f"a path is longer than {most} steps")
    return pairs


def depths(tree: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """``(node, depth, descendants)``; roots have depth 0."""
    step = F.when(F.col(parent).isNotNull(), 1).otherwise(0)
    s = _state(tree, node, parent, depth=step, size=F.lit(1).cast("long"))
    out = _last(_doubled(s, {"depth": F.col("depth") + F.col("depth_up")}, {"size": F.sum("size")}))
    return out.select(F.col("n").alias("node"), "depth", (F.col("size") - 1).alias("descendants"))


def _marked(tree: DataFrame, start: DataFrame, node: str, parent: str, down: bool) -> DataFrame:
    """The nodes ``start(n)`` and all that lie above, or below, them: the pointers of every reach are taken once, the longest first."""
    levels = [*_doubled(_state(tree, node, parent), {})]
    mark = start.select("n").distinct()
    for s in reversed(levels):
        s = s.where("p is not null")
        more = s.join(mark.select(F.col("n").alias("p")), "p", "left_semi").select("n") if down else s.join(mark, "n", "left_semi").select(F.col("p").alias("n"))
        mark = kept(mark.unionByName(more).distinct())
    return mark


def path(tree: DataFrame, target, node: str = "node", parent: str = "parent") -> DataFrame:
    """The rows of the target and of its ancestors."""
    on = _marked(tree, tree.where(F.col(node) == target).select(F.col(node).alias("n")), node, parent, False)
    return tree.join(on.select(F.col("n").alias(node)), node, "left_semi").select(*tree.columns)


def subtree(tree: DataFrame, target, node: str = "node", parent: str = "parent") -> DataFrame:
    """The rows of the target and of all below it."""
    on = _marked(tree, tree.where(F.col(node) == target).select(F.col(node).alias("n")), node, parent, True)
    return tree.join(on.select(F.col("n").alias(node)), node, "left_semi").select(*tree.columns)


def path_with_siblings(tree: DataFrame, target, node: str = "node", parent: str = "parent") -> DataFrame:
    """The target, its ancestors and the siblings of all of them; cycles are cut first."""
    cut = kept(without_cycles(tree, node, parent))
    parents = path(cut, target, node, parent).select(F.col(parent).alias("_par")).distinct()
    return cut.join(parents, F.col(parent).eqNullSafe(F.col("_par")), "left_semi")


def up_to_level_of(tree: DataFrame, target, node: str = "node", parent: str = "parent") -> DataFrame:
    """All nodes no deeper than the target."""
    d = depths(tree, node, parent).select(F.col("node").alias(node), "depth")
    limit = d.where(F.col(node) == target).select(F.col("depth").alias("_d"))
    return tree.join(d, node).join(F.broadcast(limit)).where("depth <= _d").drop("_d")  # one row


def split_at_level(tree: DataFrame, target, root, node: str = "node", parent: str = "parent") -> DataFrame:
    """Nodes at the target's level or deeper; that level hangs on the root."""
    d = depths(tree, node, parent).select(F.col("node").alias(node), "depth")
    limit = d.where(F.col(node) == target).select(F.col("depth").alias("_d"))
    j = tree.join(d, node).join(F.broadcast(limit)).where("depth >= _d")  # one row
    return j.withColumn(parent, F.when(F.col("depth") == F.col("_d"), F.lit(root)).otherwise(F.col(parent))).drop("depth", "_d")


def without_cycles(tree: DataFrame, node: str = "node", parent: str = "parent", order: str = "node", rounds: int = 40) -> DataFrame:
    """The parent link of each cycle's first node (by ``order``) is cut.

    Pointer doubling carries the least order value seen on the way; a node whose way never
    ends lies on or leads into a cycle, and the node that is its own minimum there is cut.
    """
    base = tree.select(F.col(node).alias("n"), F.col(parent).alias("p"))
    on = base.join(base.select(F.col("n").alias("p")).distinct(), "p")
    size = 1
    total = base.count()
    j = on.select("n", "p").withColumn("low", F.col("p"))
    while size < total and not j.isEmpty():
        nxt = j.select(F.col("n").alias("p"), F.col("p").alias("p2"), F.col("low").alias("low2"))
        j = j.join(nxt, "p").select("n", F.col("p2").alias("p"), F.least("low", "low2").alias("low"))
        j = kept(j)
        size *= 2
    # what still has a way after more steps than nodes leads into a cycle; the least node of that cycle closes it
    cut = j.select(F.col("low").alias(node)).distinct()
    ends = j.select(F.col("p").alias("n")).distinct().join(j, "n").select(F.col("low").alias(node)).distinct()
    first = cut.join(ends, node, "left_semi").withColumn("_cut", F.lit(True))
    return tree.join(first, node, "left").withColumn(parent, F.when(F.col("_cut").isNull(), F.col(parent))).drop("_cut").select(*tree.columns)


def later_than_parents(tree: DataFrame, millis: str, node: str = "node", parent: str = "parent") -> DataFrame:
    """Every child at least 1 ms after its parent, cascading: the maximum over the path of t + distance.  An unknown time counts as none, and takes its parent's."""
    s = _state(tree, node, parent, at=F.col(millis), reach=F.lit(1).cast("long"))
    own, up = F.col("at"), F.col("at_up") + F.col("reach")
    known = F.when(F.col("reach_up").isNotNull(), F.greatest(own, up))
    # a null own time must not hide what comes from above, nor the other way round
    out = _last(_doubled(s.withColumn("at", F.coalesce("at", F.lit(-(1 << 62)))), {"at": known, "reach": F.col("reach") + F.col("reach_up")}))
    at = out.select(F.col("n").alias(node), F.when(F.col("at") > -(1 << 61), F.col("at")).alias("_at"))
    return tree.join(at, node, "left").withColumn(millis, F.coalesce("_at", millis)).drop("_at").select(*tree.columns)


def nearest_valid_parent(tree: DataFrame, skip: Column, node: str = "node", parent: str = "parent") -> DataFrame:
    """Nodes that are not skipped, hung on their nearest ancestor that is not skipped; null where there is none."""
    marked = tree.withColumn("__skip", F.coalesce(skip, F.lit(False)))
    skipped = marked.where("__skip").select(F.col(node).alias("__s"), F.col(parent).alias("__t"))
    # only links between skipped nodes are doubled; where such a run ends is the first node above it that stays, or nothing
    end = skipped.join(skipped.select(F.col("__s").alias("__t"), F.lit(True).alias("__more")), "__t", "left")
    s = end.select(F.col("__s").alias("n"), F.when(F.col("__more"), F.col("__t")).alias("p"), F.when(F.col("__more").isNull(), F.struct(F.col("__t").alias("to"))).alias("end"))
    last = _last(_doubled(s, {"end": F.coalesce("end", "end_up")})).select(F.col("n").alias("__s"), F.col("end.to").alias("__to"))
    ok = marked.where("not __skip").drop("__skip")
    j = ok.join(last.withColumn("__in", F.lit(True)), F.col(parent) == F.col("__s"), "left").withColumn("__p", F.when(F.col("__in"), F.col("__to")).otherwise(F.col(parent)))
    real = ok.select(F.col(node).alias("__r")).distinct()
    return j.join(real, F.col("__p") == F.col("__r"), "left").withColumn(parent, F.col("__r")).select(*tree.columns)


def rekeyed(tree: DataFrame, salt: str, node: str = "node", parent: str = "parent") -> DataFrame:
    """A clone with new ids; parents outside the clone become null."""
    new = lambda c: F.sha2(F.concat(F.lit(salt), F.lit("|"), F.col(c).cast("string")), 256)
    inside = tree.select(F.col(node).alias("_in")).distinct()
    j = tree.join(inside, F.col(parent) == F.col("_in"), "left")
    return j.withColumn(parent, F.when(F.col("_in").isNotNull(), new(parent))).withColumn(node, new(node)).drop("_in").select(*tree.columns)


def relations(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Edges (a, b) that are not parent links, in both directions."""
    link = tree.where("parent is not null").select(F.col("node").alias("a"), F.col("parent").alias("b"))
    both = link.unionByName(link.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = edges.select("a", "b").join(both, ["a", "b"], "left_anti")
    return rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
