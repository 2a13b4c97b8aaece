"""Near-duplicate classes by ProbMinHash, banding and exact verification.

1. Every document becomes a weighted set of 5-word shingles (weight
   ``1 + ln(count)``) and a ProbMinHash signature (Ertl, 2020): each shingle
   sends exponential arrivals at a rate of its weight to random registers, and
   a document stops drawing when no arrival can lower a register any more.
   Two registers agree with the probability Jaccard of the weighted sets.
2. Documents with equal word sequences collapse to their smallest id first.
3. ``bands`` keys of ``rows`` registers make buckets.  Each bucket's smallest
   document is paired with every other member (a star); the
   pairs are verified by the exact probability Jaccard of their whole texts.
4. Buckets that hold more than one component by then go on.  A pair's similarity is at most the
   probability mass of its shared shingles in either text, so a pair that reaches the threshold shares a
   shingle of both *prefixes* (each text's rarest shingles, by the number of such members that have them, up
   to the mass 1 - threshold).  Members that share no prefix shingle with any other leave their buckets
   here, without a loss: texts of one template that differ in a fifth of their shingles.
5. Rounds follow until every bucket is resolved: all pairs of its members that share a prefix shingle
   were compared or lie in one component.  In a round up to ``most`` members outside the bucket's
   largest component lead: they are compared with all members of other components and
   leave the bucket.  ``most`` grows eightfold a round, so the rounds are few.
6. Connected components of the verified links are the classes.

At 0.8 and 20 bands of 4 registers a pair shares no bucket with a probability below
3e-5; all that share one are found.  In a bucket of n members of which m lie outside its
largest component that takes up to m * n tests of prefixes.  Words are runs of non-space
characters, A-Z lower-cased.  Texts under 5 words are one shingle.  Null or blank texts are alone
in their class.  Rows that repeat a doc_id share its class; a null doc_id has a null class.  An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, carried, components, join_hot, read, restored, staged, table_input
from .words import U64, Batches, WordHasher, Windows, lower_space_words, mix, per_batch, pressed, released, signed, utf8

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 4
_CHUNK = 400_000  # shingles sketched at a time; bounds memory only
_SHARD = 1_000_000  # shingles whose texts one task counts
_SHARE, _LEADERS = 1_000_000, 256  # shingles of the members and number of leaders that one task compares; larger buckets are dealt to several


def weighted_shingles(words: list[bytes], hasher: WordHasher, windows: Windows, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes and their weights 1 + ln(count)."""
    h = hasher(words)
    grams = windows.all(h, min(k, len(h)))
    grams, count = np.unique(grams, return_counts=True)
    return grams, 1.0 + np.log(count)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def prob_minhash(doc: np.ndarray, gram: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs, m) of the weighted sets given as parallel arrays."""
    low = np.full(n_docs * m, np.inf)
    sig = np.zeros(n_docs * m, U64)
    at = np.zeros(len(gram))
    turn = 0
    while len(gram):
        turn += 1
        r = mix(gram + U64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = at - np.log(_uniform(r)) / weight
        slot = doc * m + (mix(r) % U64(m)).astype(np.int64)
        np.minimum.at(low, slot, at)
        won = at == low[slot]
        sig[slot[won]] = gram[won]
        stay = at < low.reshape(n_docs, m).max(axis=1)[doc]
        doc, gram, weight, at = doc[stay], gram[stay], weight[stay], at[stay]
    return sig.reshape(n_docs, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P = sum over shared i of 1 / sum_j max(x_j/x_i, y_j/y_i)."""
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    above = np.append(np.cumsum(x[::-1])[::-1], 0)  # sum of x from i on
    below = np.append(0, np.cumsum(y))  # sum of y before i
    both = np.flatnonzero((x > 0) & (y > 0))
    first = np.searchsorted(ratio, ratio[both], "left")
    return float(np.sum(1.0 / (above[first] / x[both] + below[first] / y[both])))


def _sketch(bands: int, rows: int):
    hasher, windows = WordHasher(), Windows()
    m = bands * rows
    salt = np.arange(1, bands + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)

    def keys(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        doc = np.repeat(np.arange(len(parts)), [len(g) for g, _ in parts])
        sig = prob_minhash(doc, np.concatenate([g for g, _ in parts]), np.concatenate([w for _, w in parts]), len(parts), m)
        key = np.broadcast_to(salt, (len(parts), bands)).copy()
        for r in range(rows):
            key = mix(key + sig.reshape(len(parts), bands, rows)[:, :, r])
        return key.view(np.int64)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, content, parts, size, out = [], [], [], 0, []
            for doc, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                words = lower_space_words(text)
                if doc is None or not words:
                    continue
                ids.append(doc)
                content.append(xxhash.xxh3_128_digest(b" ".join(words)))
                parts.append(weighted_shingles(words, hasher, windows))
                size += len(parts[-1][0])
                if size > _CHUNK:
                    out.append(keys(parts))
                    parts, size = [], 0
            if parts:
                out.append(keys(parts))
            if ids:
                flat = pa.array(np.concatenate(out).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(content, pa.binary()), lists], names=["doc_id", "content", "bands"])

    return run


def _verify(threshold: float):
    hasher, windows = WordHasher(), Windows()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, last = [], (None, None)
        for a, x, y in zip(batch["a"].to_pylist(), utf8(batch["text_a"]), utf8(batch["text_b"]), strict=True):
            if last[0] != (a, x):
                last = (a, x), weighted_shingles(lower_space_words(x), hasher, windows)
            other = weighted_shingles(lower_space_words(y), hasher, windows)
            small, large = sorted((last[1][1].sum(), other[1].sum()))
            keep.append(bool(large) and probability_jaccard(last[1], other) >= threshold)
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return per_batch(run)


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = staged(docs.join(ids, "doc_id", "left_semi"), "texts")
    return (
        pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        .mapInArrow(_verify(threshold), "a long, b long").distinct()
    )


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each text's sorted shingles and their weights."""
    hasher, windows = WordHasher(), Windows()
    sets = [weighted_shingles(lower_space_words(t), hasher, windows) for t in utf8(batch["text"])]
    grams = pa.array([g.view(np.int64) for g, _ in sets], pa.list_(pa.int64()))
    return pa.record_batch([batch["doc_id"], grams, pa.array([w for _, w in sets], pa.list_(pa.float64()))], names=["node", "grams", "weights"])


def _spread(shards: int):
    """Sets -> each batch's distinct shingles and their counts for the shards (kind 0), and the batch itself for its collector (kind 1)."""

    def run(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            size = pa.compute.list_value_length(batch["grams"]).to_numpy(zero_copy_only=False)
            for lo, hi in _parts(size):
                part = batch.slice(lo, hi - lo)
                gram, weight = (pa.compute.list_flatten(part[c]).to_numpy() for c in ("grams", "weights"))
                own = size[lo:hi]
                total = np.bincount(np.repeat(np.arange(hi - lo), own), weight, hi - lo)
                key, place, n = np.unique(gram.view(U64), return_inverse=True, return_counts=True)
                edge = np.searchsorted(((key >> U64(32)) * U64(shards)) >> U64(32), np.arange(shards + 1))
                rows = [(i, number, 0, key[x:y].tobytes(), pressed(n[x:y].astype(np.uint32)), None, None) for i, (x, y) in enumerate(zip(edge, edge[1:], strict=False)) if y > x]
                whole = (part["node"].to_numpy().tobytes(), own.astype(np.int64).tobytes(), pressed(place.astype(np.uint32)) if len(place) else b"", (weight / np.repeat(total, own)).tobytes())
                yield _packed([*rows, (number % shards, number, 1, *whole)], True)
                number += 1

    return run


def _parts(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of a bounded number of shingles."""
    lo, held = 0, 0
    for i, n in enumerate(size.tolist()):
        held += n
        if held >= _CHUNK:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(size):
        yield lo, len(size)


_FIELDS = [("shard", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcd")]


def _packed(rows: list[tuple], shard: bool = False) -> pa.RecordBatch:
    fields = _FIELDS if shard else _FIELDS[1:]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _frequencies(table: pa.Table) -> pa.Table:
    """One shard: in how many texts each shingle is, sent back to the batches that hold it."""
    rows = [*zip(*(table[c].to_pylist() for c, _ in _FIELDS), strict=True)]
    out, asked = [r[1:] for r in rows if r[2]], [r for r in rows if not r[2]]
    if asked:
        key, at = np.unique(np.concatenate([np.frombuffer(r[3], U64) for r in asked]), return_inverse=True)
        n = np.bincount(at, np.concatenate([released(r[4], np.uint32) for r in asked])).astype(np.uint32)
        lo = 0
        for r in asked:
            hi = lo + len(r[3]) // 8
            out.append((r[1], 0, r[3], pressed(n[at[lo:hi]]), None, None))
            lo = hi
    return pa.Table.from_batches([_packed(out)])


def _prefix(threshold: float):
    """One batch: the prefix shingles of its texts that other texts have too."""

    def run(table: pa.Table) -> pa.Table:
        rows = [*zip(*(table[c].to_pylist() for c, _ in _FIELDS[2:]), strict=True)]
        own = next(r for r in rows if r[0])
        # shards hold ranges of ascending shingles
        parts = sorted((r for r in rows if not r[0]), key=lambda r: int(np.frombuffer(r[1][:8], U64)[0]))
        node, size, mass = np.frombuffer(own[1], np.int64), np.frombuffer(own[2], np.int64), np.frombuffer(own[4], float)
        if not parts:
            return pa.table([pa.array([], pa.int64())] * 2, names=["key", "node"])
        key, n = np.concatenate([np.frombuffer(r[1], U64) for r in parts]), np.concatenate([released(r[2], np.uint32) for r in parts])
        place = released(own[3], np.uint32)
        doc = np.repeat(np.arange(len(node)), size)
        order = np.lexsort((place, n[place], doc))
        upto = np.cumsum(mass[order])
        first = np.append(0, np.cumsum(size))[:-1]
        start = np.where(first > 0, upto[np.maximum(first - 1, 0)], 0.0)
        before = upto - mass[order] - np.repeat(start, size)
        keep = (before <= 1.0 - threshold + 1e-9) & (n[place[order]] > 1)
        return pa.table([signed(key[place[order[keep]]]), pa.array(node[doc[order[keep]]])], names=["key", "node"])

    return run


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``(key, node)``: the prefix shingles of ``sets(node, grams, weights)`` that another text has too."""
    total = sets.agg(F.sum(F.size("grams"))).first()[0] or 0
    shards = max(1, -(-total // _SHARD))
    packed = "batch long, kind int, a binary, b binary, c binary, d binary"
    spread = sets.select("node", "grams", "weights").mapInArrow(_spread(shards), f"shard int, {packed}")
    return spread.groupBy("shard").applyInArrow(_frequencies, packed).groupBy("batch").applyInArrow(_prefix(threshold), "key long, node long")


def _unresolved(member: DataFrame) -> DataFrame:
    """``(key, node, c, n, major, m)`` of the buckets of ``member(key, node, c)`` with over one component c; m of the n members are not in the largest, major."""
    member = staged(member, "labelled")
    each = member.groupBy("key", "c").agg(F.count("*").alias("size"))
    top = each.groupBy("key").agg(F.sum("size").alias("n"), F.max(F.struct("size", "c")).alias("top"))
    top = top.where("n > top.size").select("key", "n", F.col("top.c").alias("major"), (F.col("n") - F.col("top.size")).alias("m"))
    return staged(member.join(top, "key"), "unresolved")


def _compare(threshold: float):
    """The leaders and members of one share of a bucket -> the links between them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lead = table["leads"].to_numpy()
        node, c = table["node"].to_numpy(), table["c"].to_numpy()
        prefix = pa.compute.list_flatten(table["prefix"]).to_numpy()
        start = np.append(0, np.cumsum(pa.compute.list_value_length(table["prefix"]).to_numpy()))
        holder = np.repeat(np.arange(len(node)), np.diff(start))
        size = pa.compute.list_value_length(table["grams"]).to_numpy()
        flat = [pa.compute.list_flatten(table[n]).to_numpy() for n in ("grams", "weights")]
        grams, weights = flat[0].view(U64), flat[1]
        edge = np.append(0, np.cumsum(size))
        text = lambda i: (grams[edge[i] : edge[i + 1]], weights[edge[i] : edge[i + 1]])
        rest = np.flatnonzero(~lead)
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(lead):
            mine = prefix[start[i] : start[i + 1]]
            able = np.zeros(len(node), bool)
            able[holder[mine[np.minimum(np.searchsorted(mine, prefix), len(mine) - 1)] == prefix]] = True
            able = rest[able[rest] & (c[rest] != c[i]) & (node[rest] != node[i])]
            if not len(able):
                continue
            own, own_w = text(i)
            at = np.concatenate([np.arange(edge[j], edge[j + 1]) for j in able])
            which = np.repeat(np.arange(len(able)), size[able])
            x = grams[at]
            place = np.minimum(np.searchsorted(own, x), len(own) - 1)
            hit = own[place] == x
            which_hit, mine, theirs = which[hit], own_w[place[hit]], weights[at[hit]]
            count = lambda v: np.bincount(which_hit, v, len(able))
            mass = np.bincount(which, weights[at], len(able))
            low = np.minimum(mine, theirs)
            equal = mine == theirs
            union = own_w.sum() + mass - count(low)
            # shared shingles of equal weight add their part of the union; any other at most the lesser of its two parts
            most = count(np.where(equal, mine, 0)) / union + count(np.where(equal, 0, np.minimum(mine / own_w.sum(), theirs / mass[which_hit])))
            for j in able[most >= threshold - 1e-9]:
                if probability_jaccard((own, own_w), text(j)) >= threshold:
                    found.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
        a, b = zip(*sorted(set(found)), strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _round(unresolved: DataFrame, sets: DataFrame, most: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between the round's leaders and the members of other components, and the leaders (key, node)."""
    slot = F.when(F.col("m") <= most, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(most)))
    first = unresolved.where("c <> major").groupBy("key", slot.alias("slot")).agg(F.min(F.struct("node", "c", "n", "m")).alias("lead"))
    first = staged(first.select("key", "lead.*"), "leaders")
    # a bucket is dealt to a grid: its members in shares of a bounded number of shingles, its leaders in blocks
    full = unresolved.join(sets, "node")
    total = full.groupBy("key").agg(F.sum(F.size("grams")).alias("total"))
    grid = total.withColumn("shares", F.ceil(F.col("total") / _SHARE) + 1)
    deal = lambda n: F.pmod(F.xxhash64("node"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    blocks = F.ceil(F.least("m", F.lit(most)) / _LEADERS)
    columns = ["key", "share", "block", "node", "c", "leads", "prefix", "grams", "weights"]
    members = full.join(grid, "key").withColumn("share", deal(F.col("shares"))).withColumn("block", each(blocks)).withColumn("leads", F.lit(False))
    leaders = first.join(sets, "node").join(grid, "key").withColumn("block", deal(blocks)).withColumn("share", each(F.col("shares"))).withColumn("leads", F.lit(True))
    both = members.select(columns).unionByName(leaders.select(columns))
    links = both.groupBy("key", "share", "block").applyInArrow(_compare(threshold), "a long, b long").distinct()
    return links, first.select("key", "node")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, class_id)``, one row per row of ``docs``; class_id is the class's smallest doc_id."""
    docs = table_input(docs, "doc_id", "text")
    sketch = staged(docs.mapInArrow(_sketch(bands, rows), "doc_id long, content binary, bands array<long>"), "sketches")
    first = staged(sketch.groupBy("content").agg(F.min(F.struct("doc_id", "bands")).alias("m"), F.count("*").alias("n")).select("content", "m.*", "n"), "distinct")
    bucket = first.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"))
    lead = bucket.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    member = staged(join_hot(bucket, lead, ["key"], first.count() * bands).where("node <> leader"), "members")
    tried = staged(member.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    comp = staged(components(staged(verified(tried, docs, threshold), "links")), "components")

    def labelled(df: DataFrame, column: str, out: str) -> DataFrame:
        c = comp.select(F.col("node").alias(column), F.col("component").alias(out))
        return df.join(c, column, "left").withColumn(out, F.coalesce(out, column))

    open_ = _unresolved(labelled(member.select("key", "node"), "node", "c")).select(F.col("node").alias("doc_id")).distinct()
    sets = staged(docs.join(open_, "doc_id", "left_semi").mapInArrow(per_batch(_sets), "node long, grams array<long>, weights array<double>"), "sets")
    prefix = prefixes(sets, threshold).groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("prefix"))
    sets = staged(sets.join(prefix, "node"), "prefixed")
    left = member.select("key", "node").join(sets.select("node"), "node", "left_semi")
    unresolved, most = _unresolved(labelled(left, "node", "c")), 8
    while not unresolved.isEmpty():
        links, leaders = _round(unresolved, sets, most, threshold)
        links = staged(links, "links")
        if not links.isEmpty():
            comp = staged(components(comp.toDF("a", "b").union(links)), "components")  # the stars so far and what joins them
        rest = unresolved.select("key", "node").join(leaders, ["key", "node"], "left_anti")
        unresolved, most = _unresolved(labelled(rest, "node", "c")), most * 8
    # every document: its content's first document, and that one's component
    rep = join_hot(sketch.select("doc_id", "content"), first.select("content", F.col("doc_id").alias("first"), "n"), ["content"], sketch.count())
    own = labelled(rep, "first", "class_id").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = docs.select("doc_id").join(own, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of every class: that of the smallest doc_id.  Texts are what is classed, so unlike texts that share a doc_id
    are looked at one by one and none is lost with another; of rows alike in doc_id and text one stays.  Rows with a null doc_id all stay.
    """
    rows, h = carried(docs.where("doc_id is not null"), "doc_id", "text"), F.xxhash64("text")
    # doc_ids with unlike texts: all texts but the first get an id of their own
    several = rows.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi")
    several = staged(several.select("doc_id", "lo"), "several")
    alike = several.isEmpty()
    node = F.col("doc_id") if alike else F.when(F.col("lo").isNull() | (h == F.col("lo")), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text"))
    rows = (rows if alike else rows.join(several, "doc_id", "left")).withColumn("node", node).select("node", "doc_id", "text", OWN)
    classes = near_duplicate_classes(rows.select(F.col("node").alias("doc_id"), "text"), **options)
    if alike:
        keep = classes.where("doc_id = class_id").select(F.col("doc_id").alias("node")).distinct()
    else:
        each = rows.select("node", F.col("doc_id").alias("own")).distinct().join(classes.select(F.col("doc_id").alias("node"), "class_id").distinct(), "node")
        keep = each.groupBy("class_id").agg(F.min(F.struct("own", F.col("node") != F.col("own"), "node")).alias("first")).select("first.node")
    kept = rows.join(keep, "node", "left_semi").groupBy("node").agg(F.first(F.struct("doc_id", "text", OWN)).alias("row")).select("row.*")
    return restored(kept, docs, "doc_id", "text").unionByName(docs.where("doc_id is null"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read(spark, sf_dir, "documents"))
