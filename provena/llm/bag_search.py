"""Ranked lexical search by bag deduplication.

Documents are reduced to the vocabulary of the items: what is left of one is its bag, the sorted terms with their
counts.  A score depends on nothing but the bag and the length class ``m``, so documents are dealt by a hash of both,
equal hashes are verified on the bags themselves, and every class is scored once.  Of the classes only the ten best
of an item (by score, then by smallest doc_id) can hold one of its ten best documents, as each class before another
brings at least one document before all of the other's; only they are expanded, their members by ascending doc_id.

Items go out in blocks of about ``block_terms`` (item, term) pairs, a fixed bound (an item is never split): more
items take more passes over the documents, never more memory.  An item's scores are exact 64-bit sums.

Terms are the matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased, in whole texts.  Null
and wordless texts have no terms: such documents don't count and are never found, such items have no rows.  Rows that
share an item_id form one item.  Every document row stands for itself, also where doc_ids repeat; rows without a
doc_id come last among equal scores.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, staged, table_input
from .words import Batches, alnum_words, per_batch, utf8

K1000, B100 = 8, 75  # 1000 * k1 * b terms of the score: m = 100 - 75 + 75 * n * N div L, tf * 10^9 div (1000 * tf + 8 * m)
TOP, BLOCK_TERMS, CELLS, SMALL = 10, 1_000_000, 1 << 22, 64 << 20


def _item_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, terms, counts = [], [], []
    for item, text in zip(batch["item_id"].to_pylist(), utf8(batch["text"]), strict=True):
        for term, n in Counter(alnum_words(text)).items():
            ids.append(item)
            terms.append(term)
            counts.append(n)
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())], names=["item_id", "term", "n"])


def _bags(vocabulary):
    """A document's number of terms and its bag: term numbers, then counts, as little-endian unsigned 32-bit integers."""
    state: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.update({t: i for i, t in enumerate(vocabulary.value)})
        known, sizes, bags = state.keys(), [], []
        for text in utf8(batch["text"]):
            words = alnum_words(text)
            bag = Counter(words)
            sizes.append(len(words))
            found = sorted((state[t], bag[t]) for t in bag.keys() & known)
            bags.append(np.array(found, "<u4").T.tobytes() if found else None)
        return pa.record_batch([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])

    return per_batch(run)


def _document_frequencies(width: int):
    def run(batches: Batches) -> Batches:
        df = np.zeros(width, np.int64)
        for batch in batches:
            for bag in batch["bag"].to_pylist():
                terms = np.frombuffer(bag, "<u4")
                df[terms[: len(terms) // 2]] += 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(df[at])], names=["term", "df"])

    return run


class _Best:
    """The best classes of every item so far: highest score first, then smallest first doc_id, those without one last."""

    def __init__(self, items: int, top: int):
        self.top, self.floor, self.parts, self.size = top, np.ones(items, np.int64), [], 0

    def add(self, scores: np.ndarray, classes: np.ndarray, first: np.ndarray) -> None:
        at, item = np.nonzero(scores >= self.floor)
        self.parts.append((item, scores[at, item], first[at], classes[at]))
        self.size += len(at)
        if self.size > 100_000:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        item, score, first, classes = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((first, -score, item))
        item, score, first, classes = item[order], score[order], first[order], classes[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.top - 1
        self.floor[item[last]] = score[last]
        keep = rank < self.top
        self.parts = [(item[keep], score[keep], first[keep], classes[keep])]
        self.size = int(keep.sum())
        return list(self.parts[0])


def _scored(shared, top: int):
    """Every class of the task against all items of the block; the task's best classes of each item come out."""

    def run(batches: Batches) -> Batches:
        weight, coefficients = shared.value
        best = _Best(coefficients.shape[1], top)
        for batch in batches:
            ids, m, bags = batch["class"].to_numpy(), batch["m"].to_numpy(), batch["bag"].to_pylist()
            first = batch["first"].fill_null(np.iinfo(np.int64).max).to_numpy()
            sizes = np.array([len(b) // 8 for b in bags])
            step = max(1, CELLS // coefficients.shape[1])
            lo = 0
            while lo < len(bags):
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), step, "right")))
                pairs = [np.frombuffer(b, "<u4").reshape(2, -1) for b in bags[lo:hi]]
                term, tf = np.concatenate(pairs, axis=1).astype(np.int64)
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + K1000 * np.repeat(m[lo:hi], sizes[lo:hi])))
                at = np.concatenate([[0], np.cumsum(sizes[lo:hi])[:-1]])
                best.add(np.add.reduceat(coefficients[term] * value[:, None], at, axis=0), ids[lo:hi], first[lo:hi])
                lo = hi
        item, score, _, classes = best.cut()
        yield pa.record_batch([pa.array(item, pa.int64()), pa.array(classes, pa.int64()), pa.array(score, pa.int64())], names=["item", "class", "score"])

    return run


def _block(items: DataFrame, blocks: int, b: int):
    """The block's items, its vocabulary and the items' term counts as one matrix."""
    rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
    ids = sorted({r.item_id for r in rows}, key=lambda x: (x is None, x))
    vocabulary = sorted({bytes(r.term) for r in rows})
    place, number = {x: i for i, x in enumerate(ids)}, {t: i for i, t in enumerate(vocabulary)}
    counts = np.zeros((len(vocabulary), len(ids)), np.int64)
    for r in rows:
        counts[number[bytes(r.term)], place[r.item_id]] = r.n
    return ids, vocabulary, counts


def bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``(doc_id, n, bag, h)`` of every document; the bag is null where no term of the vocabulary occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = table_input(docs, "doc_id", "text").mapInArrow(_bags(shared), "doc_id long, n long, bag binary")
    return out.withColumn("h", F.xxhash64("bag"))


def classes(members: DataFrame) -> DataFrame:
    """``members(doc_id, bag, h, m)`` as classes of one bag and m: ``(class, h, bag, m, first, members)``.  Hashes bring equal
    bags together and the bags are compared; copies are combined before they are shuffled."""
    out = members.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first"), F.count("*").alias("members"))
    return staged(out.withColumn("class", F.monotonically_increasing_id()), "bag-classes")


def _expanded(members: DataFrame, chosen: DataFrame, top: int) -> DataFrame:
    """The ``top`` smallest doc_ids of each chosen class ``(class, h, m, bag)``: ``(class, doc_id)``.

    Chosen classes are at most ``top`` an item; they go out to the documents while they are small, else both sides are shuffled.
    """
    size = chosen.agg(F.sum(F.length("bag"))).first()[0] or 0
    side = F.broadcast(chosen) if size <= SMALL else chosen
    found = members.join(side, ["h", "m", "bag"]).select("class", "doc_id")
    by_id = Window.partitionBy("class").orderBy(F.col("doc_id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= top).select("class", "doc_id")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` highest-scoring documents of each item: ``(item_id, rank, doc_id, score)``."""
    spark = docs.sparkSession
    terms = table_input(items, "item_id", "text").mapInArrow(per_batch(_item_terms), "item_id long, term binary, n long")
    terms = staged(terms.groupBy("item_id", "term").agg(F.sum("n").alias("n")), "item-terms")
    blocks = max(1, -(-terms.count() // block_terms))
    out, totals = None, None
    for b in range(blocks):
        ids, vocabulary, counts = _block(terms, blocks, b)
        if not ids:
            continue
        found = staged(bags(docs, vocabulary), "bags")
        totals = totals or found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, n_terms = totals
        if not n_terms:
            break
        m = F.lit(100 - B100) + F.floor(F.expr(f"({B100} * n * {n_docs}L) div {n_terms}L"))
        members = found.where("bag is not null").select("doc_id", "h", "bag", m.cast("long").alias("m"))
        df = np.zeros(len(vocabulary), np.int64)
        each = members.select("bag").mapInArrow(_document_frequencies(len(vocabulary)), "term long, df long")
        for r in each.groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        shared = spark.sparkContext.broadcast((weight, counts))
        groups = classes(members)
        scored = groups.select("class", "m", "bag", "first").mapInArrow(_scored(shared, top), "item long, class long, score long")
        first = groups.select("class", "first")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("first").asc_nulls_last())
        chosen = staged(scored.join(first, "class").withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).drop("place", "first"), "chosen")
        wanted = staged(groups.join(chosen.select("class").distinct(), "class", "left_semi").select("class", "h", "m", "bag"), "wanted")
        hits = chosen.join(_expanded(members, wanted, top), "class")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item long, item_id long")
        hits = hits.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = hits if out is None else out.unionByName(staged(hits, "hits"))
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS c FROM b GROUP BY ALL),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY t, big_n),
l AS (SELECT r, doc_id, 25 + (75 * len(w) * big_n) // big_l AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT item_id, r, doc_id, CAST(sum(c * f.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (t) JOIN f USING (t) JOIN l USING (r) GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
