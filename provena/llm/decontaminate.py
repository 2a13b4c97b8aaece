"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive item words (a shorter item is one window).
Its shingles of three words are ordered by rarity in the corpus; since the whole
window must be contained, its necessary prefix is the one rarest shingle.  A
document place with that shingle gives exactly one possible start, which the
length bound (the window must end inside the document) and the positional bound
(start >= 0) test before the words themselves are compared.

The corpus counts of the benchmark's shingles come from one pass over all
documents.  Windows are broadcast in blocks of at most ``block_words`` words, a
fixed bound: a benchmark of any size takes more passes, never more memory.  The driver and
the tasks hold one block at a time; what a pass found is staged before the next block is made.

Words follow ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Null
texts have no words; null or wordless items have no window; items that repeat
an id count once; rows that repeat a doc_id are judged one by one.  Empty tables give
empty or clean results.  Other columns are carried along, except those named like a result column.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, read, restored, staged, table_input
from .words import U64, WordHasher, Windows, alnum_words, per_batch, signed, utf8

WINDOW, SHINGLE, BLOCK_WORDS = 10, 3, 2_000_000
_BITS = 16


def _item_windows(window: int):
    hasher, windows = WordHasher(), Windows()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for item, text in zip(batch["item_id"].to_pylist(), utf8(batch["text"]), strict=True):
            words = alnum_words(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                part = words[i : i + size]
                g = windows.all(hasher(part), min(SHINGLE, size))
                for c, x in zip(cols, (item, b" ".join(part), size, g.view(np.int64).tolist()), strict=True):
                    c.append(x)
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["item_id", "words", "size", "shingles"])

    return per_batch(run)


class _Members:
    """Is a shingle hash among the given ones: a bit table first, then a sorted search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.keys >> U64(64 - _BITS)] = True

    def places(self, g: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits[g >> U64(64 - _BITS)])
        if len(at):
            i = np.searchsorted(self.keys, g[at])
            at = at[self.keys[np.minimum(i, len(self.keys) - 1)] == g[at]]
        return at


def _count(keys):
    hasher, windows = WordHasher(), Windows()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, found = _Members(keys.value), []
        for text in utf8(batch["text"]):
            h = hasher(alnum_words(text))
            for k in range(1, SHINGLE + 1):
                g = windows.all(h, k)
                found.append(g[known.places(g)])
        key, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.record_batch([signed(key), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return per_batch(run)


def _match(block):
    hasher, windows = WordHasher(), Windows()
    state: dict = {}

    def load() -> None:
        by = defaultdict(list)
        for number, (items, words, size, key, offset) in enumerate(block.value):
            by[key].append((number, items, words, size, offset))
        state["by"] = by
        state["known"] = _Members(np.array(list(by), np.int64).view(U64))
        state["spans"] = sorted({min(SHINGLE, x[2]) for x in block.value})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            load()
        by, known = state["by"], state["known"]
        n_words, spans, items = [], [], []
        for text in utf8(batch["text"]):
            words = alnum_words(text)
            h = hasher(words)
            hit, got = set(), set()
            for k in state["spans"]:
                g = windows.all(h, k)
                at = known.places(g)
                for p, key in zip(at.tolist(), g[at].view(np.int64).tolist(), strict=True):
                    for _, ids, part, size, offset in by[key]:
                        start = p - offset
                        if min(SHINGLE, size) == k and start >= 0 and start + size <= len(words) and words[start : start + size] == part:
                            hit.add((start, start + size))
                            got.update(ids)
            n_words.append(len(words))
            spans.append([{"lo": lo, "hi": hi} for lo, hi in sorted(hit)])
            items.append(sorted(got))
        keep = [n for n in batch.schema.names if n not in ("n_words", "spans", "items")]
        if "spans" in batch.schema.names:  # an earlier block's results
            spans = [a + b for a, b in zip(batch["spans"].to_pylist(), spans, strict=True)]
            items = [sorted({*a, *b}) for a, b in zip(batch["items"].to_pylist(), items, strict=True)]
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.record_batch([*(batch[n] for n in keep), pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.int64()))], names=[*keep, "n_words", "spans", "items"])

    return per_batch(run)


def _prefixed(windows: DataFrame, counts: DataFrame | None) -> DataFrame:
    """Every distinct window with its items, its prefix shingle and that shingle's place."""
    s = windows.select("words", "size", F.posexplode("shingles").alias("offset", "shingle"))
    s = s.join(counts, "shingle", "left") if counts is not None else s.withColumn("n", F.lit(0).cast("long"))
    rare = s.groupBy("words", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("p"))
    items = windows.groupBy("words", "size").agg(F.collect_set("item_id").alias("items"))
    return staged(items.join(rare, ["words", "size"]).select("items", "words", "size", "p.shingle", "p.offset"), "windows")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, spans (hit word intervals) and items (ids of the items found)."""
    spark = docs.sparkSession
    item = table_input(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    windows = staged(item.mapInArrow(_item_windows(window), "item_id long, words binary, size int, shingles array<long>").distinct(), "item-windows")
    counts = None
    keys = windows.select(F.explode("shingles").alias("shingle")).distinct()
    parts = -(-keys.count() // block_words)
    for b in range(parts):  # one pass unless the benchmark is beyond the bound
        shared = spark.sparkContext.broadcast(np.array([r[0] for r in keys.where(F.pmod("shingle", F.lit(parts)) == b).collect()], np.int64).view(U64))
        found = table_input(docs, "text").mapInArrow(_count(shared), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        found = staged(found, "shingle-counts")
        counts = found if counts is None else counts.union(found)
        shared.unpersist()
    ready = _prefixed(windows, counts)
    total = ready.agg(F.sum(F.col("size") + F.size("items"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    span = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
    added = [T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.LongType()))]
    out = carried(docs, "text")
    schema = T.StructType([*out.schema, *added])
    for b in range(blocks):
        rows = ready.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([([*r["items"]], bytes(r.words).split(), r.size, r.shingle, r.offset) for r in rows])
        del rows
        out = out.mapInArrow(_match(shared), schema)
        if b < blocks - 1:
            out = staged(out, "block")
            shared.unpersist()
    results = ("n_words", "spans", "items")
    return restored(out, docs, "text", without=results, extra=results)


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    n_hit, names = [], []
    for spans, items in zip(batch["spans"].to_pylist(), batch["items"].to_pylist(), strict=True):
        n_hit.append(len({i for s in spans for i in range(s["lo"], s["hi"])}))
        names.append(hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest())
    return pa.record_batch([batch["doc_id"], batch["n_words"], pa.array(n_hit, pa.int64()), pa.compute.list_value_length(batch["items"]).cast(pa.int64()), pa.array(names)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    return restored(contamination(carried(docs, "text"), benchmark, **options).where(F.size("items") == 0), docs, "text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    out = found.select("doc_id", "n_words", "spans", "items").mapInArrow(per_batch(_digest), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
