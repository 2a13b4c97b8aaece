"""Substring dedup: remove every word covered by a window of 50 words that also
starts in a document with a smaller id.

Method: suffix automata over shards of reference passages, against which the
documents are streamed for matching statistics.  The references are the corpus
itself and grow with it, so shards are not broadcast but co-partitioned with
the passages that can match them:

1. Every window of ``min_words`` words picks its smallest-hash ``anchor_words``-gram
   (its *anchor*); equal windows pick equal anchors.  The windows of one anchor
   form a *context*.  One small row per context is shuffled, no text.
2. Contexts are grouped by (anchor, content).  An anchor in one document only is
   dropped.  An anchor whose contexts are all equal needs no comparison.
3. The distinct contexts of any other anchor are one reference shard: a suffix
   automaton whose states carry the smallest document id of their occurrences.
   The contexts are streamed through it; at every place where the match is
   ``min_words`` long the state tells the first document with that window.
4. An anchor with more than ``shard_contexts`` distinct contexts (a line common to
   very many documents) would make an unbounded shard.  Its windows are resolved
   exactly by a combinable ``min`` over (anchor, window) instead.
5. The windows found go back to their documents as word intervals; contexts that hold over a
   thousandth of all places are sent to the places instead of being gathered by key.

Nulls: a null text has no words; a row with a null doc_id is kept whole and is
no reference.  Rows that repeat a doc_id are judged one by one; they are no
reference for one another.  An empty table gives an empty result.  Extra
columns are carried along except those named like a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, join_hot, read, restored, staged
from .words import U64, Batches, WordHasher, Windows, mix, per_batch, signed, space_words, utf8

MIN_WORDS, ANCHOR_WORDS, SHARD_CONTEXTS = 50, 15, 64


class SuffixAutomaton:
    """Generalised suffix automaton over words; states carry the smallest label of their occurrences."""

    def __init__(self):
        self.next, self.link, self.length, self.label = [{}], [-1], [0], [None]

    def _state(self, length: int, link: int, arcs: dict) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.label.append(None)
        return len(self.next) - 1

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, word, q)
        cur, p = self._state(length[last] + 1, 0, {}), last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return cur

    def _clone(self, p: int, word: bytes, q: int) -> int:
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def add(self, words: list[bytes], label: int) -> None:
        at = 0
        for w in words:
            at = self._extend(at, w)
            if self.label[at] is None or label < self.label[at]:
                self.label[at] = label

    def close(self) -> None:
        """Labels move up the suffix links, longest states first."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up, own = self.link[s], self.label[s]
            if up > 0 and own is not None and (self.label[up] is None or own < self.label[up]):
                self.label[up] = own

    def first_documents(self, words: list[bytes], k: int) -> list[int | None]:
        """For each window of k words: the smallest label of a text that has it (None: none has)."""
        out, at, size = [], 0, 0
        for i, w in enumerate(words):
            while at and w not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if w in self.next[at]:
                at, size = self.next[at][w], size + 1
            while at and self.length[self.link[at]] >= k:
                at = self.link[at]
                size = min(size, self.length[at])
            if i >= k - 1:
                out.append(self.label[at] if size >= k else None)
        return out


def _contexts(k: int, a: int):
    hasher, windows = WordHasher(), Windows()
    salt = U64(0x5851F42D4C957F2D)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for doc, tag, text in zip(batch["doc_id"].to_pylist(), batch["tag"].to_pylist(), utf8(batch["text"]), strict=True):
            words = space_words(text)
            if len(words) < k:
                continue
            h = hasher(words)
            prefix = windows.prefix(h)
            grams = windows.between(prefix, at := np.arange(len(h) - a + 1), at + a)
            order = mix(grams ^ salt)
            view = np.lib.stride_tricks.sliding_window_view(order, k - a + 1)
            pick = view.argmin(axis=1) + np.arange(len(view))  # each window's anchor: leftmost smallest
            first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
            end = np.append(first[1:], len(pick))
            chosen = pick[first]
            body = windows.between(prefix, first, end - 1 + k)
            cols[0].append(grams[chosen])
            cols[1].append(mix(body ^ ((chosen - first).astype(U64) * salt)))
            cols[2].append(np.full(len(first), doc))
            cols[3].append(np.full(len(first), tag))
            cols[4].append(first.astype(np.int32))
            cols[5].append((end - first).astype(np.int32))
        if not cols[0]:
            return None
        c = [np.concatenate(x) for x in cols]
        return pa.record_batch(
            [signed(c[0]), signed(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.int32())],
            names=["anchor", "ctx", "doc_id", "tag", "start", "n_windows"],
        )

    return per_batch(run)


def _cut(k: int):
    """Rows of documents with wanted places -> the words of each context."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[tuple] = []
        for doc, text, wanted in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), batch["wanted"].to_pylist(), strict=True):
            words = space_words(text)
            for w in wanted:
                body = words[w["start"] : w["start"] + w["n_windows"] + k - 1]
                out.append((w["anchor"], w["ctx"], w["n_ctx"], doc, b" ".join(body)))
        a, c, n, d, b = zip(*out, strict=True) if out else ((),) * 5
        return pa.record_batch(
            [pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(b, pa.binary())],
            names=["anchor", "ctx", "n_ctx", "first_doc", "body"],
        )

    return per_batch(run)


def _runs(docs: list[int | None]) -> Iterator[tuple[int, int, int]]:
    """(from, to, document) of equal neighbours."""
    at = 0
    for i in range(1, len(docs) + 1):
        if i == len(docs) or docs[i] != docs[at]:
            if docs[at] is not None:
                yield at, i, docs[at]
            at = i


def _shards(k: int):
    """Sorted contexts, all of an anchor in one partition -> first documents by automaton."""

    def resolve(anchor: int, group: list[tuple]) -> Iterator[tuple]:
        automaton = SuffixAutomaton()
        texts = [(ctx, doc, body.split()) for ctx, doc, body in group]
        for _, doc, words in texts:
            automaton.add(words, doc)
        automaton.close()
        for ctx, _, words in texts:
            for lo, hi, src in _runs(automaton.first_documents(words, k)):
                yield anchor, ctx, lo, hi, src

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["anchor", "ctx", "lo", "hi", "src"])

    def run(batches: Batches) -> Batches:
        now, group, rows = None, [], []
        for batch in batches:
            for anchor, ctx, doc, body in zip(batch["anchor"].to_pylist(), batch["ctx"].to_pylist(), batch["first_doc"].to_pylist(), batch["body"].to_pylist(), strict=True):
                if anchor != now:
                    rows += resolve(now, group)
                    now, group = anchor, []
                group.append((ctx, doc, body))
            if len(rows) > 20_000:
                yield emit(rows)
                rows = []
        rows += resolve(now, group)
        if rows:
            yield emit(rows)

    return run


def _windows_of(k: int):
    """Contexts of very common anchors -> one row per window."""
    hasher, windows = WordHasher(), Windows()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cols: list[list] = [[], [], [], [], []]
        for anchor, ctx, doc, body in zip(batch["anchor"].to_pylist(), batch["ctx"].to_pylist(), batch["first_doc"].to_pylist(), batch["body"].to_pylist(), strict=True):
            got = windows.all(hasher(body.split()), k)
            for c, x in zip(cols, (np.full(len(got), anchor), np.full(len(got), ctx), np.full(len(got), doc), np.arange(len(got), dtype=np.int32), got.view(np.int64)), strict=True):
                c.append(x)
        return pa.record_batch([pa.array(np.concatenate(c)) for c in cols], names=["anchor", "ctx", "first_doc", "lo", "win"])

    return per_batch(run)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """Word intervals to remove: ``(doc_id, tag, spans array<struct<lo,hi>>)`` for documents that have any.

    ``docs`` has doc_id, tag (of the text) and text.
    """
    k = min_words
    known = docs.where("doc_id is not null and text is not null")
    occ = staged(known.mapInArrow(_contexts(k, anchor_words), "anchor long, ctx long, doc_id long, tag long, start int, n_windows int"), "contexts")
    ctx = occ.groupBy("anchor", "ctx").agg(F.min(F.struct("doc_id", "tag", "start", "n_windows")).alias("first"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"))
    anchor = ctx.groupBy("anchor").agg(F.count("*").alias("n_ctx"), F.min("first.doc_id").alias("lo"), F.max("last_doc").alias("hi")).where("lo < hi")
    ctx = staged(ctx.join(anchor.select("anchor", "n_ctx"), "anchor").select("anchor", "ctx", "n_ctx", "last_doc", "n", "first.*"), "shared")
    wanted = ctx.where("n_ctx > 1").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "ctx", "n_ctx", "start", "n_windows")).alias("wanted"))
    bodies = staged(
        wanted.join(known, ["doc_id", "tag"]).select("doc_id", "text", "wanted")
        .mapInArrow(_cut(k), "anchor long, ctx long, n_ctx long, first_doc long, body binary"),
        "bodies",
    ).dropDuplicates(["anchor", "ctx"])
    few = (
        bodies.where(F.col("n_ctx") <= shard_contexts).select("anchor", "ctx", "first_doc", "body")
        .repartition("anchor").sortWithinPartitions("anchor", "first_doc", "ctx")
        .mapInArrow(_shards(k), "anchor long, ctx long, lo int, hi int, src long")
    )
    many = staged(bodies.where(F.col("n_ctx") > shard_contexts).mapInArrow(_windows_of(k), "anchor long, ctx long, first_doc long, lo int, win long"), "windows")
    first = staged(many.groupBy("anchor", "win").agg(F.min("first_doc").alias("src"), F.count("*").alias("n")), "first-windows")
    many = join_hot(many, first, ["anchor", "win"], many.count()).select("anchor", "ctx", "lo", (F.col("lo") + 1).alias("hi"), "src")
    one = ctx.where("n_ctx = 1").select("anchor", "ctx", F.lit(0).alias("lo"), F.col("n_windows").alias("hi"), F.col("doc_id").alias("src"))
    useful = ctx.select("anchor", "ctx", "last_doc", "n")
    found = one.join(useful, ["anchor", "ctx"]).unionByName(few.unionByName(many).join(useful, ["anchor", "ctx"])).where("src < last_doc")
    found = staged(found.select("anchor", "ctx", "lo", "hi", "src", "n"), "found")
    hits = join_hot(occ.select("anchor", "ctx", "doc_id", "tag", "start"), found, ["anchor", "ctx"], occ.count()).where("src < doc_id")
    span = F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + (k - 1)).alias("hi"))
    return hits.groupBy("doc_id", "tag").agg(F.collect_set(span).alias("spans"))


def _keep(batch: pa.RecordBatch) -> pa.RecordBatch:
    n_words, n_removed, kept = [], [], []
    for text, spans in zip(utf8(batch["text"]), batch["spans"].to_pylist(), strict=True):
        words = space_words(text)
        gone = 0
        if spans:
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, [s["lo"] for s in spans], 1)
            np.add.at(edge, [s["hi"] for s in spans], -1)
            stay = np.cumsum(edge[:-1]) == 0
            gone = len(words) - int(stay.sum())
            words = [words[i] for i in np.flatnonzero(stay)]
        n_words.append(len(words) + gone)
        n_removed.append(gone)
        kept.append(b" ".join(words))
    names = [n for n in batch.schema.names if n != "spans"]
    return pa.record_batch(
        [*(batch[n] for n in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
        names=[*names, "n_words", "n_removed", "kept"],
    )


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the words that stay, joined by one space)."""
    own = carried(docs, "doc_id", "text").withColumn("tag", F.xxhash64("text"))
    spans = repeated_spans(own.select("doc_id", "tag", "text"), **options)
    joined = own.join(spans, ["doc_id", "tag"], "left").drop("tag")
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    out = joined.mapInArrow(per_batch(_keep), T.StructType([*(f for f in joined.schema if f.name != "spans"), *added]))
    results = ("n_words", "n_removed", "kept")
    return restored(out, docs, "doc_id", "text", without=results, extra=results)


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated passages cut from the texts; texts that lose nothing stay as they are."""
    out = remove_repeats(carried(docs, "doc_id", "text"), **options)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return restored(out.withColumn("text", text), docs, "doc_id", "text")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM s),
low AS (SELECT h, min(doc_id) AS src FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (
    SELECT win.doc_id, unnest(range(win.i, win.i + 50)) AS p FROM win JOIN low USING (h) WHERE low.src < win.doc_id)),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(words, range(1, len(words) + 1)),
           lambda x: ps IS NULL OR NOT list_contains(ps, x[2])), lambda x: x[1]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
