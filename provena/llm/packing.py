"""Packing by lexical retrieval: neighbours from a sharded BM25 index fill each document's window.

Documents are dealt to shards of bounded size by content: every document is encoded once and
its ids are shuffled to the order of its three rarest tokens by rank in the vocabulary (a BPE
vocabulary numbers its merges by frequency, so the greatest ids are the rarest).  The order is cut in ranges, so a
common key is dealt to several tasks.  A shard holds a BM25 inverted index of its documents.  A seed
document opens a window; while the window has room, the best unused neighbour of
the seed (the first unused document if none shares a term) is appended.  The last
one is cut where the window is full, and its rest opens the next window as the
new seed.  So only the last window of a shard is short: it is cut into pieces
of powers of two, at least ``least`` tokens each, and only the very last is padded.

The index's terms are the documents' token ids.  Queries use the ``query_terms`` rarest
terms of the seed.  Document frequencies, their number and the mean length are those of the whole table;
only the search for neighbours stays inside the shard.  A null text is an empty
document: its end token only.  Every id of every row lies in exactly one piece;
repeated rows are packed each on their own; a null doc_id stays null.  Equal scores go to the earlier
document.  An empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, staged, table_input
from .tokens import WordEncoder, tokenizer, vocabulary_path
from .words import Batches, per_batch, utf8

WINDOW, END_ID, SHARD_DOCS, SHARD_TOKENS, QUERY_TERMS = 2048, 1, 2000, 8_000_000, 12
K1, B = 1.2, 0.75


class ShardIndex:
    """BM25 inverted index of one shard over token ids; used documents are passed over."""

    def __init__(self, ids: list[np.ndarray], query_terms: int, table: tuple[np.ndarray, int, float]):
        df, total, mean = table
        n = len(ids)
        each = [np.unique(x, return_counts=True) for x in ids]
        doc = np.repeat(np.arange(n), [len(t) for t, _ in each])
        term = np.concatenate([t for t, _ in each]).astype(np.int64)
        tf = np.concatenate([c for _, c in each]).astype(float)
        size = np.array([len(x) for x in ids], float)
        norm = K1 * (1 - B + B * size / mean)
        useful = np.bincount(term, minlength=len(df))[term] >= 2
        doc, term, tf = doc[useful], term[useful], tf[useful]
        idf = np.log(1 + (total - df[term] + 0.5) / (df[term] + 0.5))
        self.score = idf * tf * (K1 + 1) / (tf + norm[doc])
        rare = np.lexsort((term, df[term], doc))
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)  # doc is sorted: a term's rank among its document's terms
        self.query = [[] for _ in range(n)]
        for d, t in zip(doc[place < query_terms].tolist(), term[rare][place < query_terms].tolist(), strict=True):
            self.query[d].append(t)
        order = np.argsort(term, kind="stable")
        self.doc, self.score = doc[order], self.score[order]
        self.start = np.searchsorted(term[order], np.arange(len(df) + 1))
        self.used = np.zeros(n, bool)
        self.next_unused = 0

    def use(self, d: int) -> None:
        self.used[d] = True

    def first(self) -> int | None:
        while self.next_unused < len(self.used) and self.used[self.next_unused]:
            self.next_unused += 1
        return self.next_unused if self.next_unused < len(self.used) else None

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents, best BM25 score first (ties: earlier document), then the rest in order."""
        found = [slice(self.start[t], self.start[t + 1]) for t in self.query[seed]]
        if found:
            docs, inverse = np.unique(np.concatenate([self.doc[x] for x in found]), return_inverse=True)
            score = np.bincount(inverse, np.concatenate([self.score[x] for x in found]))
            for d in docs[np.lexsort((docs, -score))].tolist():
                if not self.used[d]:
                    yield d
        while (d := self.first()) is not None:
            yield d


def powers(n: int, least: int) -> Iterator[int]:
    """Sizes of powers of two from the largest, the last one holding the rest (under 2 * least)."""
    while n > 0:
        size = 1 << (n.bit_length() - 1)
        if n - size < 0 or size <= least:
            yield n
            return
        yield size
        n -= size


def pack_shard(ids: list[np.ndarray], window: int, query_terms: int, least: int, table: tuple[np.ndarray, int, float]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    index = ShardIndex(ids, query_terms, table)
    sequence, offset, held = 0, 0, []  # held: the open window's pieces
    seed, start = index.first(), 0
    while seed is not None:
        index.use(seed)
        queue, doc = index.neighbours(seed), seed
        while True:
            n = min(window - offset, len(ids[doc]) - start)
            held.append((doc, start, n, sequence, offset))
            offset, start = offset + n, start + n
            if offset == window:
                yield from held
                held, offset, sequence = [], 0, sequence + 1
                if start < len(ids[doc]):
                    seed = doc  # its rest opens the next window
                    queue = index.neighbours(seed)
                    continue
            if start < len(ids[doc]):
                continue
            start = 0
            if offset == 0:
                seed = next(queue, None)
                break
            doc = next(queue, None)
            if doc is None:
                seed = None
                break
            index.use(doc)
    # the shard's last window, in powers of two
    sizes = list(powers(offset, least))
    at = 0
    for size in sizes:
        lo, hi = at, at + size
        for doc, s, n, _, o in held:
            a, b = max(lo, o), min(hi, o + n)
            if a < b:
                yield doc, s + a - o, b - a, sequence, a - lo
        at, sequence = hi, sequence + 1


def _encode(end_id: int, path: str | None, dtype: str):
    """Documents -> ids and keys (the three greatest token ids); a task's last row has no ids but, in ``df``, the document frequencies of its tokens."""

    def run(batches: Batches) -> Batches:
        encode = WordEncoder(path)
        df, docs, tokens = np.zeros(1 << 16, np.int64), 0, 0
        names = ["doc_id", "ids", "df", "k1", "k2", "k3"]
        for batch in batches:
            numbers, raw = batch["doc_id"].to_pylist(), utf8(batch["text"])
            for i in range(0, len(raw), 500):
                found = [np.append(got, np.uint32(end_id)) for got in encode(raw[i : i + 500])]
                keys = np.full((len(found), 3), -1, np.int64)
                for j, ids in enumerate(found):
                    own = np.unique(ids)
                    if own[-1] >= len(df):
                        df = np.append(df, np.zeros(int(own[-1]) + 1 - len(df), np.int64))
                    df[own] += 1
                    own = own[own != end_id][:-4:-1]
                    keys[j, : len(own)] = own
                docs, tokens = docs + len(found), tokens + sum(map(len, found))
                data = pa.array([x.astype(dtype).tobytes() for x in found], pa.binary())
                yield pa.record_batch([pa.array(numbers[i : i + 500], pa.int64()), data, pa.nulls(len(found), pa.binary()), *map(pa.array, keys.T.copy())], names=names)
        term = np.flatnonzero(df)
        packed = np.stack([np.append(term, [-1, -2]), np.append(df[term], [docs, tokens])]).astype("<i8").tobytes()
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary()), *[pa.nulls(1, pa.int64())] * 3], names=names)

    return run


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``(term, n)``; under term -1 the number of documents, under -2 that of tokens."""
    both = np.concatenate([np.frombuffer(x, "<i8").reshape(2, -1) for x in batch["df"].to_pylist()], axis=1)
    return pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["term", "n"])


def _pack(window: int, query_terms: int, shard_docs: int, shard_tokens: int, least: int, table: tuple[np.ndarray, int, float], dtype: str):
    kinds = (pa.int64(),) * 7
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Batches) -> Batches:
        sequence = TaskContext.get().partitionId() << 40
        docs: list = []
        ids: list = []

        def shard() -> pa.RecordBatch:
            nonlocal sequence
            rows: list[tuple] = []
            top = -1
            for d, start, n, s, o in pack_shard(ids, window, query_terms, least, table):
                rows.append((docs[d], start, n, zlib.crc32(ids[d][start : start + n].astype("<u4").tobytes()), len(ids[d]), sequence + s, o))
                top = max(top, s)
            sequence += top + 1
            for x in (docs, ids):
                x.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        held = 0
        for batch in batches:
            for doc, got in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                docs.append(doc)
                ids.append(np.frombuffer(got, dtype))
                held += len(ids[-1])
                if len(docs) >= shard_docs or held >= shard_tokens:
                    yield shard()
                    held = 0
        if docs:
            yield shard()

    return run


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, query_terms: int = QUERY_TERMS, shard_docs: int = SHARD_DOCS,
         shard_tokens: int = SHARD_TOKENS, least: int = 64, vocabulary: str | None = None) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of all documents."""
    size = tokenizer(vocabulary or vocabulary_path(), False).get_vocab_size()
    dtype = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
    coded = table_input(docs, "doc_id", "text").mapInArrow(_encode(end_id, vocabulary, dtype), "doc_id long, ids binary, df binary, k1 long, k2 long, k3 long")
    coded = staged(coded, "tokens")
    # one number per token id: bounded by the vocabulary
    counted = coded.where("k1 is null").select("df").mapInArrow(per_batch(_counts), "term long, n long")
    counts = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total, tokens = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(max(counts, default=0) + 1, np.int64)
    df[list(counts)] = list(counts.values())
    order = ["k1", "k2", "k3", F.xxhash64("doc_id")]
    f = _pack(window, query_terms, shard_docs, shard_tokens, least, (df, total, tokens / max(total, 1)), dtype)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    sorted_ = coded.where("k1 is not null").drop("df").repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.select("doc_id", "ids").mapInArrow(f, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
