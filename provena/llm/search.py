"""Exact BM25 top-k by block-max WAND over a sharded inverted index.

The scan cuts the documents into shards of at most ``shard_docs`` (or that many with ``shard_words``
words) and orders a shard's documents by their most
frequent word and length, so that blocks hold like documents and their bounds are close; each shard's
inverted index (postings by buckets of terms, with term counts, and a table of document
ids and lengths) is staged once.  Document frequencies, the number of documents and the mean length are
added up over all shards, so every shard scores with global statistics.  A block of
queries goes to ``WAYS`` tasks or more, each with a share of the shards, of which
only the buckets that hold a term of the block are sent there.  A task takes its queries through one shard after
another by block-max WAND with the query's k-th score in the shards so far as its threshold.  A block of many queries takes a
shard together instead: long lists that several queries share are multiplied as a matrix, the other lists added up, and
the documents that reach their query's threshold are scored.
Every query meets every shard, so the work grows with the product of queries and documents.
The tasks' top-k merge exactly: a document lies in one shard and its
score does not depend on the shard.

A query is all words of its text; ``query_terms`` cuts it to that many words of the greatest weight
tf * idf (ties: smaller word) where a caller wants that.
Results: score rounded to 6 digits, best first, ties by smaller doc_id.
Words are lower-cased runs of letters and digits (see ``words.alnum_words``).

Null and empty texts match nothing and find nothing; rows with a null doc_id
are not indexed; rows that repeat a doc_id are indexed each on their own and the
best of them takes one place; queries that repeat an id are one query of all their words.  An empty table finds
nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.together import CHUNK, DENSE_CELLS, DENSE_LISTS, SHARED, SUMMED, like_each_other, parts, ranges
from .common import read, staged, table_input
from .words import U64, Batches, WordHasher, alnum_words, per_batch, utf8

K, K1, B, BLOCK, SHARD_DOCS, SHARD_WORDS, QUERY_BLOCK = 10, 1.2, 0.75, 4, 8192, 4_000_000, 20_000
WAYS, SHARDS_A_TASK = 16, 64  # the shards are dealt to so many tasks for a block of queries: more where a task would get too many
SPREAD, FIRST, REACH = 8, 0.25, 0.5  # see Postings and block_max_wand; they change what is read, not what is found
ROUNDING = 1.001  # far more than single-precision sums of block bounds can be short by
BUCKET_BITS = 13  # a shard's terms go into so many buckets (as a power of 2), by the first bits of their hashes: rows of some kilobytes
SLACK = 1e-6  # scores are ranked after rounding; nothing within this of the k-th is skipped


def _index(shard_docs: int, shard_words: int):
    """Rows (shard, bucket, terms, n of each, docs uint16, counts uint32) with all postings of a bucket of terms, in the order of the
    hashes; the row without a bucket holds ids and lengths, and in n their number and the sum of the lengths."""
    names = ["shard", "bucket", "terms", "n", "docs", "counts"]

    def shard(number: int, ids: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
        size = np.array([len(h) for h in hashes])
        key = np.concatenate(hashes)
        doc = np.repeat(np.arange(len(ids)), size)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(key))).astype(np.uint32)
        key, doc = key[first], doc[first]
        # like documents next to each other: by their most frequent word, then by length
        top = np.zeros(len(ids), np.uint64)
        by_doc = np.lexsort((tf, doc))
        ends = np.flatnonzero(np.concatenate([doc[by_doc][1:] != doc[by_doc][:-1], [True]])) if len(doc) else np.zeros(0, np.int64)
        top[doc[by_doc[ends]]] = key[by_doc[ends]].astype(np.uint64)
        rows = np.lexsort((size, top))
        place = np.empty(len(ids), np.int64)
        place[rows] = np.arange(len(ids))
        doc = place[doc]
        order = np.lexsort((doc, key))
        key, doc, tf = key[order], doc[order].astype(np.uint16), tf[order]
        size, ids = size[rows], np.array(ids, np.int64)[rows]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        terms = key[start]
        bucket = bucket_of(terms)
        part = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(terms) else np.zeros(0, np.int64)
        edge = np.append(start, len(key))[np.append(part, len(terms))]

        def lists(x: np.ndarray, own: bytes) -> pa.Array:
            raw = x.tobytes() + own
            ends = np.append(edge * x.itemsize, len(raw)).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])

        def each(x: np.ndarray, own: list[int]) -> pa.Array:
            ends = np.append(part, [len(terms), len(terms) + len(own)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.append(x.astype(np.int64), np.array(own, np.int64))))

        bucket = pa.concat_arrays([pa.array(bucket[part].astype(np.int32)), pa.array([None], pa.int32())])
        n = each(np.diff(np.append(start, len(key))), [len(ids), int(size.sum())])
        shards = pa.array(np.full(len(n), number))
        return pa.record_batch([shards, bucket, each(terms.view(np.int64), []), n, lists(doc, ids.tobytes()), lists(tf, size.astype(np.uint32).tobytes())], names=names)

    def run(batches: Batches) -> Batches:
        hasher = WordHasher()
        number = TaskContext.get().partitionId() << 24
        held, ids, hashes = 0, [], []
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                ids.append(doc)
                hashes.append(hasher(alnum_words(text)))
                held += len(hashes[-1])
                if len(ids) >= shard_docs or held >= shard_words:
                    yield shard(number, ids, hashes)
                    number, held, ids, hashes = number + 1, 0, [], []
        if ids:
            yield shard(number, ids, hashes)

    return run


def bucket_of(terms: np.ndarray) -> np.ndarray:
    return terms >> U64(64 - BUCKET_BITS)


def _query_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    hasher = WordHasher()
    rows: list[tuple] = []
    for q, text in zip(batch["query_id"].to_pylist(), utf8(batch["text"]), strict=True):
        count = Counter(alnum_words(text))
        rows += zip([q] * len(count), count, hasher(list(count)).view(np.int64).tolist(), count.values(), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["query_id", "word", "term", "tf"])


class Postings:
    """The postings of a shard's queried terms, term after term.

    ``list_max`` holds the greatest impact of every list.  A long list (at least one posting to ``SPREAD`` blocks of the shard) also
    has a row of ``block_max``: the greatest impact in every block of ``BLOCK`` documents, rounded up.  Postings of long lists
    are there a second time in the order of the documents (``of_doc``, ``doc_impact``).  With ``dense`` the longest of them are
    rows of ``matrix`` as well, in single precision; ``column`` has the row of a term's list, -1 for the others.
    """

    def __init__(self, n: np.ndarray, docs: np.ndarray, impact: np.ndarray, ids: np.ndarray, dense: bool = False):
        self.docs, self.impact, self.ids = docs, impact, ids
        self.edge = np.append(0, np.cumsum(n))
        self.list_max = np.maximum.reduceat(impact, self.edge[:-1])
        self.blocks = -(-len(ids) // BLOCK)
        self.long = n * SPREAD >= self.blocks
        self.row = np.cumsum(self.long) - 1
        own = np.repeat(self.long, n)
        row, doc, high = np.repeat(self.row[self.long], n[self.long]).astype(np.int32), docs[own], impact[own]
        self.block_max = np.zeros((int(self.long.sum()), self.blocks), np.float32)
        if len(doc):
            cell = row.astype(np.int64) * self.blocks + doc // BLOCK
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            self.block_max.ravel()[cell[first]] = np.nextafter(np.maximum.reduceat(high, first).astype(np.float32), np.float32(np.inf))
        by_doc = np.argsort(doc.astype(np.uint16), kind="stable")
        self.of_doc, self.doc_impact = row[by_doc], high[by_doc]
        self.doc_edge = np.append(0, np.cumsum(np.bincount(doc, minlength=len(ids))))
        self.weight = np.zeros(len(self.block_max))  # of the rows, during a search
        self.distinct = len(np.unique(ids)) == len(ids)
        if dense:
            longest = np.argsort(-n, kind="stable")[: min(DENSE_CELLS // len(ids), DENSE_LISTS)]
            longest = longest[self.long[longest]]
            self.column = np.full(len(n), -1)
            self.column[longest] = np.arange(len(longest))
            own = np.repeat(self.column >= 0, n)
            self.matrix = np.zeros((len(longest), len(ids)), np.float32)
            self.matrix[np.repeat(self.column, n)[own], docs[own]] = impact[own]


class Work:
    """What a search has read: pivot blocks, block bounds, blocks with scored documents and postings."""

    def __init__(self):
        self.pivots = self.bounds = self.scored = self.postings = 0


def block_max_wand(p: Postings, terms: np.ndarray, weights: np.ndarray, k: int, best: np.ndarray | None = None, ids: np.ndarray | None = None, work: Work | None = None):
    """(rounded scores, doc ids) of the top k distinct ids of the shards so far; ``terms`` are positions in ``p``.

    Terms are ordered by their list bounds.  Those that together stay under the threshold can't make a pivot: only
    documents in the lists of the others, the pivot terms, can reach it.  These lists are read and added up by document.
    A pivot document goes on if its sum and the list bounds of the terms left reach the threshold, and then, with the block bounds
    of these terms, which are read at such documents' blocks only, if it still does.  The few that remain are
    scored, the most promising first, so that the threshold rises before the others are looked at.
    No posting of the terms left is read but those of scored documents.

    While there is no threshold, the best by the greatest lists, at most a share ``FIRST`` of the postings, are scored to get one.
    Lists are read until the terms left reach no more than ``REACH`` of the threshold: a few more lists leave far fewer documents.
    """
    work = work or Work()
    best, ids = (np.zeros(0), np.zeros(0, np.int64)) if best is None else (best, ids)
    bound = p.list_max[terms] * weights
    least = _least(best, k)
    if bound.sum() < least or not len(terms):
        return best, ids  # no document of the shard reaches the threshold
    # terms that may be left, by their bounds; the short lists are read in any case
    order = np.lexsort((bound, ~p.long[terms]))
    terms, weights, bound = terms[order], weights[order], bound[order]
    n_long = int(p.long[terms].sum())
    upto = np.append(0.0, np.cumsum(bound[:n_long]))  # upto[i]: what the first i terms may add
    n = p.edge[terms + 1] - p.edge[terms]
    rows, total, left = p.row[terms[:n_long]], np.zeros(len(p.ids)), n_long

    def add_up(docs: np.ndarray, impact: np.ndarray, of: slice) -> None:
        nonlocal total
        impact *= np.repeat(weights[of], n[of])
        total += np.bincount(docs, impact, len(total))
        work.postings += len(docs)

    def read(to: int) -> None:
        """Add up the long lists of the terms ``to`` and after."""
        nonlocal left
        if to < left:
            at = list(zip(p.edge[terms[to:left]].tolist(), p.edge[terms[to:left] + 1].tolist(), strict=True))
            add_up(np.concatenate([p.docs[i:j] for i, j in at]), np.concatenate([p.impact[i:j] for i, j in at]), slice(to, left))
            left = to

    def score(docs: np.ndarray) -> None:
        """Bring ``best, ids`` up to date with these documents."""
        nonlocal best, ids, least
        full = total[docs]
        if left:
            lo, hi = p.doc_edge[docs], p.doc_edge[docs + 1]
            some = np.flatnonzero(hi > lo)
            post = ranges(lo[some], hi[some])
            work.postings += len(post)
            if len(some):
                p.weight[rows[:left]] = weights[:left]
                each = p.weight.take(p.of_doc.take(post))
                each *= p.doc_impact.take(post)
                full[some] += np.add.reduceat(each, np.cumsum(hi[some] - lo[some]) - (hi[some] - lo[some]))
                p.weight[rows[:left]] = 0.0
        work.scored += len(np.unique(docs // BLOCK))
        best, ids = _merged(np.round(full, 6), p.ids[docs], p.distinct, k, best, ids, least)
        least = _least(best, k)

    short = ranges(p.edge[terms[n_long:]], p.edge[terms[n_long:] + 1])
    add_up(p.docs.take(short), p.impact.take(short), slice(n_long, None))
    if least <= 0:
        share = np.cumsum(n[::-1])[::-1]  # postings of the terms i and after
        read(min(int(np.searchsorted(-share, -FIRST * share[0])), n_long))
        score(_highest(total, np.flatnonzero(total > 0), 4 * k))
    read(max(int(np.searchsorted(upto, REACH * least, "right")) - 1, 0) if least > 0 else 0)
    able = np.flatnonzero((total + upto[left] >= least) & (total > 0))
    blocks = np.unique(able // BLOCK)
    work.pivots += len(blocks)
    high = total[able]
    if left and len(able):
        work.bounds += left * len(blocks)
        if 2 * len(blocks) > p.blocks:
            add = weights[:left].astype(np.float32) @ p.block_max[rows[:left]]
        else:
            add = np.zeros(p.blocks, np.float32)
            add[blocks] = weights[:left].astype(np.float32) @ p.block_max[rows[:left, None], blocks]
        high = high + add[able // BLOCK] * ROUNDING
    while len(able):
        able, high = able[high >= least], high[high >= least]
        if not len(able):
            break
        first = _highest(high, np.arange(len(high)), 4 * k)
        score(able[first])
        rest = np.ones(len(able), bool)
        rest[first] = False
        able, high = able[rest], high[rest]
    return best, ids


def _least(best: np.ndarray, k: int) -> float:
    return best[-1] - SLACK if len(best) == k else 0.0


def _highest(value: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Those of the places ``at`` with the ``most`` highest values."""
    return at if len(at) <= most else at[np.argpartition(value[at], len(at) - most)[len(at) - most :]]


def _merged(total: np.ndarray, doc: np.ndarray, distinct: bool, k: int, best: np.ndarray, ids: np.ndarray, least: float):
    """``best, ids`` (distinct ids, best first) brought up to date with the scored documents."""
    hit = np.flatnonzero((total > 0) & (total >= least))
    if not len(hit):
        return best, ids
    score, doc = np.concatenate([best, total[hit]]), np.concatenate([ids, doc[hit]])
    if distinct and len(score) > 2 * k:  # an id is there twice at most: among the best so far and here
        high = score >= np.partition(score, len(score) - 2 * k)[len(score) - 2 * k]
        score, doc = score[high], doc[high]
    rank = np.lexsort((doc, -score))
    rank = rank[np.sort(np.unique(doc[rank], return_index=True)[1])]  # the best row of every id
    return score[rank[:k]], doc[rank[:k]]


class BlockSearch:
    """A block of queries that is taken through one shard after another; the k-th scores so far prune the next shard."""

    def __init__(self, queries: pa.Table, k: int, mean_length: float):
        self.k, self.mean_length = k, max(mean_length, 1e-9)
        self.queries = queries["query_id"].to_numpy()
        asked = pa.chunked_array(queries["asked"]).combine_chunks()
        asked = asked.chunk(0) if isinstance(asked, pa.ChunkedArray) else asked
        self.edge = np.append(0, np.cumsum(asked.value_lengths().to_numpy()))
        flat = asked.flatten()
        self.weights = flat.field("weight").to_numpy()
        self.wanted, self.terms = np.unique(flat.field("term").to_numpy().view(U64), return_inverse=True)
        self.best = [(np.zeros(0), np.zeros(0, np.int64))] * len(self.queries)
        order = like_each_other(self.edge, self.terms, self.weights)
        self.queries, n = self.queries[order], np.diff(self.edge)[order]
        of = ranges(self.edge[order], self.edge[order] + n)
        self.edge, self.weights, self.terms = np.append(0, np.cumsum(n)), self.weights[of], self.terms[of]

    def visit(self, shard: pa.Table) -> None:
        m = len(shard) - 1  # the shard's own row, without a bucket, comes last
        if m < 1 or not len(self.wanted):
            return
        docs, counts = shard["docs"].to_pylist(), shard["counts"].to_pylist()
        ids = np.frombuffer(docs[m], np.int64)
        norm = K1 * (1 - B + B * np.frombuffer(counts[m], np.uint32) / self.mean_length)
        flat = lambda name: np.concatenate([c.flatten().to_numpy() for c in shard[name].slice(0, m).chunks])
        term, n = flat("terms").view(U64), flat("n")
        at = np.minimum(np.searchsorted(self.wanted, term), len(self.wanted) - 1)
        asked = self.wanted[at] == term
        if not asked.any():
            return
        own = np.repeat(asked, n)
        doc, tf = np.frombuffer(b"".join(docs[:m]), np.uint16)[own].astype(np.int64), np.frombuffer(b"".join(counts[:m]), np.uint32)[own].astype(float)
        many = len(self.queries) >= CHUNK // 4  # fewer don't repay the matrix
        p = Postings(n[asked], doc, tf * (K1 + 1) / (tf + norm[doc]), ids, many)
        place = np.full(len(self.wanted), -1)
        place[at[asked]] = np.arange(int(asked.sum()))
        at = place[self.terms]
        for lo in range(0, len(self.queries), CHUNK) if many else ():
            self._together(p, at, lo, min(lo + CHUNK, len(self.queries)))
        for i in () if many else range(len(self.queries)):
            mine = slice(self.edge[i], self.edge[i + 1])
            known = at[mine] >= 0
            if known.any():
                self.best[i] = block_max_wand(p, at[mine][known], self.weights[mine][known], self.k, *self.best[i])

    def _together(self, p: Postings, at: np.ndarray, lo: int, hi: int) -> None:
        """The queries ``lo`` .. ``hi`` - 1: the product of the lists in the matrix that several of them share, rounded up, and the sums of
        their other lists; documents that can reach the threshold are scored exactly."""
        mine, width = slice(self.edge[lo], self.edge[hi]), len(p.ids)
        known = at[mine] >= 0
        term, weight = at[mine][known], self.weights[mine][known]
        row = np.repeat(np.arange(hi - lo), np.diff(self.edge[lo : hi + 1]))[known]
        column = p.column[term]
        used = np.flatnonzero(np.bincount(column[column >= 0], minlength=len(p.matrix)) >= SHARED)
        if 4 * len(used) > 3 * len(p.matrix):
            used = np.arange(len(p.matrix))
        place = np.full(len(p.matrix) + 1, -1)  # the last is for -1
        place[used] = np.arange(len(used))
        column = place[column]
        dense = column >= 0
        weights = np.zeros((hi - lo, len(used)), np.float32)
        weights[row[dense], column[dense]] = weight[dense]
        reach = weights @ (p.matrix if len(used) == len(p.matrix) else p.matrix[used])
        reach *= np.float32(SUMMED)
        other, at_row, by = term[~dense], row[~dense] * width, weight[~dense]
        n = p.edge[other + 1] - p.edge[other]
        total = np.zeros((hi - lo) * width)
        for part in parts(n):
            post = ranges(p.edge[other[part]], p.edge[other[part] + 1])
            cell = p.docs.take(post)
            cell += np.repeat(at_row[part], n[part])
            impact = p.impact.take(post)
            impact *= np.repeat(by[part], n[part])
            total += np.bincount(cell, impact, len(total))
        total = total.reshape(hi - lo, width)
        reach = reach + total
        by_row = np.zeros((hi - lo, len(p.block_max)))
        by_row[row[dense], p.row[term[dense]]] = weight[dense]
        least = np.array([_least(best, self.k) for best, _ in self.best[lo:hi]])
        for i in np.flatnonzero((least <= 0) & (reach > 0).any(1)):  # no threshold yet
            docs = _highest(reach[i], np.flatnonzero(reach[i] > 0), 4 * self.k)
            self._take(p, lo + i, self._exact(p, by_row, total, np.full(len(docs), i), docs), docs)
            reach[i, docs] = 0.0
            least[i] = _least(self.best[lo + i][0], self.k)
        rows, docs = np.nonzero(reach >= np.where(least > 0, least, SLACK)[:, None])
        full = self._exact(p, by_row, total, rows, docs)
        high = np.round(full, 6) >= least[rows]
        rows, docs, full = rows[high], docs[high], full[high]
        edge = np.searchsorted(rows, np.arange(hi - lo + 1))
        for i in np.flatnonzero(np.diff(edge)):
            self._take(p, lo + i, full[edge[i] : edge[i + 1]], docs[edge[i] : edge[i + 1]])

    def _take(self, p: Postings, i: int, full: np.ndarray, docs: np.ndarray) -> None:
        best, ids = self.best[i]
        self.best[i] = _merged(np.round(full, 6), p.ids[docs], p.distinct, self.k, best, ids, _least(best, self.k))

    @staticmethod
    def _exact(p: Postings, by_row: np.ndarray, total: np.ndarray, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a document: ``total`` and the lists with a weight in ``by_row``, a bounded number of postings at a time."""
        full, first = total[rows, docs], p.doc_edge[docs]
        n = p.doc_edge[docs + 1] - first
        for part in parts(n):
            some = part.start + np.flatnonzero(n[part])
            if len(some):
                post = ranges(first[some], first[some] + n[some])
                each = by_row.ravel().take(np.repeat(rows[some] * by_row.shape[1], n[some]) + p.of_doc.take(post))
                each *= p.doc_impact.take(post)
                full[some] += np.add.reduceat(each, np.cumsum(n[some]) - n[some])
        return full

    def found(self) -> pa.RecordBatch:
        names = np.repeat(self.queries, [len(s) for s, _ in self.best])
        score, doc = (np.concatenate(x) for x in zip(*self.best, strict=True))
        return pa.record_batch([pa.array(names, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "doc_id", "score"])


def _search(k: int, mean_length: float):
    """Rows sorted by slot, shard and bucket -> the best documents of every slot; a slot's queries (shard -1) come first."""

    def run(batches: Batches) -> Batches:
        now, parts, search = None, [], None

        def take() -> None:
            nonlocal search
            table = pa.Table.from_batches(parts)
            if now[1] < 0:
                search = BlockSearch(table, k, mean_length)
            elif search is not None:
                search.visit(table)

        for batch in batches:
            slot, shard = batch["slot"].to_numpy(), batch["shard"].to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (shard[1:] != shard[:-1]), [True]])) if len(slot) else []
            for i, j in zip(edge, edge[1:], strict=False):
                key = int(slot[i]), int(shard[i])
                if key != now:
                    if parts:
                        take()
                    if now is not None and key[0] != now[0]:
                        if search is not None:
                            yield search.found()
                        search = None
                    now, parts = key, []
                parts.append(batch.slice(i, j - i))
        if parts:
            take()
        if search is not None:
            yield search.found()

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, query_terms: int | None = None, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` for ``queries(query_id, text)`` over ``docs(doc_id, text)``."""
    if shard_docs > 1 << 16:
        raise ValueError("shard_docs must fit 16 bits")
    rows = "shard long, bucket int, terms array<long>, n array<long>, docs binary, counts binary"
    index = staged(table_input(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(_index(shard_docs, shard_words), rows), "index")
    tables = index.where("bucket is null")
    stats = tables.agg(*[F.coalesce(F.sum(F.get("n", F.lit(i))), F.lit(0)).alias(x) for i, x in enumerate(("docs", "words"))], F.count("*").alias("shards")).first()
    words = index.where("bucket is not null").select(F.inline(F.arrays_zip(F.col("terms").alias("term"), "n"))).groupBy("term").agg(F.sum("n").alias("df"))
    q = table_input(queries, "query_id", "text").where("query_id is not null").mapInArrow(per_batch(_query_words), "query_id long, word binary, term long, tf long")
    q = q.groupBy("query_id", "word", "term").agg(F.sum("tf").alias("tf")).join(words, "term")
    idf = F.log(1 + (F.lit(float(stats["docs"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    q = q.withColumn("weight", idf)
    if query_terms is not None:
        best = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("tf") * F.col("weight"), 9)), "word")
        q = q.withColumn("place", F.row_number().over(best)).where(F.col("place") <= query_terms)
    blocks = max(1, -(-queries.count() // query_block))
    ways = max(WAYS, -(-stats["shards"] // SHARDS_A_TASK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    asked = staged(q.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("asked")).withColumn("block", block), "queries")
    # a slot is a block of queries and a share of the shards: the block's queries go there once, not once a shard
    slot = lambda of: F.col("block") * ways + of
    way = F.pmod(F.shiftright("shard", 24) + F.col("shard").bitwiseAND((1 << 24) - 1), F.lit(ways))  # round robin over partitions and their shards
    # each slot has a partition of its own: keys that hash to different ones
    n = blocks * ways
    home = docs.sparkSession.range(40 * n + 400).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).agg(F.min("id").cast("int").alias("key")).orderBy("p").collect()
    home = {r.p: r.key for r in home}
    homes = F.array(*[F.lit(home.get(i, i)).cast("int") for i in range(n)])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None)
    bucket = F.shiftrightunsigned("term", 64 - BUCKET_BITS).cast("int").alias("bucket")
    wanted = asked.select("block", F.explode("asked.term").alias("term")).groupBy(bucket).agg(F.collect_set("block").alias("blocks"))  # one row a bucket
    no_query = [none.cast("long").alias("query_id"), none.cast(asked.schema["asked"].dataType).alias("asked")]
    of_index = lambda rows: rows.select(slot(way).alias("slot"), *index.columns, *no_query)
    hit = of_index(index.join(F.broadcast(wanted), "bucket").withColumn("block", F.explode("blocks")))
    own = of_index(tables.withColumn("block", each(blocks)))
    no_postings = [none.cast(index.schema[c].dataType).alias(c) for c in index.columns if c != "shard"]
    to_all = asked.withColumn("way", each(ways)).select(slot(F.col("way")).alias("slot"), F.lit(-1).cast("long").alias("shard"), *no_postings, "query_id", "asked")
    found = (
        hit.unionByName(own).unionByName(to_all).withColumn("home", F.element_at(homes, F.col("slot").cast("int") + 1)).repartition(n, "home").drop("home")
        .sortWithinPartitions("slot", "shard", F.asc_nulls_last("bucket")).mapInArrow(_search(k, stats["words"] / max(stats["docs"], 1)), "query_id long, doc_id long, score double")
    )
    best = found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long"), "doc_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every document whose id is divisible by 50."""
    docs = read(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL),
len AS (SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM w GROUP BY 1) USING (doc_id)),
st AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
idf AS (SELECT word, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY word, docs),
q AS (SELECT doc_id AS query_id, word, idf FROM tf JOIN idf USING (word) WHERE doc_id % 50 = 0),
s AS (SELECT query_id, tf.doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
      FROM q JOIN tf USING (word) JOIN len USING (doc_id), st GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s
QUALIFY rank <= 10
"""
