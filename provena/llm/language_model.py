r"""N-gram language-model scores from a sharded Elias-Fano trie.

Model: trigrams over words that back off, with pseudo-counts k2 and k3:
``p(w | u, v) = c(u, v, w) / (c(u, v) + k3)`` for a trigram that was seen, else
``k3 / (c(u, v) + k3) * p(w | v)``; ``p(w | v)`` alike with k2 from bigrams down to
``p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))`` with every word's own count.  A text's first word has the context
"beginning" and no trigram.  What a seen successor would get of the backed-off mass is
left out, so the probabilities after a context add up to a little less than one; in return the
logarithm of each is a sum of parts that need one count each:

* ``log c(u, v, w)``, ``log c(v, w)`` and ``log (c(v) + k2)`` are known where v's tokens are,
* ``log (c(v, w) + k3)`` is the part of the *next* token, whose context is (v, w),
* ``log p(w)`` is known where w is the context, and asked for only where the bigram is new.

So neither the model nor the documents pass through one machine: every token of a document goes,
packed with others of its batch, to the shard of the word before it (v); tokens after very common words
are dealt on by w as well.  A shard counts the training tokens, builds its part of the trie
and answers all of its tokens by successor search.  Trie levels: words v as an
Elias-Fano sequence, their successors w, and the words u before (v, w).  Pointers to a node's children are
Elias-Fano sequences; children are stored relative to their node, so a level is
monotone as a whole; log probabilities are quantised.  The levels lie in a memory-mapped
file of the task that builds and asks them.  Sums of training documents come back added up,
tokens of others one by one with the count of v, and each batch's collector
puts its documents together.  Shards hold a bounded number of tokens, so more input means more shards.

Broadcast are the words that make up at least ``rare`` of all tokens (at most 1 / ``rare``, 16 MB): they get
short codes and, where hot, totals.  Scores do not depend on that table.  A word outside it precedes under
``rare * N`` tokens (10 million of 10**13), which bounds a shard.

Tokens: A-Z lower-cased words ``[^\x20\x09-\x0D]+`` and one end per text.  Null
texts are empty (their end only).  Rows with a null doc_id are scored and count as training.
Repeated rows are scored one by one.  An empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, staged, table_input
from .words import U64, Batches, WordHasher, lower_space_words, mix, per_batch, pressed, released, signed, utf8

K2, K3, RARE, SHARD_TOKENS, BATCH_TOKENS, BATCH_DOCS = 200.0, 3.0, 2.0**-20, 1_500_000, 1_000_000, 32_000
END, BEGIN = U64(0xE5D0E5D0E5D0E5D0), U64(0xB0551B0551B0551B)
QUANTA = 2048.0  # steps per unit of log10
HELD = np.uint32(1 << 31)


_ONES = np.array([x.bit_count() for x in range(256)], np.uint8)  # of a byte, and below the place of its r-th one, first bit first
_PLACE = np.array([(p := [i for i in range(8) if x >> (7 - i) & 1]) + [0] * (8 - len(p)) for x in range(256)], np.uint8)


def _select(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th one (from 0) in each row of eight bytes."""
    upto = np.cumsum(_ONES[rows], axis=1, dtype=np.uint8)
    byte = np.minimum((upto <= r[:, None]).sum(axis=1), 7)
    each = np.arange(len(rows))
    inside = r - np.where(byte > 0, upto[each, byte - 1], 0)
    return byte * 8 + _PLACE[rows[each, byte], np.clip(inside, 0, 7)]


class EliasFano:
    """A monotone sequence of uint64 in compact, memory-mapped arrays."""

    def __init__(self, values: np.ndarray, keep):
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low = max(0, (top // max(1, self.n)).bit_length() - 1)
        high = (values >> U64(self.low)).astype(np.int64) + np.arange(self.n)
        bits = np.zeros((int(high[-1]) + 2 if self.n else 1) + 63 >> 6 << 6, bool)
        bits[high] = True
        self.bits = keep(np.packbits(bits))
        ones = np.add.reduceat(bits, np.arange(0, len(bits), 64), dtype=np.int64)
        self.zeros = keep(np.concatenate([[0], np.cumsum(64 - ones)]).astype(np.int64))
        self.ones = keep(np.concatenate([[0], np.cumsum(ones)]).astype(np.int64))
        self.words = keep(self._packed(values & U64((1 << self.low) - 1)))

    def _packed(self, x: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(2, U64)
        place = np.arange(self.n, dtype=U64) * U64(self.low)
        word, shift = (place >> U64(6)).astype(np.int64), place & U64(63)
        out = np.zeros(self.n * self.low // 64 + 2, U64)
        np.bitwise_or.at(out, word, x << shift)
        over = shift + U64(self.low) > U64(64)
        np.bitwise_or.at(out, word[over] + 1, x[over] >> (U64(64) - shift[over]))
        return out

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), U64)
        place = i.astype(U64) * U64(self.low)
        word, shift = (place >> U64(6)).astype(np.int64), place & U64(63)
        left = np.where(shift > 0, self.words[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return ((self.words[word] >> shift) | left) & U64((1 << self.low) - 1)

    def _ones_before_zero(self, k: np.ndarray) -> np.ndarray:
        """Number of elements before the k-th zero of the high bits (k from 0)."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        word = np.minimum(word, len(self.zeros) - 2)
        at = _select(~self.bits.reshape(-1, 8)[word], k - self.zeros[word])
        return np.where(k >= self.zeros[-1], self.n, word * 64 + at - k)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at the places i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        at = _select(self.bits.reshape(-1, 8)[word], i - self.ones[word])
        return (word * 64 + at - i).astype(U64) << U64(self.low) | self.lows(i)

    def find(self, x: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
        """Index of the first element >= x (the successor); n if there is none."""
        return np.concatenate([self._find(x[i : i + chunk]) for i in range(0, len(x), chunk)]) if len(x) else np.zeros(0, np.int64)

    def _find(self, x: np.ndarray) -> np.ndarray:
        high = (x >> U64(self.low)).astype(np.int64)
        lo = np.where(high > 0, self._ones_before_zero(np.maximum(high - 1, 0)), 0)
        hi = self._ones_before_zero(high)
        want = x & U64((1 << self.low) - 1)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo


class Level:
    """Children of the nodes of the level above: a node's children are consecutive and ascending.

    They are stored plus an offset, the last child of all nodes before, so that the level is one monotone sequence.
    """

    def __init__(self, parent: np.ndarray, child: np.ndarray, parents: int, keep):
        first = np.searchsorted(parent, np.arange(parents + 1))
        self.pointers = EliasFano(first.astype(U64), keep)
        last = np.zeros(parents, U64)
        some = first[1:] > first[:-1]
        last[some] = child[first[1:][some] - 1].astype(U64) + U64(1)
        offset = np.concatenate([[U64(0)], np.cumsum(last, dtype=U64)])[:-1]
        self.children = EliasFano(child.astype(U64) + offset[parent], keep)

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Place of each child below its parent, -1 if it is not there; parents of -1 have none."""
        out = np.full(len(parent), -1)
        ask = np.flatnonzero(parent >= 0)
        if not len(ask) or not self.children.n:
            return out
        lo, hi = self.pointers.get(parent[ask]).astype(np.int64), self.pointers.get(parent[ask] + 1).astype(np.int64)
        offset = np.where(lo > 0, self.children.get(np.maximum(lo - 1, 0)) + U64(1), U64(0))
        want = offset + child[ask].astype(U64)
        i = self.children.find(want)
        hit = (i < hi) & (self.children.get(np.minimum(i, self.children.n - 1)) == want)
        out[ask[hit]] = i[hit]
        return out


class Trie:
    """Words v -> successors w -> words u before them, from training counts; memory-mapped.

    ``pair`` are (context number << 32 | word number), ``triple`` (pair number << 32 | code of u), both ascending.
    """

    def __init__(self, contexts: np.ndarray, total: np.ndarray, pair: np.ndarray, pair_n: np.ndarray, triple: np.ndarray, triple_n: np.ndarray, k2: float, k3: float):
        self.file = tempfile.TemporaryFile()  # noqa: SIM115  gone with the trie
        self.contexts = EliasFano(contexts, self._map)
        below = lambda x, n: Level((x >> U64(32)).astype(np.int64), x & U64(0xFFFFFFFF), n, self._map)
        self.bigrams, self.trigrams = below(pair, len(contexts)), below(triple, len(pair))
        of = (pair >> U64(32)).astype(np.int64)
        self.back = self._quantised(np.log10(k2) - np.log10(total + k2))
        self.bigram = self._quantised(np.log10(pair_n) - np.log10(total[of] + k2))
        self.next = self._quantised(-np.log10(pair_n + k3))
        self.trigram = self._quantised(-np.log10(triple_n))

    def _quantised(self, log: np.ndarray) -> np.ndarray:
        """Logarithms from 0 down to -32 in 16 bits; the few below (counts beyond 10**32) don't occur."""
        return self._map(np.round(-log * QUANTA).astype(np.uint16))

    def _map(self, x: np.ndarray) -> np.ndarray:
        if not x.size:
            return x
        at = self.file.seek(0, 2)
        at += -at % 64
        self.file.seek(at)
        self.file.write(np.ascontiguousarray(x).tobytes())
        self.file.flush()
        return np.memmap(self.file, x.dtype, "r", at, x.shape)

    def values(self, level: np.ndarray, at: np.ndarray, otherwise: float) -> np.ndarray:
        return np.where(at >= 0, level[np.maximum(at, 0)].astype(float) / -QUANTA, otherwise) if len(level) else np.full(len(at), otherwise)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the contexts (hashes) and of the bigrams; -1: not in the trie."""
        if not self.contexts.n:
            return np.full(len(context), -1), np.full(len(context), -1)
        i = self.contexts.find(context)
        at = np.where((i < self.contexts.n) & (self.contexts.get(np.minimum(i, self.contexts.n - 1)) == context), i, -1)
        return at, self.bigrams.find(at, word)


@dataclass
class Totals:
    """Corpus totals and the bounded table of common words (sorted hashes)."""

    n: int
    v: int
    train_docs: int
    hashes: np.ndarray
    counts: np.ndarray
    shards: int

    def __post_init__(self):
        self.denominator = self.n + 0.5 * (self.v + 1)
        hot = self.counts >= max(2, self.n // (4 * self.shards))
        self.hot = np.union1d(self.hashes[hot], BEGIN)

    def log_p(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / self.denominator)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Common words: their place in the table; others: 47 bits of the hash above."""
        i = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        known = self.hashes[i] == h if len(self.hashes) else np.zeros(len(h), bool)
        return np.where(known, i.astype(U64), h >> U64(17) | U64(1 << 47))


def _word_counts(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    hasher = WordHasher()
    found = [hasher(lower_space_words(t)) for t in utf8(batch["text"])]
    key, n = np.unique(np.concatenate(found), return_counts=True)
    return pa.record_batch([signed(key), pa.array(n.astype(np.int64))], names=["word", "c"])


def totals(docs: DataFrame, rare: float = RARE, shard_tokens: int = SHARD_TOKENS) -> Totals:
    """Counts over all training texts; of single words only those with c >= rare * N reach the driver (at most 1 / rare)."""
    train = docs.where("train")
    counts = staged(train.select("text").mapInArrow(per_batch(_word_counts), "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    t = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    n, v = (t["n"] or 0) + ends, t["v"] + (ends > 0)
    top = counts.where(F.col("c") >= max(2.0, rare * n)).toPandas()
    h = np.append(top["word"].to_numpy(np.int64).view(U64), END)
    c = np.append(top["c"].to_numpy(np.int64), ends)
    order = np.argsort(h)
    return Totals(n, v, ends, h[order], c[order], max(1, -(-int(n * 1.3) // shard_tokens)))


_NAMES = ["batch", "kind", *"abcdefg"]
_KINDS = (pa.int64(), pa.int32(), *(pa.binary(),) * 7)
_PACKED = "batch long, kind int, " + ", ".join(f"{x} binary" for x in "abcdefg")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    rows = [(*r, *[None] * (len(_KINDS) - len(r))) for r in rows]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES) if rows else pa.record_batch([pa.array([], k) for k in _KINDS], names=_NAMES)


def _deal(shared):
    """Documents -> packed tokens for each shard (kind 0), and each batch's document table for its collector (kind 1)."""

    def run(batches: Batches) -> Batches:
        hasher, t = WordHasher(), shared.value
        number = TaskContext.get().partitionId() << 24

        def packed(ids: list, train: list, words: list[np.ndarray]):
            size = np.array([len(w) for w in words])
            v = np.concatenate([x for w in words for x in ([BEGIN], w)]).astype(U64)
            w = np.concatenate([x for w in words for x in (w, [END])]).astype(U64)
            code, before = t.codes(w), t.codes(v)
            u = np.append(np.uint32(0), np.where(before >> U64(47), before >> U64(16), before)[:-1].astype(np.uint32))
            doc = np.repeat(np.arange(len(words), dtype=np.uint32), size + 1)
            who = np.where(np.repeat(np.array(train, bool), size + 1), doc, HELD | np.arange(len(v), dtype=np.uint32))
            where = np.where(np.isin(v, t.hot), mix(v ^ mix(w)), mix(v))
            shard = (where % U64(t.shards)).astype(np.int32)
            order = np.lexsort((v, shard))
            v, code, u, who, shard = v[order], code[order], u[order], who[order], shard[order]
            edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            rows, shards = [], []
            for lo, hi in zip(edge, [*edge[1:], len(shard)], strict=True):
                part = v[lo:hi]
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                runs = np.diff(np.append(first, len(part))).astype(np.uint32)
                low, high = (code[lo:hi] & U64(0xFFFFFFFF)).astype(np.uint32), (code[lo:hi] >> U64(32)).astype(np.uint16)
                rows.append((number, 0, part[first].tobytes(), *map(pressed, (runs, low, high, u[lo:hi], who[lo:hi]))))
                shards.append(int(shard[lo]))
            known = np.array([i is not None for i in ids])
            rows.append((number, 1, np.array([i or 0 for i in ids], np.int64).tobytes(), known.tobytes(), np.array(train, bool).tobytes(), size.astype(np.int64).tobytes()))
            out = _rows(rows)
            return pa.record_batch([pa.array([*shards, number % t.shards], pa.int32()), *out.columns], names=["shard", *_NAMES])

        ids, train, words, held = [], [], [], 0
        for batch in batches:
            for i, y, text in zip(batch["doc_id"].to_pylist(), batch["train"].to_pylist(), utf8(batch["text"]), strict=True):
                ids.append(i)
                train.append(y)
                words.append(hasher(lower_space_words(text)))
                held += len(words[-1])
                if held >= BATCH_TOKENS or len(ids) >= BATCH_DOCS:
                    yield packed(ids, train, words)
                    number += 1
                    ids, train, words, held = [], [], [], 0
        if ids:
            yield packed(ids, train, words)

    return run


def _shard(shared, k2: float, k3: float):
    """One shard: count, build the trie, answer every token; sums of training documents (kind 0), tokens of others (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        t: Totals = shared.value
        out: list[tuple] = []
        parts = []
        for batch, kind, *x in zip(*(table[c].to_pylist() for c in _NAMES), strict=True):
            if kind:
                out.append((batch, 1, *x))
            else:
                parts.append((batch, np.frombuffer(x[0], U64), *(released(y, d) for y, d in zip(x[1:6], (np.uint32, np.uint32, np.uint16, np.uint32, np.uint32), strict=True))))
        del table
        if parts:
            parts.sort(key=lambda p: p[0])
            contexts = np.unique(np.concatenate([p[1] for p in parts]))
            at = np.concatenate([np.repeat(np.searchsorted(contexts, p[1]), p[2]) for p in parts]).astype(np.int32)
            code = np.concatenate([p[4].astype(U64) << U64(32) | p[3] for p in parts])
            u, who = np.concatenate([p[5] for p in parts]), np.concatenate([p[6] for p in parts])
            row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[3]) for p in parts])
            batches = [p[0] for p in parts]
            del parts
            train = who < HELD
            words, word = np.unique(code, return_inverse=True)
            del code
            pair, of_pair = np.unique(at.astype(U64) << U64(32) | word.astype(U64), return_inverse=True)
            del word
            triple, of_triple = np.unique(of_pair.astype(U64) << U64(32) | u, return_inverse=True)
            del u
            pair_n, triple_n = np.bincount(of_pair[train], minlength=len(pair)), np.bincount(of_triple[train], minlength=len(triple))
            total = np.bincount(at[train], minlength=len(contexts))
            hot = np.isin(contexts, t.hot)  # their tokens lie in several shards; the table knows their totals
            i = np.minimum(np.searchsorted(t.hashes, contexts[hot]), len(t.hashes) - 1)
            total[hot] = np.where(contexts[hot] == BEGIN, t.train_docs, t.counts[i])
            # the trie holds what was seen in training
            seen1, seen2, seen3 = total > 0, pair_n > 0, triple_n > 0
            place1, place2 = np.cumsum(seen1) - 1, np.cumsum(seen2) - 1
            renumbered = lambda x, place: place[(x >> U64(32)).astype(np.int64)].astype(U64) << U64(32) | (x & U64(0xFFFFFFFF))
            trie = Trie(contexts[seen1], total[seen1], renumbered(pair[seen2], place1), pair_n[seen2], renumbered(triple[seen3], place2), triple_n[seen3], k2, k3)
            context = (pair >> U64(32)).astype(np.int64)
            number = (pair & U64(0xFFFFFFFF)).astype(np.int64)
            node, bigram = trie.find(contexts[context], number)
            log_pair = np.where(bigram >= 0, trie.values(trie.bigram, bigram, 0.0), trie.values(trie.back, node, 0.0))
            begins = contexts[context] == BEGIN
            ends = words[number] == t.codes(np.array([END]))[0]
            following = np.where(ends, 0.0, trie.values(trie.next, bigram, -np.log10(k3)))
            of = (triple >> U64(32)).astype(np.int64)
            trigram = trie.trigrams.find(bigram[of], triple & U64(0xFFFFFFFF))
            log_p = np.where(begins[of], log_pair[of], np.where(trigram >= 0, -trie.values(trie.trigram, trigram, 0.0), np.log10(k3) + log_pair[of])) + following[of]
            del triple, trigram, following
            is_word = contexts != BEGIN
            base = np.where(is_word, t.log_p(total), 0.0)
            slot, back = np.unique(row[train].astype(np.int64) << 32 | who[train], return_inverse=True)
            sums = np.bincount(back, log_p[of_triple[train]]), np.bincount(back, base[at[train]])
            edge = np.searchsorted(slot, np.arange(len(batches) + 1) << 32)
            rest = np.flatnonzero(~train)
            own = np.searchsorted(row[rest], np.arange(len(batches) + 1))
            for k, batch in enumerate(batches):
                lo, hi = edge[k], edge[k + 1]
                if hi > lo:
                    out.append((batch, 0, (slot[lo:hi] & 0xFFFFFFFF).astype(np.uint16).tobytes(), sums[0][lo:hi].astype(np.float32).tobytes(), sums[1][lo:hi].tobytes()))
                j = rest[own[k] : own[k + 1]]
                if len(j):
                    new = bigram[of_pair[j]] < 0
                    out.append((batch, 2, *map(pressed, (who[j] ^ HELD, log_p[of_triple[j]].astype(np.float32), new, np.where(is_word[at[j]], total[at[j]], 0)))))
        return pa.Table.from_batches([_rows(out)])

    return run


def _collect(shared):
    """One batch of documents: add up what the shards found."""

    def run(table: pa.Table) -> pa.Table:
        t: Totals = shared.value
        rows = [*zip(*(table[c].to_pylist() for c in _NAMES[1:]), strict=True)]
        own = next(r for r in rows if r[0] == 1)
        ids, known, train, size = np.frombuffer(own[1], np.int64), np.frombuffer(own[2], bool), np.frombuffer(own[3], bool), np.frombuffer(own[4], np.int64)
        score, base, n = np.zeros(len(ids)), np.zeros(len(ids)), np.where(train, size, 0)
        for r in sorted((r for r in rows if r[0] == 0), key=lambda r: r[1:4]):
            i = np.frombuffer(r[1], np.uint16)
            score[i] += np.frombuffer(r[2], np.float32)
            base[i] += np.frombuffer(r[3], np.float64)
        doc = np.repeat(np.arange(len(ids)), size + 1)
        log_p, new, count = np.zeros(len(doc)), np.zeros(len(doc), bool), np.full(len(doc), t.train_docs)
        for r in (r for r in rows if r[0] == 2):
            at = released(r[1], np.uint32).astype(np.int64)
            log_p[at], new[at] = released(r[2], np.float32), released(r[3], bool)
            first = np.append(True, doc[1:] != doc[:-1])[at]  # a text's first token has no word before it
            count[at[~first] - 1] = released(r[4], np.int64)[~first]
        held = ~train[doc]
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
        log_1 = t.log_p(count)
        score += np.bincount(doc[held], (log_p + np.where(new, log_1, 0.0))[held], len(ids))
        word = held & ~last
        base += np.bincount(doc[word], log_1[word], len(ids)) + t.log_p(np.array(t.train_docs))
        n = n + np.bincount(doc[word], count[word] > 0, len(ids)).astype(np.int64) + (t.train_docs > 0)
        return pa.table(
            [pa.array(ids, mask=~known), pa.array(~train), pa.array(size + 1), pa.array(n), pa.array(np.full(len(ids), t.n)), pa.array(base), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score_texts(docs: DataFrame, k2: float = K2, k3: float = K3, rare: float = RARE, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Scores of ``docs(doc_id, text, train)``; the model learns from rows where ``train`` is true."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train"))
    shared = spark.sparkContext.broadcast(totals(docs, rare, shard_tokens))
    dealt = docs.mapInArrow(_deal(shared), f"shard int, {_PACKED}")
    sums = dealt.groupBy("shard").applyInArrow(_shard(shared, k2, k3), _PACKED)
    return sums.groupBy("batch").applyInArrow(_collect(shared), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_input(read(spark, sf_dir, "documents"), "doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return score_texts(docs.withColumn("train", ~held))
