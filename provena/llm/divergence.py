"""Source divergence audit: how far the sources of a language differ from each other in their terms.

Counting goes by sorted pointers.  A task looks at slices of its Arrow text buffers in place: every place where a word
starts is a pointer, pointers are ordered by the group of their row, then a multikey sort (eight bytes of the words
at a time, stable, only what is still equal goes on to the next eight) brings equal words together.  Within the run of
a word the pointers of a group are one stretch, its length the source's count and its number of distinct rows the
document frequency.  Spark adds the slices' counts up.

Shares are compared in blocks: the terms of a language are dealt to blocks of about ``CELLS`` (term, source) cells,
each block gets the sizes of all sources and returns its part of every pair's sum and its own best terms per source.
So a language or source of any share is spread over many tasks; a block returns one row per pair of sources, as the
result itself has.

Null text, lang and source count as ''.  A document counts once for its language whatever repeats in it; rows that
repeat a doc_id are documents of their own.  A text without terms still makes its group; a language without kept terms
(V = 0) gives pairs of value 0 and no terms.  A language of one source has no pairs.  Empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, staged
from .words import Batches

LEAST_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
SLICE_BYTES, CELLS = 16 << 20, 1 << 15

#: For the term rule [^\x00-\x40\x5B-\x60\x7B-\x7F]+ after lower-casing A-Z: every other byte becomes zero.
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0 for c in range(256)], np.uint8)
_FIRST = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * n)) - 1) for n in range(9)], np.uint64)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column, without copying the texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return places, np.frombuffer(data or b"", np.uint8)


def word_pointers(lowered: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words of a slice whose rows start at ``rows`` (its last entry is the end)."""
    inside = np.concatenate([lowered != 0, [False]])
    starts, ends = inside.copy(), ~inside
    starts[1:] &= ~inside[:-1]
    ends[1:] &= inside[:-1]
    ends[0] = False
    borders = rows[(rows > 0) & (rows < len(lowered))]
    joined = np.unique(borders[inside[borders] & inside[borders - 1]])  # one row ends and the next begins inside a word
    starts[joined] = True
    at, to = np.flatnonzero(starts), np.flatnonzero(ends)
    return at, (np.sort(np.concatenate([to, joined])) if len(joined) else to) - at


def multikey_sorted(lowered: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pointers' stable order by word and, in that order, the places where a new word begins."""
    eights = np.ndarray((len(lowered) + 1,), ">u8", np.concatenate([lowered, np.zeros(8, np.uint8)]), strides=(1,))
    key = lambda p, depth: eights[starts[p] + depth].astype(np.uint64) & _FIRST[np.minimum(lengths[p] - depth, 8)]
    order = np.arange(len(starts))
    k = key(order, 0)
    by = np.argsort(k, kind="stable")
    order, k = order[by], k[by]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    depth, open_ = 8, np.flatnonzero(lengths[order] >= 8)  # a word that ends here comes before its continuations
    while len(open_):
        run = np.cumsum(new)[open_]
        k = key(order[open_], depth)
        by = np.lexsort((k, run))
        order[open_] = order[open_][by]
        k, run = k[by], run[by]
        new[open_] |= np.concatenate([[True], (k[1:] != k[:-1]) | (run[1:] != run[:-1])])
        depth += 8
        open_ = open_[lengths[order[open_]] >= depth]
    return order, np.flatnonzero(new)


def _slice_counts(lowered: np.ndarray, rows: np.ndarray, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words, groups, counts and document frequencies of a slice."""
    starts, lengths = word_pointers(lowered, rows)
    if not len(starts):
        return [], *[np.zeros(0, np.int64)] * 3
    row = np.searchsorted(rows, starts, "right") - 1
    by = np.argsort(group[row], kind="stable")
    starts, lengths, row = starts[by], lengths[by], row[by]
    order, words = multikey_sorted(lowered, starts, lengths)
    row = row[order]
    g = group[row]
    new = np.zeros(len(order), bool)
    new[words] = True
    stretch = new.copy()
    stretch[1:] |= g[1:] != g[:-1]
    document = stretch.copy()
    document[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(stretch)
    raw = lowered.tobytes()
    first = order[at]
    names = [raw[s : s + n] for s, n in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)]
    return names, g[at], np.diff(np.append(at, len(order))), np.add.reduceat(document.astype(np.int64), at)


def _counts(batches: Batches) -> Batches:
    for batch in batches:
        if not batch.num_rows:
            continue
        pair = pa.StructArray.from_arrays([batch["lang"], batch["source"]], ["lang", "source"])
        table = pa.table({"lang": batch["lang"], "source": batch["source"]}).group_by(["lang", "source"]).aggregate([])
        number = {(a, b): i for i, (a, b) in enumerate(zip(table["lang"].to_pylist(), table["source"].to_pylist(), strict=True))}
        group = np.array([number[x["lang"], x["source"]] for x in pair.to_pylist()], np.uint16 if len(number) < 1 << 16 else np.int64)
        offsets, data = _buffers(batch["text"])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
            names, g, n, docs = _slice_counts(_LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], group[lo:hi])
            yield pa.record_batch(
                [table["lang"].combine_chunks().take(pa.array(g)), table["source"].combine_chunks().take(pa.array(g)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
            lo = hi


def named(docs: DataFrame) -> DataFrame:
    """``(text, lang, source)`` with nulls as ''."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of every term in every group."""
    found = named(docs).mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """``1 + floor(10^9 * (count + 5) / (total + 5 * v))``, exact for totals under 9 * 10^15: three decimals at a time."""
    below = total + SMOOTHING * v
    whole, rest = np.divmod(count + SMOOTHING, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + more
    return 1 + whole


def _compared(top: int):
    """One block: partial sums of all pairs of sources and the best terms of each source."""

    def run(table: pa.Table) -> pa.Table:
        head = table.filter(pa.compute.is_null(table["term"])).sort_by("source")
        body = table.filter(pa.compute.is_valid(table["term"]))
        sources, total, v = head["source"].to_pylist(), head["n"].to_numpy(), head["v"][0].as_py()
        terms = pa.compute.unique(body["term"]).sort()
        count = np.zeros((len(terms), len(sources)), np.int64)
        at, of = pa.compute.index_in(body["term"], terms).to_numpy(), pa.compute.index_in(body["source"], head["source"]).to_numpy()
        count[at, of] = body["n"].to_numpy()
        out: list[list] = [[], [], [], []]
        p = shares(count, total, v) if v else count
        q = shares(count.sum(1), total.sum(), v) if v else count.sum(1)
        names = terms.to_pylist()
        for i, source in enumerate(sources):
            value = np.abs(p - p[:, i : i + 1]).sum(0)
            for j in range(len(sources)):
                if j != i:
                    for column, x in zip(out, (source, "pair", sources[j], int(value[j])), strict=True):
                        column.append(x)
            f = p[:, i] - q
            more = np.flatnonzero((count[:, i] > 0) & (f > 0))
            for t in more[np.argsort(-f[more], kind="stable")][:top]:  # terms are in order, so ties are too
                for column, x in zip(out, (source, "term", names[t], int(f[t])), strict=True):
                    column.append(x)
        return pa.table([pa.array([table["lang"][0].as_py()] * len(out[0]), pa.string()), *(pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True))], names=["lang", "source", "part", "item", "value"])

    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source against the others of its language, and its most over-represented terms."""
    by_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumn("df", F.sum("docs").over(by_term)).where(F.col("df") >= least_docs)
    kept = staged(counted.select("lang", "source", "term", "n"), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = staged(named(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    v = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("s")).join(v, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) * F.col("s") / cells)).alias("blocks"))
    langs = staged(langs, "languages")
    cells_of = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n", "v")
    heads = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), "n", "v")
    schema = "lang string, source string, part string, item string, value long"
    parts = staged(cells_of.unionByName(heads).groupBy("lang", "block").applyInArrow(_compared(top), schema), "compared")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS t FROM d),
kept AS (SELECT lang, t FROM o GROUP BY lang, t HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS n FROM o SEMI JOIN kept USING (lang, t) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
p AS (SELECT lang, source, t, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM x JOIN v USING (lang)),
q AS (SELECT lang, t, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, t, sum(n) AS n FROM x GROUP BY ALL) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
