"""Names against names: phrases inside texts and the most similar names, exact for a stated set of terms against all rows.

The set goes out in blocks of a fixed size, so its length costs passes and never memory; the other side is scanned where
it lies.  Null and empty texts, names and patterns match nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.operators.kept import kept

BLOCK_PATTERNS, BLOCK_TERMS, BINS = 200_000, 20_000, 64
DEALT, POOL, SEEDS, AT_ONCE = 50_000, 200_000, 128, 4096  # names a task gets and looks at together, those of a first look, and names compared at a time
Batches = Iterator[pa.RecordBatch]


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two strings, 0 to 1: half the transposed letters count (rounded down), a common head of up to four letters only above 0.7."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, same = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                same.append(x)
                break
    if not same:
        return 0.0
    m, swaps = len(same), sum(x != y for x, y in zip(same, (b[j] for j in range(len(b)) if used[j]), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    head = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + head * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _rows(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, letters by bin and first four letters of many names."""
    size = np.fromiter(map(len, names), np.int64, len(names))
    code = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(names)), size)
    letters = np.bincount(row * BINS + code % BINS, minlength=len(names) * BINS).reshape(-1, BINS).astype(np.int32)
    at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    head = np.full((len(names), 4), -1)
    first = at < 4
    head[row[first], at[first]] = code[first]
    return size, letters, head


def similarity_bounds(term: str, size: np.ndarray, letters: np.ndarray, head: np.ndarray) -> np.ndarray:
    """What the similarity of a term and each name can be at most, from lengths, shared letters and the common head."""
    return _bounds(*(x[0] for x in _rows([term])), size, letters, head)


def _bounds(n: int, own: np.ndarray, first: np.ndarray, size: np.ndarray, letters: np.ndarray, head: np.ndarray) -> np.ndarray:
    shared = np.minimum(letters, own).sum(1)
    jaro = np.where(shared > 0, (shared / n + shared / np.maximum(size, 1) + 1) / 3, 0.0)
    same = np.cumprod((head == first) & (first >= 0), axis=1).sum(1)
    return np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro)


def similarities(term: str, codes: np.ndarray) -> np.ndarray:
    """``jaro_winkler`` of a term and many names of one length, rows of letters' codes."""
    own = np.frombuffer(term.encode("utf-32-le"), np.uint32)
    count, width = codes.shape
    reach = max(len(own), width) // 2 - 1
    rows, used, met = np.arange(count), np.zeros(codes.shape, bool), np.zeros((count, len(own)), bool)
    for i, x in enumerate(own):
        lo, hi = max(0, i - reach), min(width, i + reach + 1)
        if lo >= hi:
            continue
        hit = codes[:, lo:hi] == x
        hit &= ~used[:, lo:hi]
        at = hit.argmax(1)
        met[:, i] = hit[rows, at]
        used[rows, lo + at] |= met[:, i]
    m = met.sum(1)
    k = min(len(own), width)
    of_term = own[np.argsort(~met, axis=1, kind="stable")[:, :k]]
    of_name = np.take_along_axis(codes, np.argsort(~used, axis=1, kind="stable")[:, :k], 1)
    swaps = ((of_term != of_name) & (np.arange(k) < m[:, None])).sum(1) // 2
    most = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / len(own) + m / width + (m - swaps) / most) / 3, 0.0)
    start = min(4, k)
    head = np.cumprod(codes[:, :start] == own[:start], axis=1).sum(1)
    out = np.where(jaro > 0.7, jaro + head * 0.1 * (1 - jaro), jaro)
    if len(own) == width:
        out[(codes == own).all(1)] = 1.0
    return out


class _Pool:
    """Names in groups of the same length, letters and head, which have the same bound."""

    def __init__(self, ids: list, names: list[str]):
        size, letters, head = _rows(names)
        kinds = np.flatnonzero(letters.any(0))
        rng = np.random.default_rng(7)
        draw = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64)
        key = size.astype(np.uint64) * draw(1) + letters[:, kinds].astype(np.uint64) @ draw(len(kinds)) + (head + 1).astype(np.uint64) @ draw(4)
        first, group = np.unique(key, return_index=True, return_inverse=True)[1:]
        if (letters != letters[first][group]).any() or (head != head[first][group]).any() or (size != size[first][group]).any():
            first = group = np.arange(len(names))  # unlike names with one key
        order = np.argsort(group, kind="stable")
        self.size, self.letters, self.head, self.kinds = size[first], np.ascontiguousarray(letters[first][:, kinds]), head[first], kinds
        self.edge = np.append(0, np.cumsum(np.bincount(group, minlength=len(first))))
        self.ids = [ids[i] for i in order]
        ordered = [names[i] for i in order]
        self.code = np.frombuffer("".join(ordered).encode("utf-32-le"), np.uint32)
        self.at = np.append(0, np.cumsum(size[order]))

    def look(self, term: str, shape: tuple, found: list, floor: float, k: int, first: bool) -> None:
        """Bring the ``found`` pairs (-similarity, id) of a term up to date; nothing under ``floor`` is needed.  A ``first`` look compares the most promising names only."""
        n, own, head = shape
        bound = _bounds(n, own[self.kinds], head, self.size, self.letters, self.head)
        least = max(floor, -found[k - 1][0] if len(found) >= k else 0.0)
        able = np.flatnonzero(bound >= max(least, bound.max() if first else 0.0) - 1e-9)
        able = able[np.argsort(-bound[able], kind="stable")]
        seen, want = 0, SEEDS if first else 8 * k
        while seen < len(able):
            if bound[able[seen]] < least - 1e-9 or bound[able[seen]] <= 0:
                break
            # groups of one length, some more every time
            upto, total, width = seen, 0, self.size[able[seen]]
            while upto < len(able) and total < want and self.size[able[upto]] == width and bound[able[upto]] >= least - 1e-9:
                total += int(self.edge[able[upto] + 1] - self.edge[able[upto]])
                upto += 1
            members = np.concatenate([np.arange(self.edge[g], self.edge[g + 1]) for g in able[seen:upto]])
            members = members[:SEEDS] if first else members
            for lo in range(0, len(members), AT_ONCE):
                part = members[lo : lo + AT_ONCE]
                value = np.round(similarities(term, self.code[self.at[part][:, None] + np.arange(width)]), 9)
                for i in np.flatnonzero((value >= least - 1e-9) & (value > 0)).tolist():
                    found.append((-float(value[i]), self.ids[part[i]]))
                best: dict = {}  # an id's best name counts
                for x, name in sorted(found):
                    best.setdefault(name, x)
                    if len(best) == k:
                        break
                found[:] = [(x, name) for name, x in best.items()]
                least = max(floor, -found[k - 1][0] if len(found) >= k else 0.0)
            if first:
                break
            seen, want = upto, min(want * 8, AT_ONCE)


def _nearest(block, k: int, first: bool):
    def run(batches: Batches) -> Batches:
        terms, floors = block.value
        shapes = list(zip(*_rows(terms), strict=True)) if terms else []
        best: list[list[tuple[float, int]]] = [[] for _ in terms]
        kind, ids, names = None, [], []

        def look() -> None:
            pool = _Pool(ids, names)
            for found, term, shape, floor in zip(best, terms, shapes, floors, strict=True):
                pool.look(term, shape, found, floor, k, first)

        for batch in batches:
            kind = batch["id"].type
            ids += batch["id"].to_pylist()
            names += batch["name"].to_pylist()
            if len(names) >= POOL:
                look()
                ids, names = [], []
        if names:
            look()
        rows = [(t, i, -s) for t, found in zip(terms, best, strict=True) for s, i in found]
        if rows:
            t, i, s = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(t), pa.array(i, kind), pa.array(s, pa.float64())], names=["term", "id", "similarity"])

    return run


def nearest_names(terms: DataFrame, names: DataFrame, k: int = 3, block: int = BLOCK_TERMS) -> DataFrame:
    """``(term, id, similarity)``: the ``k`` ids of ``names(id, name)`` whose names are most similar to each distinct term; ties by id.

    Names of the same letters go to one task and have the same bound on their similarity.  A first look at the most promising names of every
    task tells what the k-th similarity is at least; then each task compares the names whose bound reaches that, and the
    tasks' best are merged.  An id with several names has its best one.
    """
    spark = terms.sparkSession
    asked = kept(terms.select("term").where(F.length("term") > 0).distinct())
    blocks = max(1, -(-asked.count() // block))
    pool = names.select("id", "name").where(F.col("id").isNotNull() & (F.length("name") > 0))
    tasks = max(spark.sparkContext.defaultParallelism, -(-pool.count() // DEALT))
    pool = kept(pool.repartition(tasks, F.array_sort(F.split("name", ""))))
    kinds = f"term string, id {names.schema['id'].dataType.simpleString()}, similarity double"
    order = Window.partitionBy("term").orderBy(F.desc("similarity"), "id")

    def best(found: DataFrame) -> DataFrame:
        one = found.groupBy("term", "id").agg(F.max("similarity").alias("similarity"))
        return one.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")

    out = None
    for b in range(blocks):
        mine = sorted(r.term for r in asked.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).collect())
        seeds = pool.mapInArrow(_nearest(spark.sparkContext.broadcast((mine, [0.0] * len(mine))), k, True), kinds)
        sure = best(seeds).groupBy("term").agg(F.min("similarity").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        floor = {r.term: r.least for r in sure.collect()} if mine else {}
        found = pool.mapInArrow(_nearest(spark.sparkContext.broadcast((mine, [floor.get(t, 0.0) for t in mine])), k, False), kinds)
        out = found if out is None else out.unionByName(found)
    return best(out)


def _inside(block, whole: bool):
    state: dict = {}

    def load() -> None:
        automaton, keyed, number = ahocorasick.Automaton(), defaultdict(list), {}
        for group, patterns in block.value:
            for p in patterns:
                number.setdefault(p, len(number))
            keyed[number[max(patterns, key=len)]].append((group, frozenset(number[p] for p in patterns)))
        for p, i in number.items():
            automaton.add_word(p, (i, len(p)))
        automaton.make_automaton()
        state.update(automaton=automaton, keyed=keyed)

    def edge(c: str) -> bool:
        return not ("a" <= c <= "z" or "0" <= c <= "9")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not block.value:
                return
            if not state:
                load()
            keys, groups = [], []
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                hits = set()
                for end, (i, size) in state["automaton"].iter(text):
                    if not whole or (end - size < 0 or edge(text[end - size])) and (end + 1 == len(text) or edge(text[end + 1])):
                        hits.add(i)
                for i in hits:
                    for group, needed in state["keyed"].get(i, ()):
                        if needed <= hits:
                            keys.append(key)
                            groups.append(group)
            yield pa.record_batch([pa.array(keys, batch["key"].type), pa.array(groups, pa.string())], names=["key", "group"])

    return run


def all_inside(texts: DataFrame, groups: DataFrame, whole: bool, block: int = BLOCK_PATTERNS) -> DataFrame:
    """``(key, group as text)`` of ``texts(key, text)`` and ``groups(group, patterns)`` where every pattern of the group occurs in the text.

    Patterns and texts are taken as they are (fold both first); ``whole``: only between characters other than a-z and 0-9.
    The patterns of a block are one Aho-Corasick automaton that reads each text once; a group is looked at where its
    longest pattern was found.
    """
    spark = texts.sparkSession
    usable = groups.select(F.col("group").cast("string").alias("group"), F.array_distinct(F.filter("patterns", lambda p: F.length(p) > 0)).alias("patterns")).where((F.size("patterns") > 0) & F.col("group").isNotNull()).distinct()
    total = usable.agg(F.sum(F.size("patterns"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    scanned = texts.select("key", "text").where(F.length("text") > 0)
    kinds = f"key {texts.schema['key'].dataType.simpleString()}, group string"
    out = None
    for b in range(blocks):
        rows = usable.where(F.pmod(F.xxhash64("group"), F.lit(blocks)) == b).collect()
        found = scanned.mapInArrow(_inside(spark.sparkContext.broadcast([(r.group, list(r.patterns)) for r in rows]), whole), kinds)
        out = found if out is None else out.unionByName(found)
    return out
