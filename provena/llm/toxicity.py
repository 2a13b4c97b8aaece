"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses.  Words become a few symbols (insult, threat, target,
negation, reported speech; everything else is passed over), and four weighted
transducers are composed into one machine that scores the matches of a clause:

* the core transducer emits the weight of an insult or threat,
* the target transducer raises it if the clause addresses someone (before or
  after the match: it guesses and must see the target by the clause's end),
  and lets a threat without a target count little,
* the negation transducer lowers what follows a negation in the clause,
* the report transducer lowers what follows a verb of saying in the sentence.

A clause's score is the best path's sum (max-plus), a document's features are the
sum, the maximum and the number of its matched clauses, and a logistic function
fitted on labelled documents turns them into a score.

The insult lexicon is learned: words and word beginnings whose documents are
labelled toxic more often than chance allows (a G test at 0.05 over all candidates),
on a sample of at most ``max_train`` labelled documents (the bound of the model),
one of each group of near copies.  Half of the sample gives the lexicon, half
the logistic weights.  A short fixed list in four languages is always known.

Null and empty texts have no match.  Rows are scored one by one; labels that are
null or missing teach nothing; without labels the fixed list and weights serve.  An
empty table gives an empty result; a caller's columns are carried along, but for a column ``score``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .common import carried, read, restored, staged, table_input
from .tokens import forget, remembered
from .words import WordHasher, Windows, lower_space_words, mix, per_batch, utf8

MAX_TRAIN, PREFIXES = 20_000, (4, 5, 6, 7)

#: The words every lexicon knows.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash clown pathetic worthless disgusting imbecile bastard bitch asshole retard "
    "arschloch schlampe dummkopf abschaum hurensohn connard salope abruti ordure imbécile idiota imbécil estúpido cabrón pendejo escoria".split()
)
THREATS = frozenset("kill hurt destroy beat stab shoot murder burn töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your you're yourself u ya du dich dir dein deine ihr euch tu te toi ton vous votre tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never don't isn't aren't won't nicht kein keine nie niemals ne pas jamais aucun nunca jamás".split())
REPORTS = frozenset("said says say told wrote quoted claimed called reported sagte sagt schrieb nannte dit déclaré écrit dijo dice escribió llamó".split())
LANGUAGE_WEIGHT = 3.0
#: Symbols: insult, threat, target, negation, report, soft and hard clause end.
I, T, Y, N, R, C, E = "itynrce"
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?|[.,;:!?\n\"“”«»()]")
HARD = frozenset(".!?\n;")


class Transducer:
    """arcs: (state, symbol) -> [(state, factor)]; symbols without an arc keep the state at factor 1."""

    def __init__(self, start: str, finals: set[str], arcs: dict[tuple[str, str], list[tuple[str, float]]]):
        self.start, self.finals, self.arcs = start, finals, arcs

    def step(self, state: str, symbol: str) -> list[tuple[str, float]]:
        return self.arcs.get((state, symbol), [(state, 1.0)])

    def compose(self, other: Transducer) -> Transducer:
        """The product machine: factors multiply."""
        arcs, todo, seen = {}, [(self.start, other.start)], set()
        while todo:
            a, b = pair = todo.pop()
            if pair in seen:
                continue
            seen.add(pair)
            for s in (I, T, Y, N, R, C, E):
                arcs[a + b, s] = [(x + y, f * g) for x, f in self.step(a, s) for y, g in other.step(b, s)]
                todo += [(x, y) for x, _ in self.step(a, s) for y, _ in other.step(b, s)]
        return Transducer(self.start + other.start, {a + b for a, b in seen if a in self.finals and b in other.finals}, arcs)


TARGET = Transducer(
    "0", {"0", "1"},
    {("0", I): [("0", 1.0), ("g", 1.5)], ("0", T): [("0", 0.2), ("g", 2.0)], ("0", Y): [("1", 1.0)], ("1", I): [("1", 1.5)], ("1", T): [("1", 2.0)],
     ("g", I): [("g", 1.5)], ("g", T): [("g", 2.0)], ("g", Y): [("1", 1.0)], ("1", C): [("0", 1.0)], ("1", E): [("0", 1.0)], ("g", C): [], ("g", E): []},
)
NEGATION = Transducer("0", {"0", "1"}, {("0", N): [("1", 1.0)], ("1", I): [("0", 0.4)], ("1", T): [("0", 0.3)], ("1", C): [("0", 1.0)], ("1", E): [("0", 1.0)]})
REPORT = Transducer("0", {"0", "1"}, {("0", R): [("1", 1.0)], ("1", I): [("1", 0.6)], ("1", T): [("1", 0.5)], ("1", E): [("0", 1.0)]})
GRAMMAR = TARGET.compose(NEGATION).compose(REPORT)


def clause_scores(symbols: list[tuple[str, float]], grammar: Transducer = GRAMMAR) -> Iterator[float]:
    """Best path sums of the clauses that have a match; ``symbols`` are (symbol, weight)."""
    now, matched = {grammar.start: 0.0}, False
    for s, w in [*symbols, (E, 0.0)]:
        nxt: dict[str, float] = {}
        for state, total in now.items():
            for to, factor in grammar.step(state, s):
                value = total + factor * w
                if value > nxt.get(to, -1.0):
                    nxt[to] = value
        now, matched = nxt, matched or s in (I, T)
        if s in (C, E):
            if matched:
                yield max(v for k, v in now.items() if k in grammar.finals)
            now, matched = {k: 0.0 for k in now}, False


class Reader(dict):
    """word -> (symbol, weight) or None, by the lexicon's words and beginnings."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        for words, s in ((THREATS, T), (TARGETS, Y), (NEGATIONS, N), (REPORTS, R)):
            self.update({w: (s, LANGUAGE_WEIGHT if s == T else 0.0) for w in words})
        self.update({w: (I, max(LANGUAGE_WEIGHT, lexicon.get(w, 0.0))) for w in INSULTS})
        self.update({c: (E if c in HARD else C, 0.0) for c in ".,;:!?\n\"“”«»()"})
        self.fixed = dict(self)

    def __missing__(self, word: str):
        if len(self) > 150_000:
            self.clear()
            self.update(self.fixed)
            if word in self:
                return self[word]
        weight = self.lexicon.get(word)
        if weight is None:
            weight = next((x for n in reversed(PREFIXES) if len(word) > n and (x := self.lexicon.get(word[:n] + "*")) is not None), None)
        self[word] = got = None if weight is None else (I, weight)
        return got


def features(text: str | None, reader: Reader) -> tuple[float, float, float]:
    """log(1 + sum), max and log(1 + number) of the clause scores."""
    symbols = [s for s in map(reader.__getitem__, TOKEN.findall((text or "").lower())) if s is not None]
    if not any(s in (I, T) for s, _ in symbols):
        return 0.0, 0.0, 0.0
    scores = list(clause_scores(symbols))
    return math.log1p(sum(scores)), max(scores), math.log1p(len(scores))


def _sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Training rows with a one-value MinHash, equal for most near copies, and their distinct words."""
    hasher, windows = WordHasher(), Windows()
    sketch, words = [], []
    for text in utf8(batch["text"]):
        h = hasher(lower_space_words(text))
        g = windows.all(h, min(5, len(h))) if len(h) else h
        sketch.append(int(mix(g).min() >> np.uint64(1)) if len(g) else 0)
        words.append(sorted(set(TOKEN.findall((text or b"").decode("utf-8", "replace").lower()))))
    return pa.record_batch([pa.array(sketch, pa.int64()), batch["toxic"], batch["text"], pa.array(words, pa.list_(pa.string()))], names=["sketch", "toxic", "text", "words"])


def _learn_lexicon(rows: DataFrame) -> dict[str, float]:
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total["n"] or 0, total["t"] or 0
    if not 0 < t < n:
        return {}
    word = rows.select("toxic", F.explode("words").alias("w")).where("length(w) > 2").groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).withColumn("forms", F.lit(1))
    starts = F.transform(F.filter(F.array(*map(F.lit, PREFIXES)), lambda k: k < F.length("w")), lambda k: F.concat(F.substring("w", F.lit(1), k), F.lit("*")))
    start = word.select(F.explode(starts).alias("w"), "n", "t").groupBy("w").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.count("*").alias("forms")).where("forms > 1")
    both = word.unionByName(start)
    p = t / n
    rate = F.col("t") / F.col("n")
    part = lambda k, q: F.when(k > 0, k * F.log(k / (F.col("n") * q))).otherwise(0.0)
    g = 2 * (part(F.col("t"), p) + part(F.col("n") - F.col("t"), 1 - p))
    weight = F.log((F.col("t") + p) / (F.col("n") - F.col("t") + 1 - p)) - math.log(p / (1 - p))
    scored = staged(both.where((F.col("n") >= 3) & (rate > min(0.5, 3 * p))).select("w", weight.alias("weight"), g.alias("g")), "lexicon")
    candidates = both.where("n >= 3").count()
    least = 2 * math.log(max(candidates, 2) / 0.05)
    top = scored.where(F.col("g") >= least).orderBy(F.desc("g"), "w").collect()  # bounded by the sample
    return {r.w: min(6.0, r.weight) for r in top if r.weight > 0}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 40) -> np.ndarray:
    """Logistic weights by Newton's method; the last is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


def _features_of(lexicon):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        reader = _reader(lexicon)
        got = [features(t, reader) for t in batch["text"].to_pylist()]
        cols = [pa.array(c, pa.float64()) for c in (zip(*got, strict=True))]
        return pa.record_batch([*cols, batch["toxic"]], names=["a", "b", "c", "toxic"])

    return per_batch(run)


_READERS = remembered({})


def _reader(lexicon) -> Reader:
    """One reader for a broadcast lexicon in a worker.  It is kept with the lexicon: the id of a freed one would be given again."""
    key = id(lexicon)
    if key not in _READERS:
        forget()
        _READERS[key] = lexicon, Reader(lexicon.value)
    return _READERS[key][1]


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """The model: lexicon and logistic weights.  ``labels`` holds only rows that may be learned from."""
    spark = docs.sparkSession
    known = table_input(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # bounded, so it may be broadcast
    text = table_input(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    rows = staged(text.mapInArrow(per_batch(_sketched), "sketch long, toxic long, text string, words array<string>").dropDuplicates(["sketch"]), "training")
    half = F.pmod(F.xxhash64("sketch"), F.lit(2))
    lexicon = _learn_lexicon(rows.where(half == 0))
    shared = spark.sparkContext.broadcast(lexicon)
    got = rows.where(half == 1).select("text", "toxic").mapInArrow(_features_of(shared), "a double, b double, c double, toxic long").collect()
    y = np.array([r.toxic for r in got], float)
    weights = np.array([0.5, 0.4, 0.5, -3.0])
    if len(y) and 0 < y.sum() < len(y):
        weights = _fit(np.array([[r.a, r.b, r.c] for r in got]), y)
    return {"lexicon": lexicon, "weights": weights}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with a column score (0 to 1)."""
    own = carried(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model["lexicon"])
    w = model["weights"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        reader = _reader(shared)
        x = np.array([features(t, reader) for t in batch["text"].to_pylist()]).reshape(-1, 3)
        p = 1 / (1 + np.exp(-np.clip(x @ w[:3] + w[3], -30, 30)))
        return pa.record_batch([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])

    out = own.mapInArrow(per_batch(run), T_.StructType([*own.schema, T_.StructField("score", T_.DoubleType())]))
    return restored(out, docs, "text", without=("score",), extra=("score",))


def held_out(doc_id: str = "doc_id", remainder: int = 0):
    """Is crc32 of the doc_id's text mod 5 the remainder (a null id is not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold."""
    model = train(docs, labels.where(~held_out()))
    return restored(score(carried(docs, "text"), model).where(F.col("score") < threshold), docs, "text")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels").where(~held_out()))
    rated = score(docs, model)
    return rated.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
