"""The pipeline's stages in order on planted documents, against brute force, with clashing columns and empty tables."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.llm import decontaminate, near_dedup, substring_dedup, toxicity
from provena.llm.tokens import tokenizer, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n))


SHARED, ITEM = prose(900, 60), prose(901, 30)
EXACT = prose(1, 200)
NEAR = EXACT.split()
NEAR[100] = "changed"
PLANTED = {
    1: EXACT, 2: EXACT, 3: " ".join(NEAR), 4: prose(4, 80) + " " + SHARED, 5: prose(5, 90) + " " + SHARED + " " + prose(55, 20),
    6: prose(6, 40) + " " + " ".join(ITEM.split()[5:17]).upper() + " tail", 7: "You are an idiot, you moron! You stupid, pathetic clown. You are scum! " + prose(7, 20), 8: prose(8, 300), 9: "", 10: None,
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in PLANTED.items()], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_whole_pipeline(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    # toxicity takes 7, near dedup 2 and 3 (and no blank text), substring dedup the passage of 5, decontamination 6
    left = {1: EXACT, 4: PLANTED[4], 5: PLANTED[5].replace(SHARED + " ", ""), 8: PLANTED[8], 9: "", 10: ""}
    t = tokenizer(vocabulary_path(), False)
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in left.items()}
    pieces: dict = {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert pieces.keys() == left.keys()
    for i, x in pieces.items():
        ends = np.cumsum([n for _, n in sorted(x)])
        assert [s for s, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] == len(ids[i])


def test_stages_keep_columns_of_any_name(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name in ("tag", "spans", "n_words", "items", "score", "kept", "n_removed", "ids", "bands", "content", "class_id", "toxic"):
        docs = docs.withColumn(name, F.struct(F.col("doc_id").alias("was")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.dtypes == docs.dtypes, name
        assert out.where("tag.was <> doc_id or score.was <> doc_id or kept.was <> doc_id").count() == 0, name
        assert stage(spark, docs.where("false"), tables).count() == 0, name


def test_stages_keep_repeated_and_null_ids(spark, tables):
    rows = [(1, "one two three four five six"), (1, "another text of the same id"), (None, "x y"), (None, None), (2, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in near_dedup.one_of_each(docs).collect()) == [(0, ""), (0, "x y"), (1, "another text of the same id"), (1, "one two three four five six")]
    # a near copy under an id that also has another text: the class keeps its smallest id, the other text stays
    words = prose(77, 60).split()
    many = spark.createDataFrame([(5, " ".join(words)), (5, "unlike " + prose(78, 60)), (9, " ".join(words[:-1])), (5, " ".join(words)), (9, prose(79, 60))], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:6]) for r in near_dedup.one_of_each(many).collect()) == sorted([(5, words[0]), (5, "unlike"), (9, prose(79, 60)[:6])])
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    assert decontaminate.clean(docs, bench).count() == substring_dedup.clean(docs).count() == 5
    assert toxicity.reject_toxic(docs, spark.read.parquet(f"{tables}/labels.parquet")).count() == 5


def test_grammar_decides(spark):
    """The machines' say, on planted sentences: the same insults and threats, told apart only by their clauses."""
    d = "/root/testdata/sf0.01"
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    pairs = [("You are stupid.", "You are not stupid."), ("You pathetic clown!", "They said: pathetic clown."), ("I will kill you.", "The plants kill weeds."), ("You moron", "Never a moron")]
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[2 * i] > got[2 * i + 1] for i in range(len(pairs)))
    # without the machines they would be the same
    flat = toxicity.Transducer("0", {"0"}, {})
    weigh = lambda t, g: max(toxicity.clause_scores([s for s in map(toxicity.Reader(model["lexicon"]).__getitem__, toxicity.TOKEN.findall(t.lower())) if s], g))
    for a, b in (("You are stupid.", "You are not stupid."), ("You pathetic clown!", "They said: pathetic clown.")):
        assert weigh(a, flat) == weigh(b, flat) and weigh(a, toxicity.GRAMMAR) > weigh(b, toxicity.GRAMMAR)
