"""Literal fixtures of cards, costs, excerpts and file plans."""

import pytest
from pyspark.sql import functions as F

from provena.operators import cards, excerpts, usage


def test_costs_of_cached_prompts(spark):
    d = spark.createDataFrame([(100, 10, None, 2.0, 4.0, 0.5), (0, 0, 0, 2.0, 2.0, 2.0)], "i long, w long, r long, rate double, wr double, rr double")
    got = [tuple(x.p) for x in d.select(usage.prompt_value(*[F.col(c) for c in d.columns]).alias("p")).collect()]
    assert got[0] == (-240.0, -110, 240 / 110) and got[1][2] == 2.0


def test_calls_without_a_run_belong_to_any(spark):
    e = spark.createDataFrame([(1, 1, "a", None, 5), (1, 2, None, None, 7), (1, 3, "a", "tool", 9), (1, 4, "b", None, 2)], "conv_id int, idx int, run string, kind string, output_tokens int")
    runs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "conv_id int, run string")
    assert {r.run: r.call and r.call.idx for r in usage.final_calls(e, runs).collect()} == {"a": 2, "b": 4, "c": None}
    assert {r.idx: r.before for r in usage.outputs_before(e).collect()} == {1: 0, 2: 5, 3: 12, 4: 7}


def test_bad_json_and_cursors(spark):
    d = spark.createDataFrame([("[{\"k\": 1}]", "eyJ2YWx1ZSI6IjEiLCJ0aWUiOiIyIn0="), ("x", "%%"), (None, None)], "j string, c string")
    got = d.select(F.size(usage.events_of("j", "struct<k:bigint>")).alias("n"), usage.cursor_of("c")["tie"].alias("t")).collect()
    assert [tuple(r) for r in got] == [(1, "2"), (0, None), (0, None)]


def test_grades(spark):
    i = spark.createDataFrame([(e, k, v) for e, row in {1: (10, 10, 10), 2: (11, 9, 10), 3: (11, 50, 50), 4: (99, 99, 99)}.items() for k, v in enumerate(row)], "entity int, indicator int, value int")
    p = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a int, b int")
    assert {r.b: r.grade for r in cards.similarity_grade(i, p).collect()} == {2: "equivalent", 3: "close", 4: "distant"}


def test_one_event_for_a_sentence_of_two_themes(spark):
    s = spark.createDataFrame([("f", "t", 1, "s1", 8.0), ("f", "t", 2, "s2", 8.0), ("f", "u", 2, "s2", 9.0), ("f", "v", 1, "weak", 6.0)], "file string, theme string, page int, sentence string, score double")
    c = spark.createDataFrame([("f", t, p, p2) for t in "tuv" for p, p2 in ((1, 2), (2, 1))], "file string, theme string, page int, place int")
    best = excerpts.best_excerpts(s, c, ["file", "theme"], "page").withColumn("year", F.lit(2020))
    got = excerpts.excerpt_events(best, "year", "theme", "file", "page").collect()
    assert [(r.sentence, r.themes, r.points) for r in got] == [("s2", ["t", "u"], 10.0)]


def test_missing_metadata_and_groups_are_errors(spark):
    f = spark.createDataFrame([("a/1",), ("b/2",)], "path string")
    with pytest.raises(Exception, match="no metadata: b/2"):
        excerpts.with_metadata(f, f.where("path = 'a/1'")).collect()
    assert excerpts.with_metadata(f, f).select("area").distinct().count() == 2
    with pytest.raises(ValueError, match="missing groups: two"):
        excerpts.merged_groups({"one": f, "two": None}, ["path"])


def test_empty_tables(spark):
    o = spark.createDataFrame([], "id int, alias string, year int")
    assert cards.entity_card(o.select("id"), o, o, F.lit(True)).count() == 0
    pages = spark.createDataFrame([], "report int, page int, pos int")
    assert excerpts.candidate_pages([pages, pages], ["report"], "page").count() == 0
