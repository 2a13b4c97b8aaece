"""Edge cases (nulls, blanks, repeats, empty tables, clashing columns), brute force and exact round trips."""

import glob
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from provena.llm import chat_format, decontaminate, html_extract, language_model, near_dedup, packing, search, substring_dedup, token_scan, toxicity
from provena.llm.html_extract import extract, main_text
from provena.llm.tokens import WordEncoder, tokenizer, vocabulary_path

LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [(1, LONG, "x"), (2, "start " + LONG, "x"), (3, None, "x"), (4, "", "x"), (5, "  \n ", "x"), (5, "one two", "x"), (None, LONG, "x"), (1, LONG, "x"), (7, "Ünï " * 3000, "x")]


def same_as_sql(spark, sf_dir, query, sql, keys):
    got = query(spark, sf_dir).toPandas()
    with duckdb.connect() as c:
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            at = f"{path}/*.parquet" if os.path.isdir(path) else path
            c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{at}'")
        want = c.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = lambda x: x[sorted(want.columns)].sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_words string")  # n_words clashes with a result column


def test_substring_dedup(spark, docs):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(0, 120, 0), (1, 120, 0), (1, 120, 0), (2, 121, 120), (3, 0, 0), (4, 0, 0), (5, 0, 0), (5, 2, 0), (7, 3000, 0)]
    assert substring_dedup.remove_repeats(docs.where("false")).count() == 0
    # every anchor is resolved by windows instead of automata: the same result
    again = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, shard_contexts=1).collect())
    assert again == got


def test_suffix_automaton_against_brute_force():
    rng = np.random.default_rng(1)
    texts = [[b"ab"[i : i + 1] for i in rng.integers(0, 2, 60)] for _ in range(6)]
    a = substring_dedup.SuffixAutomaton()
    for n, t in enumerate(texts):
        a.add(t, n)
    a.close()
    for t in texts:
        want = [min(n for n, u in enumerate(texts) if any(u[j : j + 6] == t[i : i + 6] for j in range(len(u)))) for i in range(len(t) - 5)]
        assert a.first_documents(t, 6) == want


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(20, 35)), 0), (2, "two", 0), (3, None, 0), (4, "...", 0)], "item_id long, text string, items int")
    got = sorted((r.doc_id or 0, r.n_words, len(r.spans), r["items"]) for r in decontaminate.contamination(docs, bench).collect())
    assert [x for x in got if x[3]] == [(0, 120, 6, [1]), (1, 120, 6, [1]), (1, 120, 6, [1]), (2, 121, 6, [1]), (5, 2, 1, [2])]
    blocks = sorted((r.doc_id or 0, r.n_words, len(r.spans), r["items"]) for r in decontaminate.contamination(docs, bench, block_words=20).collect())
    assert blocks == got
    assert decontaminate.contamination(docs, bench.where("false")).where("size(items) > 0").count() == 0
    assert decontaminate.clean(docs, bench).count() == 4


def test_near_dedup(spark, docs):
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in near_dedup.near_duplicate_classes(docs).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (5, 5), (7, 7)]
    assert near_dedup.near_duplicate_classes(docs.where("false")).count() == 0
    assert near_dedup.one_of_each(docs).where("doc_id in (1, 2)").count() == 1


def test_near_dedup_in_a_group_of_one_template(spark):
    # 400 documents of one template (mostly J < 0.8 to each other), then 20 planted pairs that differ in one of 20 slots
    rng = np.random.default_rng(2)
    draw = lambda: (rng.random(20) < 0.15).astype(int)
    slots = [draw() for _ in range(400)]
    for _ in range(20):
        y = draw()
        z = y.copy()
        z[rng.choice(np.flatnonzero(y == 0))] = 1
        slots += [y, z]
    texts = [" ".join(f"s{i}v{x}w{j}" for i, x in enumerate(v) for j in range(8)) for v in slots]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    own = list(range(len(texts)))  # no shingle occurs twice in a text, so the plain Jaccard is the exact one
    for i, g in enumerate(grams):
        for j in range(i):
            if 5 * len(g & grams[j]) >= 4 * len(g | grams[j]) and own[i] != own[j]:
                low, high = sorted((own[i], own[j]))
                own = [low if x == high else x for x in own]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(d).collect()} == dict(enumerate(own))


def test_probability_jaccard_and_sketch():
    x = (np.array([1, 2, 3], np.uint64), np.array([1.0, 2.0, 1.0]))
    y = (np.array([2, 3, 4], np.uint64), np.array([1.0, 1.0, 2.0]))
    want = sum(1 / sum(max(a / p, b / q) for a, b in ((1, 0), (2, 1), (1, 1), (0, 2))) for p, q in ((2, 1), (1, 1)))
    assert near_dedup.probability_jaccard(x, y) == pytest.approx(want)
    doc = np.array([0, 0, 0, 1, 1, 1])
    sig = near_dedup.prob_minhash(doc, np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05


def test_chat_format_round_trip(spark):
    rows = [(1, 0, "user", "a\\<|im_end|>\n"), (1, 1, "assistant", None), (2, None, None, "x"), (2, 1, "assistant", "y"), (2, 2, "assistant", "y"), (3, 0, "user\nx", "only")]
    t = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = chat_format.format_examples(t)
    whole = out.groupBy("conv_id").agg(F.max_by("formatted", "n_context").alias("whole")).select("conv_id", chat_format.parse(F.col("whole")).alias("turns"))
    got = {r.conv_id: [(x.role, x.text) for x in r.turns] for r in whole.collect()}
    assert got == {1: [("user", "a\\<|im_end|>\n"), ("assistant", "")], 2: [("", "x"), ("assistant", "y"), ("assistant", "y")], 3: [("user\nx", "only")]}
    assert out.where("trainable").count() == 3 and out.where("not trainable").count() == 1
    assert chat_format.format_examples(t.where("false")).count() == 0


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies.</div><div id=c><h2>Head line</h2><p>First para&shy;graph, with text, and more; indeed a good deal of it here.<p>Second&nbsp;one <b>is</b>n't short either, as you can see.</div><div class=comments><p>Nice, really, thanks a lot for this one!</p></div><form>Mail <input></form><footer>&copy; x</footer>"
    assert main_text(page) == "Head line First para\xadgraph, with text, and more; indeed a good deal of it here. Second one isn't short either, as you can see."
    d = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (3, "", "<p", 0)], "page_id long, url string, html string, n_chars int")
    assert [r.n_chars for r in extract(d).orderBy("page_id").collect()] == [len(main_text(page)), 0, 0]
    assert extract(d.where("false")).count() == 0


P = "<p>" + "A sentence, with a few words; more of it here. " * 4 + "</p>"


@pytest.mark.parametrize(
    ("page", "times"),
    [
        (f'<div class="wrapper has-sidebar"><article>{P}</article></div>', 1), (f'<div class="layout no-ads">{P * 3}</div>', 3), (f"<form id=aspnet><div>{P * 3}</div></form>", 3),
        (f"<article><a name=top>{P}{P}</article>", 2), (f'<article><a href="x">open {P}{P}</article>', 2), (f'<body><article>{P}</article><article>{P}</article><div class="comments">{P}</div></body>', 2),
        (f'<article><section id="related-work"><h2>Related work</h2>{P}</section>{P}</article>', 2), (f'<div class="sidebar-wrapper"><div class="content">{P * 4}</div></div>', 4),
        (f'<body><main>{P * 2}</main><aside>{P}</aside><div class="related"><a href=a>{"Other things to read, at length. " * 3}</a></div></body>', 2),
    ],
)
def test_html_keeps_whole_articles(page, times):
    assert main_text(page).count("A sentence") == 4 * times and "Other things" not in main_text(page)


PROSE = "One of the long sentences, with commas, of the article: it goes on for a while, and then it ends. "


def test_html_scores_choose_the_nodes(monkeypatch):
    """Pages without semantic tags, or with one that is wrong: a constant score gives another text."""
    lines = "".join(f"<div class=row>Item number {i} of the stock list</div>" for i in range(40))
    body = "".join(f"<div class=para>{PROSE}{i}.</div>" for i in range(6))
    want = " ".join(f"{PROSE}{i}." for i in range(6))
    pages = {
        "lines before": f"<body><div id=x>{lines}</div><div id=y>{body}</div></body>", "lines after": f"<body><div id=y>{body}</div><div id=x>{lines}</div></body>",
        "wrong article": f"<body><article>{lines.replace('div', 'p')}</article><div id=y>{body}</div></body>",
    }
    assert {k: main_text(x) for k, x in pages.items()} == dict.fromkeys(pages, want)
    monkeypatch.setattr(html_extract, "path_scores", lambda found: [1.0] * len(found))
    assert all(main_text(x) != want for x in pages.values())


def test_html_keeps_linked_entries_and_second_articles():
    first = "".join(f"<p>{PROSE}</p>" for _ in range(9))
    listed = "<ul><li><a href=/x>Linked item</a></li></ul><table><tr><td><a href=/y>Linked cell</a></td></tr></table>"
    nine = " ".join([PROSE.strip()] * 9)
    assert main_text(f"<body><article>{first}{listed}</article></body>") == nine + " Linked item Linked cell"
    second = f"<article><h2>Second</h2><p>{PROSE}</p><p>Short end.</p></article>"
    assert main_text(f"<body><article>{first}</article>{second}</body>") == f"{nine} Second {PROSE.strip()} Short end."
    card = f"<article><h3><a href=/z>Elsewhere</a></h3><p>{PROSE}</p></article>"
    assert main_text(f"<body><article>{first}</article>{card}</body>") == nine
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Topic {i}</a></li>" for i in range(5)) + "</ul>"
    assert main_text(f"<body><div id=c>{menu}{first}<ul><li>Plain</li><li><a href=/q>Linked</a></li><li>Plain too</li></ul></div></body>").endswith("Plain Linked Plain too")
    assert main_text(f"<body><div id=c>{menu}{first}</div></body>") == nine


def test_html_of_a_very_long_page():
    assert main_text(f"<body><div id=c>{''.join(f'<p>{PROSE}{i}</p>' for i in range(3000))}</div><div class=footer>x</div></body>").count("One of the long") == 3000


def test_html_odd_markup():
    assert main_text('<article><p title="x>One, two; three. <p class="b">Four, five; six.</article>') == "One, two; three. Four, five; six."
    assert "All of it linked" in main_text(f"<article>{P}<p><a href=x>All of it linked</a></p>{P}</article>")
    assert main_text("<") == "<" and main_text("<p") == "" and main_text(None) == ""


def test_word_encoder_equals_the_tokenizer():
    texts = ["don't.'s \"'s .'re9 99abc's É́. éx. naïve!!", "Ünï' x\x01y á. ñ'.'s ΑΣ. ǅ, I'Ll THEY'RE <|x|>. ²³. a². İstanbul! ŒUVRE? ſ, ǆ.", "a<|endoftext|>. b~c ~ ~~ d~.", "ﬁn. été, ÉTÉ; Straße: ẞ.", ""]
    for plain in (False, True):
        t = tokenizer(vocabulary_path(), plain)
        assert [x.tolist() for x in WordEncoder(plain=plain)([s.encode() for s in texts])] == [t.encode(s, add_special_tokens=False).ids for s in texts]


def test_sql_of_the_contracts(spark, sf_dir):
    for query, sql, keys in ((decontaminate.op3_decontaminate, decontaminate.OP3_SQL, ["doc_id"]), (chat_format.op6_chat_format, chat_format.OP6_SQL, ["conv_id"]),
                             (substring_dedup.op10_substring_dedup, substring_dedup.OP10_SQL, ["doc_id"]), (search.op2_top_k, search.OP2_SQL, ["query_id", "rank"])):
        same_as_sql(spark, sf_dir, query, sql, keys)


def test_near_dedup_against_brute_force(spark):
    """All pairs of sf0.01 by exact similarity: no link is lost and classes are equal."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    hasher, windows = near_dedup.WordHasher(), near_dedup.Windows()
    sets = {r.doc_id: near_dedup.weighted_shingles(near_dedup.lower_space_words((r.text or "").encode()), hasher, windows) for r in docs if (r.text or "").split()}
    by: dict = {}
    for d, (grams, _) in sets.items():
        for g in grams.tolist():
            by.setdefault(g, []).append(d)
    own = {r.doc_id: r.doc_id for r in docs}
    for a, b in sorted({(a, b) for x in by.values() for a in x for b in x if a < b}):
        if own[a] != own[b] and near_dedup.probability_jaccard(sets[a], sets[b]) >= near_dedup.THRESHOLD:
            low, high = sorted((own[a], own[b]))
            own = {k: low if v == high else v for k, v in own.items()}
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == own


def test_packing_cases(spark, docs):
    assert packing.pack(docs.where("false")).count() == 0
    # equal texts tie; every id of every repeated row is there once
    d = spark.createDataFrame([(1, "same words here", "k"), (2, "same words here", "k"), (2, "same words here", "k"), (None, "", "k"), (3, "a " * 5000, "k")], "doc_id long, text string, k1 string")
    rows = packing.pack(d).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == {1: 1, 2: 2, None: 1, 3: 1}
    t = tokenizer(vocabulary_path(), False)
    ids = np.array([*t.encode("a " * 5000, add_special_tokens=False).ids, 1], "<u4")
    for r in rows:
        if r.doc_id == 3:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_tokens_and_packing(spark, docs):
    texts = ["it's THE <|endoftext|>x a~b ~ ½ Σας", "", "z" * 5000]
    t = tokenizer(vocabulary_path(), False)
    assert [x.tolist() for x in WordEncoder()([s.encode() for s in texts])] == [t.encode(s, add_special_tokens=False).ids for s in texts]
    rows = packing.pack(docs, shard_docs=4).collect()
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 2048
    want = sum(len(t.encode(x[1] or "", add_special_tokens=False).ids) + 1 for x in ROWS)
    assert sum(r.length for r in rows) == want
    whole = {r.doc_id: r for r in rows if r.start == 0 and r.length == r.doc_tokens}
    ids = np.array([1], "<u4")
    assert whole[3].ids_crc32 == zlib.crc32(ids.tobytes())


def test_packing_finds_neighbours_beyond_the_scan_order(spark):
    words = sorted(w for w in tokenizer(vocabulary_path(), False).get_vocab() if w.isascii() and w.isalpha() and w.islower() and len(w) > 3)
    encode = WordEncoder()
    own = [w for w in words if len(encode([w.encode()])[0]) == 1][:120]
    # documents i and i + 20 share their words and are 20 rows apart; two fill a window
    rows = [(i, " ".join(own[6 * (i % 20) : 6 * (i % 20) + 6] * 5)) for i in range(40)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=62, shard_docs=8).collect()
    assert sum(r.length for r in got) == 40 * 31
    at: dict = {}
    for r in got:
        at.setdefault(r.doc_id, set()).add(r.sequence_id)
    assert sum(bool(at[i] & at[i + 20]) for i in range(20)) >= 15


def test_token_scan(spark, docs, tmp_path):
    t = tokenizer(vocabulary_path(), True)
    want = Counter((x[0], len(t.encode(x[1] or "", add_special_tokens=False).ids)) for x in ROWS)
    manifest = token_scan.token_files(docs.repartition(2), f"file://{tmp_path}/a").cache()
    files = manifest.where("bytes is not null").select("file", "bytes")
    names = {(r.file, r["first"] + i): d for r in manifest.collect() for i, d in enumerate(r.doc_ids)}
    for block in (50, 7, 1 << 19):
        found = token_scan.stitch(token_scan.separators(files, block_tokens=block)).collect()
        assert Counter((names[r.file, r.ordinal], r.n_tokens) for r in found) == want and all(r.terminated for r in found)
    assert token_scan.token_files(docs.where("false"), f"file://{tmp_path}/b").count() == 0
    # files of others: an open end, no separator at all, nothing at all
    (tmp_path / "c").mkdir()
    for name, ids in (("x", [1, 2, 9, 3, 4]), ("y", [5, 6]), ("z", []), ("w", [9, 9])):
        (tmp_path / "c" / name).write_bytes(np.array(ids, "<u2").tobytes())
    got = token_scan.stitch(token_scan.separators(token_scan.existing_files(spark, f"file://{tmp_path}/c"), 9, block_tokens=2)).collect()
    assert sorted((r.file[-1], r.ordinal, r.start, r.n_tokens, r.terminated) for r in got) == [("w", 0, 0, 0, True), ("w", 1, 1, 0, True), ("x", 0, 0, 2, True), ("x", 1, 3, 2, False), ("y", 0, 0, 2, False)]


def test_token_scan_query(spark, sf_dir):
    t = tokenizer(vocabulary_path(), True)
    want = sorted((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted((r.doc_id, r.n_tokens) for r in token_scan.op7_token_scan(spark, sf_dir).collect()) == want


def test_search(spark, docs):
    q = spark.createDataFrame([(1, "w5 w6 nothing"), (2, None)], "query_id long, text string")
    got = [(r.query_id, r.rank, r.doc_id) for r in search.top_k(docs, q, k=3, shard_docs=2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2)]
    assert search.top_k(docs.where("false"), q).count() == 0


def test_block_max_wand_against_brute_force():
    rng = np.random.default_rng(3)
    sizes, weights = np.array([400, 300, 20, 1]), rng.random(4) * 3
    docs, impact = np.concatenate([np.sort(rng.choice(500, n, replace=False)) for n in sizes]), rng.random(sizes.sum()).round(3)
    for ids in (np.arange(500), np.arange(500) // 7):  # the second with repeated ids
        postings = search.Postings(sizes, docs, impact, ids)
        for terms in ([0, 1, 2, 3], [1, 2], [3]):
            total: Counter = Counter()
            for t in terms:
                for i in range(sizes[:t].sum(), sizes[: t + 1].sum()):
                    total[docs[i]] += impact[i] * weights[t]
            best: dict = {}
            for d, s in total.items():
                best[ids[d]] = max(best.get(ids[d], 0.0), round(s, 6))
            want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10]
            score, doc = search.block_max_wand(postings, np.array(terms), weights[terms], 10)
            assert doc.tolist() == [d for d, _ in want]
            assert np.allclose(score, [s for _, s in want], atol=2e-6)


def test_block_max_wand_jumps_blocks_unread():
    # a common word everywhere with small impacts, a rare one in three blocks: once these are found the rest is jumped
    n = 64 * 200
    rare = np.array([5, 6, 7, 64 * 9 + 1, 64 * 150])
    docs = np.concatenate([np.arange(n), rare])
    impact = np.concatenate([np.full(n, 0.1), np.full(5, 2.0)])
    postings = search.Postings(np.array([n, 5]), docs, impact, np.arange(n))
    work = search.Work()
    score, doc = search.block_max_wand(postings, np.array([0, 1]), np.array([1.0, 1.0]), 3, work=work)
    assert doc.tolist() == [5, 6, 7] and np.allclose(score, 2.1)
    assert work.pivots < 15 and work.bounds < 30 and work.scored < 15
    # the threshold of an earlier shard leaves nothing to read
    work = search.Work()
    search.block_max_wand(postings, np.array([0, 1]), np.array([1.0, 1.0]), 3, np.array([9.0, 8.0, 7.0]), np.array([90000, 90001, 90002]), work)
    assert work.pivots == work.postings == 0


def test_block_max_wand_reads_few_postings_of_long_queries():
    # whole documents as queries: every block of documents holds many of their words, few documents hold enough of them
    rng = np.random.default_rng(8)
    tf = np.array([np.bincount(((rng.zipf(1.2, 400) - 1) * 7 + rng.integers(0, 7, 400)) % 6000, minlength=6000) for _ in range(3000)]).T
    tf[:, 1500:1520] = tf[:, :20]  # a copy of each query
    n = (tf > 0).sum(1)
    weight = np.log(1 + (3000 - n + 0.5) / (n + 0.5))
    kept = np.flatnonzero(n)
    term, doc = np.nonzero(tf[kept])
    impact = tf[kept][term, doc] * 2.2 / (tf[kept][term, doc] + 1.2)
    postings, work, listed = search.Postings(n[kept], doc, impact, np.arange(3000)), search.Work(), 0
    for q in range(20):
        asked = np.flatnonzero(tf[kept, q])
        listed += n[kept][asked].sum()
        score, found = search.block_max_wand(postings, asked, weight[kept][asked], 2, work=work)
        mine = np.isin(term, asked)
        total = np.bincount(doc[mine], (impact * weight[kept][term])[mine], 3000).round(6)
        want = np.lexsort((np.arange(3000), -total))[:2]
        assert found.tolist() == want.tolist() == [q, 1500 + q] and np.allclose(score, total[want], atol=2e-6)
    assert work.postings < 0.4 * listed


def test_search_index_packs_a_shards_terms_by_buckets(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i, 20 * i)) or None) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    index = d.mapInArrow(search._index(512, 10**9), "shard long, bucket int, terms array<long>, n array<long>, docs binary, counts binary").toPandas()
    assert len(index.shard.unique()) == 2 and not index.duplicated(["shard", "bucket"]).any() and index.bucket.max() < 1 << search.BUCKET_BITS
    parts = index[index.bucket.notna()]
    assert parts.n.map(sum).tolist() == (parts.docs.map(len) // 2).tolist() == (parts.counts.map(len) // 4).tolist()
    assert parts.n.map(sum).sum() == sum(19 * i for i in range(600)) == index[index.bucket.isna()].n.map(lambda x: x[1]).sum()
    assert all(t >> (64 - search.BUCKET_BITS) & ((1 << search.BUCKET_BITS) - 1) == b for b, ts in zip(parts.bucket, parts.terms, strict=True) for t in ts)


def test_search_whole_long_queries_against_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(3000)])
    rows = [(i, " ".join(words[(rng.zipf(1.3, int(rng.integers(1, 600))) - 1) % 3000])) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, str(tmp_path), search.op2_top_k, search.OP2_SQL, ["query_id", "rank"])


def test_search_repeated_rows_take_one_place(spark):
    rows = [(1, "alpha beta beta")] * 12 + [(i, "alpha " + "gamma " * i) for i in range(2, 20)] + [(None, "alpha"), (50, None), (51, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(1)
    q = spark.createDataFrame([(7, "alpha beta"), (8, None), (9, "")], "query_id long, text string")
    got = sorted((r.query_id, r.rank, r.doc_id) for r in search.top_k(d, q).collect())
    assert got == [(7, i, i) for i in range(1, 11)]


def test_toxicity(spark, docs):
    assert max(toxicity.clause_scores([(toxicity.Y, 0.0), (toxicity.I, 2.0)])) == 3.0
    assert max(toxicity.clause_scores([(toxicity.I, 2.0), (toxicity.Y, 0.0)])) == 3.0
    assert max(toxicity.clause_scores([(toxicity.N, 0.0), (toxicity.I, 2.0)])) == pytest.approx(0.8)
    labels = spark.createDataFrame([(1, 0, 1), (2, None, 1), (9, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == len(ROWS)
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_toxicity_reader_is_of_the_lexicon_given(monkeypatch):
    class Shared:
        def __init__(self, value):
            self.value = value

    monkeypatch.setattr(toxicity, "Reader", lambda value: value)
    monkeypatch.setattr(toxicity, "_READERS", toxicity.remembered({}))
    assert [toxicity._reader(Shared(i)) for i in range(50)] == list(range(50))


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op5_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    right = (got.predicted == 1) & (got.toxic == 1)
    assert right.sum() / got.toxic.sum() > 0.85 and right.sum() / got.predicted.sum() > 0.9


def brute_language_model(rows, k2, k3):
    """(score, base score, tokens, known tokens) of (doc_id, text, train) rows."""
    texts = [[*(x or "").encode().lower().split(), None] for _, x, _ in rows]
    one, two, three, n_train = Counter(), Counter(), Counter(), sum(r[2] for r in rows)
    for y, r in zip(texts, rows, strict=True):
        if r[2]:
            p = [False, *y[:-1]]
            one.update(y)
            two.update(zip(p, y, strict=True))
            three.update(zip(p[:-1], p[1:], y[1:], strict=True))
    n, kinds = sum(one.values()), len(one)
    out = []
    for y in texts:
        score = base = 0.0
        p = [False, *y[:-1]]
        for i, (v, w) in enumerate(zip(p, y, strict=True)):
            p1 = (one[w] + 0.5) / (n + 0.5 * (kinds + 1))
            base += math.log10(p1)
            c = n_train if v is False else one[v]
            q = two[v, w] / (c + k2) if two[v, w] else k2 / (c + k2) * p1
            if i:
                u = p[i - 1]
                q = three[u, v, w] / (two[u, v] + k3) if three[u, v, w] else k3 / (two[u, v] + k3) * q
            score += math.log10(q)
        out.append((score, base, len(y), sum(one[w] > 0 for w in y)))
    return out


def test_elias_fano_and_levels():
    rng = np.random.default_rng(2)
    v = np.unique(rng.integers(0, 1 << 50, 3000).astype(np.uint64))
    e = language_model.EliasFano(v, lambda x: x)
    q = np.concatenate([v, v + np.uint64(1), np.array([0, 1 << 51], np.uint64)])
    assert (e.find(q) == np.searchsorted(v, q)).all() and (e.get(np.arange(len(v))) == v).all()
    both = np.unique(rng.integers(0, 500, 4000) * 1000 + rng.integers(0, 900, 4000))
    parent, child = both // 1000, both % 1000
    level = language_model.Level(parent, child, 501, lambda x: x)
    assert (level.find(parent, child) == np.arange(len(both))).all()
    assert (level.find(np.array([-1, 500, parent[0]]), np.array([1, 1, 950])) == -1).all()


def test_language_model(spark):
    rows = [(1, "a b a"), (2, None), (3, "A c"), (None, "b"), (3, "A c")]
    train = [True, True, False, True, False]
    d = spark.createDataFrame([(*r, t, 0.0) for r, t in zip(rows, train, strict=True)], "doc_id long, text string, train boolean, score double")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 9), r.score) for r in language_model.score_texts(d).collect())
    brute = brute_language_model([(*r, t) for r, t in zip(rows, train, strict=True)], language_model.K2, language_model.K3)
    want = sorted((r[0] or 0, n, k, round(b, 9), s) for r, (s, b, n, k) in zip(rows, brute, strict=True))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) <= g[1] * 2 / language_model.QUANTA for g, w in zip(got, want, strict=True))
    assert language_model.score_texts(d.where("false")).count() == 0


def test_language_model_above_any_table_size(spark):
    # sf0.01 holds over 2**18 training tokens; many small shards and hot contexts, with and without the table of common words
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in docs]
    brute = dict(zip([r[0] for r in rows], brute_language_model(rows, language_model.K2, language_model.K3), strict=True))
    frame = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    for options in ({"shard_tokens": 40_000}, {"rare": 1e-3}):
        got = language_model.score_texts(frame, **options).collect()
        assert len(got) == len(rows) and got[0].train_tokens > 1 << 18
        for r in got:
            s, b, n, k = brute[r.doc_id]
            assert (r.n_tokens, r.n_known) == (n, k) and abs(r.base_score - b) < 1e-6 and abs(r.score - s) <= n * 2 / language_model.QUANTA
