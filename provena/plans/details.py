"""Further registered queries: identities, amounts, rankings, plans, permissions, retention, statements and emissions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from provena.functions import norm as N
from provena.operators import company, facts, ledger, reconcile, search, temporal
from provena.operators import measures as M
from provena.sources.io import read

from .registry import query
from .registry import rounded as _round


@query("""SELECT s_suppkey, regexp_replace(s_name, '\\D', '', 'g') AS digits, lpad(regexp_replace(s_name, '\\D', '', 'g'), 14, '0') AS padded,
regexp_replace(lpad(regexp_replace(s_name, '\\D', '', 'g'), 14, '0'), '^(\\d{2})(\\d{3})(\\d{3})(\\d{4})(\\d{2})$', '\\1.\\2.\\3/\\4-\\5') AS formatted,
contains(lower(s_name), '#00000001') OR regexp_replace(s_name, '\\D', '', 'g') = '00000001' AS matched, s_acctbal BETWEEN 0 AND 5000 AND s_nationkey IN (1, 2, 3) AS chosen,
contains(lower(s_name), 'supplier') AND contains(lower(s_name), '7') AS words FROM supplier""")
def identities(spark, d):
    """Ids from free text, entity match, optional ranges and sets, all words."""
    return read(spark, d, "supplier").select(
        "s_suppkey", N.digits("s_name").alias("digits"), N.padded_id("s_name").alias("padded"), N.formatted_id("s_name").alias("formatted"), N.matches_entity("s_name", "s_name", "#00000001").alias("matched"),
        (N.between("s_acctbal", 0, 5000) & N.one_of("s_nationkey", [1, 2, 3])).alias("chosen"), N.all_words("s_name", "supplier 7").alias("words"),
    )


@query("""SELECT o_orderkey, round(o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 1 END, 2) AS amount, year(o_orderdate) || 'T' || quarter(o_orderdate) AS label,
CASE WHEN o_orderstatus = 'F' THEN 'saldo' WHEN month(o_orderdate) = 1 AND day(o_orderdate) = 1 THEN 'acumulado' ELSE 'trimestre' END AS kind, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS value,
CASE WHEN o_orderstatus = 'F' THEN 'operating' WHEN o_orderstatus = 'O' THEN 'planned' ELSE 'unknown' END AS status, o_orderdate + to_months(CAST(o_orderkey % 14 AS INTEGER)) AS later FROM orders""")
def amounts(spark, d):
    """Scaled amounts, quarter labels, period kinds, finite values, status, interval arithmetic."""
    o = read(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return o.select(
        "o_orderkey", F.round(N.scaled_amount(F.col("o_totalprice").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " mil ").otherwise("UNIDADE")), 2).alias("amount"), N.quarter_label("o_orderdate").alias("label"),
        N.period_kind("o_orderdate", F.col("o_orderstatus") == "F").alias("kind"), N.finite(F.when(F.col("o_orderkey") % 5 == 0, float("inf")).otherwise(F.col("o_totalprice"))).alias("value"),
        N.status_label(F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O").alias("status"), N.plus_interval("o_orderdate", F.col("o_orderkey") % 14, "months").cast("timestamp_ntz").alias("later"),
    )


@query("""SELECT c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal NULLS LAST) AS rank, count(*) OVER (PARTITION BY c_mktsegment) AS class_size,
round(2 * (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 5) AS score FROM customer""")
def customer_scores(spark, d):
    """Ranks in a class with its size, and weighted z-scores (L24, part of L21)."""
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    out = M.z_scores(M.rank_in_class(c, "c_mktsegment", "c_acctbal"), {"c_acctbal": 2.0})
    return _round(out, "score", digits=5).select("c_custkey", "c_mktsegment", F.col("rank").cast("long"), "class_size", "score")


@query("""WITH f AS (SELECT o_orderkey, l_returnflag AS file, list_sort(list(DISTINCT l_linenumber)) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderkey, string_agg(file || ' p.' || array_to_string(p, ', '), '; ' ORDER BY file) AS sources FROM f GROUP BY 1""")
def line_provenance(spark, d):
    """Files and pages that a figure came from, as one text."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linenumber")
    return M.provenance(l.join(read(spark, d, "orders").select("o_orderkey"), "o_orderkey"), ["o_orderkey"], "l_returnflag", "l_linenumber")


@query("""SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS urgent, max(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS low FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1""")
def account_pivot(spark, d):
    """Codes as columns."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    return M.pivot_accounts(o, ["o_custkey"], "o_orderpriority", "o_totalprice", {"1-URGENT": "urgent", "5-LOW": "low"})


@query("""SELECT user_id, count(*) AS n, round(sum(value), 2) AS value, round(CASE WHEN bool_and(event_type <> 'error') THEN sum(value * 2) END, 2) AS cost FROM events GROUP BY 1""")
def cost_rollup(spark, d):
    """Sums whose cost is null where any row lacks one."""
    e = read(spark, d, "events").select("user_id", "value", F.when(F.col("event_type") != "error", F.col("value") * 2).alias("cost"))
    return _round(M.priced_rollup(e, ["user_id"], "value", "cost"), "value", "cost", digits=2)


@query("""WITH g AS (SELECT o_custkey, year(o_orderdate) AS year, round(sum(CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END), 2) AS value FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year DESC) AS i FROM g), p AS (SELECT o_custkey, max(year) FILTER (i = 1) AS period, max(value) FILTER (i = 1) AS "last", max(year) FILTER (i = 2) AS previous_period, max(value) FILTER (i = 2) AS previous FROM r WHERE i <= 2 GROUP BY 1)
SELECT *, round(CASE WHEN previous <> 0 AND sign(previous) = sign("last") THEN ("last" - previous) / abs(previous) END, 6) AS change FROM p""")
def last_two_years(spark, d):
    """The last two periods and their change; none where the sign changes."""
    v = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    g = read(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum(v), 2).alias("value"))
    return _round(temporal.last_and_previous(g, ["o_custkey"], "year", "value"), "change", digits=6)


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END AS ident, 'C' || o_custkey AS name, year(o_orderdate) AS year, o_orderpriority AS label FROM orders),
l AS (SELECT * FROM o QUALIFY year = max(year) OVER (PARTITION BY coalesce(ident, name))) SELECT o_orderkey, name, year, max_by(label, o_orderkey) OVER (PARTITION BY name) AS label FROM l""")
def latest_editions(spark, d):
    """Newest edition of each entity by id, else by name, with its current label."""
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("string")).alias("ident"), F.concat(F.lit("C"), "o_custkey").alias("name"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("label"))
    return temporal.current_name(temporal.latest_edition(o, "ident", "name", "year"), ["name"], "label", "o_orderkey").select("o_orderkey", "name", "year", "label")


_QUARTERS = "q AS (SELECT o_orderstatus AS k, year(o_orderdate) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL), a AS (SELECT k, year, sum(value) AS value FROM q GROUP BY ALL)"


@query(f"""WITH {_QUARTERS}, n AS (SELECT k, year, sum(value) AS s FROM q WHERE quarter < 4 GROUP BY ALL HAVING count(*) = 3)
SELECT k, year, quarter, value FROM q WHERE quarter < 4 UNION ALL SELECT k, year, 4, round(a.value - s, 2) FROM a JOIN n USING (k, year)""")
def fourth_quarter(spark, d):
    """The fourth quarter as the year less three quarters."""
    q = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("k"), F.year("o_orderdate").cast("long").alias("year"), F.quarter("o_orderdate").cast("int").alias("quarter")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return _round(temporal.fourth_quarters(q, q.groupBy("k", "year").agg(F.sum("value").alias("value")), ["k"], "year", "quarter", "value"), "value", digits=2)


@query("""WITH d AS (SELECT o_custkey AS k, year(o_orderdate) AS year FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ALL), w AS (SELECT o_custkey AS k, year(o_orderdate) AS year FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
SELECT k, year, CASE WHEN d.k IS NOT NULL AND w.k IS NOT NULL THEN 'keep' WHEN w.k IS NOT NULL THEN 'pending' ELSE 'stale' END AS action FROM d FULL JOIN w USING (k, year)""")
def refresh_actions(spark, d):
    """What to keep, make and drop."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("year"), "o_orderkey")
    return reconcile.refresh_plan(o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 2 = 0"), ["k", "year"])


@query("""WITH old AS (SELECT * FROM orders WHERE o_orderkey % 4 > 0), t AS (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0),
r AS (SELECT * FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM t) UNION ALL SELECT * FROM orders WHERE o_orderkey % 7 = 0)
SELECT o_orderkey, o_custkey, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS has_open FROM r WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)""")
def replaced_orders(spark, d):
    """Everything of the customers read now replaced, flagged, and only those without a first line."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.where("o_orderkey % 7 = 0")
    r = reconcile.with_flag(reconcile.replace_by_key(o.where("o_orderkey % 4 > 0"), new, new, "o_custkey"), o.where("o_orderstatus = 'P'"), "o_custkey", "has_open")
    first = read(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return reconcile.orphans(r, first, "o_orderkey").select("o_orderkey", "o_custkey", "has_open")


@query("""WITH m AS (SELECT p_partkey, 'old/' || p_partkey || '.pdf' AS path FROM part WHERE p_partkey % 5 > 0), l AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'old/' ELSE 'new/' END || p_partkey || '.pdf' AS found FROM part WHERE p_partkey % 7 > 0)
SELECT p_partkey, path, found, CASE WHEN found IS NULL THEN 'missing' WHEN found = path THEN 'path' ELSE 'name' END AS how FROM m LEFT JOIN l ON split_part(path, '/', 2) = split_part(found, '/', 2)""")
def moved_files(spark, d):
    """A manifest matched with a listing by path, else by a unique name."""
    p = read(spark, d, "part").select("p_partkey")
    manifest = p.where("p_partkey % 5 > 0").select("p_partkey", F.format_string("old/%d.pdf", "p_partkey").alias("path"))
    listing = p.where("p_partkey % 7 > 0").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "old/").otherwise("new/"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"))
    return reconcile.match_listing(manifest, listing).select("p_partkey", "path", "found", "how")


@query("SELECT min(doc_id) AS doc_id, any_value(n_chars) AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY text")
def exact_copies(spark, d):
    """One document of equal texts; only those that share a length are hashed."""
    t = read(spark, d, "documents").where("text is not null").select("doc_id", "n_chars", "text")
    return reconcile.exact_copies(t, "n_chars", "text", [F.asc("doc_id")]).select("doc_id", "n_chars")


_THEMES = {"water": r"\b\w*ater\w*", "than": r"\bthan\b", "year": r"\b(19|20)\d{2}\b"}
_PARAGRAPHS = "p AS (SELECT doc_id, trim(unnest(string_split_regex(text, '\\n\\s*\\n|\\n')), ' ') AS paragraph FROM documents)"


@query(f"""WITH {_PARAGRAPHS}, f AS (SELECT doc_id, lower(strip_accents(paragraph)) AS t FROM p WHERE length(paragraph) >= 80)
SELECT doc_id, count(*) AS paragraphs, CAST(count_if(regexp_matches(t, '\\bthan\\b')) AS BIGINT) AS than, CAST(count_if(regexp_matches(t, '\\b(19|20)\\d{{2}}\\b')) AS BIGINT) AS year FROM f GROUP BY 1""")
def themed_paragraphs(spark, d):
    """Paragraphs of 80 characters or more and their themes."""
    p = search.paragraphs(read(spark, d, "documents").select("doc_id", "text"), "text").withColumn("tags", search.tagged("paragraph", _THEMES))
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), *[F.count_if(F.array_contains("tags", t)).alias(t) for t in ("than", "year")])


@query("""WITH r AS (SELECT 'by_' || (o_orderkey % 2) AS method, o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_orderkey % 2, o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders),
g AS (SELECT o_custkey AS query_id, max(o_orderkey) AS doc_id FROM orders GROUP BY 1), b AS (SELECT m.method, g.query_id, pos + 1 AS rank FROM g, (SELECT DISTINCT method FROM r) m LEFT JOIN r ON r.method = m.method AND r.query_id = g.query_id AND r.doc_id = g.doc_id)
SELECT method, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM b GROUP BY 1""")
def retrieval_scores(spark, d):
    """Hit rates and mean reciprocal ranks by method."""
    o = read(spark, d, "orders").select(F.concat(F.lit("by_"), (F.col("o_orderkey") % 2)).alias("method"), F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), "o_totalprice")
    r = o.withColumn("pos", F.row_number().over(Window.partitionBy("method", "query_id").orderBy(F.desc("o_totalprice"), "doc_id")) - 1)
    return _round(search.retrieval_quality(r, o.groupBy("query_id").agg(F.max("doc_id").alias("doc_id")), "doc_id"), "hit_1", "hit_5", "hit_10", "mrr", digits=6)


@query("""WITH o AS (SELECT *, 1 + o_orderkey % 3 AS scope, year(o_orderdate) AS y FROM orders), g AS (SELECT o_custkey AS entity, y AS year, scope, max(o_totalprice) AS value FROM o WHERE o_orderkey % 2 = 0 GROUP BY ALL),
f AS (SELECT o_custkey AS entity, scope, y AS edition, o_totalprice * 1.01 AS got, o_orderstatus <> 'P' AS accepted, o_orderkey FROM o WHERE o_orderkey % 5 > 0),
b AS (SELECT g.*, got, accepted FROM g LEFT JOIN f ON f.entity = g.entity AND f.scope = g.scope AND edition IN (year, year + 1) QUALIFY row_number() OVER (PARTITION BY g.entity, year, g.scope ORDER BY accepted DESC NULLS LAST, abs(got - value) NULLS LAST, edition) = 1)
SELECT entity, year, scope, CASE WHEN got IS NULL THEN 'missing' WHEN NOT accepted THEN 'rejected' WHEN abs(got - value) <= 0.02 * abs(value) THEN 'ok' ELSE 'diverge' END AS verdict FROM b""")
def gold_verdicts(spark, d):
    """Found figures against a gold table."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), (1 + F.col("o_orderkey") % 3).alias("scope"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    gold = o.where("o_orderkey % 2 = 0").groupBy("entity", "year", "scope").agg(F.max("value").alias("value"))
    found = o.where("o_orderkey % 5 > 0").withColumn("value", F.col("value") * 1.01).withColumn("accepted", F.col("o_orderstatus") != "P")
    return facts.gold_verdicts(gold, found).select("entity", "year", "scope", "verdict")


_ACL = "a AS (SELECT user_id AS resource, event_type AS principal, CAST(event_id % 8 AS INTEGER) AS bits FROM events)"


@query(f"""WITH {_ACL}, m AS (SELECT DISTINCT resource FROM a WHERE principal IN ('click', 'view') AND bits & 5 = 5), s AS (SELECT resource FROM a GROUP BY 1 HAVING bool_or(principal = 'click' AND bits & 4 > 0) AND NOT bool_or(principal <> 'click' AND bits & 4 > 0))
SELECT 'accessible' AS kind, resource FROM m UNION ALL SELECT 'sole', resource FROM s""")
def permitted_resources(spark, d):
    """Resources with all asked bits, and those only one principal may delete."""
    a = read(spark, d, "events").select(F.col("user_id").alias("resource"), F.lit("group").alias("principal_type"), F.col("event_type").alias("principal"), (F.col("event_id") % 8).cast("int").alias("bits"))
    p = spark.createDataFrame([("group", "click"), ("group", "view")], "principal_type string, principal string")
    return ledger.accessible(a, p, 5).select(F.lit("accessible").alias("kind"), "resource").unionByName(ledger.sole_owned(a, "click", 4).select(F.lit("sole").alias("kind"), "resource"))


@query("""WITH b AS (SELECT tag, count(*) AS n FROM (SELECT DISTINCT o_orderkey, o_orderpriority AS tag FROM orders) GROUP BY 1), a AS (SELECT tag, count(*) AS n FROM (SELECT DISTINCT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS tag FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1),
c AS (SELECT o_orderpriority AS tag, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1) SELECT tag, greatest(0, coalesce(c.n, 0) + coalesce(a.n, 0) - coalesce(b.n, 0)) AS n FROM c FULL JOIN a USING (tag) FULL JOIN b USING (tag)""")
def tag_totals(spark, d):
    """Tag counts after a change of tags, never under zero."""
    o = read(spark, d, "orders")
    before, after = o.select(F.array("o_orderpriority").alias("tags")), o.where("o_orderkey % 2 = 0").select(F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    counts = o.where("o_orderkey % 3 > 0").groupBy(F.col("o_orderpriority").alias("tag")).agg(F.count("*").alias("n"))
    return ledger.tag_counts(before, after, counts).select("tag", F.col("n").cast("long"))


@query("""WITH m AS (SELECT conv_id % 50 AS "user", conv_id, turn FROM conversations) SELECT "user", count(DISTINCT conv_id) AS conversations, count(*) AS messages FROM m GROUP BY 1""")
def user_activity(spark, d):
    """Conversations and messages of each user."""
    m = read(spark, d, "conversations").select((F.col("conv_id") % 50).alias("user"), "conv_id")
    return ledger.activity(m.select("user"), m.distinct(), m)


@query("""WITH m AS (SELECT conv_id AS "user", role || '-' || turn AS key, length(coalesce(text, '')) AS tokens FROM conversations)
SELECT "user", string_agg(i || '. ' || key || ': ' || tokens, chr(10) ORDER BY i) AS digest, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY key) AS i FROM m) GROUP BY 1""")
def memory_digest(spark, d):
    """Numbered digest of a user's memories and their tokens."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("user"), F.concat_ws("-", "role", F.col("turn").cast("string")).alias("key"), F.length(F.coalesce("text", F.lit(""))).alias("tokens"))
    return ledger.digest(c.withColumn("value", F.col("tokens").cast("string")))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN ts + to_days(CAST(event_id % 40 AS INTEGER)) END AS expires, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 5 = 0 END AS temporary FROM events)
SELECT event_id, CASE WHEN temporary THEN FALSE WHEN temporary IS NULL THEN expires IS NULL ELSE expires IS NULL OR expires > TIMESTAMP '2024-01-20' END AS visible FROM e""")
def retained_events(spark, d):
    """What retention shows."""
    e = read(spark, d, "events").withColumn("expires", F.when(F.col("event_id") % 3 > 0, F.col("ts").cast("timestamp_ntz") + F.make_dt_interval((F.col("event_id") % 40).cast("int"))))
    temporary = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("event_id") % 5 == 0)
    return e.select("event_id", ledger.visible(F.col("expires"), temporary, F.lit("2024-01-20").cast("timestamp_ntz")).alias("visible"))


@query("""SELECT event_id, token_type, raw, round(CASE WHEN token_type = 'completion' AND event_id % 4 = 0 THEN ceil(raw * 2.5 * 1.15) ELSE raw * 2.5 END, 4) AS value, CASE WHEN event_id % 2 = 0 THEN input_tokens ELSE greatest(0, input_tokens - 30 - 20) END AS uncached
FROM (SELECT event_id, event_id % 97 AS input_tokens, unnest([{'token_type': 'prompt', 'raw': event_id % 97}, {'token_type': 'completion', 'raw': event_id % 31}], recursive := true) FROM events) WHERE raw > 0""")
def ledger_entries(spark, d):
    """Ledger rows of usage with values and the uncached input."""
    e = read(spark, d, "events").select("event_id", (F.col("event_id") % 97).alias("input_tokens"), (F.col("event_id") % 31).alias("output_tokens"))
    e = e.withColumn("uncached", ledger.split_input(F.col("event_id") % 2 == 0, F.col("input_tokens"), F.lit(30).cast("long"), F.lit(20).cast("long")))
    r = ledger.ledger_rows(e)
    value = ledger.token_value(F.col("raw"), F.lit(2.5), (F.col("token_type") == "completion") & (F.col("event_id") % 4 == 0))
    return r.select("event_id", "token_type", "raw", F.round(value, 4).alias("value"), "uncached")


@query("""WITH w AS (SELECT o_orderkey, o_totalprice AS revenue, o_totalprice * 0.3 + 10 AS ebitda, o_totalprice * 0.5 - 200 AS net FROM orders)
SELECT o_orderkey, round(ebitda, 4) AS ebitda, round(net, 4) AS net_debt, round(ebitda / nullif(revenue, 0), 6) AS ebitda_margin, round(ebitda / 7, 6) AS interest_cover FROM w""")
def order_kpis(spark, d):
    """Earnings, net debt, margin and cover of a wide statement (L4)."""
    v = F.col("o_totalprice")
    w = read(spark, d, "orders").select("o_orderkey", v.alias("revenue"), (v * 0.3).alias("ebit"), F.lit(10.0).alias("depreciation"), (v * 0.2).alias("debt_short"), (v * 0.3).alias("debt_long"), F.lit(200.0).alias("cash"), F.lit(None).cast("double").alias("securities"),
        F.lit(1.0).alias("capex"), F.lit(2.0).alias("concession"), (v * 0.1).alias("profit"), (v * 0.9).alias("equity"), F.lit(-7.0).alias("interest"))
    return _round(_round(company.kpis(w), "ebitda", "net_debt"), "ebitda_margin", "interest_cover", digits=6).select("o_orderkey", "ebitda", "net_debt", "ebitda_margin", "interest_cover")


_EMISSIONS = """o AS (SELECT o_custkey AS company, year(o_orderdate) AS year, CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2_market' WHEN 2 THEN '2_location' ELSE '3' END AS scope, o_totalprice AS tco2e, o_orderstatus AS file, o_orderkey AS page, CASE WHEN o_orderkey % 9 = 0 THEN 0.3 ELSE 0.9 END AS confidence FROM orders),
v AS (SELECT * FROM o WHERE confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY company, year, scope ORDER BY tco2e DESC NULLS LAST, file, page) = 1),
b AS (SELECT *, regexp_replace(scope, '_(market|location)$', '') AS base_scope FROM v QUALIFY row_number() OVER (PARTITION BY company, year, base_scope ORDER BY ends_with(scope, '_market') DESC, scope) = 1),
t AS (SELECT company, year, round(sum(tco2e), 2) AS tco2e, list_sort(list(DISTINCT base_scope)) AS have FROM b GROUP BY ALL)"""


def _emissions(spark, d):
    scope = F.element_at(F.array(*map(F.lit, ("1", "2_market", "2_location", "3"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").cast("long").alias("year"), scope.alias("scope"), F.col("o_totalprice").alias("tco2e"), F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 9 == 0, 0.3).otherwise(0.9).alias("confidence"))
    return company.emissions_view(o)


@query(f"""WITH {_EMISSIONS}, a AS (SELECT c_custkey AS company, unnest([1993, 1996]) AS y FROM customer WHERE c_custkey % 3 > 0),
p AS (SELECT t.company, t.year, any_value(tco2e) AS tco2e, max(y) AS accounts_year FROM t LEFT JOIN a ON a.company = t.company AND y <= t.year GROUP BY t.company, t.year)
SELECT company, year, tco2e, accounts_year, round(1e6 * tco2e / (accounts_year * 1000.0), 4) AS per_million FROM p""")
def emission_intensity(spark, d):
    """Largest confident figure by scope, market before location, per million of the latest revenue."""
    c = read(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("company"), F.explode(F.array(F.lit(1993).cast("long"), F.lit(1996).cast("long"))).alias("year"))
    return _round(_round(company.intensity(_emissions(spark, d), c.withColumn("revenue", F.col("year") * 1000.0)), "tco2e", digits=2), "per_million").select("company", "year", "tco2e", "accounts_year", "per_million")


@query(f"""WITH {_EMISSIONS}, x AS (SELECT company, year, tco2e, list_filter(['1', '2', '3'], lambda s: NOT list_contains(have, s)) AS missing FROM t QUALIFY row_number() OVER (PARTITION BY company ORDER BY len(missing) = 0 DESC, year DESC) = 1)
SELECT company, year, array_to_string(missing, ',') AS missing, price, round(tco2e * price, 2) AS cost FROM x, (VALUES (0.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE)) p(price)""")
def carbon_exposure(spark, d):
    """Cost of emissions by price, for the newest edition with all scopes."""
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("company"), F.lit(1990).alias("year"), F.lit(1.0).alias("ebitda"))
    return _round(company.exposure(_emissions(spark, d), a, (0, 50, 100)), "cost", digits=2).select("company", "year", F.array_join("missing", ",").alias("missing"), "price", "cost")


@query("""SELECT o_orderkey, round(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 1000 WHEN 'O' THEN 1 END, 2) AS tonnes, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown unit ' || o_orderstatus END AS error FROM orders""")
def tonnes(spark, d):
    """Units to tonnes, unknown ones as an error."""
    unit = F.when(F.col("o_orderstatus") == "F", " kt").when(F.col("o_orderstatus") == "O", "T").otherwise(F.col("o_orderstatus"))
    return _round(company.in_tonnes(read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"), unit.alias("unit"))), "tonnes", digits=2).select("o_orderkey", "tonnes", "error")
