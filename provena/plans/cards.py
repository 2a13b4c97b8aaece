"""Registered queries: cards and shares, costs and runs of calls, excerpts, plans of files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from provena.operators import cards, excerpts, usage
from provena.operators.reconcile import names_and_more
from provena.sources.io import read

from .registry import query
from .registry import rounded as _round


@query("""WITH a AS (SELECT o_custkey AS id, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS aliases, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) FILTER (regexp_matches(o_orderpriority, '^[12]')) AS chosen FROM orders GROUP BY 1),
y AS (SELECT o_custkey AS id, min(year(o_orderdate)) || '-' || max(year(o_orderdate)) AS years FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS id, c_name AS name, aliases, chosen, coalesce(years, 'none') AS years FROM customer LEFT JOIN a ON a.id = c_custkey LEFT JOIN y ON y.id = c_custkey""")
def entity_cards(spark, d):
    """Customers with aliases, chosen aliases and years."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("alias"), F.year("o_orderdate").alias("year"), "o_orderstatus")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return cards.entity_card(c, o, o.where("o_orderstatus = 'F'"), F.col("alias").rlike("^[12]"))


@query("""SELECT o_custkey, min_by(o_orderpriority, lpad(CAST(length(o_orderpriority) AS VARCHAR), 6, '0') || o_orderpriority) AS name, bool_or(o_orderstatus = 'F') AS done FROM orders GROUP BY 1""")
def merged_entities(spark, d):
    """One row per id: shortest name, any flag (A3)."""
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") == "F").alias("done"))
    return cards.merged(o, "o_custkey", "name", "done")


@query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 20 AS holding, s_acctbal > 0 AS direct FROM supplier), p AS (SELECT holding, id AS member FROM s WHERE direct UNION SELECT holding, holding FROM s),
n AS (SELECT holding, count(*) AS members, list_sort(list(DISTINCT s_name)) AS l FROM p JOIN supplier ON s_suppkey = member GROUP BY 1)
SELECT holding, members, array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN ' and ' || (len(l) - 3) || ' more' ELSE '' END AS names FROM n""")
def perimeters(spark, d):
    """Holdings with what they control directly, and themselves."""
    s = read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 20).alias("holding"), (F.col("s_acctbal") > 0).alias("direct"), "s_name")
    p = cards.perimeter(s, "s_suppkey", "holding", "direct").join(s.select(F.col("s_suppkey").alias("member"), "s_name"), "member")
    return p.groupBy("holding").agg(F.count("*").alias("members"), names_and_more(F.array_sort(F.collect_list("s_name")), 3).alias("names"))


@query("""SELECT l_partkey AS asset, round(sum(coalesce(CASE WHEN p_size > 10 THEN p_retailprice END, p_size) * l_quantity / 100) / 1000, 6) AS share FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 20 = 3 AND s_acctbal > 0 UNION SELECT 3) GROUP BY 1""")
def owned_shares(spark, d):
    """Members' shares of what they own parts of."""
    s = read(spark, d, "supplier").where("s_suppkey % 20 = 3").select("s_suppkey", F.lit(3).cast("long").alias("holding"), (F.col("s_acctbal") > 0).alias("direct"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("asset"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price"), F.col("p_size").cast("double").alias("size"))
    l = read(spark, d, "lineitem").select(F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("owner"), "l_quantity")
    return _round(cards.owned_share(p, l, cards.perimeter(s, "s_suppkey", "holding", "direct"), "asset", "owner", "price", "size", "l_quantity"), "share", digits=6)


@query("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::BOOLEAN AS active, 1 AS priority FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal > 0, 0 FROM supplier""")
def typed_sources(spark, d):
    """Unlike sources as one table with typed nulls and priorities."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("active"))
    return cards.typed_union([(c, 1), (s, 0)], {"id": "long", "name": "string", "segment": "string", "active": "boolean"})


@query("SELECT p_type, count(*) AS n FROM part WHERE contains(lower(p_type), 'e') GROUP BY 1")
def type_counts(spark, d):
    """Values with counts, those that contain a text (A4)."""
    return cards.value_counts(read(spark, d, "part"), "p_type", contains="E")


@query("""SELECT n_name, o_orderpriority, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0 GROUP BY ALL HAVING sum(c_acctbal) > 0""")
def positive_balances(spark, d):
    """Sums above zero of rows without a phase or of one phase (A5, A10)."""
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_acctbal")
    o = read(spark, d, "orders").select("o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 2 == 0, "Operação").otherwise("Projeto")).alias("phase"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return _round(cards.positive_sums(j, ["n_name", "o_orderpriority"], "c_acctbal", "phase", "opera"), "total", digits=2)


@query("""SELECT p_brand, round(sum(p_retailprice), 2) AS total, round(100 * sum(CASE WHEN contains(lower(p_type), 'econ') OR contains(lower(p_type), 'promo') THEN p_retailprice ELSE 0 END) / sum(p_retailprice), 4) AS pct,
round(sum(p_retailprice) FILTER (starts_with(p_type, 'ECO')), 2) AS money, round(sum(p_retailprice) FILTER (starts_with(p_type, 'PRO')), 2) AS others FROM part GROUP BY 1""")
def type_shares(spark, d):
    """Shares of some kinds, and sums by code prefix."""
    p = read(spark, d, "part").select("p_brand", "p_type", "p_retailprice")
    share = _round(_round(cards.share_of(p, ["p_brand"], "p_type", "p_retailprice", ["econ", "promo"]), "total", digits=2), "pct").drop("part")
    return share.join(_round(cards.prefix_sums(p, ["p_brand"], "p_type", "p_retailprice", {"money": "ECO", "others": "PRO"}), "money", "others", digits=2), "p_brand")


@query("""WITH i AS (SELECT c_custkey % 100 AS entity, o_orderpriority AS indicator, round(avg(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT x.entity AS a, y.entity AS b, count(*) AS of, CAST(count_if(abs(x.value - y.value) < 0.2 * greatest(abs(x.value), abs(y.value)) OR x.value = y.value) AS BIGINT) AS near FROM i x JOIN i y ON y.entity = x.entity + 1 AND x.indicator = y.indicator GROUP BY ALL)
SELECT a, b, of, near, CASE WHEN near >= 2 / 3 * of THEN 'equivalent' WHEN near >= 1 / 3 * of THEN 'close' ELSE 'distant' END AS grade FROM g""")
def similar_companies(spark, d):
    """Grades of stated pairs by their indicators."""
    o = read(spark, d, "orders").select((F.col("o_custkey") % 100).alias("entity"), F.col("o_orderpriority").alias("indicator"), "o_totalprice")
    i = o.groupBy("entity", "indicator").agg(F.round(F.avg("o_totalprice"), 2).alias("value"))
    return cards.similarity_grade(i, i.select(F.col("entity").alias("a"), (F.col("entity") + 1).alias("b")).distinct())


@query("""WITH r AS (SELECT o_custkey AS company, o_orderdate AS reference, o_orderstatus AS statement, o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 1 END AS amount, o_orderkey % 3 AS version, o_orderkey FROM orders WHERE o_orderkey % 5 > 0)
SELECT o_orderkey, round(amount, 2) AS amount, CASE WHEN statement = 'F' THEN 'saldo' WHEN month(reference) = 1 AND day(reference) = 1 THEN 'acumulado' ELSE 'trimestre' END AS period FROM r QUALIFY version = max(version) OVER (PARTITION BY company, reference, statement)""")
def quarterly_statements(spark, d):
    """Quarterly rows of the highest version with the kind of period (L2)."""
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("company"), F.col("o_orderdate").alias("reference"), F.when(F.col("o_orderstatus") == "F", "BPA").otherwise(F.col("o_orderstatus")).alias("statement"), F.lit("con").alias("scope"),
        F.col("o_totalprice").cast("string").alias("amount"), F.when(k % 2 == 0, "MIL").otherwise("UNIDADE").alias("scale"), (k % 3).cast("string").alias("version"), F.when(k % 5 == 0, "PENULTIMO").otherwise("ultimo").alias("order"),
        F.col("o_orderdate").alias("start"), F.lit(None).cast("timestamp_ntz").alias("end"))
    return _round(cards.quarterly_statements(o), "amount", digits=2).select("o_orderkey", "amount", "period")


@query("""WITH q AS (SELECT o_custkey AS company, date_trunc('quarter', o_orderdate) AS reference, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL)
SELECT 'quarter' AS part, company, CAST(reference AS DATE) AS reference, value, count(*) OVER (PARTITION BY company) AS in_base, count(*) OVER (PARTITION BY company) > 4 AS cut FROM q QUALIFY row_number() OVER (PARTITION BY company ORDER BY reference DESC) <= 4
UNION ALL SELECT 'year', o_custkey, make_date(year(o_orderdate), 1, 1), round(sum(o_totalprice), 2), NULL, NULL FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996 GROUP BY ALL""")
def indicator_cards(spark, d):
    """The years of a range and the last four quarters of each company, how many quarters there are, and whether some are cut."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year"), F.trunc("o_orderdate", "quarter").alias("reference"), "o_totalprice")
    q = o.groupBy("company", "reference").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    years, last = cards.indicator_card(o.groupBy("company", "year").agg(F.round(F.sum("o_totalprice"), 2).alias("value")), q, "company", 1994, 1996)
    y = years.select(F.lit("year").alias("part"), "company", F.make_date("year", F.lit(1), F.lit(1)).alias("reference"), "value", F.lit(None).cast("long").alias("in_base"), F.lit(None).cast("boolean").alias("cut"))
    return last.select(F.lit("quarter").alias("part"), "company", "reference", "value", "in_base", "cut").unionByName(y)


@query("""WITH g AS (SELECT o_custkey AS company, year(o_orderdate) AS year, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS value FROM orders GROUP BY ALL)
SELECT company, year, value FROM g WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company ORDER BY year DESC, value DESC) = 1""")
def latest_rankings(spark, d):
    """Companies by a metric of their newest edition that has it."""
    g = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("value"))
    return cards.latest_ranking(g, "company", "year", "value")


@query(r"""SELECT doc_id AS "case", regexp_matches(text, '(?i)\bthe') AND NOT regexp_matches(text, '\d{4}') AS said, doc_id % 4 <> 1 AS used, regexp_matches(text, '(?i)\bthe') AND NOT regexp_matches(text, '\d{4}') AND doc_id % 4 <> 1 AND doc_id % 10 > 0 AS passed FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def scoreboard(spark, d):
    """Answers against patterns they must and must not hold, and the tools used."""
    t = read(spark, d, "documents").select(F.col("doc_id").alias("case"), F.col("text").alias("answer"))
    names = lambda *x: F.array(*map(F.lit, x))
    runs = t.withColumn("tools", F.when(F.col("case") % 4 == 1, names("other")).otherwise(names("search", "other"))).withColumn("error", F.when(F.col("case") % 10 == 0, "timeout"))
    cases = t.select("case", names(r"(?i)\bthe").alias("must"), names(r"\d{4}").alias("must_not"), names("search").alias("tools"))
    return cards.scoreboard(runs, cases)


@query("""SELECT 'orders' AS "table", count(*) AS rows, 'All orders.' AS summary, 'o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string' AS columns FROM orders
UNION ALL SELECT 'customer', count(*), 'All customers.', 'c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string' FROM customer UNION ALL SELECT 'nation', count(*), NULL, 'n_nationkey int, n_name string, n_regionkey int' FROM nation""")
def listed_tables(spark, d):
    """Tables with their rows, columns and summaries."""
    s = spark.createDataFrame([("orders", "All orders."), ("customer", "All customers.")], "table string, summary string")
    return cards.described({t: read(spark, d, t) for t in ("orders", "customer", "nation")}, s)


@query("""WITH u AS (SELECT event_id, event_type, event_id % 97 * CASE WHEN event_id % 19 = 0 THEN 5000 ELSE 1 END AS i, event_id % 13 AS w, event_id % 7 AS r, event_id % 31 AS o, CASE WHEN event_id % 17 = 0 THEN 1.5 END AS own FROM events),
p AS (SELECT *, coalesce(own, CASE event_type WHEN 'click' THEN CASE WHEN i > 200000 THEN 3.0 ELSE 2.0 END WHEN 'view' THEN 4.0 ELSE 6.0 END) AS rate FROM u), c AS (SELECT *, CASE event_type WHEN 'click' THEN 2.5 ELSE rate END AS wr, CASE event_type WHEN 'click' THEN 0.2 ELSE rate END AS rr FROM p)
SELECT event_id, rate, round((i * rate + w * wr + r * rr + o * 3 * rate) / 1e6, 9) AS usd, round(CASE WHEN i + w + r > 0 THEN (i * rate + w * wr + r * rr) / (i + w + r) ELSE rate END, 6) AS blended FROM c""")
def call_costs(spark, d):
    """What calls cost with cached parts, own rates and the tier for long inputs, and their blended rates."""
    k = spark.createDataFrame([("click", 2.0, 3.0, 2.5, 0.2), ("view", 4.0, None, None, None)], "key string, base double, premium double, write double, read double")
    e = F.col("event_id")
    i = e % 97 * F.when(e % 19 == 0, 5000).otherwise(1)
    u = read(spark, d, "events").select("event_id", F.col("event_type").alias("model"), i.alias("input_only"), i.alias("input_tokens"), (e % 13).alias("cache_write"), (e % 7).alias("cache_read"), (e % 31).alias("output_tokens"), F.when(e % 17 == 0, 1.5).alias("override"))
    r = usage.cache_rated(u, k).withColumn("completion_rate", F.col("rate") * 3)
    p = usage.prompt_value(*[F.col(c) for c in ("input_only", "cache_write", "cache_read", "rate", "write_rate", "read_rate")])
    return usage.call_costs(r).select("event_id", "rate", F.round("usd", 9).alias("usd"), F.round(p["rate"], 6).alias("blended"))


_CALLS = "e AS (SELECT user_id AS conv_id, event_id AS idx, CASE WHEN event_id % 11 > 0 THEN event_id % 3 END AS run, CASE event_type WHEN 'error' THEN 'tool' WHEN 'view' THEN 'summarization' END AS kind, event_id % 31 AS output_tokens FROM events)"


def _calls(spark, d):
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "tool").when(F.col("event_type") == "view", "summarization")
    return read(spark, d, "events").select(F.col("user_id").alias("conv_id"), i.alias("idx"), F.when(i % 11 > 0, i % 3).alias("run"), kind.alias("kind"), (i % 31).alias("output_tokens"))


@query(f"""WITH {_CALLS}, r AS (SELECT DISTINCT conv_id, run FROM e WHERE run IS NOT NULL)
SELECT r.conv_id, r.run, max(idx) AS idx, max_by(output_tokens, idx) AS output_tokens FROM r LEFT JOIN e ON e.conv_id = r.conv_id AND e.kind IS NULL AND (e.run IS NULL OR e.run = r.run) GROUP BY ALL""")
def final_calls(spark, d):
    """The last primary call of every run."""
    e = _calls(spark, d)
    return usage.final_calls(e, e.where("run is not null").select("conv_id", "run").distinct()).select("conv_id", "run", "call.idx", "call.output_tokens")


@query(f"""WITH {_CALLS}, c AS (SELECT *, CASE WHEN kind IS NULL OR kind = 'summarization' THEN output_tokens ELSE 0 END AS x FROM e),
s AS (SELECT *, sum(x) OVER (PARTITION BY conv_id ORDER BY idx) - x AS every, sum(x) OVER (PARTITION BY conv_id, run ORDER BY idx) - x AS own, coalesce(sum(CASE WHEN run IS NULL THEN x END) OVER (PARTITION BY conv_id ORDER BY idx), 0) AS loose FROM c)
SELECT conv_id, idx, CAST(CASE WHEN run IS NULL THEN every ELSE own + loose END AS BIGINT) AS "before" FROM s""")
def outputs_before(spark, d):
    """Outputs before a call within its run."""
    return usage.outputs_before(_calls(spark, d)).select("conv_id", "idx", "before")


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT p_partkey AS file, p_size + coalesce(n, 0) AS usage FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM r GROUP BY 1) ON l_partkey = p_partkey""")
def file_usage(spark, d):
    """Uses of files, one for each request that names them (C14)."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.array("l_partkey").alias("files"))
    return usage.file_usage(read(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("usage")), l)


@query("""SELECT c_custkey AS project, count(o_orderkey) AS n, max_by(o_orderkey, strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS latest, max(o_orderdate) AS at FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY 1""")
def project_stats(spark, d):
    """Shown conversations of projects and the latest one."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("conv_id"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    return usage.project_stats(read(spark, d, "customer").select(F.col("c_custkey").alias("project")), o, F.col("o_orderstatus") != "P")


@query("""SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND contains(lower(props), '"k": 8') AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20' AND (contains(CAST(user_id AS VARCHAR), '1') OR contains(event_type, '1'))""")
def audited(spark, d):
    """Audit rows by values, literal name, range and search (F16)."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.where(usage.audit_filter({"event_type": ["click", "error"], "user_id": []}, ("props", '"k": 8'), at("2024-01-03"), at("2024-01-20"), "ts", "1", ("user_id", "event_type"))).select("event_id")


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE 0 END AS k, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS tie FROM events""")
def event_lists(spark, d):
    """JSON arrays with bad ones empty, and cursors with bad ones null."""
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise("{broken").alias("json"))
    cursor = F.when(F.col("event_id") % 2 == 0, F.base64(F.encode(F.to_json(F.struct(F.lit("v").alias("value"), F.col("event_id").cast("string").alias("tie"))), "UTF-8"))).otherwise("?!")
    k = F.aggregate(usage.events_of("json", "struct<k:bigint>"), F.lit(0).cast("long"), lambda s, x: s + x["k"])
    return e.select("event_id", k.alias("k"), usage.cursor_of(cursor)["tie"].alias("tie"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = o_orderkey % 5 THEN c_name END AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def tenant_lookup(spark, d):
    """A lookup that blanks partners of another tenant."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 5).alias("tenant"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("tenant"), F.col("c_name").alias("name"))
    return usage.of_tenant(o, c, "id", "tenant", ["name"]).select("o_orderkey", "name")


@query("""SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND year(l_shipdate) = year(o_orderdate)""")
def contracts_named(spark, d):
    """Texts that name a contract by number and year."""
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Obra do Contrato nº "), F.format_string("%06d", "l_orderkey"), F.lit("/"), F.year("l_shipdate").cast("string")).alias("text"))
    o = read(spark, d, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), F.year("o_orderdate").cast("string")).alias("number"))
    return usage.numbered_contracts(l, o, "text", "number").select("l_orderkey", "l_linenumber", "o_orderkey")


_LISTS = """a AS (SELECT o_custkey AS report, o_orderkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders), b AS (SELECT o_custkey AS report, o_orderkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
u AS (SELECT report, page, round(sum(1 / (60 + pos)), 9) AS fused, min(pos) AS best, sum(1 / (60 + pos)) AS exact FROM (FROM a UNION ALL FROM b) WHERE pos <= 12 GROUP BY ALL),
c AS (SELECT report, page, fused, row_number() OVER (PARTITION BY report ORDER BY round(exact, 12) DESC, page) AS place FROM u WHERE best <= 6)"""


def _candidates(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("report"), F.col("o_orderkey").alias("page"), "o_totalprice", "o_orderdate")
    w = Window.partitionBy("report")
    lists = [o.withColumn("pos", F.row_number().over(w.orderBy(*order))) for order in ([F.desc("o_totalprice"), F.asc("page")], [F.asc("o_orderdate"), F.asc("page")])]
    return lists, excerpts.candidate_pages(lists, ["report"], "page")


@query(f"WITH {_LISTS} SELECT report, page, fused, place FROM c")
def candidate_union(spark, d):
    """The first pages of two searches, in the order of their fused ranks."""
    return _round(_candidates(spark, d)[1], "fused", digits=9).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {_LISTS}, s AS (SELECT l_orderkey AS page, max(l_extendedprice) AS score, min(CASE WHEN l_extendedprice = m THEN l_shipdate || '' END) AS chunk FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1)
SELECT report, c.page, score, left(chunk, 10) AS chunk, a.page IS NOT NULL AS by_price, b.page IS NOT NULL AS by_date FROM c LEFT JOIN s USING (page) LEFT JOIN (FROM a WHERE pos <= 6) a USING (report, page) LEFT JOIN (FROM b WHERE pos <= 6) b USING (report, page)""")
def best_chunks(spark, d):
    """Chosen pages with their best chunk and the methods that found them."""
    lists, chosen = _candidates(spark, d)
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_extendedprice").alias("score"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("chunk"))
    methods = dict(zip(("by_price", "by_date"), (x.where("pos <= 6").select("page") for x in lists), strict=True))
    return excerpts.best_chunks(l, chosen, ["page"], "score", "chunk", methods).select("report", "page", "score", "chunk", "by_price", "by_date")


@query(f"""WITH {_LISTS}, x AS (SELECT report, page, l_returnflag AS theme, l_quantity / 5 AS score, 'line ' || l_linenumber || ' ' || l_partkey AS sentence, place FROM c JOIN lineitem ON l_orderkey = page WHERE l_quantity / 5 >= 7),
e AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY report, theme ORDER BY round(score + 1 / place, 9) DESC, place, sentence) = 1),
y AS (SELECT e.*, score + 1 / place AS points, CAST(year(o_orderdate) AS BIGINT) AS year FROM e JOIN orders ON o_orderkey = page),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY year, theme ORDER BY round(points, 9) DESC, report, page, sentence) = 1)
SELECT max(year) AS year, report, page, sentence, string_agg(theme, ',' ORDER BY theme) AS themes, round(max(points), 6) AS points FROM z GROUP BY report, page, sentence""")
def excerpt_events(spark, d):
    """The best sentence per report and theme, then per year and theme."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("theme"), (F.col("l_quantity") / 5).alias("score"), F.concat_ws(" ", F.lit("line"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("sentence"))
    c = _candidates(spark, d)[1]
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.year("o_orderdate").cast("long").alias("year"))
    owned = l.join(c.select("report", "page"), "page")
    best = excerpts.best_excerpts(owned, c.join(l.select("page", "theme").distinct(), "page"), ["report", "theme"], "page")
    e = excerpts.excerpt_events(best.join(o, "page"), "year", "theme", "report", "page")
    return _round(e, "points", digits=6).withColumn("themes", F.array_join("themes", ","))


@query("""SELECT doc_id, lang || ' ' || n_chars || ', ' || source || '. ' || left(text, 40) AS contextual, 'a' || (doc_id % 5) AS area FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL""")
def contextual_chunks(spark, d):
    """Chunks with the head of their document, which must have metadata."""
    t = read(spark, d, "documents").where("text is not null and lang is not null and source is not null and n_chars is not null")
    path = F.format_string("a%d/%d.txt", F.col("doc_id") % 5, "doc_id").alias("path")
    files = excerpts.with_metadata(t.select("doc_id", path, F.substring("text", 1, 40).alias("chunk")), t.select(path, F.lit("x").alias("kind")))
    return excerpts.contextual(files, t.select("doc_id", F.col("lang").alias("company"), F.col("n_chars").alias("year"), F.col("source").alias("title")), "doc_id").select("doc_id", "contextual", "area")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def listed_documents(spark, d):
    """Documents counted by language and source."""
    return excerpts.listed(read(spark, d, "documents"), ["lang", "source"], "n_chars", "doc_id")[0]


@query("""WITH p AS (SELECT p_partkey, p_partkey || '.pdf' AS name, 'x/' || p_brand || '/' || p_size || '/' || p_partkey || '.pdf' AS expected FROM part),
l AS (SELECT name, CASE WHEN p_partkey % 3 = 0 THEN 'inbox/' || name ELSE expected END AS path FROM p WHERE p_partkey % 11 > 0 UNION ALL SELECT name, 'z/' || name FROM p WHERE p_partkey % 11 > 0 AND p_partkey % 7 = 0),
g AS (SELECT name, count(*) AS n, any_value(path) AS path FROM l GROUP BY 1)
SELECT p_partkey, expected, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN path = expected THEN 'keep' ELSE 'move' END AS action FROM p LEFT JOIN g USING (name) WHERE p_partkey % 5 > 0""")
def relocation_plan(spark, d):
    """Where files belong, and what is to move, missing or named twice."""
    p = read(spark, d, "part").select("p_partkey", F.lit("x").alias("area"), F.col("p_brand").alias("company"), F.col("p_size").alias("year"), F.concat(F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("name"))
    at = p.where("p_partkey % 11 > 0").withColumn("path", F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("/", F.lit("inbox"), "name")).otherwise(F.concat_ws("/", "area", "company", F.col("year").cast("string"), "name")))
    again = p.where("p_partkey % 11 > 0 and p_partkey % 7 = 0").withColumn("path", F.concat_ws("/", F.lit("z"), "name"))
    listing = excerpts.merged_groups({"first": at, "again": again}, ["path"])
    return excerpts.relocation(p.where("p_partkey % 5 > 0"), listing).select("p_partkey", "expected", "action")
