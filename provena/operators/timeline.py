"""Events of a company by year, what moved beside them, and trajectories from a contract to its result.

Inputs are long tables keyed by ``company``; no step gathers more than ``most`` items of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions.norm import fold

from .temporal import top_n

#: Kinds of events in the order of a year's page.
KINDS = ["relatorio", "usina", "leilao", "bndes", "transmissao_contrato", "transmissao_operacao", "ped"]

#: Kind or theme of an event -> series whose change of that year is shown beside it.
IMPACT = {
    "usina": ["capacidade_renovavel_mw", "capacidade_nao_renovavel_mw"],
    "leilao": ["investimento_total_brl"],
    "bndes": ["investimento_total_brl", "divida_liquida_ebitda"],
    "transmissao_contrato": ["investimento_total_brl"],
    "transmissao_operacao": ["receita_liquida_brl"],
    "ped": ["ped_brl"],
    "renovavel": ["capacidade_renovavel_mw"],
    "investimento_ambiental": ["investimento_total_brl", "bndes_brl"],
    "descarbonizacao": ["investimento_total_brl"],
    "transicao": ["investimento_total_brl"],
    "metas": ["investimento_total_brl"],
    "sustentabilidade": ["investimento_total_brl"],
    "inovacao": ["ped_brl"],
}

STEP = "struct<year int, role string, link string, n bigint, amount double, source string>"


def yearly_events(rows: DataFrame, kind: str, item: str, amount: str, source: str, themes: str | None = None, per: tuple[str, ...] = (), most: int = 12, closed_before: int | None = None) -> DataFrame:
    """One event per company and year (and ``per``): rows, total, the ``most`` largest items and the themes seen; with ``closed_before`` only of earlier years.

    A null amount counts as zero in the total and comes last among the items; ties by item.
    """
    keys = ["company", "year", *per]
    rows = rows if closed_before is None else rows.where(F.col("year") < closed_before)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(amount), item)
    seen = F.array_sort(F.array_distinct(F.flatten(F.collect_set(themes)))) if themes else F.array().cast("array<string>")
    total = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("total"), seen.alias("themes"))
    first = rows.select(*keys, F.col(item).cast("string").alias("_i"), F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= most)
    items = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_i"))), lambda x: x["_i"]).alias("items"))
    return total.join(items, keys).select("company", "year", F.lit(kind).alias("kind"), *per, "n", "total", "items", "themes", F.lit(source).alias("source"))


def largest_events(rows: DataFrame, kind: str, item: str, amount: str, source: str, themes: str | None = None, most: int = 3) -> DataFrame:
    """The ``most`` largest rows of every company and year, each an event of its own."""
    t = F.col(themes) if themes else F.array().cast("array<string>")
    best = top_n(rows, ["company", "year"], [F.desc_nulls_last(amount), F.asc(item)], most)
    return best.select("company", "year", F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("n"), F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("total"), F.array(F.col(item).cast("string")).alias("items"), t.alias("themes"), F.lit(source).alias("source"))


def impact(events: DataFrame, changes: DataFrame, rules: dict[str, list[str]] = IMPACT) -> DataFrame:
    """``(company, year, series, change)`` of the series that the year's kinds and themes point to, where they moved."""
    m = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    cues = F.concat(F.array("kind"), F.coalesce("themes", F.array().cast("array<string>")))
    linked = events.select("company", "year", F.explode(cues).alias("cue")).distinct()
    linked = linked.select("company", "year", F.explode(F.try_element_at(m, F.col("cue"))).alias("series")).distinct()
    return changes.where(F.coalesce("change", F.lit(0.0)) != 0).join(linked, ["company", "year", "series"], "left_semi")


def timeline(events: DataFrame, changes: DataFrame, kinds: list[str] = KINDS, rules: dict[str, list[str]] = IMPACT) -> DataFrame:
    """One row per company and year that has events or changes: events in order, themes, highlight, impact and evolution."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int"), F.lit(0))
    key = F.struct((F.size("themes") == 0).alias("plain"), place.alias("place"), (-F.col("total")).alias("less"), "kind", "n", "total", "items", "themes", "source")
    keys = ["company", "year"]
    e = events.groupBy(*keys).agg(F.array_sort(F.collect_list(key)).alias("events"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("themes")))).alias("themes"))
    series = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("series", "change"))).alias(name))
    j = e.join(series(changes, "evolution"), keys, "full").join(series(impact(events, changes, rules), "impact"), keys, "left")
    return j.withColumn("highlight", F.coalesce(F.size("themes") > 0, F.lit(False)))


def selector(companies: DataFrame, statements: DataFrame, reports: DataFrame, today: int, before: int = 2) -> DataFrame:
    """Every company with what the base holds of it and the suggested first year of its timeline.

    That year is the earlier of the first report and ``before`` years ahead of the first statement,
    never ahead of the base's own first year; a company with neither starts with the base.
    """
    s = statements.groupBy("company").agg(F.min("year").alias("first_statement"), F.max("year").alias("last_statement"))
    r = reports.groupBy("company").agg(F.min("year").alias("first_report"), F.count("*").alias("reports"))
    start = s.agg((F.least(F.min("first_statement"), F.lit(today)) - before).alias("start"))
    base = start.join(r.agg(F.min("first_report").alias("_r"))).select("start", F.least("_r", "start").alias("base"))  # one row
    j = companies.join(s, "company", "left").join(r, "company", "left").join(F.broadcast(base))
    own = F.coalesce(F.least("first_report", F.col("first_statement") - before), "start")
    return j.withColumn("since", F.greatest(own, "base")).withColumn("until", F.lit(today)).withColumn("reports", F.coalesce("reports", F.lit(0))).drop("start", "base")


def first_taker(offers: DataFrame, asset: str, order: list[Column]) -> DataFrame:
    """Every asset goes to the first offer, in order, that names it; an offer's conditions are on single assets, so this equals taking offers in turn."""
    return top_n(offers, ["company", asset], order)


def investment_step(spans: DataFrame, series: DataFrame) -> DataFrame:
    """``(company, title, year, rise)``: the largest yearly rise after ``since`` up to ``until``; the later year wins ties."""
    w = Window.partitionBy("company").orderBy("year")
    rises = series.withColumn("_p", F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("value").over(w))).select("company", "year", (F.col("value") - F.col("_p")).alias("rise")).where("rise > 0")
    j = spans.select("company", "title", "since", "until").join(rises, "company").where("year > since and year <= until")
    return top_n(j, ["company", "title"], [F.desc("rise"), F.desc("year")]).select("company", "title", "year", "rise")


def asset_trajectories(assets: DataFrame, loans: DataFrame, auctions: DataFrame, series: DataFrame, today: int) -> DataFrame:
    """Steps of financing -> operation and, for assets no loan covers, auction -> operation.

    ``assets(company, asset, name, amount, entry_year or null)``, ``loans(company, year, amount, name)``,
    ``auctions(company, year, auction, asset)``, ``series(company, year, value)``.  A loan names assets by their
    name without its last number or letter; assets that entered before the loan are not its own.
    Returns ``steps(company, title, year, role, link, n, amount, source)`` for ``trajectories``.
    """
    base = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+([0-9]+|[IVXLCivxlc]+|[A-Za-z])$", "")))
    a = assets.withColumn("_b", base("name"))
    l = loans.select("company", F.lower(F.trim("name")).alias("_b"), F.col("year").alias("since"), F.col("amount").alias("lent"))
    named = a.join(l, ["company", "_b"]).where(F.col("entry_year").isNull() | (F.col("entry_year") >= F.col("since")))
    lent = first_taker(named, "asset", [F.asc("since"), F.desc("lent")])
    lent = lent.withColumn("title", F.concat("_b", F.lit(": loan of "), F.col("since").cast("string"), F.lit(" to operation")))
    free = auctions.join(lent.select("company", "asset"), ["company", "asset"], "left_anti")
    size = free.groupBy("company", "year", "auction").agg(F.count_distinct("asset").alias("_n"))
    sold = free.join(size, ["company", "year", "auction"]).join(assets, ["company", "asset"])
    sold = first_taker(sold.withColumnRenamed("year", "since"), "asset", [F.desc("_n"), F.asc("since"), F.asc("auction")])
    sold = sold.withColumn("title", F.concat("auction", F.lit(": auction to operation")))

    def steps(own: DataFrame, role: str, paid: Column, link: str, source: str) -> DataFrame:
        g = own.groupBy("company", "title").agg(F.min("since").alias("since"), F.count("*").alias("n"), paid.alias("paid"), F.max("entry_year").alias("entered"), F.count("entry_year").alias("on"), F.sum(F.when(F.col("entry_year").isNotNull(), F.col("amount"))).alias("running"), F.sum(F.when(F.col("entry_year").isNull(), F.col("amount"))).alias("waiting"))
        g = g.withColumn("until", F.coalesce("entered", "since"))
        row = lambda df, *c: df.select("company", "title", *[F.col(x).alias(n) if x in df.columns else F.lit(x).alias(n) for x, n in zip(c, ("year", "role", "link", "n", "amount", "source"), strict=True)])
        now = g.withColumn("today", F.lit(today)).withColumn("off", F.col("n") - F.col("on"))
        return reduce(DataFrame.unionByName, [
            row(g, "since", role, "", "n", "paid", source),
            row(investment_step(g, series).withColumn("n", F.lit(1).cast("long")), "year", "investment", "", "n", "rise", "statements"),
            row(g.where("on > 0"), "entered", "result", link, "on", "running", "register"),
            row(now.where("off > 0"), "today", "not yet seen", link, "off", "waiting", "register"),
        ])

    return steps(lent, "financing", F.max("lent"), "name of the asset in the loan", "loans").unionByName(steps(sold, "contract", F.lit(None).cast("double"), "id of the asset", "auctions"))


#: Themes of a report that announce a strategy.
STRATEGIC = ("metas", "transicao", "renovavel", "investimento_ambiental", "descarbonizacao")


def _step(df: DataFrame, year, role: str, link: str, n, amount, source: str) -> DataFrame:
    """Rows of one role in the columns that ``trajectories`` takes."""
    c = lambda x, name, kind: (F.col(x) if isinstance(x, str) else F.lit(x)).cast(kind).alias(name)
    return df.select("company", "title", c(year, "year", "int"), F.lit(role).alias("role"), F.lit(link).alias("link"), c(n, "n", "long"), c(amount, "amount", "double"), F.lit(source).alias("source"))


def contract_trajectories(contracts: DataFrame, works: DataFrame, loans: DataFrame, series: DataFrame, today: int) -> DataFrame:
    """Steps of contract -> (loan that cites its number) -> investment -> operation.

    ``contracts(company, contract, number, holder, signed)`` with a number like 12/2019 and a date, ``works(company,
    contract, name, running, entered)`` with a date, ``loans(company, year, amount, name)``, ``series(company, year, value)``.
    Works that ran before the signature aren't the contract's; a contract without works, signature or number has no steps.
    """
    number = lambda c, group: F.regexp_extract(fold(c), r"(?:contrato\D{0,40})?\b(\d+)/(\d{4})", group).try_cast("int")
    c = contracts.where(F.col("signed").isNotNull()).withColumn("_a", number("number", 1)).withColumn("_y", number("number", 2)).where("_y is not null")
    c = c.withColumn("since", F.year("signed")).withColumn("title", F.concat(F.lit("transmission "), "number", F.lit(" ("), F.coalesce("holder", F.lit("")), F.lit("): contract to operation")))
    w = works.select("company", "contract", F.coalesce("running", F.lit(False)).alias("running"), "entered")
    j = c.join(w, ["company", "contract"]).where(~(F.col("running") & F.coalesce(F.col("entered") < F.col("signed"), F.lit(False))))
    g = j.groupBy("company", "title", "_a", "_y", "since").agg(F.count("*").alias("n"), F.count_if(F.col("running")).alias("on"), F.max(F.when(F.col("running"), F.year("entered"))).alias("entry"))
    g = g.withColumn("until", F.coalesce("entry", "since")).withColumn("off", F.col("n") - F.col("on"))
    cited = F.regexp_extract(fold("name"), r"contrato\D{0,40}\b(\d+/\d{4})", 1)
    l = loans.select("company", F.col("year").alias("lent_in"), F.col("amount").alias("lent"), F.split(cited, "/").alias("_c")).where(F.size("_c") == 2)
    l = l.select("company", "lent_in", "lent", F.col("_c")[0].cast("int").alias("_a"), F.col("_c")[1].cast("int").alias("_y"))
    paid = top_n(g.join(l, ["company", "_a", "_y"]), ["company", "title"], [F.asc("lent_in"), F.desc("lent")])
    parts = [
        _step(g, "since", "contract", "", 1, None, "contracts"), _step(paid, "lent_in", "financing", "number of the contract in the loan", 1, "lent", "loans"),
        _step(investment_step(g, series), "year", "investment", "", 1, "rise", "statements"), _step(g.where("on > 0"), "entry", "result", "same contract", "on", None, "works"),
        _step(g.where("off > 0"), today, "not yet seen", "same contract", "off", None, "works"),
    ]
    return reduce(DataFrame.unionByName, parts)


def report_trajectories(reports: DataFrame, series: DataFrame, entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Steps of a strategy announced in year A -> the investment's rise in A + 1 -> what is seen in A + 2.

    ``reports(company, year, title, themes, points)``: each year's event of most points with a strategic theme (ties by
    title); ``series(company, year, value)`` of investment, without a rise there are no steps; ``entries(company, year, mw)`` of
    renewable plants that went into operation; ``accounts(company, year, ebitda)``.  Seen are the plants of A + 2, else earnings
    of A + 2 after known ones of A + 1; where the accounts end before A + 2 it is not yet seen.
    """
    told = reports.where(F.arrays_overlap("themes", F.array(*map(F.lit, STRATEGIC))))
    best = top_n(told, ["company", "year"], [F.desc("points"), F.asc("title")])
    best = best.withColumn("since", F.col("year")).withColumn("until", F.col("year") + 1).withColumn("title", F.concat("title", F.lit(" in the report of "), F.col("year").cast("string"), F.lit(": investment to result")))
    rise = investment_step(best, series)
    s = best.join(rise.select("company", "title", F.col("year").alias("rose"), "rise"), ["company", "title"]).withColumn("seen", F.col("since") + 2)
    e = entries.groupBy("company", F.col("year").alias("seen")).agg(F.sum("mw").alias("mw"), F.count("*").alias("plants"))
    a = accounts.where("ebitda is not null and ebitda <> 0").select("company", "year", "ebitda")
    both = a.join(a.select("company", (F.col("year") + 1).alias("year"), F.lit(True).alias("_before")), ["company", "year"]).select("company", F.col("year").alias("seen"), "ebitda")
    last = accounts.groupBy("company").agg(F.max("year").alias("last"))
    s = s.join(e, ["company", "seen"], "left").join(both, ["company", "seen"], "left").join(last, "company", "left")
    late = F.col("plants").isNull() & (F.col("seen") > F.coalesce("last", F.lit(0)))
    parts = [
        _step(s, "since", "strategy", "", 1, None, "reports"), _step(s, "rose", "investment", "", 1, "rise", "statements"), _step(s.where("plants > 0"), "seen", "result", "", "plants", "mw", "register"),
        _step(s.where("plants is null and ebitda is not null"), "seen", "result", "", 1, "ebitda", "statements"), _step(s.where(late), "seen", "not yet seen", "", 1, None, "statements"),
    ]
    return reduce(DataFrame.unionByName, parts)


def trajectories(steps: DataFrame, first: int, lead: int = 5, most: int = 8) -> DataFrame:
    """Steps in order of time, one row per company and title.

    Kept are those of two steps or more that start no more than ``lead`` years before ``first`` and end
    in it or later.  The first step has no link, a step without one says "order in time".  A company shows its
    ``most`` first: those with a result, then the latest, then the longest.
    """
    s = steps.withColumn("link", F.when(F.length("link") > 0, F.col("link")).otherwise("order in time")).withColumn("year", F.col("year").cast("int"))
    s = s.withColumn("link", F.when(F.row_number().over(Window.partitionBy("company", "title").orderBy("year", "role")) > 1, F.col("link")))
    one = F.struct("year", "role", "link", F.col("n").cast("long").alias("n"), F.col("amount").cast("double").alias("amount"), "source").cast(STEP)
    g = s.groupBy("company", "title").agg(F.array_sort(F.collect_list(one)).alias("steps"))
    g = g.where(F.size("steps") >= 2).where(F.element_at("steps", 1)["year"] >= first - lead).where(F.element_at("steps", -1)["year"] >= first)
    order = [F.desc(F.exists("steps", lambda x: x["role"] == "result")), F.desc(F.element_at("steps", -1)["year"]), F.desc(F.size("steps")), F.asc("title")]
    return top_n(g, ["company"], order, most)
