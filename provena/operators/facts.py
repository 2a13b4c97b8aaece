"""Checking extracted facts against the page they cite, and text audits."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.functions.norm import fold


def agreed(readings: DataFrame, keys: list[str], reading: str = "reading") -> DataFrame:
    """Rows of the first reading that another one confirms; a single reading passes as it is.

    ``keys`` starts with the columns that name the document (all but the last).
    """
    doc = keys[:-1]
    n = readings.groupBy(*doc).agg(F.count_distinct(reading).alias("_all"))
    k = readings.groupBy(*keys).agg(F.min(reading).alias("_first"), F.count_distinct(reading).alias("_n"))
    first = readings.where(F.col(reading) == 0).dropDuplicates(keys)
    return first.join(k, keys).join(n, doc).where("_all = 1 or (_first = 0 and _n >= 2)").drop("_all", "_first", "_n")


def value_on_page(value: Column, quote: Column, page: Column) -> Column:
    """Is a number of two digits or more on the quote or page (any thousands and decimal marks), or its mantissa in the quote.

    For a number of one digit or none the quote's start must be on the page.  The quote must hold a word of three letters.
    """
    plain = F.regexp_replace(F.format_string("%.6f", F.abs(value.cast("double"))), r"0+$", "")
    number = F.regexp_replace(F.regexp_replace(plain, r"\D", ""), "^0+", "")
    mantissa = F.regexp_replace(number, "0+$", "")
    pattern = lambda d: F.concat(F.lit(r"(?<!\d)0?[.,]?"), F.array_join(F.split(d, "(?<=.)(?=.)"), r"[.,\s]?"), F.lit(r"(?:[.,]0+)?(?!\d)"))
    both = F.concat_ws("\n", quote, page)
    enough = lambda d: F.length(d) >= 2
    seen = (enough(number) & F.rlike(both, pattern(number))) | (enough(mantissa) & F.rlike(quote, pattern(mantissa)))
    squeeze = lambda x: F.regexp_replace(fold(x), r"\s+", " ")
    start = F.substring(F.trim(squeeze(quote)), 1, 40)
    quoted = F.coalesce(F.length(number) < 2, F.lit(True)) & (F.length(start) > 0) & F.contains(squeeze(page), start)
    return F.coalesce(fold(quote).rlike("[a-z]{3}") & (F.coalesce(seen, F.lit(False)) | quoted), F.lit(False))


def revalidated(facts: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Stored facts that still stand on their pages."""
    j = facts.join(pages.select(*keys, F.col("text").alias("_page")), keys)
    return j.where(value_on_page(F.col("value"), F.col("quote"), F.col("_page"))).drop("_page")


def candidate_pages(pages: DataFrame, doc: str, page: str, text: str, pattern: str, n: int) -> DataFrame:
    """The n pages of a document with the most pattern hits; ties: later page first."""
    from .temporal import top_n

    hits = pages.withColumn("hits", F.regexp_count(fold(text), F.lit(pattern))).where("hits > 0")
    return top_n(hits, [doc], [F.desc("hits"), F.desc(page)], n)


def _spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows over the text; all but the last end behind a break (line end, or full stop and space) of their second half, if it has one."""
    marks = [(m.start() + 1, m.end()) for m in re.finditer(r"\n|\. ", text)]
    closed = [end for _, end in marks]
    lo = 0
    while lo < len(text):
        hi = lo + size
        if hi >= len(text):
            yield lo, len(text)
            return
        at = bisect_right(closed, hi) - 1
        if at >= 0 and marks[at][0] > lo + size // 2:
            hi = marks[at][0]
        yield lo, hi
        lo = max(hi - overlap, lo + 1)


def chunks(pages: DataFrame, text: str = "text", size: int = 1200, overlap: int = 200, least: int = 80) -> DataFrame:
    """Pages cut into overlapping chunks; ``chunk`` and ``pos`` are added in place of the text.

    Runs of blanks become one and runs of empty lines one empty line first; chunks, and pages, of under ``least`` characters are left out.
    """
    squeezed = F.trim(F.regexp_replace(F.regexp_replace(F.col(text), r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \t\n\r\f\x0b"))

    rest = [c for c in pages.columns if c not in (text, "pos", "chunk")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, chunk = [], [], []
            for i, s in enumerate(batch["_t"].to_pylist()):
                pieces = [x for x in (s[lo:hi].strip() for lo, hi in _spans(s, size, overlap)) if len(x) >= least]
                row += [i] * len(pieces)
                pos += range(len(pieces))
                chunk += pieces
            own = pa.record_batch([batch[c] for c in rest], names=rest).take(pa.array(row, pa.int64())) if rest else None
            yield pa.record_batch([*(own.columns if own else ()), pa.array(pos, pa.int64()), pa.array(chunk, pa.string())], names=[*rest, "pos", "chunk"])

    whole = pages.select(*rest, squeezed.alias("_t")).where(F.length("_t") >= least)
    schema = T.StructType([*[pages.schema[c] for c in rest], T.StructField("pos", T.LongType()), T.StructField("chunk", T.StringType())])
    return whole.mapInArrow(cut, schema)


#: Starter patterns, first match wins.
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "bearer": r"(?i)\bbearer\s+[a-z0-9._-]{20,}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "card": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b",
}


def first_secret(text: Column | str, patterns: dict[str, str] | None = None) -> Column:
    """Name of the first pattern found, null if none."""
    t = F.col(text) if isinstance(text, str) else text
    out = F.lit(None).cast("string")
    for name, p in reversed(list((patterns or SECRETS).items())):
        out = F.when(t.rlike(p), name).otherwise(out)
    return out


def merged_quotes(text: Column, quotes: Column) -> Column:
    """Quoted excerpts as a block of ``> `` lines, then the text, as a model gets them."""
    block = F.array_join(F.transform(F.filter(quotes, lambda q: F.length(F.trim(q)) > 0), lambda q: F.concat(F.lit("> "), F.regexp_replace(q, "\n", "\n> "))), "\n\n")
    body = F.coalesce(text, F.lit(""))
    return F.when(F.length(F.coalesce(block, F.lit(""))) == 0, body).when(F.length(body) == 0, block).otherwise(F.concat(block, F.lit("\n\n"), body))


def first_secret_of(text: Column | str, quotes: Column | str, patterns: dict[str, str] | None = None) -> Column:
    """The first secret of the text, else of its quotes, else of both as one text (a secret may be split between them)."""
    t, q = (F.col(x) if isinstance(x, str) else x for x in (text, quotes))
    inside = F.array_compact(F.transform(q, lambda x: first_secret(x, patterns)))
    return F.coalesce(first_secret(t, patterns), F.try_element_at(inside, F.lit(1)), first_secret(merged_quotes(t, q), patterns))


def citation_audit(reports: DataFrame, sources: DataFrame, text: str = "text", tables: DataFrame | None = None) -> DataFrame:
    """Findings (report, kind, detail): numbers without a citation, cited keys that do not exist, keys never cited, paragraphs that
    end in a mark of cutting or in mid sentence (lists and headings may), and, where ``tables(table)`` is given, names like those of tables that are none."""
    p = reports.select("report", F.posexplode(F.split(text, r"\n\s*\n")).alias("pos", "paragraph"))
    bare = F.regexp_replace("paragraph", r"https?://\S+|\[[A-Z]\d+\]|\b\d{2}/\d{2}/\d{4}\b|\b(19|20)\d{2}\b", "")
    keys = F.regexp_extract_all("paragraph", F.lit(r"\[([A-Z]\d+)\]"), F.lit(1))
    uncited = p.where(bare.rlike(r"\d") & (F.size(keys) == 0)).select("report", F.lit("number without citation").alias("kind"), F.col("pos").cast("string").alias("detail"))
    cited = p.select("report", F.explode(keys).alias("key")).distinct()
    known = sources.select("report", "key").distinct()
    gone = cited.join(known, ["report", "key"], "left_anti").select("report", F.lit("undefined key").alias("kind"), F.col("key").alias("detail"))
    idle = known.join(cited, ["report", "key"], "left_anti").select("report", F.lit("key never cited").alias("kind"), F.col("key").alias("detail"))
    body = p.where(~F.col("paragraph").rlike(r"^\s*([#*|-]|\d+[.)] )") & (F.length(F.trim("paragraph")) > 0))
    last = F.regexp_replace("paragraph", r"\s+$", "")
    cut = F.when(last.rlike(r"(\u2026|\.\.\.)$"), "mark of cutting").when(~last.rlike(r"[.!?:;)\u201d\"'\]}]$"), "truncated")
    ends = body.withColumn("kind", cut).where("kind is not null").select("report", "kind", F.col("pos").cast("string").alias("detail"))
    out = uncited.unionByName(gone).unionByName(idle).unionByName(ends)
    if tables is None:
        return out
    plain = F.regexp_replace("paragraph", r"https?://\S+|\S+\.(pdf|csv|xlsx?|parquet|json)\b|\[[A-Z]\d+\]", " ")
    named = p.select("report", F.explode(F.regexp_extract_all(plain, F.lit(r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"), F.lit(0))).alias("detail")).distinct()
    known = tables.select(F.lower("table").alias("detail")).distinct()
    return out.unionByName(named.join(known, "detail", "left_anti").select("report", F.lit("unknown table").alias("kind"), "detail"))


def has_sections(text: Column | str, titles: list[str]) -> Column:
    """Are the level-two headings exactly these, in order."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"(?m)^## +(.+?)\s*$"), F.lit(1)) == F.array(*map(F.lit, titles))


def gold_verdicts(gold: DataFrame, found: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Best candidate per (entity, year, scope), of the year or the next edition: ok, diverge, missing or rejected."""
    from .temporal import top_n

    f = found.select("entity", "scope", F.col("year").alias("edition"), F.col("value").alias("got"), "accepted")
    j = gold.join(f, ["entity", "scope"], "left").where("edition is null or edition in (year, year + 1)")
    best = top_n(j, ["entity", "year", "scope"], [F.desc_nulls_last("accepted"), F.asc_nulls_last(F.abs(F.col("got") - F.col("value"))), F.asc("edition")])
    all_ = gold.join(best.select("entity", "year", "scope", "got", "accepted"), ["entity", "year", "scope"], "left")
    near = F.abs(F.col("got") - F.col("value")) <= tolerance * F.abs("value")
    return all_.withColumn("verdict", F.when(F.col("got").isNull(), "missing").when(~F.col("accepted"), "rejected").when(near, "ok").otherwise("diverge"))
