"""What model calls cost, runs of calls, and the counters kept beside conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions.norm import fold

from .ledger import rated


def cache_rated(usage: DataFrame, prices: DataFrame, threshold: int = 200_000, default: float = 6.0) -> DataFrame:
    """``rated`` usage with cache rates: ``read`` and ``write`` of the price list, or the input rate where they are null."""
    return rated(usage, prices, threshold, default).withColumn("write_rate", F.coalesce("write", "rate")).withColumn("read_rate", F.coalesce("read", "rate"))


def prompt_value(fresh: Column, write: Column, read: Column, rate: Column, write_rate: Column, read_rate: Column) -> Column:
    """struct(value, raw, rate) of a prompt with cached parts: value and raw are debits (negative), the rate is blended over all tokens."""
    z = lambda x: F.abs(F.coalesce(x, F.lit(0)))
    total = z(fresh) + z(write) + z(read)
    value = z(fresh) * rate + z(write) * write_rate + z(read) * read_rate
    return F.struct((-value).alias("value"), (-total).alias("raw"), F.when(total > 0, F.abs(value) / total).otherwise(F.abs(rate)).alias("rate"))


def call_costs(rated_usage: DataFrame) -> DataFrame:
    """Adds ``usd``: absolute credits of the prompt and the completion, by the million.

    Takes ``input_only, cache_write, cache_read, output_tokens, completion_rate`` beside the rates.
    """
    p = prompt_value(F.col("input_only"), F.col("cache_write"), F.col("cache_read"), F.col("rate"), F.col("write_rate"), F.col("read_rate"))
    out = F.abs(F.coalesce("output_tokens", F.lit(0)) * F.col("completion_rate"))
    return rated_usage.withColumn("usd", (F.abs(p["value"]) + out) / 1e6)


def final_calls(events: DataFrame, runs: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """``runs(conversation, run)`` with the last primary call (no ``kind``) of the run; calls without a run belong to any."""
    e = events.where("kind is null").withColumn("call", F.struct("idx", *[c for c in events.columns if c not in (conversation, "run", "kind", "idx")]))
    own = e.where("run is not null").groupBy(conversation, "run").agg(F.max_by("call", "idx").alias("_own"))
    loose = e.where("run is null").groupBy(conversation).agg(F.max_by("call", "idx").alias("_any"))
    j = runs.join(own, [conversation, "run"], "left").join(loose, conversation, "left")
    later = F.col("_own.idx") >= F.coalesce(F.col("_any.idx"), F.lit(-1))
    return j.withColumn("call", F.when(F.col("_own").isNotNull() & later, F.col("_own")).otherwise(F.col("_any"))).drop("_own", "_any")


def outputs_before(events: DataFrame, conversation: str = "conv_id", output: str = "output_tokens") -> DataFrame:
    """Adds ``before``: outputs of the earlier primary and summarising calls of the same run, or of those without a run; for a call without one, of all."""
    counted = F.when(F.col("kind").isNull() | (F.col("kind") == "summarization"), F.coalesce(output, F.lit(0))).otherwise(0)
    loose = F.when(F.col("run").isNull(), counted).otherwise(0)
    up = lambda *keys: Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    of_run, of_any, of_all = F.sum(counted).over(up(conversation, "run")), F.sum(loose).over(up(conversation)), F.sum(counted).over(up(conversation))
    z = lambda x: F.coalesce(x, F.lit(0))
    return events.withColumn("before", F.when(F.col("run").isNull(), z(of_all)).otherwise(z(of_run) + z(of_any)))


def file_usage(files: DataFrame, requests: DataFrame) -> DataFrame:
    """``files(file, usage)`` raised by one for each request that names the file, however often it does."""
    n = requests.select("request", F.explode("files").alias("file")).distinct().groupBy("file").agg(F.count("*").alias("_n"))
    return files.join(n, "file", "left").withColumn("usage", F.coalesce("usage", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def project_stats(projects: DataFrame, conversations: DataFrame, shown: Column) -> DataFrame:
    """Per project: its shown conversations, and the latest one with its time (ties: larger id)."""
    c = conversations.where(shown).groupBy("project").agg(F.count("*").alias("n"), F.max(F.struct("at", "conv_id")).alias("m"))
    return projects.join(c, "project", "left").select(*projects.columns, F.coalesce("n", F.lit(0)).alias("n"), F.col("m.conv_id").alias("latest"), F.col("m.at").alias("at"))


def audit_filter(chosen: dict[str, list] | None = None, name: tuple[str, str] | None = None, since=None, until=None, at: str = "at", search: str | None = None, fields: tuple[str, ...] = ()) -> Column:
    """Columns in the chosen values, a literal text contained in a name, a time range, and a search over some fields; what is missing filters nothing."""
    has = lambda c, text: F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    out = F.lit(True)
    for column, values in (chosen or {}).items():
        if values:
            out = out & F.col(column).isin(list(values))
    if name and name[1]:
        out = out & has(*name)
    out = out & (F.col(at) >= since if since is not None else F.lit(True)) & (F.col(at) <= until if until is not None else F.lit(True))
    if search:
        any_ = F.lit(False)
        for c in fields:
            any_ = any_ | has(c, search)
        out = out & any_
    return out


def events_of(json: Column | str, schema: str) -> Column:
    """A JSON array of events; text that is none gives an empty one."""
    return F.coalesce(F.from_json(json, f"array<{schema}>"), F.array().cast(f"array<{schema}>"))


def cursor_of(cursor: Column | str, schema: str = "struct<value:string, tie:string>") -> Column:
    """A cursor (base64 of JSON) as a struct; a bad one is null."""
    text = F.try_to_binary(cursor, F.lit("base64")).cast("string")
    return F.from_json(text, schema)


def of_tenant(left: DataFrame, right: DataFrame, key: str, tenant: str, columns: list[str]) -> DataFrame:
    """A lookup that keeps rows without a partner and blanks partners of another tenant."""
    r = right.select(key, F.col(tenant).alias("_tenant"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.col(tenant).eqNullSafe(F.col("_tenant"))
    return left.join(r, key, "left").select(*left.columns, *[F.when(same, F.col(f"_{c}")).alias(c) for c in columns])


def numbered_contracts(texts: DataFrame, contracts: DataFrame, text: str, number: str, pattern: str = r"contrato\D{0,20}(\d+)/(\d{4})") -> DataFrame:
    """Texts that name a contract joined to it: number and year are read from both sides."""
    t = fold(text)
    found = texts.withColumn("_n", F.regexp_extract(t, pattern, 1).try_cast("long")).withColumn("_y", F.regexp_extract(t, pattern, 2)).where("_n is not null")
    known = contracts.withColumn("_n", F.regexp_extract(number, r"^(\d+)/(\d{4})", 1).try_cast("long")).withColumn("_y", F.regexp_extract(number, r"^(\d+)/(\d{4})", 2)).where("_n is not null")
    return found.join(known, ["_n", "_y"]).drop("_n", "_y")
