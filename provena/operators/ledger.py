"""Token ledgers, permissions, retention and conversation views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.operators.names import all_inside


def longest_key(items: DataFrame, keys: DataFrame, model: str = "model", key: str = "key") -> DataFrame:
    """Each distinct model with the longest key it contains (later key on ties, exact match first), all found in one reading of each model."""
    m = items.select(model).where(F.col(model).isNotNull()).distinct()
    found = all_inside(m.select(F.col(model).alias("key"), F.col(model).alias("text")), keys.select(F.col(key).alias("group"), F.array(key).alias("patterns")), False)
    j = found.select(F.col("key").alias(model), F.col("group").alias(key)).join(keys, key)
    w = Window.partitionBy(model).orderBy(F.desc(F.col(model) == F.col(key)), F.desc(F.length(key)), F.desc(key))
    return j.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rated(usage: DataFrame, prices: DataFrame, threshold: int = 200_000, default: float = 6.0) -> DataFrame:
    """Usage with its rate: override, then the premium tier for long inputs, then the base rate, then the default."""
    j = usage.join(longest_key(usage, prices), "model", "left")
    tier = F.when((F.col("input_tokens") > threshold) & F.col("premium").isNotNull(), F.col("premium"))
    return j.withColumn("rate", F.coalesce("override", tier, F.col("base"), F.lit(default)))


def token_value(raw: Column, rate: Column, incomplete: Column) -> Column:
    """raw x rate; an incomplete completion costs 15 % more, rounded up."""
    return F.when(incomplete, F.ceil(raw * rate * 1.15).cast("double")).otherwise(raw * rate)


def ledger_rows(usage: DataFrame) -> DataFrame:
    """A usage row becomes up to two ledger rows: prompt and completion, each only if it has tokens."""
    rows = F.filter(
        F.array(F.struct(F.lit("prompt").alias("token_type"), F.col("input_tokens").alias("raw")), F.struct(F.lit("completion").alias("token_type"), F.col("output_tokens").alias("raw"))),
        lambda r: F.coalesce(r["raw"], F.lit(0)) > 0,
    )
    return usage.select(*usage.columns, F.inline(rows)).drop("input_tokens", "output_tokens")


def split_input(additive: Column, total: Column, read: Column, write: Column) -> Column:
    """Uncached input: the total where caches are counted beside it, else what is left of it."""
    c = lambda x: F.coalesce(x, F.lit(0))
    return F.when(additive, c(total)).otherwise(F.greatest(F.lit(0), c(total) - c(read) - c(write)))


def split_usage(usage: DataFrame) -> DataFrame:
    """Adds ``input_only, total_input, completion`` to calls with ``input_tokens, output_tokens, total_tokens, cache_read, cache_write, includes_cache``.

    Where ``includes_cache`` is null, the caches are taken to be part of the input if they fit in it.  A completion is
    repaired where the total tells of more than input, output and additive caches (tokens of thought that weren't counted).
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    caches = z("cache_read") + z("cache_write")
    inside = F.coalesce("includes_cache", caches <= z("input_tokens"))
    beside = F.when(inside, F.lit(0)).otherwise(caches)
    out = usage.withColumn("input_only", F.when(inside, F.greatest(F.lit(0), z("input_tokens") - caches)).otherwise(z("input_tokens")))
    out = out.withColumn("total_input", z("input_tokens") + beside)
    more = z("total_tokens") > z("input_tokens") + z("output_tokens") + beside
    return out.withColumn("completion", F.when(more, z("total_tokens") - z("input_tokens") - beside).otherwise(z("output_tokens")))


def effective_bits(acl: DataFrame, principals: DataFrame) -> DataFrame:
    """Permission bits of a set of principals per resource."""
    return acl.join(principals.distinct(), ["principal_type", "principal"], "left_semi").groupBy("resource").agg(F.bit_or("bits").alias("bits"))


def accessible(acl: DataFrame, principals: DataFrame, required: int) -> DataFrame:
    return acl.join(principals.distinct(), ["principal_type", "principal"], "left_semi").where(F.col("bits").bitwiseAND(required) == required).select("resource").distinct()


def sole_owned(acl: DataFrame, principal: str, delete_bit: int) -> DataFrame:
    """Resources the principal may delete and nobody else may."""
    can = acl.where(F.col("bits").bitwiseAND(delete_bit) > 0)
    return can.where(F.col("principal") == principal).select("resource").distinct().join(can.where(F.col("principal") != principal).select("resource").distinct(), "resource", "left_anti")


def tag_counts(before: DataFrame, after: DataFrame, counts: DataFrame) -> DataFrame:
    """Tag counts after conversations changed their tags; never under 0."""
    one = lambda d, s: d.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg((F.count("*") * s).alias("d"))
    delta = one(before, -1).unionByName(one(after, 1)).groupBy("tag").agg(F.sum("d").alias("d"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return counts.join(delta, "tag", "full").select("tag", F.greatest(F.lit(0), z("n") + z("d")).alias("n"))


def digest(memories: DataFrame, key: str = "user") -> DataFrame:
    """Numbered list in order of key, and the token total."""
    g = memories.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("m"), F.sum("tokens").alias("tokens"))
    line = F.transform("m", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["key"], F.lit(": "), x["value"]))
    return g.select(key, F.array_join(line, "\n").alias("digest"), "tokens")


def text_stats(messages: DataFrame, text: str = "text") -> DataFrame:
    """Bytes, quoted lines and their bytes of each message."""
    quotes = F.filter(F.split(text, "\n"), lambda x: F.startswith(x, F.lit(">")))
    return messages.withColumn("bytes", F.octet_length(text)).withColumn("quote_lines", F.size(quotes)).withColumn("quote_bytes", F.octet_length(F.array_join(quotes, "")))


def activity(users: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    c = conversations.groupBy("user").agg(F.count("*").alias("conversations"))
    m = messages.groupBy("user").agg(F.count("*").alias("messages"))
    j = users.select("user").distinct().join(c, "user", "left").join(m, "user", "left").fillna(0, ["conversations", "messages"])
    return j.orderBy(F.desc("conversations"), F.desc("messages"), "user")


def visible(expires: Column, temporary: Column, now: Column) -> Column:
    """Retention: permanent rows until they expire; rows of unknown kind only without an expiry; temporary rows never."""
    return F.when(temporary, F.lit(False)).when(temporary.isNull(), expires.isNull()).otherwise(expires.isNull() | (expires > now))


def expired(df: DataFrame, expires: str, now: Column, n: int) -> DataFrame:
    return df.where(F.col(expires).isNotNull() & (F.col(expires) <= now)).orderBy(expires).limit(n)


def since_message(messages: DataFrame, message_id) -> DataFrame:
    """Rows strictly later than a message of the same conversation."""
    p = messages.where(F.col("message_id") == message_id).select(F.col("conv_id"), F.col("at").alias("_at"))
    return messages.join(F.broadcast(p), "conv_id").where("at > _at").drop("_at")  # one row


def without_fields(kind: T.DataType, value: Column, names: set[str]) -> Column:
    """A value without the named fields, at any depth of structs, arrays and maps; a struct that is left with no field becomes null."""
    if isinstance(kind, T.StructType):
        parts = [without_fields(f.dataType, value[f.name], names).alias(f.name) for f in kind.fields if f.name not in names]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_fields(kind.elementType, x, names))
    if isinstance(kind, T.MapType):
        clean = F.map_filter(value, lambda k, _: ~k.isin(*names)) if isinstance(kind.keyType, T.StringType) else value
        return F.transform_values(clean, lambda _, x: without_fields(kind.valueType, x, names))
    return value


def shared_view(messages: DataFrame, salt: str, columns: list[str], secret: tuple[str, ...] = (), root: str | None = None) -> DataFrame:
    """Allow-listed columns with pseudonymous ids; parents follow their messages, and ``root`` (the parent of a first message) stays as it is.

    Fields named in ``secret`` are dropped from the allowed columns at any depth.
    """
    new = lambda c: F.concat(F.lit("msg_"), F.substring(F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256), 1, 21))
    p = lambda c: F.when(F.col(c).isNotNull(), F.when(F.col(c).cast("string").eqNullSafe(F.lit(root)), F.col(c).cast("string")).otherwise(new(c)))
    clean = [without_fields(messages.schema[c].dataType, F.col(c), set(secret)).alias(c) for c in columns if c not in secret]
    return messages.select(p("message_id").alias("message_id"), p("parent_id").alias("parent_id"), *clean)
