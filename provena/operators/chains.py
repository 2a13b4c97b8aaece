"""Audit chains: canonical JSON, rows whose hashes hang on each other, verification and purges.

A row's hash is SHA-256 over the canonical JSON of its hashed columns, among them the hash of the row before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = "\u0001previous\u0001"


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """A value of any nesting as JSON that is the same for equal values: keys sorted, nothing between tokens, nulls written.

    Whole numbers have no fraction, other numbers no exponent and no trailing zeros (up to 18 decimals, below 10^20);
    times are ISO with milliseconds in UTC; map keys are text.  Binary is written as hex; NaN and infinities as null.
    """
    if isinstance(kind, T.StructType):
        names = sorted(kind.names)
        parts = [F.concat(F.lit(f'{"" if i == 0 else ","}"{n}":'), canonical_json(value[n], kind[n].dataType)) for i, n in enumerate(names)]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        one = lambda e: F.concat(_text(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, one), ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType | T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, T.DecimalType):
        out = _short(value.cast("string"))
    elif isinstance(kind, T.FractionalType):
        plain = F.when(F.abs(value) < 1e20, _short(value.cast("string").try_cast("decimal(38,18)").cast("string"))).otherwise(value.cast("string"))
        out = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), plain)
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        at = value if isinstance(kind, T.TimestampNTZType) else F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz"))
        out = F.concat(F.lit('"'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"'))
    elif isinstance(kind, T.BinaryType):
        out = F.concat(F.lit('"'), F.lower(F.hex(value)), F.lit('"'))
    else:
        out = _text(value.cast("string"))
    return F.coalesce(out, F.lit("null"))


def _text(x: Column) -> Column:
    """A JSON string: what is null stays null."""
    return F.when(x.isNotNull(), F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))


def _short(x: Column) -> Column:
    return F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)


def entry_json(df: DataFrame, columns: list[str], prev_hash: str = "prev_hash", previous: Column | None = None) -> Column:
    """Canonical JSON of a row's hashed columns, the previous hash among them."""
    fields = [*columns, prev_hash]
    value = F.struct(*[(previous if c == prev_hash and previous is not None else F.col(c)).alias(c) for c in fields])
    kind = T.StructType([T.StructField(c, T.StringType() if c == prev_hash else df.schema[c].dataType) for c in fields])
    return canonical_json(value, kind)


def entry_hash(df: DataFrame, columns: list[str], prev_hash: str = "prev_hash") -> Column:
    return F.sha2(entry_json(df, columns, prev_hash), 256)


def _linked(genesis: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = object(), genesis
        for batch in batches:
            before, own = [], []
            for c, text in zip(batch["chain"].to_pylist(), batch["_json"].to_pylist(), strict=True):
                last, chain = (last if c == chain else genesis), c
                before.append(last)
                last = hashlib.sha256(text.replace(_MARK, last).encode()).hexdigest()
                own.append(last)
            yield pa.record_batch([batch["chain"], batch["seq"], pa.array(before, pa.string()), pa.array(own, pa.string())], names=["chain", "seq", "prev_hash", "hash"])

    return run


def linked(df: DataFrame, columns: list[str], chain: str, seq: str, genesis: str) -> DataFrame:
    """``(chain, seq, prev_hash, hash)``: the rows' hashes, each on the one before.

    A chain is sequential by nature: its rows pass through one task in order, as a stream that holds one hash.
    """
    marked = F.regexp_replace(F.to_json(F.array(F.lit(_MARK))), r'^\["|"\]$', "")
    text = F.replace(entry_json(df, columns, previous=F.lit(_MARK)), marked, F.lit(_MARK))
    rows = df.select(F.col(chain).alias("chain"), F.col(seq).alias("seq"), text.alias("_json")).repartition("chain").sortWithinPartitions("chain", "seq")
    kinds = {c: df.schema[x].dataType.simpleString() for c, x in (("chain", chain), ("seq", seq))}
    return rows.mapInArrow(_linked(genesis), f"chain {kinds['chain']}, seq {kinds['seq']}, prev_hash string, hash string")


def verified(df: DataFrame, columns: list[str], chain: str, seq: str, genesis: str, checkpoints: DataFrame | None = None, prev_hash: str = "prev_hash", own: str = "hash") -> DataFrame:
    """``(chain, n, first_seq, bad_seq, fault)``: the first fault of every chain, null where it is sound.

    ``start``: the chain doesn't begin at 1 and no checkpoint is given; ``checkpoint``: the one given, ``(chain, through_seq,
    hash)``, ends elsewhere or with another hash; ``gap``: the next number is missing or the same again (``bad_seq`` is the number that was
    due); ``link``: the previous hash isn't that of the row before, or of the genesis; ``hash``: the row's content doesn't
    have its hash.  Rows meet their neighbours by an equi-join on (chain, number), so a chain of any length is spread over
    all tasks.
    """
    r = df.select(F.col(chain).alias("chain"), F.col(seq).cast("long").alias("seq"), F.col(prev_hash).alias("_p"), F.col(own).alias("_h"), entry_hash(df, columns, prev_hash).alias("_e"))
    ends = r.groupBy("chain").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    # of rows of one number the one that goes on is the least; the others are a gap
    one = r.groupBy("chain", "seq").agg(F.min(F.struct("_h", "_p", "_e")).alias("_r"), F.count("*").alias("_n")).select("chain", "seq", "_r.*", "_n")
    before = one.select("chain", (F.col("seq") + 1).alias("seq"), F.col("_h").alias("_before"), F.lit(True).alias("_known"))
    j = one.join(before, ["chain", "seq"], "full").join(ends, "chain")
    due = F.col("_n").isNull() & (F.col("seq") <= F.col("last_seq"))
    inner = F.col("_n").isNotNull() & F.col("_known").isNotNull()
    fault = F.when(due, "gap").when(inner & ~F.col("_p").eqNullSafe(F.col("_before")), "link").when(inner & ~F.col("_h").eqNullSafe(F.col("_e")), "hash")
    rest = j.where(F.col("seq") > F.col("first_seq")).select("chain", "seq", fault.alias("fault"))
    again = one.where("_n > 1").select("chain", (F.col("seq") + 1).alias("seq"), F.lit("gap").alias("fault"))
    head = one.join(ends.select("chain", F.col("first_seq").alias("seq")), ["chain", "seq"])
    if checkpoints is not None:
        head = head.join(checkpoints.select(F.col("chain"), "through_seq", F.col("hash").alias("_c")), "chain", "left")
    else:
        head = head.withColumn("through_seq", F.lit(None).cast("long")).withColumn("_c", F.lit(None).cast("string"))
    trusted = (F.col("through_seq") == F.col("seq") - 1) & F.col("_c").eqNullSafe(F.col("_p"))
    began = (
        F.when((F.col("seq") == 1) & ~F.col("_p").eqNullSafe(F.lit(genesis)), "link").when((F.col("seq") != 1) & F.col("through_seq").isNull(), "start")
        .when((F.col("seq") != 1) & ~trusted, "checkpoint").when(~F.col("_h").eqNullSafe(F.col("_e")), "hash")
    )
    faults = rest.unionByName(head.select("chain", "seq", began.alias("fault"))).unionByName(again).where("fault is not null")
    first = faults.groupBy("chain").agg(F.min(F.struct("seq", F.when(F.col("fault") == "gap", 0).otherwise(1).alias("_o"), "fault")).alias("_f"))
    return ends.join(first, "chain", "left").select("chain", "n", "first_seq", F.col("_f.seq").alias("bad_seq"), F.col("_f.fault").alias("fault"))


def purged(df: DataFrame, chain: str, seq: str, at: str, cut: Column, prev_hash: str = "prev_hash") -> tuple[DataFrame, DataFrame]:
    """(rows kept, ``(chain, deleted, through_seq, hash)``): what precedes, by number, the first row at or after the cut goes.

    A chain without such a row goes whole.  Only chains that lost rows and kept some get a checkpoint (null otherwise):
    a purge of nothing must not vouch for what was missing before.
    """
    first = df.where(F.col(at) >= cut).groupBy(chain).agg(F.min(seq).alias("_first"))
    j = df.join(first, chain, "left")
    stays = F.col("_first").isNotNull() & (F.col(seq) >= F.col("_first"))
    kept = j.where(stays).drop("_first")
    link = F.min_by(F.when(stays, F.col(prev_hash)), F.when(stays, F.col(seq)))
    gone = j.groupBy(F.col(chain).alias("chain")).agg(F.count_if(~stays).alias("deleted"), (F.min(F.when(stays, F.col(seq))) - 1).alias("through_seq"), link.alias("hash"))
    return kept, gone.where("deleted > 0")
