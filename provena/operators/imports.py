"""Import of exported conversations of several formats as one table of messages.

A row of input is one export file's JSON text.  Its format is told from its content: an array of conversations with a
``mapping`` of nodes (tree), an array of conversations with ``chat_messages`` (chain), an object with ``version`` and a
``history`` (chats), or an object with a conversation id and its messages, flat or as a tree (native).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.operators.graph import nearest_valid_parent
from provena.operators.kept import kept

NO_PARENT = "00000000-0000-0000-0000-000000000000"  # fixed value: the parent of a first message
COLUMNS = ("file", "format", "conv", "title", "seq", "node", "parent", "role", "text", "created")


def export_format(json: Column | str) -> Column:
    """``tree``, ``chain``, ``chats``, ``native``, or null for what isn't an export; an empty array is an empty tree."""
    v = F.try_parse_json(json)
    has = lambda path, kind: F.try_variant_get(v, path, kind).isNotNull()
    of = F.schema_of_variant(v)
    array = of.startswith("ARRAY")
    return (
        F.when(array & has("$[0].chat_messages", "array<variant>"), "chain").when(array & (has("$[0].mapping", "map<string,variant>") | of.startswith("ARRAY<VOID")), "tree")
        .when(of.startswith("OBJECT") & has("$.version", "variant") & has("$.history", "array<variant>"), "chats")
        .when(of.startswith("OBJECT") & has("$.conversationId", "string") & (has("$.messages", "array<variant>") | has("$.messagesTree", "array<variant>")), "native")
    )


def _at(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _moment(v: str, path: str) -> Column:
    """Seconds since 1970 as a number, or an ISO text, as a timestamp."""
    return F.coalesce(F.timestamp_micros((_at(v, path, "double") * 1_000_000).cast("long")), F.try_to_timestamp(_at(v, path)))


def _trees(files: DataFrame) -> DataFrame:
    conv = files.select("file", F.posexplode(_at("v", "$", "array<variant>")).alias("conv", "c"))
    nodes = conv.select("file", "conv", _at("c", "$.title").alias("title"), _moment("c", "$.create_time").alias("_t"), F.posexplode(F.map_entries(_at("c", "$.mapping", "map<string,variant>"))).alias("seq", "e"))
    n = nodes.select("file", "conv", "title", "_t", "seq", F.col("e.key").alias("node"), F.col("e.value").alias("m"))
    kind, role = _at("m", "$.message.content.content_type"), F.coalesce(_at("m", "$.message.author.role"), F.lit(""))
    parts = _at("m", "$.message.content.parts", "array<variant>")
    fenced = lambda label, x: F.concat(F.lit(f"```{label}\n"), x, F.lit("\n```"))
    texts = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$", "string"), F.to_json(p)))
    text = (
        F.when((kind == "text") & parts.isNotNull(), F.array_join(texts, " "))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce(_at("m", "$.message.content.language"), F.lit("")), F.lit("\n"), F.coalesce(_at("m", "$.message.content.text"), F.lit("")), F.lit("\n```")))
        .when(kind == "execution_output", F.concat(F.lit("Execution Output:\n> "), F.coalesce(_at("m", "$.message.content.text"), F.lit(""))))
        .when(parts.isNotNull(), F.trim(F.array_join(texts, " "))).otherwise(fenced("json", F.to_json(_at("m", "$.message.content", "variant"))))
    )
    cites = F.coalesce(_at("m", "$.message.metadata.citations", "array<variant>"), F.array().cast("array<variant>"))
    said = F.when((kind == "text") & (role != "user"), with_citations(text, cites)).otherwise(text)
    skip = (role == "system") | kind.isin("thoughts", "reasoning_recap")
    out = n.where(kind.isNotNull()).select("file", F.lit("tree").alias("format"), "conv", "title", "seq", "node", _at("m", "$.parent").alias("parent"), role.alias("role"), said.alias("text"), F.coalesce(_moment("m", "$.message.create_time"), "_t").alias("created"), (skip | (F.length(F.trim(said)) == 0)).alias("_skip"))
    # node ids are unique only within their conversation
    key = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct("file", "conv", F.col(c).alias("id"))))
    hung = out.withColumn("_n", key("node")).withColumn("_p", key("parent"))
    kept = nearest_valid_parent(hung, F.coalesce("_skip", F.lit(False)), "_n", "_p")
    return kept.withColumn("parent", F.coalesce(F.get_json_object("_p", "$.id"), F.lit(NO_PARENT))).select(*COLUMNS)


def with_citations(text: Column, citations: Column) -> Column:
    """The text with each web citation's span replaced by a link, from the right, so that no replacement moves another's place."""
    one = lambda c: F.struct(
        F.try_variant_get(c, "$.start_ix", "int").alias("lo"), F.try_variant_get(c, "$.end_ix", "int").alias("hi"), F.try_variant_get(c, "$.metadata.type", "string").alias("type"),
        F.concat(F.lit(" (["), F.coalesce(F.try_variant_get(c, "$.metadata.title", "string"), F.lit("undefined")), F.lit("]("), F.coalesce(F.try_variant_get(c, "$.metadata.url", "string"), F.lit("undefined")), F.lit("))")).alias("link"))
    usable = F.filter(F.transform(citations, one), lambda c: (c["type"] == "webpage") & (c["lo"] < c["hi"]))
    ordered = F.reverse(F.array_sort(usable))
    put = lambda s, c: F.concat(F.substring(s, F.lit(1), c["lo"]), c["link"], F.substring(s, c["hi"] + 1, F.length(s)))
    return F.when(text.isNotNull(), F.aggregate(ordered, text, put))


def _chain(rows: DataFrame) -> DataFrame:
    """Messages in order: each on the one before it that has text."""
    w = Window.partitionBy("file", "conv").orderBy("seq")
    return rows.where(F.length(F.trim("text")) > 0).withColumn("parent", F.coalesce(F.lag("node").over(w), F.lit(NO_PARENT))).select(*COLUMNS)


def _chains(files: DataFrame) -> DataFrame:
    conv = files.select("file", F.posexplode(_at("v", "$", "array<variant>")).alias("conv", "c"))
    m = conv.select("file", "conv", F.coalesce(_at("c", "$.name"), F.lit("Imported chat")).alias("title"), _moment("c", "$.created_at").alias("_t"), F.posexplode(_at("c", "$.chat_messages", "array<variant>")).alias("seq", "m"))
    parts = F.filter(_at("m", "$.content", "array<variant>"), lambda p: F.try_variant_get(p, "$.type", "string") == "text")
    said = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
    text = F.coalesce(F.nullif(said, F.lit("")), _at("m", "$.text"))
    node = F.coalesce(_at("m", "$.uuid"), F.concat_ws("-", "conv", "seq"))
    role = F.when(_at("m", "$.sender") == "human", "user").otherwise("assistant")
    rows = m.select("file", F.lit("chain").alias("format"), "conv", "title", "seq", node.alias("node"), role.alias("role"), text.alias("text"), F.coalesce(_moment("m", "$.created_at"), "_t").alias("created"))
    later = Window.partitionBy("file", "conv").orderBy("seq")
    out = _chain(rows)
    # every message at least a millisecond after the one before: the running maximum of the time less its place
    ms, place = F.unix_millis("created"), F.row_number().over(later)
    at = out.withColumn("_o", place).withColumn("_m", F.max(ms - F.col("_o")).over(later.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_o"))
    return at.withColumn("created", F.when(F.col("created").isNotNull(), F.timestamp_millis("_m"))).select(*COLUMNS)


def _chats(files: DataFrame) -> DataFrame:
    h = files.select("file", F.posexplode(_at("v", "$.history", "array<variant>")).alias("conv", "c"))
    m = h.select("file", "conv", _at("c", "$.name").alias("title"), F.posexplode(_at("c", "$.messages", "array<variant>")).alias("seq", "m"))
    return _chain(m.select("file", F.lit("chats").alias("format"), "conv", "title", "seq", F.concat_ws("-", "conv", "seq").alias("node"), _at("m", "$.role").alias("role"), _at("m", "$.content").alias("text"), F.lit(None).cast("timestamp").alias("created")))


def _native(files: DataFrame) -> DataFrame:
    """Messages with their parents: flat, or nested in ``children`` (of any depth, opened a level at a time), where an empty message takes what hangs on it along."""
    top = F.coalesce(_at("v", "$.messagesTree", "array<variant>"), _at("v", "$.messages", "array<variant>"))
    now = files.select("file", _at("v", "$.title").alias("title"), F.coalesce(_at("v", "$.recursive", "boolean"), F.lit(False)).alias("nested"), F.explode(top).alias("m"), F.lit(None).cast("string").alias("above"))
    full = (F.length(F.coalesce(_at("m", "$.text"), F.lit(""))) > 0) | _at("m", "$.content", "array<variant>").isNotNull()
    now, out = kept(now.where(full | ~F.col("nested"))), None
    while not now.isEmpty():
        out = now if out is None else out.unionByName(now)
        now = now.where("nested").select("file", "title", "nested", F.explode(_at("m", "$.children", "array<variant>")).alias("m"), _at("m", "$.messageId").alias("above"))
        now = kept(now.where(full))
    out = now if out is None else out
    own = F.when(F.col("nested"), F.col("above")).otherwise(_at("m", "$.parentMessageId"))
    said = F.array_join(F.transform(_at("m", "$.content", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
    text = F.coalesce(F.nullif(_at("m", "$.text"), F.lit("")), said, F.lit(""))
    rows = out.select("file", F.lit("native").alias("format"), F.lit(0).alias("conv"), "title", _at("m", "$.messageId").alias("node"), F.coalesce(own, F.lit(NO_PARENT)).alias("parent"), F.when(_at("m", "$.isCreatedByUser", "boolean"), "user").otherwise("assistant").alias("role"), text.alias("text"), _moment("m", "$.createdAt").alias("created"))
    order = Window.partitionBy("file").orderBy("created", "node")
    return rows.where("node is not null").withColumn("seq", F.row_number().over(order) - 1).select(*COLUMNS)


def imported(exports: DataFrame, column: str = "json") -> DataFrame:
    """``(file, format, conv, title, seq, node, parent, role, text, created)`` of ``exports(file, json)``.

    Empty messages go, and of trees also system messages and thoughts; what hung on them hangs on the nearest message that
    stays, or is a first one.  Citations become links.  A row that isn't JSON or no known export is an error that names
    the file; a null row holds nothing.
    """
    f = exports.where(F.col(column).isNotNull()).select(F.col("file").cast("string").alias("file"), F.try_parse_json(column).alias("v"), export_format(column).alias("_f"))
    f = f.withColumn("_f", F.coalesce("_f", F.raise_error(F.concat(F.lit("unsupported import: "), F.coalesce("file", F.lit("?")))).cast("string")))
    of = lambda kind: f.where(F.col("_f") == kind).select("file", "v")
    return _trees(of("tree")).unionByName(_chains(of("chain"))).unionByName(_chats(of("chats"))).unionByName(_native(of("native")))
