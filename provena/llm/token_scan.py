"""Token counts by a separator scan over flat, unindexed token files.

A token file is a run of little-endian ids in which an end-of-document id closes
every document; nothing says where documents start.  It is read in byte ranges of a
fixed size, so a file of any length is dealt to many tasks.  Each block is searched for the separator on its own
(vectorised); a prefix scan over the blocks' small summaries (tokens, separators, place of the
last separator) then stitches documents that cross block borders and numbers them.
Only separator positions are shuffled, never tokens.

``token_files`` writes such files from documents (null text: an empty document; null doc_id: a document
without a name) to a shared folder; a file that a lost task left behind is in no manifest.  What follows
the last separator of a file is one more, unterminated document; an empty file or table has none.  Extra
columns are ignored; repeated rows are documents of their own.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, shared_dir, staged, table_input
from .tokens import WordEncoder
from .words import Batches, per_batch, utf8

SEPARATOR, BLOCK_TOKENS, DTYPE = 49407, 1 << 19, "<u2"


def _store(uri: str):
    """File system and path of a folder or file that all executors see."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def token_files(docs: DataFrame, folder: str, separator: int = SEPARATOR, vocabulary: str | None = None) -> DataFrame:
    """Writes the documents as one flat token file per partition; returns the manifest ``(file, bytes, first, doc_ids)``.

    ``doc_ids`` are documents in the order written, the first of them number ``first`` of its file; the row with
    ``bytes`` closes a file.  The scan uses the manifest only for the files' names and lengths.
    """

    def run(batches: Batches) -> Batches:
        encode, out, written, first, at = WordEncoder(vocabulary, plain=True), None, 0, 0, ""
        row = lambda ids, size: pa.record_batch(
            [pa.array([at]), pa.array([size], pa.int64()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "bytes", "first", "doc_ids"])
        for batch in batches:
            numbers, raw = batch["doc_id"].to_pylist(), utf8(batch["text"])
            for i in range(0, len(raw), 500):
                if out is None:
                    task = TaskContext.get()
                    at = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.tokens"
                    store, path = _store(folder)
                    store.create_dir(path, recursive=True)
                    store, path = _store(at)
                    out = store.open_output_stream(path)
                data = b"".join(np.append(got, np.uint32(separator)).astype(DTYPE).tobytes() for got in encode(raw[i : i + 500]))
                out.write(data)
                written += len(data)
                yield row(numbers[i : i + 500], None)
                first += len(numbers[i : i + 500])
        if out is not None:
            out.close()
            yield row([], written)

    return table_input(docs, "doc_id", "text").mapInArrow(run, "file string, bytes long, first long, doc_ids array<long>")


def existing_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes)`` of token files under ``path``; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def separators(files: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, dtype: str = DTYPE) -> DataFrame:
    """``(file, block, n, at)`` of ``files(file, bytes)``: every block's number of tokens and the places of its separators."""
    size = block_tokens * np.dtype(dtype).itemsize

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, at = [], []
        for file, block in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), strict=True):
            store, path = _store(file)
            with store.open_input_file(path) as f:
                tokens = np.frombuffer(f.read_at(min(size, f.size() - block * size), block * size), dtype)
            n.append(len(tokens))
            at.append(np.flatnonzero(tokens == separator))
        return pa.record_batch([batch["file"], batch["block"], pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int64()))], names=["file", "block", "n", "at"])

    blocks = files.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / size))).alias("block"))
    return blocks.repartition("file", "block").mapInArrow(per_batch(run), "file string, block long, n long, at array<long>")


def stitch(found: DataFrame) -> DataFrame:
    """``(file, ordinal, start, n_tokens, terminated)`` of every document of the scanned files."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file")
    # the scan itself: one small row per block
    s = found.select("file", "block", "n", F.size("at").alias("count"), F.try_element_at(F.col("at"), F.lit(-1)).alias("at_last"))
    s = s.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("end", F.col("base") + F.col("n"))
    s = s.withColumn("seen", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("last", F.col("base") + F.col("at_last"))
    s = s.withColumn("carry", F.coalesce(F.max("last").over(before), F.lit(-1)))
    s = s.withColumn("file_end", F.max("end").over(every)).withColumn("file_last", F.coalesce(F.max("last").over(every), F.lit(-1))).withColumn("total", F.sum("count").over(every))
    placed = found.select("file", "block", "at").join(s.where("count > 0").select("file", "block", "base", "seen", "carry"), ["file", "block"])
    prev = lambda x, i: F.when(i > 0, F.col("base") + F.get("at", i - 1)).otherwise(F.col("carry"))
    spans = F.transform("at", lambda x, i: F.struct((F.col("seen") + i).alias("ordinal"), (prev(x, i) + 1).alias("start"), (F.col("base") + x - prev(x, i) - 1).alias("n_tokens")))
    closed = placed.select("file", F.inline(spans)).withColumn("terminated", F.lit(True))
    open_ = s.where("block = 0 and file_last < file_end - 1").select(
        "file", F.col("total").alias("ordinal"), (F.col("file_last") + 1).alias("start"), (F.col("file_end") - F.col("file_last") - 1).alias("n_tokens"), F.lit(False).alias("terminated")
    )
    return closed.unionByName(open_)


def op7_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, found by scanning the token files; the manifest only names the documents found."""
    folder = f"{shared_dir(spark)}/provena/tokens-{uuid.uuid4().hex}"
    manifest = staged(token_files(read(spark, sf_dir, "documents"), folder), "manifest")
    found = staged(separators(manifest.where("bytes is not null").select("file", "bytes")), "separators")
    names = manifest.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return stitch(found).join(names, ["file", "ordinal"]).select("doc_id", F.substring_index("file", "/", -1).alias("file"), F.col("ordinal").cast("long"), "start", "n_tokens")
