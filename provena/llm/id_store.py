"""Token ids on disk with keyed access: raw payload files and a minimal perfect hash index.

Payload.  Documents are put in ascending doc_id order and their ids are written, nothing between them, to one file per
range of doc_ids: little-endian unsigned integers of the smallest width that holds the vocabulary.

Index.  Every document has a key (doc_id, copy); copies number the rows of one doc_id, in the order of their texts'
hashes.  Keys are dealt by hash to index files of about ``INDEX_KEYS`` keys.  In a file a minimal perfect hash gives
each of its n keys its own slot 0..n-1: at every level the keys not yet placed are hashed to bits, those alone on a bit
are placed, and a slot is the rank of the key's bit.  A slot holds a 32-bit fingerprint of the key, the payload file,
the offset and length there and the number of ids before the document in the whole store.  So one document is found
with a few reads of fixed size, whatever the store's size, and a key that isn't there is told by its fingerprint (all
but one in 2^32 of such keys).

Files are written by their task under a name of its own and listed only in what the task returns, so a lost task's
files are in no listing and a repeated task writes new ones.

Null text: no ids but the end id; a null doc_id is a key of its own and comes first.  Repeated rows are copies.
Empty tables make a store without files.  A hot doc_id is dealt over as many ranges as it fills by its texts' hashes;
what shares doc_id and text goes through one task as a stream.  Other columns are ignored.  Texts of any length are
held one batch at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, shared_dir, staged, table_input
from .tokens import WordEncoder, tokenizer, vocabulary_path
from .words import U64, Batches, mix, per_batch, utf8

END, FILE_TOKENS, INDEX_KEYS, READ_TOKENS = 1, 1 << 24, 1 << 18, 1 << 20
_NULL = np.uint64(0x6E756C6C6B657921)
_SLOT = np.dtype([("print", "<u4"), ("file", "<u4"), ("offset", "<i8"), ("n", "<i8"), ("start", "<i8")])


def _store(uri: str):
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def key_hashes(doc_id: pa.Array, copy: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the keys: of the place, and of the file and fingerprint."""
    ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    c = copy.to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    with np.errstate(over="ignore"):
        base = np.where(doc_id.is_null().to_numpy(zero_copy_only=False), mix(ids ^ _NULL), mix(ids))
        both = mix(base + c * U64(0x9E3779B97F4A7C15))
        return mix(both ^ U64(0xA5A5A5A5A5A5A5A5)), mix(both + base * U64(0xD6E8FEB86659FD93))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes: bits of all levels as one array, ranks every 512 bits."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words.reshape(-1, 8)).sum(1)
        self.ranks = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys + U64(level + 1) * U64(0x9E3779B97F4A7C15)) % U64(size)).astype(np.int64)

    @classmethod
    def built(cls, keys: np.ndarray, load: float = 2.0) -> PerfectHash:
        if len(np.unique(keys)) < len(keys):
            raise ValueError("keys of a perfect hash must differ")
        sizes, levels = [], []
        while len(keys):
            size = -(-int(load * len(keys)) // 512) * 512
            at = cls._bit(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The keys' slots; -1 for keys that no level has (surely absent)."""
        out, open_, base = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            bit = base + self._bit(keys[open_], level, size)
            word = self.words[bit >> 6]
            low = (bit & 63).astype(U64)
            found = (word >> low) & U64(1) == 1
            b, w = bit[found], word[found]
            within = np.bitwise_count(w & ((U64(1) << low[found]) - U64(1))).astype(np.int64)
            block = b >> 9
            for i in range(7):  # whole words of the 512-bit block before the bit's word
                before = np.flatnonzero((b >> 6) & 7 > i)
                within[before] += np.bitwise_count(self.words[(block[before] << 3) + i])
            out[open_[found]] = self.ranks[block] + within
            open_, base = open_[~found], base + size
        return out


class IndexFile:
    """One index file: the perfect hash, then a record a slot."""

    def __init__(self, raw: bytes):
        head = int.from_bytes(raw[:4], "little")
        meta = json.loads(raw[4 : 4 + head])
        words = np.frombuffer(raw, "<u8", sum(meta["sizes"]) // 64, 4 + head)
        self.hash, self.slots = PerfectHash(meta["sizes"], words), np.frombuffer(raw, _SLOT, meta["keys"], 4 + head + 8 * len(words))

    @staticmethod
    def packed(place: np.ndarray, prints: np.ndarray, columns: dict[str, np.ndarray]) -> bytes:
        h = PerfectHash.built(place)
        table = np.zeros(len(place), _SLOT)
        at = h.slots(place)
        for name, values in {"print": prints, **columns}.items():
            table[name][at] = values
        meta = json.dumps({"sizes": h.sizes, "keys": len(place)}).encode()
        meta += b" " * (-(4 + len(meta)) % 8)
        return len(meta).to_bytes(4, "little") + meta + h.words.tobytes() + table.tobytes()

    def lookup(self, place: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Records of the keys and whether each is there."""
        at = self.hash.slots(place)
        got = self.slots[np.maximum(at, 0)] if len(self.slots) else np.zeros(len(at), _SLOT)
        return got, (at >= 0) & (got["print"] == prints)


def _encoded(bounds, vocabulary: str | None, end: int):
    """Ids of every document and the range it belongs to: rows without doc_id first, then by doc_id; what fills several ranges is dealt by its text's hash."""
    width = np.uint16 if _small(vocabulary) else np.uint32

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cuts, unnamed = bounds.value
        doc, encode = batch["doc_id"], WordEncoder(vocabulary)
        high = batch["u"].to_numpy().astype(np.int64).view(U64) + U64(1 << 63) >> U64(32)
        number = doc.fill_null(0).to_numpy(zero_copy_only=False)
        missing = doc.is_null().to_numpy(zero_copy_only=False)
        lo = np.where(missing, 0, unnamed + np.searchsorted(cuts, number, "left"))
        many = np.where(missing, max(unnamed, 1), np.searchsorted(cuts, number, "right") + unnamed - lo + 1)
        part = lo + (high * many.astype(U64) >> U64(32)).astype(np.int64)
        raw = [np.append(x, np.uint32(end)).astype(width).tobytes() for x in encode(utf8(batch["text"]))]
        return pa.record_batch([doc, batch["u"], pa.array(part, pa.int32()), pa.array(raw, pa.binary())], names=["doc_id", "u", "part", "ids"])

    return per_batch(run)


def _small(vocabulary: str | None) -> bool:
    return tokenizer(vocabulary or vocabulary_path(), False).get_vocab_size() <= 1 << 16


def _written(folder: str, width: int, file_tokens: int):
    """Streams a task's sorted documents into payload files, a new one for each range and after ``file_tokens`` ids."""

    def run(batches: Batches) -> Batches:
        task, (store, root) = TaskContext.get(), _store(folder)
        store.create_dir(root, recursive=True)
        out, name, part, files, offset, last, copy = None, "", None, 0, 0, None, 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, p, raw in zip(*(batch[c].to_pylist() for c in ("doc_id", "part", "ids")), strict=True):
                if p != part or offset >= file_tokens:
                    if out is not None:
                        out.close()
                    name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}-{files:05d}.bin"
                    out, files, offset = store.open_output_stream(f"{root}/{name}"), files + 1, 0
                copy = copy + 1 if (p, doc) == (part, last) else 0
                part, last, n = p, doc, len(raw) // width
                for c, x in zip(cols, (doc, copy, p, name, offset, n), strict=True):
                    c.append(x)
                out.write(raw)
                offset += n
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "copy", "part", "name", "offset", "n"])
        if out is not None:
            out.close()

    return run


def _indexed(folder: str):
    """Writes one index file of all the task's keys."""

    def run(batches: Batches) -> Batches:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        column = lambda c: table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c]
        place, prints = key_hashes(column("doc_id"), column("copy"))
        raw = IndexFile.packed(place, prints.astype(np.uint32), {c: table[c].to_numpy() for c in ("file", "offset", "n", "start")})
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name = f"index-{table['shard'][0].as_py():06d}-{TaskContext.get().taskAttemptId()}.mph"
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(raw)
        yield pa.record_batch([table["shard"].slice(0, 1).combine_chunks(), pa.array([name]), pa.array([table.num_rows], pa.int64())], names=["shard", "name", "keys"])

    return run


def _sharded(shards: int):
    """Keys with the index file that their hash names."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, prints = key_hashes(batch["doc_id"], batch["copy"])
        return pa.record_batch([*batch.columns, pa.array(((prints >> U64(32)) % U64(shards)).astype(np.int64))], names=[*batch.schema.names, "shard"])

    return per_batch(run)


def _looked_up(folder: str):
    """Places of keys; a task opens its index file once."""

    def run(batches: Batches) -> Batches:
        index, at = None, None
        for batch in batches:
            for name in pa.compute.unique(batch["name"]).to_pylist():
                if name != at:
                    store, root = _store(folder)
                    with store.open_input_file(f"{root}/{name}") as f:
                        index, at = IndexFile(f.read()), name
                mine = batch.filter(pa.compute.equal(batch["name"], name))
                place, prints = key_hashes(mine["doc_id"], mine["copy"])
                got, found = index.lookup(place, prints.astype(np.uint32))
                values = [pa.array(got[c].astype(np.int64), mask=~found) for c in ("file", "offset", "n", "start")]
                yield pa.record_batch([mine["doc_id"], mine["copy"], *values], names=["doc_id", "copy", "file", "offset", "n", "start"])

    return run


def _payload(folder: str, width: int):
    """The ids of the places, which come sorted by file and offset; each block of a file is read at once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids: list = []
        store, root = _store(folder)
        rows = list(zip(*(batch[c].to_pylist() for c in ("name", "block", "offset", "n")), strict=True))
        lo = 0
        while lo < len(rows):
            hi, end = lo, 0
            while hi < len(rows) and rows[hi][:2] == rows[lo][:2]:
                end = max(end, rows[hi][2] + rows[hi][3])
                hi += 1
            first = rows[lo][2]
            with store.open_input_file(f"{root}/{rows[lo][0]}") as f:
                raw = np.frombuffer(f.read_at((end - first) * width, first * width), f"<u{width}")
            ids += [raw[o - first : o - first + n].astype("<u4").tobytes() for _, _, o, n in rows[lo:hi]]
            lo = hi
        return pa.record_batch([batch["doc_id"], batch["copy"], batch["start"], batch["n"], pa.array(ids, pa.binary())], names=["doc_id", "copy", "start", "n_tokens", "ids"])

    return per_batch(run)


@dataclass
class Store:
    """A written store: its folder, bytes an id, and the listings ``files(file, name, first, n, docs)`` and ``index(shard, name, keys)``."""

    folder: str
    width: int
    shards: int
    files: DataFrame
    index: DataFrame

    def located(self, keys: DataFrame) -> DataFrame:
        """``keys(doc_id, copy)`` with ``(file, offset, n, start)``; null where the store has no such key."""
        asked = table_input(keys, "doc_id", "copy").mapInArrow(_sharded(self.shards), "doc_id long, copy long, shard long")
        asked = asked.join(self.index.select("shard", "name"), "shard", "left")
        schema = "doc_id long, copy long, file long, offset long, n long, start long"
        found = asked.where("name is not null").repartitionById(self.shards, F.col("shard").cast("int")).select("doc_id", "copy", "name").mapInArrow(_looked_up(self.folder), schema)
        nowhere = asked.where("name is null").select("doc_id", "copy", *[F.lit(None).cast("long").alias(c) for c in ("file", "offset", "n", "start")])
        return found.unionByName(nowhere)

    def fetched(self, keys: DataFrame, block: int = READ_TOKENS) -> DataFrame:
        """``(doc_id, copy, start, n_tokens, ids)`` of the keys that are there; ``ids`` as little-endian unsigned 32-bit integers."""
        at = self.located(keys).where("file is not null").join(self.files.select("file", "name"), "file")
        at = at.withColumn("block", F.floor(F.col("offset") / block)).repartition("name", "block").sortWithinPartitions("name", "offset")
        return at.mapInArrow(_payload(self.folder, self.width), "doc_id long, copy long, start long, n_tokens long, ids binary")


def write_store(docs: DataFrame, vocabulary: str | None = None, end: int = END, file_tokens: int = FILE_TOKENS, index_keys: int = INDEX_KEYS, ranges: int | None = None) -> Store:
    """Encodes ``docs(doc_id, text)`` and writes payload and index files to the shared folder."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/provena/ids-{uuid.uuid4().hex}"
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = [i / parts for i in range(1, parts)] or [0.5]
    cuts, rows, unnamed = table_input(docs, "doc_id").agg(F.percentile_approx("doc_id", grid, 100 * parts), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    unnamed = -(-parts * unnamed // rows) if rows else 0
    shared = spark.sparkContext.broadcast((np.array(cuts or [], np.int64), unnamed))
    # rows of one doc_id by the order of their hashes, which is also how ranges deal them
    source = table_input(docs, "doc_id", "text").withColumn("u", F.xxhash64(F.coalesce("text", F.lit(""))))
    coded = source.mapInArrow(_encoded(shared, vocabulary, end), "doc_id long, u long, part int, ids binary")
    ordered = coded.repartitionById(len(cuts or []) + 1 + unnamed, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "u")
    width = 2 if _small(vocabulary) else 4
    entries = staged(ordered.mapInArrow(_written(folder, width, file_tokens), "doc_id long, copy long, part int, name string, offset long, n long"), "id-entries")
    # a prefix scan over the files, of which there is one a range or ``file_tokens`` ids
    before = Window.orderBy("part", "name")
    files = entries.groupBy("part", "name").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    files = files.select("name", (F.row_number().over(before) - 1).cast("long").alias("file"), F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), "n", "docs")
    files = staged(files, "id-files")
    # copies of a doc_id that lies in several ranges go on counting: only rows without doc_id and doc_ids at a cut can
    edges = spark.createDataFrame([(c,) for c in {None, *(cuts or [])}], "edge long")
    split = entries.join(F.broadcast(edges), F.col("doc_id").eqNullSafe(F.col("edge"))).groupBy("edge", F.col("part").alias("range")).agg(F.count("*").alias("rows"))
    earlier = F.coalesce(F.sum("rows").over(Window.partitionBy("edge").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = split.withColumn("earlier", earlier).where("earlier > 0")
    keyed = entries.join(F.broadcast(split), F.col("doc_id").eqNullSafe(F.col("edge")) & (F.col("part") == F.col("range")), "left")
    keyed = keyed.withColumn("copy", F.col("copy") + F.coalesce("earlier", F.lit(0))).join(files.select("name", "file", "first"), "name")
    keyed = keyed.select("doc_id", "copy", "file", "offset", "n", (F.col("first") + F.col("offset")).alias("start"))
    shards = max(1, -(-rows // index_keys))
    dealt = keyed.mapInArrow(_sharded(shards), "doc_id long, copy long, file long, offset long, n long, start long, shard long")
    index = staged(dealt.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(_indexed(folder), "shard long, name string, keys long"), "id-index")
    return Store(folder, width, shards, files, index)


def keys_of(docs: DataFrame) -> DataFrame:
    """The keys of a table's rows: every doc_id with copies from 0 on, counted before they are spread out."""
    return table_input(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("rows")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))


def op11_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files and fetched back by key through the index."""
    docs = read(spark, sf_dir, "documents")
    got = write_store(docs).fetched(keys_of(docs))
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
