"""Data sources for files that Spark's own readers don't cover: series in JSON windows and text with a preamble.

Register with ``register(spark)``; both list their files on the driver and read them in tasks through the file system that
the path names.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

BLOCK_BYTES = 64 << 20


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri if ":" in uri else f"file://{uri}"))


def _files(path: str, pattern: str) -> list[tuple[str, int]]:
    """Files under a folder (or the file itself) whose name matches, with their sizes, in order of name."""
    store, root = _store(path)
    info = store.get_file_info(root)
    found = [info] if info.is_file else store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and re.search(pattern, f.base_name))


@dataclass
class Part(InputPartition):
    file: str
    start: int = 0
    end: int = -1


class _SeriesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", r"\.json$")
        self.since, self.until = (date.fromisoformat(options[k]) if k in options else None for k in ("since", "until"))

    def partitions(self) -> list[Part]:
        return [Part(f) for f, _ in _files(self.path, self.pattern)] or [Part("")]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.file:
            return
        store, _ = _store(self.path)
        with store.open_input_file(part.file) as f:
            points = json.loads(f.read())
        for p in points:
            try:
                day = datetime.strptime(p["data"], "%d/%m/%Y").date()
            except (KeyError, TypeError, ValueError):
                continue  # a row without a date says nothing
            if (self.since is None or day >= self.since) and (self.until is None or day <= self.until):
                try:
                    value = float(p.get("valor"))
                except (TypeError, ValueError):
                    value = None
                yield part.file.rsplit("/", 1)[-1], day, value


class DateSeries(DataSource):
    """``date_series``: arrays of ``{data: dd/mm/yyyy, valor: text}``, one partition a file.

    Options: path, pattern (of file names), since and until (ISO dates).  Bad values are null, rows without a date are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "date_series"

    def schema(self) -> str:
        return "file string, date date, value double"

    def reader(self, schema) -> DataSourceReader:
        return _SeriesReader(self.options)


class _PreambleReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.pattern, self.names, self.width = options["path"], options.get("pattern", "."), names, len(names) - 1
        self.skip, self.encoding, self.sep = int(options.get("skip", 0)), options.get("encoding", "ISO-8859-1"), options.get("sep", "\t")
        self.block, self.header = int(options.get("block", BLOCK_BYTES)), options.get("header", "true") == "true"

    def partitions(self) -> list[Part]:
        store, _ = _store(self.path)
        parts = []
        for file, size in _files(self.path, self.pattern):
            with store.open_input_stream(file) as f:
                text = io.BufferedReader(f)
                start = sum(len(text.readline()) for _ in range(self.skip + self.header))
            cuts = [*range(start, size, self.block), size]
            parts += [Part(file, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return parts or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the part's bytes; the last one is read to its end."""
        if not part.file:
            return
        store, _ = _store(self.path)
        with store.open_input_file(part.file) as f:
            first = part.start
            f.seek(max(first - 1, 0))
            stream = io.BufferedReader(f)
            at = max(first - 1, 0)
            if first and self._begun(stream):
                at += 1
            elif first:
                at += 1 + len(stream.readline())
            rows: list[list] = []
            while at < part.end:
                line = stream.readline()
                if not line:
                    break
                at += len(line)
                fields = next(csv.reader([line.decode(self.encoding).rstrip("\r\n")], delimiter=self.sep, quoting=csv.QUOTE_NONE), [])
                rows.append([*fields[: self.width], *[None] * (self.width - len(fields))])
                if len(rows) == 10_000:
                    yield self._batch(rows, part.file)
                    rows = []
            if rows:
                yield self._batch(rows, part.file)

    @staticmethod
    def _begun(stream) -> bool:
        return stream.read(1) == b"\n"

    def _batch(self, rows: list[list], file: str) -> pa.RecordBatch:
        columns = [pa.array([x if x else None for x in c], pa.string()) for c in zip(*rows, strict=True)]
        return pa.record_batch([*columns, pa.array([file.rsplit("/", 1)[-1]] * len(rows))], names=self.names)


class PreambleText(DataSource):
    """``preamble_text``: separated text with ``skip`` lines before the header of every file, split into blocks at line ends.

    Names come from the first file's header: trimmed, empty ones by position (``c3``), repeated ones numbered (``unit``,
    ``unit_2``); without a header (``header`` false) all are by position over ``columns`` columns.  All columns are text,
    empty fields null, short rows filled with nulls, what is beyond the last name is left out.  Line breaks inside fields aren't known to it.
    """

    @classmethod
    def name(cls) -> str:
        return "preamble_text"

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType()) for n in [*self._names(), "file"]])

    def _names(self) -> list[str]:
        o = self.options
        if o.get("header", "true") != "true":
            return [f"c{i}" for i in range(int(o["columns"]))]
        found = _files(o["path"], o.get("pattern", "."))
        if not found:
            raise ValueError(f"no files under {o['path']}")
        with _store(o["path"])[0].open_input_stream(found[0][0]) as f:
            text = io.BufferedReader(f)
            for _ in range(int(o.get("skip", 0))):
                text.readline()
            raw = text.readline().decode(o.get("encoding", "ISO-8859-1")).rstrip("\r\n").split(o.get("sep", "\t"))
        seen: dict[str, int] = {}
        names = []
        for i, n in enumerate(x.strip() or f"c{i}" for i, x in enumerate(raw)):
            seen[n.lower()] = seen.get(n.lower(), 0) + 1
            names.append(n if seen[n.lower()] == 1 else f"{n}_{seen[n.lower()]}")
        return names

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PreambleReader(self.options, schema.names)


def register(spark: SparkSession) -> SparkSession:
    for source in (DateSeries, PreambleText):
        spark.dataSource.register(source)
    return spark


def series(spark: SparkSession, path: str, key: str = r"^(.*)\.json$", **options) -> DataFrame:
    """``(series, date, value)`` of a folder of windows: the series is named by the file name's group; where windows overlap a date has its greatest value."""
    d = register(spark).read.format("date_series").options(path=path, **options).load()
    return d.groupBy(F.regexp_extract("file", key, 1).alias("series"), "date").agg(F.max("value").alias("value"))


def with_preamble(spark: SparkSession, path: str, skip: int, **options) -> DataFrame:
    return register(spark).read.format("preamble_text").options(path=path, skip=skip, **options).load()
