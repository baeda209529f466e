"""Session files as a Spark data source: `spark.read.format("spikesession").option("table", "points").load(path)`.

Options: path (a file, or a pattern on a file system that all executors share), table (of schema.TABLES), names (a
JSON list: payloads of these variables only; unknown names are passed over), max_payload_bytes, validate_layout,
ignore_metadata_errors, compact_timestamps, numeric_strings, from_row and before_row (rows of each variable by number; of
continuous signals, samples). Large files, and large variables in them, are read by several tasks. Files in stores that only Spark reaches go
through `decode_files`.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import TABLES
from ..session import Session
from .codec import TABLE_OF, Reader, ReadOptions, payload_batches, session_row, variable_row

#: Bytes of files that one partition reads; payload bytes read at once, and markers, as their cells are Python values.
PARTITION_BYTES, UNIT_BYTES, UNIT_MARKERS = 64 << 20, 8 << 20, 1 << 15


def read_options(options: dict[str, str]) -> ReadOptions:
    flag = lambda name, default: str(options.get(name, default)).lower() == "true"
    names = options.get("names")
    return ReadOptions(
        frozenset(json.loads(names)) if names is not None else None, flag("ignore_metadata_errors", False), int(options.get("max_payload_bytes", 512 << 20)),
        flag("validate_layout", True), flag("compact_timestamps", False), flag("numeric_strings", True),
    )


class FileParts(InputPartition):
    """(path, k, n): the k-th of n parts of each file's payload."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts


@dataclass
class Wanted:
    """Which rows of each variable are read, by number."""

    low: int = 0
    high: int | None = None


def ranges(reader: Reader, table: str, wanted: Wanted) -> list[tuple[dict, int, int, int]]:
    """(variable, lo, hi, bytes) of all that is to be read of a table, in pieces of about UNIT_BYTES."""
    out = []
    for v in sorted(reader.header.variables, key=lambda v: v["data_offset"]):
        if TABLE_OF[v["kind"]] != table or not reader.wanted(v):
            continue
        n = reader.units(v)
        lo, hi = max(0, wanted.low), n if wanted.high is None else min(n, wanted.high)
        each = max(1, reader.payload_bytes(v) // max(n, 1))
        step = max(1, min(UNIT_BYTES // each, UNIT_MARKERS if v["kind"] == "marker" else UNIT_BYTES))
        out += [(v, a, min(hi, a + step), (min(hi, a + step) - a) * each) for a in range(lo, hi, step)]
    return out


def open_reader(path: str, options: ReadOptions) -> Reader:
    def read(offset: int, size: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(size)

    return Reader(read, os.path.getsize(path), options)


def head_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a table of plain columns."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def table_batches(reader: Reader, path: str, table: str, wanted: Wanted | None = None, k: int = 0, n: int = 1) -> Iterator[pa.RecordBatch]:
    """The table's rows of one file, in Arrow batches; of its payload, the k-th of n parts."""
    if table in ("sessions", "variables"):
        meta = reader.metadata()
        rows = [session_row(path, path, reader.header, meta)] if table == "sessions" else [variable_row(path, v) for v in reader.header.variables]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, head_schema(TABLES[table]))
        return
    pieces = ranges(reader, table, wanted or Wanted())
    total, done = sum(size for *_, size in pieces), 0
    for v, lo, hi, size in pieces:
        if done * n // max(total, 1) == k:
            yield from payload_batches(path, v, reader.payload(v, lo, hi), lo)
        done += size


class SessionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.table = dict(options), options.get("table", "points")
        high = options.get("before_row")
        self.wanted = Wanted(int(options.get("from_row", 0)), int(high) if high is not None else None)
        if self.table not in TABLES:
            raise ValueError(f"no table {self.table}")

    def partitions(self) -> list[FileParts]:
        """Small files together, large ones in several parts, by their sizes alone: headers are read in tasks."""
        pattern = self.options["path"].removeprefix("file://")
        paths = sorted(glob.glob(pattern)) or [pattern]
        out, some, filled = [], [], 0
        for path in paths:
            size = os.path.getsize(path)
            n = 1 if self.table in ("sessions", "variables") else max(1, -(-size // PARTITION_BYTES))
            if n > 1:
                out += [FileParts([(path, k, n)]) for k in range(n)]
                continue
            some.append((path, 0, 1))
            filled += size
            if filled >= PARTITION_BYTES or len(some) >= 100:
                out.append(FileParts(some))
                some, filled = [], 0
        return out + ([FileParts(some)] if some else [])

    def read(self, partition: FileParts) -> Iterator[pa.RecordBatch]:
        for path, k, n in partition.parts:
            yield from table_batches(open_reader(path, read_options(self.options)), path, self.table, self.wanted, k, n)


class SessionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spikesession"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "points")]

    def reader(self, schema) -> SessionReader:
        return SessionReader(self.options)


def read_session(spark: SparkSession, path: str, **options) -> Session:
    """All tables of a file or pattern, each read when asked for; headers alone need no payload.

    `Session.payload`, `timestamps` and `timestamp_range` open the files anew for the one variable, and the rows, that they
    want. (Filters on the tables are not handed to the reader: Spark 4.1 keeps what a Python source has been told with the
    table, so that two filters on it in one query would read the same rows.)
    """
    spark.dataSource.register(SessionSource)
    loaded = frozenset(options["names"]) if options.get("names") is not None else None
    options = {k: json.dumps(v) if isinstance(v, list | tuple) else str(v) for k, v in options.items()}

    def table(name: str, **more) -> DataFrame:
        return spark.read.format("spikesession").options(**(options | more), table=name).load(path)

    def reopen(name: str, variable: str, low: int, high: int | None) -> DataFrame:
        return table(name, names=json.dumps([variable]), from_row=str(low), **({} if high is None else {"before_row": str(high)}))

    return Session(**{t: table(t) for t in TABLES}, loaded=loaded, reopen=reopen)


def decode_files(files: DataFrame, table: str, **options) -> DataFrame:
    """The same table, by the same options, from rows of Spark's binaryFile source (path, content), wherever the files are."""
    wanted = Wanted(options.pop("from_row", 0), options.pop("before_row", None))
    opts = read_options({k: json.dumps(v) if isinstance(v, list | tuple) else str(v) for k, v in options.items()})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                yield from table_batches(Reader.of_bytes(raw, opts), path, table, wanted)

    return files.select("path", "content").mapInArrow(decode, TABLES[table])
