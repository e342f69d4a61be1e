"""Spark data sources for the two byte formats: `wal` (a log file) and `sst` (a sorted run file).

Reading: spark.read.format("wal").load(pattern); one partition per file. Files are whole units in both formats, small
by design (a log is cut at every flush, a run is what a flush wrote), so a task reads one file at a time.

Writing: every partition writes one file. Files get their names when the job commits, so a failed or repeated task
leaves nothing behind that a reader would see.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidelog.sources import codec

ROWS = 50_000


def _local(path: str) -> str:
    return path.removeprefix("file://")


@dataclass
class _File(InputPartition):
    number: int
    path: str


class _Reader(DataSourceReader):
    suffix = ""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self):
        path = _local(self.options["path"])
        found = sorted(glob.glob(f"{path}/*{self.suffix}") if os.path.isdir(path) else glob.glob(path), key=_order)
        # Spark asks for at least one partition.
        return [_File(i, p) for i, p in enumerate(found)] or [_File(-1, "")]

    def rows(self, data: bytes, path: str, number: int) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.number < 0:
            return
        held: list[tuple] = []
        for row in self.file_rows(partition):
            held.append(row)
            if len(held) == ROWS:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def file_rows(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        yield from self.rows(data, partition.path, partition.number)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _order(path: str) -> tuple[int, str]:
    """By generation as a number: a name of seven digits follows one of six."""
    stem = os.path.basename(path).split(".")[0]
    return (int(stem) if stem.isdigit() else -1, path)


class _WalReader(_Reader):
    """`seq` is the record's number in its file. A torn tail is left out; with the option `torn` set to `fail` it is
    an error. Nothing behind a torn record is read, as nothing tells where the next one would begin."""

    suffix = ".log"

    def rows(self, data, path, number):
        try:
            for seq, (offset, kind, key, value) in enumerate(codec.records(data)):
                yield os.path.basename(path), seq, offset, kind, key, value
        except codec.Torn:
            if self.options.get("torn") == "fail":
                raise


class _SstReader(_Reader):
    """`gen` is the number in the file's name. A file without a sound footer is an error.

    Filters key = ..., key IN (...) and gen = ... are taken over: files of other generations are not opened, and of the
    others only the footer and the filter are read, the index and single records where the filter may hold a key.
    """

    suffix = ".sst"
    keys: frozenset[bytes] | None = None
    gens: frozenset[int] | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = [f.value] if isinstance(f, (EqualTo, EqualNullSafe)) else f.value if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name == "key" and all(isinstance(v, (bytes, bytearray)) for v in values):
                wanted = frozenset(bytes(v) for v in values)
                self.keys = wanted if self.keys is None else self.keys & wanted
            elif name == "gen" and all(isinstance(v, int) for v in values):
                self.gens = frozenset(values) if self.gens is None else self.gens & frozenset(values)
            else:
                yield f

    def partitions(self):
        found = super().partitions()
        kept = [p for p in found if p.number < 0 or self.gens is None or _order(p.path)[0] in self.gens]
        return kept or [_File(-1, "")]

    def file_rows(self, partition):
        if self.keys is None:
            yield from super().file_rows(partition)
            return
        with open(partition.path, "rb") as f:
            for offset, kind, key, value in codec.run_lookup(f, self.keys):
                yield _order(partition.path)[0], offset, kind, key, value

    def rows(self, data, path, number):
        index_at, *_ = codec.run_sections(data)
        gen = _order(path)[0]
        for offset, kind, key, value in codec.records(data, 0, index_at):
            yield gen, offset, kind, key, value


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Writes each partition to a temporary file; commit gives the files their numbers, after those there are."""

    suffix = ""

    def __init__(self, options: dict, overwrite: bool):
        self.dir, self.overwrite = _local(options["path"]), overwrite

    def encode(self, rows: list[tuple]) -> bytes:
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        os.makedirs(self.dir, exist_ok=True)
        rows: list[tuple] = []
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("kind", "key", "value")]
            rows += zip(cols[0].to_pylist(), *[c.cast(pa.binary()).to_pylist() for c in cols[1:]])
        if not rows:
            return _Written("", 0)
        path = f"{self.dir}/.{uuid.uuid4().hex}.tmp"
        with open(path, "wb") as f:
            f.write(self.encode(rows))
            f.flush()
            os.fsync(f.fileno())
        return _Written(path, len(rows))

    def commit(self, messages):
        there = sorted(glob.glob(f"{self.dir}/*{self.suffix}"), key=_order)
        if self.overwrite:
            for p in there:
                os.remove(p)
            there = []
        gen = _order(there[-1])[0] + 1 if there else 1
        for m in messages:
            if m is not None and m.path:
                os.rename(m.path, f"{self.dir}/{gen:06d}{self.suffix}")
                gen += 1

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class _WalWriter(_Writer):
    suffix = ".log"

    def encode(self, rows):
        return b"".join(codec.encode(*r) for r in rows)


class _SstWriter(_Writer):
    """Of a key's rows in a partition the last one is kept; the file is sorted by key."""

    suffix = ".sst"

    def encode(self, rows):
        newest = {key: (kind, key, value) for kind, key, value in rows}
        return codec.encode_run([newest[k] for k in sorted(newest)])


class WalSource(DataSource):
    @classmethod
    def name(cls):
        return "wal"

    def schema(self):
        return "file string, seq bigint, offset bigint, kind int, key binary, value binary"

    def reader(self, schema):
        return _WalReader(self.options, schema)

    def writer(self, schema, overwrite):
        return _WalWriter(self.options, overwrite)


class SstSource(DataSource):
    @classmethod
    def name(cls):
        return "sst"

    def schema(self):
        return "gen bigint, offset bigint, kind int, key binary, value binary"

    def reader(self, schema):
        return _SstReader(self.options, schema)

    def writer(self, schema, overwrite):
        return _SstWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats `wal` and `sst` known to the session, and lets it hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WalSource)
    spark.dataSource.register(SstSource)
