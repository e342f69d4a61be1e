"""Consolidation of very many small sorted runs into few files of a given size, by merging.

1. The live files are told by their latest listings, which also give the bytes there are and so the number of key
   ranges; a bounded sample of the live records' keys gives the ends of the ranges.
2. Where records are read, they come as slices of sorted files. The slices are merged k ways into one sorted run, copies
   of a record are folded, and the run is cut at the ends of the ranges. A slice that is sorted is never sorted again.
3. Each range receives its part of every run and merges these k ways. A range beyond MERGE_BYTES is merged externally:
   what is held is merged into a run on the task's scratch disk, and the runs are merged in the end.
4. Along the merged order files are rolled by bytes, and the listing of each new file - count, bytes, ends, filter - is
   made while it is written.

The write order is part of a range's ends, so a key that holds a third of all records is spread over many ranges.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import materialize, shared_path
from tidelog.sources.codec import bloom_of, fnv1a64

TARGET_BYTES = 64 << 20
#: A range is made to hold about so many bytes at most, and so many at least where there are cores to spare.
RANGE_BYTES, LEAST_BYTES = 64 << 20, 4 << 20
#: Beyond so many ranges they grow instead; their ends are then a few MB.
RANGES_MAX = 20_000
#: Keys of the sample for each range, and in all.
SAMPLES, SAMPLES_MAX = 200, 400_000
#: Arrow bytes that a task holds while it merges.
SLICE_BYTES, MERGE_BYTES = 16 << 20, 96 << 20
#: Up to so many live files, of 8 bytes each, are broadcast; beyond, the records are shuffled by file.
BROADCAST_FILES = 1_000_000
#: Taken for a record of a file whose listing has no bytes, where only the number of ranges depends on it.
TYPICAL_BYTES = 64
#: Output files of one range are numbered range * FILES_PER_RANGE + n.
FILES_PER_RANGE = 1 << 20
ROWS_OUT = 10_000
FIELDS = ("cluster_id", "key", "seq", "kind", "value", "rec_len")
LISTING = "n_records int, n_bytes bigint, min_key string, max_key string, bloom_k int, bloom_m bigint, bloom_bits binary"
PARTS = ("part", "cluster_id", "file_no")
_LEAST = -(2**63)


def latest_listings(listings: DataFrame) -> DataFrame:
    """(file_id, cluster_id, gen, file_name, listed_at, file_state, n_records, n_bytes): each file's latest listing.

    Of listings at the same time the greatest state by name counts. Rows without file_id are ignored; a listing
    without a time is older than any with one.
    """
    have = set(listings.columns)
    more = {"cluster_id": "int", "gen": "int", "file_name": "string", "n_records": "bigint", "n_bytes": "bigint"}
    fields = ["listed_at", "file_state", *more]
    rows = listings.select(
        "file_id", "listed_at", "file_state", *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in more.items()]
    )
    last = rows.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max(F.struct(*fields)).alias("_last"))
    return last.select("file_id", *[F.col(f"_last.{c}").alias(c) for c in fields])


def live_files(listings: DataFrame) -> DataFrame:
    """(file_id): files whose latest listing says live."""
    return latest_listings(listings).filter(F.col("file_state") == "live").select("file_id")


def ranges_for(n_bytes: int, cores: int) -> int:
    """How many ranges: enough for RANGE_BYTES each and for all cores, if that leaves LEAST_BYTES to each."""
    at_most = -(-n_bytes // LEAST_BYTES)
    return max(1, min(RANGES_MAX, max(-(-n_bytes // RANGE_BYTES), min(2 * cores, at_most))))


# -- merging ---------------------------------------------------------------------------------------------------


def order_keys(rows: pa.Table) -> list[tuple]:
    """(cluster, has a key, key, seq) of each row: what records are ordered by; nulls come first.

    Strings compare by code point, as their UTF-8 bytes do.
    """
    cluster = [_LEAST if c is None else c for c in rows["cluster_id"].to_pylist()]
    key = rows["key"].to_pylist()
    return [(c, k is not None, k or "", _LEAST if s is None else s) for c, k, s in zip(cluster, key, rows["seq"].to_pylist())]


def sorted_slices(keys: Sequence) -> list[tuple[int, int]]:
    """(from, to) of the longest pieces that are in order as they stand."""
    out, lo = [], 0
    for i in range(1, len(keys)):
        if keys[i] < keys[i - 1]:
            out.append((lo, i))
            lo = i
    if len(keys):
        out.append((lo, len(keys)))
    return out


def merge_order(keys: Sequence) -> list[int]:
    """The positions of `keys` in order, by a k-way merge of the slices that are in order; of equal keys the first only."""
    slices = sorted_slices(keys)
    if len(slices) < 2:
        order: Iterable[int] = range(len(keys))
    else:
        order = (i for _, i in heapq.merge(*[zip(keys[lo:hi], range(lo, hi)) for lo, hi in slices]))
    out: list[int] = []
    last = None
    for i in order:
        if keys[i] != last:
            last = keys[i]
            out.append(i)
    return out


def _merged(held: list[pa.RecordBatch]) -> tuple[pa.Table, list[tuple]]:
    rows = pa.Table.from_batches(held).combine_chunks()
    keys = order_keys(rows)
    order = merge_order(keys)
    return rows.take(pa.array(order, pa.int64())), [keys[i] for i in order]


def _form_runs(ends: list[tuple]):
    """Rows as read to sorted runs without copies, each row with the number of its range."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys = _merged(held)
        borders = [0, *(bisect_left(keys, e) for e in ends), len(keys)]
        number = np.repeat(np.arange(len(ends) + 1), np.diff(borders))
        yield from rows.append_column("range", pa.array(number, pa.int32())).to_batches(ROWS_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SLICE_BYTES:
                yield from cut(held)
                held, size = [], 0
        if size:
            yield from cut(held)

    return run


class _Scratch:
    """Sorted runs that a task put aside, in the scratch folders that Spark gives its workers."""

    def __init__(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        self.folder = tempfile.TemporaryDirectory(prefix="merge-", dir=folder)
        self.files: list[str] = []

    def put(self, rows: pa.Table) -> None:
        self.files.append(os.path.join(self.folder.name, str(len(self.files))))
        with pa.OSFile(self.files[-1], "wb") as f, pa.ipc.new_stream(f, rows.schema) as out:
            out.write_table(rows, ROWS_OUT)

    def rows(self, n: int) -> Iterator[tuple[tuple, int, tuple]]:
        with pa.OSFile(self.files[n], "rb") as f, pa.ipc.open_stream(f) as stream:
            for batch in stream:
                columns = [c.to_pylist() for c in batch.columns]
                for key, *row in zip(order_keys(pa.Table.from_batches([batch])), *columns):
                    yield key, n, tuple(row)

    def merged(self, schema: pa.Schema) -> Iterator[tuple[pa.Table, list[tuple]]]:
        keys: list[tuple] = []
        out: list[tuple] = []
        last = None
        for key, _, row in heapq.merge(*[self.rows(n) for n in range(len(self.files))], key=lambda r: r[:2]):
            if key == last:
                continue
            last = key
            keys.append(key)
            out.append(row)
            if len(out) == ROWS_OUT:
                yield self._table(out, schema), keys
                keys, out = [], []
        if out:
            yield self._table(out, schema), keys
        self.folder.cleanup()

    @staticmethod
    def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _merge_range(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, list[tuple]]]:
    """The rows of one range in order, without copies, from runs that come one behind the other."""
    held: list[pa.RecordBatch] = []
    size, aside, schema = 0, None, None
    for batch in batches:
        schema = batch.schema
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            aside = aside or _Scratch()
            aside.put(_merged(held)[0])
            held, size = [], 0
    if aside is None:
        if held:
            yield _merged(held)
        return
    if held:
        aside.put(_merged(held)[0])
        held = []
    yield from aside.merged(schema)


class _Roller:
    """Numbers the files along the merged order and keeps the listing of the one that is being filled."""

    def __init__(self, first: int, target: int):
        self.file_no, self.target = first, target
        self.cluster: int | None = None
        self.last: tuple | None = None
        self.open = False
        self._clear()

    def _clear(self) -> None:
        self.n = self.bytes = 0
        self.least: str | None = None
        self.greatest: str | None = None
        self.hashes: list[np.ndarray] = []

    def listing(self) -> dict:
        k, m, bits = bloom_of(np.concatenate(self.hashes) if self.hashes else np.empty(0, np.uint64))
        return {
            "cluster_id": self.cluster, "file_no": self.file_no,
            "listing": {"n_records": self.n, "n_bytes": self.bytes, "min_key": self.least, "max_key": self.greatest, "bloom_k": k, "bloom_m": m, "bloom_bits": bits},
        }

    def roll(self, rows: pa.Table, keys: list[tuple]) -> Iterator[tuple[int, int, int]]:
        """(file_no, from, to) of the rows; yields -1 for the number where a file is full and can be listed."""
        size = rows["rec_len"].to_numpy()
        cluster = np.array([k[0] for k in keys])
        at = 0
        while at < len(keys):
            if self.open and (self.cluster_key != cluster[at] or self.bytes >= self.target):
                yield -1, at, at
                self.file_no += 1
                self._clear()
            self.open, self.cluster_key = True, cluster[at]
            self.cluster = None if cluster[at] == _LEAST else int(cluster[at])
            end = int(np.searchsorted(cluster, cluster[at], "right"))
            filled = self.bytes + np.cumsum(size[at:end])
            # A record belongs to the file in which its first byte falls.
            hi = at + int(np.searchsorted(filled - size[at:end], self.target, "left"))
            self._take(keys[at:hi], int(size[at:hi].sum()))
            yield self.file_no, at, hi
            at = hi

    def _take(self, keys: list[tuple], n_bytes: int) -> None:
        self.n += len(keys)
        self.bytes += n_bytes
        named = [k for k in keys if k[1]]
        if named:
            self.least = named[0][2] if self.least is None else self.least
            # Versions of one key stand together.
            new = [k[2].encode() for i, k in enumerate(named) if k[2] != (named[i - 1][2] if i else self.greatest)]
            self.greatest = named[-1][2]
            if new:
                self.hashes.append(fnv1a64(new))


def _merge(target: int, most: int):
    """Runs of ranges to the rows of files and their listings."""
    listing = pa.struct([("n_records", pa.int32()), ("n_bytes", pa.int64()), ("min_key", pa.string()), ("max_key", pa.string()), ("bloom_k", pa.int32()), ("bloom_m", pa.int64()), ("bloom_bits", pa.binary())])

    def out(rows: pa.Table, file_no: int) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        whole = [rows[c] for c in FIELDS] + [pa.nulls(n, listing), pa.array(["records"]).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, file_no))]
        yield from pa.table(whole, [*FIELDS, "listing", "part", "file_no"]).combine_chunks().to_batches(ROWS_OUT)

    def listed(r: _Roller) -> pa.RecordBatch:
        x = r.listing()
        types = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
        # The number of the file stands where records have their order: listings of a range share a folder.
        values = [x["cluster_id"], None, x["file_no"], None, None, None]
        arrays = [pa.array([v], t) for v, t in zip(values, types)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([x["listing"]], listing), pa.array(["listings"]), pa.array([-1], pa.int64())], [*FIELDS, "listing", "part", "file_no"])

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            number = batch["range"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    yield int(number[lo]), batch.slice(lo, hi - lo).select(list(FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = by_range(batches)
        first = next(parts, None)
        if first is None:
            return
        # A partition is a range.
        roller = _Roller(first[0] * FILES_PER_RANGE, target)
        for rows, keys in _merge_range((b for _, b in _chain(first, parts)), most):
            for file_no, lo, hi in roller.roll(rows, keys):
                if file_no < 0:
                    yield listed(roller)
                else:
                    yield from out(rows.slice(lo, hi - lo), file_no)
        yield listed(roller)

    return run


def _chain(first, rest):
    yield first
    yield from rest


# -- the job ---------------------------------------------------------------------------------------------------


def _ends(live: DataFrame, keys: DataFrame, n_records: int, ranges: int) -> list[tuple]:
    """The first order key of each range but the first, from a sample of the live records' keys."""
    if ranges < 2:
        return []
    wanted = min(SAMPLES_MAX, SAMPLES * ranges)
    one_in = max(1, n_records // wanted)
    some = keys.filter(F.pmod(F.xxhash64("cluster_id", "key", "seq"), F.lit(one_in)) == 0).join(live, "file_id", "left_semi")
    # About as many as wanted; the limit holds if the listings gave far too few records.
    got = order_keys(some.select("cluster_id", "key", "seq").limit(2 * SAMPLES_MAX).toArrow())
    got.sort()
    return sorted({got[len(got) * k // ranges] for k in range(1, ranges)}) if got else []


def _bytes():
    """The encoded length of a record: as recorded, else from its parts."""
    whole = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 9
    return F.coalesce(F.col("rec_len"), whole, F.lit(9)).cast("bigint")


def consolidate_files(
    records: DataFrame, listings: DataFrame, target_bytes: int = TARGET_BYTES, path: str | None = None, merge_bytes: int = MERGE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Writes the consolidated files and their listings; (records, listings) as DataFrames over what was written.

    Records: (cluster_id, key, seq, kind, value, rec_len, file_no). The files are Parquet under cluster_id=.../file_no=...
    of `path`/part=records (by default a fresh path in the shared folder), sorted by key and then write order, none much
    beyond `target_bytes`. Records are told by (cluster_id, key, seq), and wherever one occurs its other fields are taken
    to be the same.

    Listings: in the form of `listings`: the new files as live, with a file_id beyond all others and the next generation
    of their cluster, and the files they replace as dropped, all later than every listing before; so the live files of
    the old and the new listings together are the new files.

    Nulls: a record with a null key sorts first and is kept; an absent rec_len is computed. Files without a listing
    are not live; records without file_id belong to no file. Empty inputs give an empty result. Extra columns are ignored.
    """
    spark = records.sparkSession
    path = path or shared_path(spark, "consolidated")
    # Written once, so that sizes are known before anything is joined: a large file then makes no hot join key.
    latest = materialize(latest_listings(listings), "latest")
    live_rows = latest.filter(F.col("file_state") == "live")
    known = F.coalesce("n_bytes", F.col("n_records") * TYPICAL_BYTES, F.lit(TYPICAL_BYTES))
    size = live_rows.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(known), F.lit(0)), F.coalesce(F.sum(F.coalesce("n_records", (F.col("n_bytes") / TYPICAL_BYTES).cast("bigint"), F.lit(1))), F.lit(0))
    ).first()
    live = live_rows.select("file_id")
    live = F.broadcast(live) if size[0] <= BROADCAST_FILES else live
    ends = _ends(live, records.select("file_id", "cluster_id", "key", "seq"), int(size[2]), ranges_for(int(size[1]), spark.sparkContext.defaultParallelism))
    sized = records.select("file_id", F.col("cluster_id").cast("int"), "key", F.col("seq").cast("bigint"), F.col("kind").cast("int"), "value", _bytes().alias("rec_len"))
    held = sized.join(live, "file_id", "left_semi").select(*FIELDS)
    rows = T.StructType([T.StructField(f.name, f.dataType) for f in held.schema])
    runs = held.mapInArrow(_form_runs(ends), T.StructType([*rows, T.StructField("range", T.IntegerType())]))
    ranged = runs.repartitionById(len(ends) + 1, F.col("range"))
    schema = T.StructType([*rows, T.StructField("listing", T._parse_datatype_string(LISTING)), T.StructField("part", T.StringType()), T.StructField("file_no", T.LongType())])
    _write(ranged.mapInArrow(_merge(target_bytes, merge_bytes), schema), path)
    back = spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(path)
    done = back.filter(F.col("part") == "records").select(*FIELDS, "file_no")
    made = back.filter(F.col("part") == "listings").select("cluster_id", F.col("seq").alias("file_no"), "listing.*")
    return done, materialize(_listings(latest, made), "listings")


def _write(rows: DataFrame, path: str) -> None:
    """Writes rows that come file by file, in their order: with a writer for each open file Spark does not sort them."""
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, None)
    conf.set(name, "256")
    try:
        rows.write.partitionBy(*PARTS).parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _listings(latest: DataFrame, made: DataFrame) -> DataFrame:
    """The listings of new files and of those they replace."""
    # One row: the ends of what was listed. Null where there was nothing.
    top = latest.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("_file"), F.max("listed_at").alias("_at"))
    gens = latest.groupBy("cluster_id").agg((F.coalesce(F.max("gen"), F.lit(0)) + 1).cast("int").alias("gen"))
    later = F.col("_at") + (F.lit(1) if isinstance(latest.schema["listed_at"].dataType, T.IntegralType) else F.expr("INTERVAL 1 SECOND"))
    new = made.withColumnRenamed("cluster_id", "_cluster").join(gens, F.col("_cluster").eqNullSafe(F.col("cluster_id")), "left").join(F.broadcast(top))
    file_id = F.col("_file") + 1 + F.col("file_no")
    live = new.select(
        file_id.alias("file_id"), F.col("_cluster").alias("cluster_id"), F.coalesce("gen", F.lit(1)).alias("gen"), F.concat(F.lpad(file_id.cast("string"), 12, "0"), F.lit(".sst")).alias("file_name"),
        F.lit("live").alias("file_state"), "n_records", "n_bytes", "min_key", "max_key", "bloom_k", "bloom_m", "bloom_bits", later.alias("listed_at"), "file_no",
    )
    gone = latest.filter(F.col("file_state") == "live").join(F.broadcast(top)).select(
        F.col("file_id").cast("bigint"), "cluster_id", "gen", "file_name", F.lit("dropped").alias("file_state"), F.col("n_records").cast("int"), "n_bytes", later.alias("listed_at")
    )
    return live.unionByName(gone, allowMissingColumns=True)


def consolidate(records: DataFrame, listings: DataFrame, target_bytes: int = TARGET_BYTES, path: str | None = None) -> DataFrame:
    """The records of consolidate_files()."""
    return consolidate_files(records, listings, target_bytes, path)[0]


def file_ranges(consolidated: DataFrame) -> DataFrame:
    """The metadata of files, told from their records: counts, bytes and the ends of their ranges."""
    return consolidated.groupBy("cluster_id", "file_no").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum("rec_len").alias("n_bytes"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
    )


