"""Bloom filters over the keys of runs: packed bits, built and tested a batch of keys at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.bytes import BLOOM_BITS_PER_KEY, BLOOM_HASHES
from tidelog.session import materialize
from tidelog.sources.codec import bloom_of, bloom_test, fnv1a64

#: Filters of up to so many bytes together are sent to every task; beyond, keys travel to the filters.
BROADCAST_BYTES = 32 << 20
#: Keys that a task tests against one filter, about, where keys travel.
KEYS_PER_PART = 1_000_000


def _raw(keys: pa.Array) -> list[bytes]:
    return keys.cast(pa.binary()).to_pylist()


def hashes(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, h1, h2): the two hashes that positions are made of; h2 is never 0. A null key has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.filter(batch.column(0).is_valid())
            h = fnv1a64(_raw(held.column(0)))
            h2 = h >> np.uint64(32)
            parts = [pa.array((h & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(np.where(h2 == 0, np.uint64(1), h2).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([held.column(0), *parts], [key, "h1", "h2"])

    field = keys.select(key).schema[0]
    return keys.select(key).mapInArrow(run, T.StructType([field, T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))


def _hashed(groups: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = fnv1a64(_raw(batch.column(len(groups))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(groups)], pa.array(h.view(np.int64))], [*groups, "_h"])

    return run


def _build(groups: Sequence[str]):
    """Rows come group by group; the hashes of one group are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, schema = None, [], None

        def done() -> pa.RecordBatch:
            h = np.concatenate(held).view(np.uint64)
            k, m, bits = bloom_of(h)
            n_set = int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum())
            own = [pa.array([v], schema.field(c).type) for v, c in zip(at, groups)]
            rest = [pa.array([v], t) for v, t in zip((len(h), k, m, n_set, bits), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays([*own, *rest], [*groups, "n_keys", "k", "m", "n_set", "bits"])

        for batch in batches:
            schema = batch.schema
            h = batch.column(len(groups)).to_numpy()
            names = list(zip(*[c.to_pylist() for c in batch.columns[: len(groups)]])) or [()] * len(h)
            lo = 0
            for hi in range(1, len(h) + 1):
                if hi == len(h) or names[hi] != names[lo]:
                    if held and at != names[lo]:
                        yield done()
                        held = []
                    at = names[lo]
                    held.append(h[lo:hi])
                    lo = hi
        if held:
            yield done()

    return run


def packed(keys: DataFrame, groups: Sequence[str] = (), key: str = "key") -> DataFrame:
    """(*groups, n_keys, k, m, n_set, bits): the filter of each group's distinct keys; null keys are left out.

    A filter is that of one run file, so a group is a bounded unit: a task holds the hashes of one, 8 bytes a key. For
    the keys of a whole history there are the sharded filters of seen.py.
    """
    rows = keys.filter(F.col(key).isNotNull()).select(*groups, key).distinct()
    own = rows.select(*groups).schema.fields
    hashed = rows.mapInArrow(_hashed(groups), T.StructType([*own, T.StructField("_h", T.LongType())]))
    ordered = hashed.repartition(*groups).sortWithinPartitions(*groups) if groups else hashed.repartition(1)
    more = T._parse_datatype_string("n_keys bigint, k int, m bigint, n_set bigint, bits binary")
    return ordered.mapInArrow(_build(groups), T.StructType([*own, *more.fields]))


def fill(keys: DataFrame, groups: Sequence[str], key: str = "key") -> DataFrame:
    """(*groups, n_keys, m, n_set): size and load of each group's filter."""
    return packed(keys, groups, key).select(*groups, "n_keys", "m", "n_set")


def probe(filters: DataFrame, probes: DataFrame, groups: Sequence[str] = (), key: str = "key") -> DataFrame:
    """(*groups, key, maybe): each distinct probe against the filter of its group, as packed() gave them.

    Probes whose group has no filter are left out, null keys too. Filters of BROADCAST_BYTES together or less are known
    to every task, and nothing is shuffled to test; more are met by the keys, and keys of one filter are spread.
    """
    asked = probes.select(*groups, key).filter(F.col(key).isNotNull()).distinct()
    schema = T.StructType([*asked.schema.fields, T.StructField("maybe", T.BooleanType())])
    # Written once, so that the size is known before anything is sent.
    filters = materialize(filters.select(*groups, "k", "m", "bits"), "filters")
    size = filters.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        known = {tuple(r[: len(groups)]): tuple(r[len(groups) :]) for r in filters.collect()}
        return asked.mapInArrow(_test_known(known, len(groups)), schema)
    parts = max(1, -(-asked.count() // KEYS_PER_PART))
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("_part")
    names = [*groups, "_part"]
    copies = filters.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = left.select([*groups, key])
        if not right.num_rows:
            return cols.slice(0, 0).append_column("maybe", pa.array([], pa.bool_()))
        f = right.select(["k", "m", "bits"]).to_pylist()[0]
        return cols.append_column("maybe", pa.array(bloom_test(_raw(cols[key].combine_chunks()), f["k"], f["m"], f["bits"])))

    return asked.select(*groups, key, part).groupBy(*names).cogroup(copies.groupBy(*names)).applyInArrow(both, schema)


def _test_known(known: dict[tuple, tuple], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(zip(*[c.to_pylist() for c in batch.columns[:n]])) or [()] * batch.num_rows
            of: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                of.setdefault(name, []).append(i)
            for name, rows in of.items():
                if name in known:
                    mine = batch.take(pa.array(rows))
                    yield mine.append_column("maybe", pa.array(bloom_test(_raw(mine.column(n)), *known[name])))

    return run


#: Keys of one file that a task tests at most, about; a larger file is spread over several.
KEYS_PER_TASK = 100_000


def _test_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (file, part), the part's filter before its keys; one filter is held at a time."""
    at, filter_ = None, None
    for batch in batches:
        files, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keys = batch.column(3).to_pylist()
        lo, out = 0, []
        for hi in range(1, len(files) + 1):
            if hi < len(files) and (files[hi], parts[hi]) == (files[lo], parts[lo]):
                continue
            if at != (files[lo], parts[lo]):
                # The filter stands first, as it has the lesser tag.
                at = (files[lo], parts[lo])
                filter_ = tuple(batch.column(c)[lo].as_py() for c in (4, 5, 6))
            mine = [k for k in keys[lo:hi] if k is not None]
            if mine:
                out.append((files[lo], len(mine), len(mine) - int(bloom_test(mine, *filter_).sum())))
            lo = hi
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["file_id", "n_keys", "n_missing"]
        )


def check_blobs(records: DataFrame, listings: DataFrame) -> DataFrame:
    """(file_id, n_keys, n_missing): how many of a file's keys its recorded filter denies.

    A sound filter denies none. Files whose latest listing has no filter, or one whose length does not fit its m, are
    left out. A filter travels once per part of its file, never once per key.
    """
    latest = listings.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(
        F.max(F.struct("listed_at", "bloom_k", "bloom_m", "bloom_bits")).alias("_f")
    )
    sound = latest.select(
        "file_id", F.col("_f.bloom_k").alias("k"), F.col("_f.bloom_m").alias("m"), F.col("_f.bloom_bits").alias("bits")
    ).filter((F.col("k") == BLOOM_HASHES) & (F.octet_length("bits") * 8 == F.col("m")))
    parts = F.greatest(F.ceil(F.col("m") / (BLOOM_BITS_PER_KEY * KEYS_PER_TASK)), F.lit(1)).cast("int")
    sized = sound.withColumn("parts", parts)
    none = lambda t: F.lit(None).cast(t)
    filters = sized.select("file_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("tag"), none("binary").alias("key"), "k", "m", "bits")
    keys = records.filter(F.col("key").isNotNull()).select("file_id", F.col("key").cast("binary").alias("key")).distinct()
    asked = keys.join(sized.select("file_id", "parts"), "file_id").select(
        "file_id", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("tag"), "key", none("int").alias("k"), none("bigint").alias("m"), none("binary").alias("bits")
    )
    both = filters.unionByName(asked).repartition("file_id", "part").sortWithinPartitions("file_id", "part", "tag")
    found = both.mapInArrow(_test_blobs, "file_id bigint, n_keys bigint, n_missing bigint")
    return found.groupBy("file_id").agg(F.sum("n_keys").alias("n_keys"), F.sum("n_missing").alias("n_missing"))
