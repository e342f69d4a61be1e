"""Has this key been seen before? Filter, then verify.

The keys of the history are reduced to hashes, spread over shards, and each shard's hashes become one Bloom filter, so
the memory of a task is a few bytes per key of one shard and does not depend on the length of the keys. Probes are
tested against the filter of their shard; negatives are decided at once. Only positives go to the exact lookup against
the full keys on disk, and every positive it disproves is kept as a measured error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import materialize

BITS_PER_KEY = 10
HASHES = 7
#: Rows of the history for a shard at most: with 8 bytes a hash while it is built, about 8 MB; and so many at least
#: where there are cores to spare.
KEYS_PER_SHARD, LEAST_PER_SHARD = 1 << 20, 1 << 15
#: Up to so many hashes of positives, of 8 bytes each, are broadcast to find their keys in the history; beyond, the
#: history is shuffled by key.
BROADCAST_POSITIVES = 2_000_000

FILTER_SCHEMA = "shard int, n bigint, k int, m bigint, bits binary"


def _shard(key: str, shards: int):
    return F.pmod(F.hash(key), F.lit(shards)).alias("shard")


def _positions(h: np.ndarray, m: int, k: int) -> np.ndarray:
    """k rows of bit positions by double hashing."""
    u = h.view(np.uint64)
    h1, h2 = u & np.uint64(0xFFFFFFFF), u >> np.uint64(32)
    h2 = np.where(h2 == 0, np.uint64(1), h2)
    return (h1[None, :] + np.arange(k, dtype=np.uint64)[:, None] * h2[None, :]) % np.uint64(m)


def fill(h: np.ndarray, bits_per_key: int = BITS_PER_KEY, k: int = HASHES) -> tuple[int, bytes]:
    """(m, bits) for the given hashes: bit p is bit p % 8 of byte p // 8."""
    m = -(-max(64, bits_per_key * max(1, len(h))) // 8) * 8
    bits = np.zeros(m, bool)
    for row in _positions(h, m, k):
        bits[row] = True
    return m, np.packbits(bits, bitorder="little").tobytes()


def test(h: np.ndarray, bits: np.ndarray, m: int, k: int) -> np.ndarray:
    """Whether each hash may have been put in."""
    maybe = np.ones(len(h), bool)
    for p in _positions(h, m, k):
        maybe &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return maybe


def _runs(shards: np.ndarray):
    """(lo, hi) of each run of equal values."""
    cuts = np.flatnonzero(np.diff(shards)) + 1
    return zip([0, *cuts], [*cuts, len(shards)])


def _build(bits_per_key: int, k: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def done():
            h = np.concatenate(held)
            m, bits = fill(h, bits_per_key, k)
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([k], pa.int32()), pa.array([m], pa.int64()), pa.array([bits], pa.binary())],
                ["shard", "n", "k", "m", "bits"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for lo, hi in _runs(shard):
                if at is not None and at != shard[lo]:
                    yield done()
                    held = []
                at = int(shard[lo])
                held.append(h[lo:hi].copy())
        if held:
            yield done()

    return build


def shards_for(rows: int, keys_per_shard: int = KEYS_PER_SHARD, cores: int = 1) -> int:
    """Enough for the rows, and for all cores if that leaves LEAST_PER_SHARD to each."""
    return max(1, -(-rows // keys_per_shard), min(2 * cores, rows // LEAST_PER_SHARD))


def build_filter(history: DataFrame, key: str, shards: int, bits_per_key: int = BITS_PER_KEY, k: int = HASHES) -> DataFrame:
    """(shard, n, k, m, bits): one Bloom filter for each shard of the history's keys. Null keys are left out."""
    hashes = (
        history.filter(F.col(key).isNotNull()).select(_shard(key, shards), F.xxhash64(key).alias("h")).distinct()
    )
    # A partition is a shard.
    return hashes.repartitionById(shards, F.col("shard")).mapInArrow(_build(bits_per_key, k), FILTER_SCHEMA)


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, the shard's filter first; the filters of one shard are held at a time."""
    at, m, k, bits = None, 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column(0).to_numpy(zero_copy_only=False)
        is_probe = batch.column(1).to_numpy(zero_copy_only=False)
        h = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)
        maybe = np.zeros(batch.num_rows, bool)
        for lo, hi in _runs(shard):
            if at != shard[lo]:
                at, bits = shard[lo], None
            if not is_probe[lo]:
                m, k = batch.column(5)[int(lo)].as_py(), batch.column(6)[int(lo)].as_py()
                bits = np.frombuffer(batch.column(7)[int(lo)].as_py(), np.uint8)
            if bits is not None:
                maybe[lo:hi] = test(h[lo:hi], bits, m, k)
        keep = pa.array(is_probe == 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(2).filter(keep), batch.column(3).filter(keep), pa.array(maybe).filter(keep)], ["id", "key", "maybe"]
        )


def route(firsts: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """(id, key, maybe): the filter's answer for each row (id, key) of `firsts`."""
    probes = firsts.select(
        _shard("key", shards), F.lit(1).alias("is_probe"), "id", "key", F.xxhash64("key").alias("h"),
        F.lit(None).cast("bigint").alias("m"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("binary").alias("bits"),
    )
    tests = filters.select(
        "shard", F.lit(0).alias("is_probe"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("bigint").alias("h"), "m", "k", "bits",
    )
    both = tests.unionByName(probes).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "is_probe")
    return both.mapInArrow(_route, "id bigint, key string, maybe boolean")


class Seen:
    """The answers for a table of probes against a history of keys.

    `probes` has an order column of integers that identifies a probe; `history` has the key column. A probe is seen
    if its key is in the history or in a probe with a smaller id. Null keys are never seen; rows with a null id are
    no probes; exact repeats of a probe count once. Extra columns are ignored; either table may be empty.

    A key's first probe is the only one that needs a lookup: every later one has been seen for certain. So each key
    is looked up once, however many probes ask for it.

    `filters`: what build_filter() gave for this history and its number of shards, as it was stored; batch after batch
    is then tested without reading the history's keys again, but for the lookup of positives.
    """

    def __init__(
        self, probes: DataFrame, history: DataFrame, probe_id: str, key: str, keys_per_shard: int = KEYS_PER_SHARD,
        filters: tuple[DataFrame, int] | None = None,
    ):
        self.probes = probes.select(F.col(probe_id).alias("id"), F.col(key).alias("key")).filter(
            F.col("id").isNotNull() & F.col("key").isNotNull()
        )
        self.history = history.select(F.col(key).alias("key")).filter(F.col("key").isNotNull())
        if filters is None:
            # All rows, null keys too: of a Parquet table this reads the footers alone.
            shards = shards_for(history.count(), keys_per_shard, history.sparkSession.sparkContext.defaultParallelism)
            filters = build_filter(self.history, "key", shards), shards
        firsts = self.probes.groupBy("key").agg(F.min("id").alias("id"))
        #: The log of the filter's answers, written once.
        self.routed = materialize(route(firsts, *filters), "routed")

    def disproved(self) -> DataFrame:
        """(id, key): probes that the filter let through though the history lacks their key."""
        positives = self.routed.filter("maybe").select("id", "key")
        # Of the history only what hashes like a positive is looked at in full.
        asked = positives.select(F.xxhash64("key").alias("_h")).distinct()
        there = self.history
        if positives.count() <= BROADCAST_POSITIVES:
            there = there.join(F.broadcast(asked), F.xxhash64("key") == F.col("_h"), "left_semi")
        return positives.join(there.distinct(), "key", "left_anti").select("id", "key")

    def found(self) -> DataFrame:
        """(id): the probes that were seen, each once."""
        unseen = self.routed.filter("NOT maybe").select("id").unionByName(self.disproved().select("id"))
        return self.probes.select("id").distinct().join(unseen, "id", "left_anti")

    def error_rate(self) -> DataFrame:
        """One row: looked_up, negatives, positives, wrong, and wrong as a share of the keys the history lacks."""
        wrong = self.disproved().agg(F.count(F.lit(1)).alias("wrong"))
        totals = self.routed.agg(
            F.count(F.lit(1)).alias("looked_up"),
            F.count_if(~F.col("maybe")).alias("negatives"),
            F.count_if("maybe").alias("positives"),
        )
        rate = F.col("wrong") / F.greatest(F.col("negatives") + F.col("wrong"), F.lit(1))
        # One row each: both sides are global aggregates.
        return totals.join(F.broadcast(wrong)).withColumn("error_rate", rate)
