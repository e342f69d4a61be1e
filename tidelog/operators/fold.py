"""Last writer wins: the fold of an ordered mutation log with tombstones.

A mutation is (seq, key, kind, value) with kind 0 for a put and 1 for a delete. The newest record of a key decides,
also if it is a tombstone; an empty value is a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.blocked import suffix_min
from tidelog.session import materialize

PUT, DELETE = 0, 1
#: Mutations whose versions of one key are looked at together.
HISTORY_BLOCK = 1 << 20


def newest_per_key(df: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """The last row of each key by `order`; the rank limit also runs before the exchange, so hot keys shrink first."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def live(df: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """The newest rows that are puts."""
    return newest_per_key(df, keys, order).filter(F.col("kind") == PUT)


def deleted(df: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """The newest rows that are tombstones."""
    return newest_per_key(df, keys, order).filter(F.col("kind") == DELETE)


def as_of(df: DataFrame, seq: int) -> DataFrame:
    """The live rows after the mutation `seq`."""
    return live(df.filter(F.col("seq") <= seq))


def get(df: DataFrame, key) -> DataFrame:
    """The live row of one key, or none; the filter on the key reaches the scan."""
    return live(df.filter(F.col("key") == F.lit(key)))


def multi_get(df: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """(key, found, value) for each distinct probe. Only keys that are asked for are folded."""
    asked = probes.select(F.col(key).alias("key")).filter(F.col("key").isNotNull()).distinct()
    held = live(df.join(asked, "key", "left_semi")).select("key", "value", F.lit(True).alias("_found"))
    return asked.join(held, "key", "left").select("key", F.coalesce("_found", F.lit(False)).alias("found"), "value")


def missing(df: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """(key): distinct probes without a live row."""
    asked = probes.select(F.col(key).alias("key")).filter(F.col("key").isNotNull()).distinct()
    return asked.join(live(df).select("key"), "key", "left_anti")


def history(df: DataFrame) -> DataFrame:
    """Every version with the seq at which the next one of its key replaced it.

    The next seq is the least greater one, found in blocks of seq, so a key with very many versions makes no long task.
    """
    rows = suffix_min(df.select("key", "seq", "kind", "value"), ["key"], "seq", "seq", "to_seq", HISTORY_BLOCK)
    return rows.select("key", F.col("seq").alias("from_seq"), "to_seq", "kind", "value")


def overlay(older: DataFrame, newer: DataFrame) -> DataFrame:
    """(key, value): the live rows of two layers with one row per key each, the newer deciding."""
    both = older.select("key", "kind", "value", F.lit(0).alias("layer")).unionByName(
        newer.select("key", "kind", "value", F.lit(1).alias("layer"))
    )
    return live(both, order=["layer"]).select("key", "value")


def between(df: DataFrame, low, high) -> DataFrame:
    """Live rows with low <= key < high, by key."""
    return live(df.filter((F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high)))).orderBy("key")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Live rows whose key starts with `prefix`, by key; a prefix is a range, so statistics can skip files."""
    return live(df.filter(F.col("key").startswith(prefix))).orderBy("key")


def positioned(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Adds each row's place, from 0, in the total order by `order`.

    No task sees all rows: ranges are sorted on their own and written once; a range starts where the counts of the
    ones before it end. There are as many counts as ranges.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mask = F.lit((1 << 33) - 1)
    at = F.monotonically_increasing_id()
    kept = materialize(ranged.select("*", F.spark_partition_id().alias("_range"), at.bitwiseAND(mask).alias("_at")), "ranged")
    counts = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return kept.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def memtable_size(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(n_keys, size): one record per key, at its key, value and eight bytes more."""
    size = F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + 8
    return newest_per_key(df).agg(F.count(F.lit(1)).alias("n_keys"), F.sum(size).alias("size"))
