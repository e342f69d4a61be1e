"""Immutable runs: flush, statistics, layered lookup and compaction.

A run is the rows of one `gen`, one per key; a higher gen is newer. The newest run that has a key decides on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.bytes import record_length
from tidelog.operators.fold import live, newest_per_key
from tidelog.session import materialize


def flush(log: DataFrame) -> DataFrame:
    """One record per (gen, key), the newest by seq; tombstones stay, as older runs may hold the key."""
    return newest_per_key(log, ["gen", "key"], ["seq"])


def stats(runs: DataFrame) -> DataFrame:
    """(gen, n_records, n_tombstones, min_key, max_key): what a manifest keeps of a run."""
    return runs.groupBy("gen").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(F.col("kind") == 1).alias("n_tombstones"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
    )


def index(runs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(gen, key, offset): where each record starts in its run's file.

    A run may be as large as the data after a consolidation, so it is cut into ranges of keys, each summed on its own; a
    run's part of a range starts where its parts before it end.
    """
    size = record_length(F.col(key).cast("string"), F.col(value).cast("string"))
    ranged = runs.select("gen", "key", size.alias("_size")).repartitionByRange("gen", "key").sortWithinPartitions("gen", "key")
    kept = materialize(ranged.withColumn("_range", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("gen", "_range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range and each run that reaches into it.
    parts = kept.groupBy("gen", "_range").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("gen").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("gen", "_range", F.sum("_sum").over(before).alias("_start"))
    offset = F.coalesce("_start", F.lit(0)) + F.coalesce("_in", F.lit(0))
    summed = kept.withColumn("_in", F.sum("_size").over(inside)).join(starts, ["gen", "_range"])
    return summed.select("gen", "key", offset.cast("bigint").alias("offset"))


def probe_depth(runs: DataFrame) -> DataFrame:
    """(key, runs_read): how many runs, newest first, a lookup reads before one decides."""
    newest = runs.agg(F.max("gen").alias("_top"))
    deciding = runs.groupBy("key").agg(F.max("gen").alias("_gen"))
    # Every generation up to the top is a run; one row is broadcast.
    return deciding.join(F.broadcast(newest)).select("key", (F.col("_top") - F.col("_gen") + 1).alias("runs_read"))


def compact(runs: DataFrame) -> DataFrame:
    """All runs merged to one: the newest record per key, without tombstones."""
    return live(runs, order=["gen"])


def compact_partial(runs: DataFrame, low: int, high: int) -> DataFrame:
    """The runs low..high merged to one of gen `high`; the others as they are.

    Tombstones are dropped only if nothing older is left that they could be hiding.
    """
    inside = F.col("gen").between(low, high)
    merged = newest_per_key(runs.filter(inside), order=["gen"]).withColumn("gen", F.lit(high))
    older = runs.filter(F.col("gen") < low).select("key").distinct()
    hides = merged.join(older, "key", "left_semi").filter("kind = 1")
    return runs.filter(~inside).unionByName(merged.filter("kind = 0")).unionByName(hides)


def gain(runs: DataFrame) -> DataFrame:
    """One row: records before and after a full compaction, versions and tombstones dropped."""
    newest = runs.groupBy("key").agg(F.max(F.struct("gen", "kind")).alias("_last"), F.count(F.lit(1)).alias("_n"))
    return newest.agg(
        F.sum("_n").alias("records_in"),
        F.count_if(F.col("_last.kind") == 0).alias("records_out"),
        F.sum(F.col("_n") - 1).alias("versions_dropped"),
        F.count_if(F.col("_last.kind") == 1).alias("tombstones_dropped"),
    )


def same_state(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (missing, extra): rows of a that b lacks, and the other way round."""
    cols = a.columns
    tagged = a.withColumn("_d", F.lit(1)).unionByName(b.select(*cols).withColumn("_d", F.lit(-1)))
    net = tagged.groupBy(*cols).agg(F.sum("_d").alias("_net"))
    zero = F.lit(0).cast("bigint")
    return net.agg(
        F.coalesce(F.sum(F.greatest(F.col("_net"), zero)), zero).alias("missing"),
        F.coalesce(F.sum(F.greatest(-F.col("_net"), zero)), zero).alias("extra"),
    )
