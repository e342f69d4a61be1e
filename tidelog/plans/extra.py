"""Queries through the sources, the store and the streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans import fixtures as X
from tidelog.plans.kv import _TEXTS, _runs, _texts
from tidelog.session import shared_path, table
from tidelog.sources.formats import register
from tidelog.store import Store
from tidelog.streaming import apply


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for the byte formats, which read and write plain files: it must be on a mount of all executors."""
    path = shared_path(spark, name)
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"the formats wal and sst need a mounted folder, not {path}")
    path = path.removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


def wal_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every mutation written as log files and read again."""
    register(spark)
    path = _folder(spark, "wal")
    _texts(spark, d).select("kind", "key", "value").write.format("wal").mode("append").save(path)
    return spark.read.format("wal").load(path).select("kind", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _run_files(spark: SparkSession, d: str) -> str:
    """The folder of a run file for each generation."""
    register(spark)
    path = _folder(spark, "sst")
    rows = _runs(spark, d).select("gen", "kind", F.concat(F.lit("key"), F.col("key").cast("string")).alias("key"), F.when(F.col("kind") == 0, F.concat(F.lit("v"), F.col("seq").cast("string"))).alias("value"))
    # A partition is a file, so each generation is given its own by number: the files are numbered in this order.
    rows.repartitionById(X.N_GENS, F.col("gen")).select("kind", "key", "value").write.format("sst").mode("append").save(path)
    return path


def sst_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every generation written as a run file and read again."""
    back = spark.read.format("sst").load(_run_files(spark, d))
    return back.select("kind", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def sst_lookup(spark: SparkSession, d: str) -> DataFrame:
    """(gen, kind, value): what every run file says about two keys, one of which no file has; filters, indexes and single
    records are read."""
    keys = [b"key7", b"key-none"]
    held = spark.read.format("sst").load(_run_files(spark, d)).filter(F.col("key").isin(*[F.lit(k) for k in keys]))
    return held.select((F.col("gen") - 1).cast("int").alias("gen"), "kind", F.col("value").cast("string").alias("value"))


def store_state(spark: SparkSession, d: str) -> DataFrame:
    """The mutation log appended to a store in eight batches, with flushes and compactions in between."""
    store = Store(spark, shared_path(spark, "store"), auto_flush=False)
    log = X.generations(spark, d).select("seq", "kind", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "gen")
    for g in range(X.N_GENS):
        store.append(log.filter(F.col("gen") == g), order="seq", batch=f"gen-{g}")
        if g % 2:
            store.flush()
        if g == 4:
            store.compact()
    return store.read().select(F.col("key").cast("bigint").alias("key"), F.col("value").cast("double").alias("value"))


def store_auto_flush(spark: SparkSession, d: str) -> DataFrame:
    """The mutation log appended in four batches to a store that flushes by itself, read by another one, closed and opened."""
    path = shared_path(spark, "store")
    log = X.generations(spark, d).select("seq", "kind", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "gen")
    store = Store(spark, path, flush_bytes=1 << 14)
    for g in range(4):
        store.append(log.filter((F.col("gen") / 2).cast("int") == g), order="seq", batch=f"half-{g}")
    store.close()
    again = Store(spark, path)
    return again.read(again.wait_for(1)).select(F.col("key").cast("bigint").alias("key"), F.col("value").cast("double").alias("value"))


def stream_apply(spark: SparkSession, d: str) -> DataFrame:
    stream = apply.read_table(spark, d, "events")
    dies = F.col("event_type") == "error"
    log = stream.select((F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("key"), F.when(dies, 1).otherwise(0).alias("kind"), F.when(~dies, F.col("value")).alias("value"))
    applier = apply.Applier(spark)
    applier.start(log).awaitTermination()
    return applier.state()


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """(start, event_type, n): events per hour, from the stream's complete result."""
    counted = apply.event_windows(apply.read_table(spark, d, "events"))
    done = apply.complete(counted, shared_path(spark, "windows"))
    return done.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, sessions): how many sessions each user has, no event further than half an hour from the next."""
    found = apply.sessions(table(spark, d, "events").drop("props"))
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


QUERIES = {f.__name__: f for f in (wal_roundtrip, sst_roundtrip, sst_lookup, store_state, store_auto_flush, stream_apply, stream_windows, events_sessions)}

SQL = {
    "wal_roundtrip": f"WITH {_TEXTS} SELECT kind, key, CASE WHEN kind = 0 THEN value END AS value FROM texts",
    "sst_roundtrip": f"WITH {X.RUNS_SQL} SELECT kind, 'key' || key AS key, CASE WHEN kind = 0 THEN 'v' || seq END AS value FROM kvruns",
    "sst_lookup": f"WITH {X.RUNS_SQL} SELECT gen, kind, CASE WHEN kind = 0 THEN 'v' || seq END AS value FROM kvruns WHERE key = 7",
    "store_state": f"WITH {X.LOG_SQL} SELECT key, value FROM state",
    "store_auto_flush": f"WITH {X.LOG_SQL} SELECT key, value FROM state",
    "stream_apply": f"WITH {X.LOG_SQL} SELECT key, value FROM state",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "events_sessions": """
        WITH g AS (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
        SELECT user_id, count(*) FILTER (gap IS NULL OR gap >= INTERVAL 30 MINUTE) AS sessions FROM g GROUP BY user_id""",
}
