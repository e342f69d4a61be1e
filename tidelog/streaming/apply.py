"""Streams of mutations: applied to a table batch by batch, or folded in keyed state.

Rows of a micro-batch come in no order and a batch may be run twice. So every batch is folded by seq first, is written
under its own number, and a repeated batch replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tidelog.operators.fold import live, newest_per_key
from tidelog.session import shared_path
from tidelog.store import Store

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark: SparkSession, d: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table of a data directory as a stream of its files."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


class Applier:
    """The state of a stream of (seq, key, kind, value), kept as one folded file set per micro-batch."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "applied")

    def batch(self, df: DataFrame, number: int) -> None:
        newest_per_key(df.select("seq", "key", "kind", "value")).write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Applies what is there and ends; started again, it goes on behind the last batch."""
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint")
        return writer.trigger(availableNow=True).start()

    def state(self) -> DataFrame:
        """(key, value): the live rows of everything applied so far."""
        return live(self.spark.read.parquet(f"{self.path}/rows")).select("key", "value")


def complete(aggregated: DataFrame, path: str) -> DataFrame:
    """The complete result of an aggregated stream after all that is there, as a table below `path`; no row passes
    through the driver. Every micro-batch writes the whole result under its number, the last of which counts, and drops
    the ones before the last; started again it goes on from where it ended."""
    spark = aggregated.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers() -> list[int]:
        root = jvm_path(f"{path}/result")
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removeprefix("batch-")) for n in names)

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/result/batch-{number}")
        for old in [n for n in numbers() if n < number - 1]:
            fs.delete(jvm_path(f"{path}/result/batch-{old}"), True)

    writer = aggregated.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    have = numbers()
    if not have:
        return spark.createDataFrame([], aggregated.schema)
    return spark.read.schema(aggregated.schema).parquet(f"{path}/result/batch-{have[-1]}")


def into_store(stream: DataFrame, store: Store, name: str, checkpoint: str) -> StreamingQuery:
    """Applies a stream of (seq, key, kind, value) to a store, each micro-batch once: a batch that is run again finds
    its name in the manifest."""

    def batch(df: DataFrame, number: int) -> None:
        store.append(df, order="seq", batch=f"{name}-{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class NewestWins(StatefulProcessor):
    """Per key the newest mutation by seq; emits a row whenever it changes. Late and repeated mutations change
    nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("seq", LongType()), StructField("kind", IntegerType()), StructField("value", StringType())])
        self.newest = handle.getValueState("newest", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.newest.get() if self.newest.exists() else None
        had = best[0] if best else None
        for pdf in rows:
            top = pdf.loc[pdf["seq"].idxmax()]
            if best is None or int(top["seq"]) > best[0]:
                value = None if pd.isna(top["value"]) else str(top["value"])
                best = (int(top["seq"]), int(top["kind"]), value)
        if best is not None and best[0] != had:
            self.newest.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "kind": [best[1]], "value": [best[2]]})

    def close(self) -> None:
        pass


def newest_wins(stream: DataFrame) -> DataFrame:
    """The changes (key, seq, kind, value) of each key's newest mutation. Needs the RocksDB state store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return stream.groupBy("key").transformWithStateInPandas(
        statefulProcessor=NewestWins(),
        outputStructType="key string, seq bigint, kind int, value string",
        outputMode="Update",
        timeMode="None",
    )


def event_windows(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window of event time; later rows than `late` are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events no further apart than `gap`."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
