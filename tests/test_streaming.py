"""Streams give what the batch gives, whatever the batches and their repeats."""

import random

from pyspark.sql import functions as F

from tests.conftest import rows
from tidelog.operators.fold import live
from tidelog.streaming import apply

SCHEMA = "seq bigint, key string, kind int, value string"


def feed(spark, tmp_path, seed=0, files=4):
    rng = random.Random(seed)
    data = [(i, rng.choice(["hot", f"k{rng.randrange(9)}"]), int(rng.random() < 0.3), f"v{i}") for i in range(120)]
    rng.shuffle(data)
    data += data[:15]  # repeats
    for f in range(files):
        spark.createDataFrame(data[f::files], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return stream, rows(live(spark.createDataFrame(data, SCHEMA).distinct()).select("key", "value"))


def test_applier(spark, tmp_path):
    stream, want = feed(spark, tmp_path)
    a = apply.Applier(spark, f"{tmp_path}/out")
    a.start(stream).awaitTermination()
    assert rows(a.state()) == want
    # A batch that is run again replaces itself.
    a.batch(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in").limit(30), 0)
    a.start(stream).awaitTermination()
    spark.createDataFrame([(999, "hot", 0, "last")], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    a.start(stream).awaitTermination()
    assert ("hot", "last") in rows(a.state())


def test_keyed_state(spark, tmp_path):
    stream, want = feed(spark, tmp_path, 1)
    got = {}

    def keep(df, _):
        for r in df.collect():
            assert r.key not in got or r.seq > got[r.key][0]
            got[r.key] = (r.seq, r.kind, r.value)

    query = apply.newest_wins(stream).writeStream.outputMode("update").foreachBatch(keep)
    query.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted((k, v) for k, (_, kind, v) in got.items() if kind == 0) == want


def test_windows_drop_what_is_too_late(spark, tmp_path):
    src = f"{tmp_path}/ev"
    schema = "ts timestamp_ntz, event_type string, value double"
    for hours in ([1, 2], [9], [10], [1, 11]):
        data = [(h,) for h in hours]
        df = spark.createDataFrame(data, "h int").select(F.expr("cast('2024-01-01' AS timestamp_ntz) + make_dt_interval(0, h)").alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
        df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    apply.event_windows(stream).writeStream.outputMode("update").format("memory").queryName("late").trigger(availableNow=True).start().awaitTermination()
    hours = {}
    for r in spark.table("late").collect():
        hours[r.window.start.hour] = max(hours.get(r.window.start.hour, 0), r.n)
    assert hours == {1: 1, 2: 1, 9: 1, 10: 1, 11: 1}
