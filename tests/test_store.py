"""The store: situations of overwrites, deletes, flushes, compactions, restarts and rival writers."""

import json
import random
import threading

import pytest

from tests.conftest import rows
from tidelog.functions.sql import register, views
from tidelog.store import Store, was_applied, with_applied
from tidelog.streaming.apply import into_store


def kv(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, value string")


def keys(spark, *names):
    return spark.createDataFrame([(k,) for k in names], "key string")


def muts(spark, data):
    return spark.createDataFrame(data, "seq bigint, kind int, key string, value string, extra int")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", auto_flush=False)


def test_put_overwrite_delete(spark, store):
    store.put(kv(spark, ("name", "bird")))
    assert store.get("name") == "bird"
    store.put(kv(spark, ("name", "kite")))
    assert store.get("name") == "kite"
    store.delete(keys(spark, "name", "absent"))
    assert store.get("name") is None and not store.lookup("name").found
    assert store.size()["tombstones"] == 2  # also for a key that was never there


def test_empty_value_is_found(spark, store):
    store.put(kv(spark, ("a", ""), ("b", None)))
    assert store.get("a") == "" and store.lookup("b").found
    store.put(kv(spark, (None, "x"), ("", "empty key")))
    assert store.get("") == "empty key" and store.read().count() == 3


def test_restart(spark, store):
    store.put(kv(spark, ("a", "1"), ("b", "2")))
    store.flush()
    store.delete(keys(spark, "a"))
    store.put(kv(spark, ("c", "3")))
    store.close()
    again = Store(spark, store.path)
    assert rows(again.read()) == [("b", "2"), ("c", "3")]
    assert again.size()["tails"] == 2 and again.size()["runs"] == 1


def test_newer_run_and_tombstone_win(spark, store):
    store.put(kv(spark, ("k", "old"), ("j", "1")))
    store.flush()
    store.put(kv(spark, ("k", "new")))
    store.flush()
    assert store.get("k") == "new"
    store.delete(keys(spark, "k"))
    assert store.get("k") is None
    store.flush()
    assert store.get("k") is None and store.get("j") == "1"


def test_flush_and_compact_of_little_are_nothing(spark, store):
    assert store.flush() == 0 and store.compact() == 0
    store.put(kv(spark, ("k", "v")))
    store.delete(keys(spark, "gone"))
    v = store.flush()
    assert store.flush() == v and store.compact() == v
    assert store.size()["tombstones"] == 1  # a single run keeps its tombstones


def test_compaction(spark, store):
    for data in ([("k", "1"), ("a", "1")], [("k", "2")], [("j", "9")]):
        store.put(kv(spark, *data))
        store.flush()
    store.delete(keys(spark, "a"))
    store.flush()
    store.delete(keys(spark, "j"))  # in the tail, which takes no part
    before = rows(store.read())
    store.compact()
    assert store.size()["runs"] == 1 and store.size()["tails"] == 1 and store.size()["tombstones"] == 1
    assert rows(store.read()) == before == [("k", "2")]
    assert rows(Store(spark, store.path).read()) == before


def test_versions_are_snapshots(spark, store):
    v1 = store.put(kv(spark, ("k", "1")))
    v2 = store.put(kv(spark, ("k", "2")))
    store.flush()
    store.put(kv(spark, ("k", "3")))
    store.flush()
    store.compact()
    assert [store.get("k", v) for v in (v1, v2, None)] == ["1", "2", "3"]
    assert store.vacuum() > 0 and store.get("k") == "3" and len(store.versions()) == 1


def test_scan_and_multi_get(spark, store):
    store.put(kv(spark, *[(f"k{i:02d}", str(i)) for i in range(20)]))
    store.flush()
    store.delete(keys(spark, "k05"))
    assert [r.key for r in store.scan("k04", "k07").collect()] == ["k04", "k06", "k07"]
    got = rows(store.multi_get(keys(spark, "k05", "k06", "k06", "no", None)))
    assert got == [("k05", False, None), ("k06", True, "6"), ("no", False, None)]


@pytest.mark.parametrize("seed", range(2))
def test_state_does_not_depend_on_flushes_and_compactions(spark, store, seed):
    rng = random.Random(seed)
    state = {}
    seq = 0
    for step in range(5):
        data = []
        for _ in range(30):
            seq += 1
            k, dead = rng.choice(["hot", f"k{rng.randrange(12)}", "ß"]), rng.random() < 0.3
            data.append((seq, int(dead), k, f"v{seq}", 0))
            state.pop(k, None) if dead else state.__setitem__(k, f"v{seq}")
        rng.shuffle(data)
        store.append(muts(spark, data), order="seq")
        for act in rng.sample([store.flush, store.compact, lambda: 0], 2):
            act()
    assert dict(rows(store.read())) == state


def test_a_batch_is_applied_once(spark, store):
    df = muts(spark, [(1, 0, "k", "1", 0)])
    v = store.append(df, order="seq", batch="b1")
    assert store.append(df, order="seq", batch="b1") == v
    store.flush()
    assert store.append(df, order="seq", batch="b1") == store.manifest()["version"]
    assert store.size()["records"] == 1


def test_rival_writers_lose_nothing(spark, store):
    errors = []

    def write(i):
        try:
            Store(spark, store.path, auto_flush=False).put(kv(spark, (f"w{i}", str(i))))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(r.key for r in store.read().collect()) == [f"w{i}" for i in range(5)]
    assert store.versions() == list(range(1, 6))


def test_flush_by_size(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", flush_bytes=100)
    s.put(kv(spark, ("a", "x" * 10)))
    assert s.size()["tails"] == 1
    s.put(kv(spark, ("b", "x" * 100)))
    assert s.size()["tails"] == 0 and s.size()["runs"] == 1


def test_stream_into_store(spark, store, tmp_path):
    src, ckpt = f"{tmp_path}/in", f"{tmp_path}/ckpt"
    schema = "seq bigint, kind int, key string, value string"
    for part in ([(1, 0, "a", "1"), (3, 1, "b", None)], [(2, 0, "b", "2"), (4, 0, "a", "4")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    into_store(stream, store, "s", ckpt).awaitTermination()
    assert rows(store.read()) == [("a", "4")]
    spark.createDataFrame([(9, 0, "c", "9")], schema).write.mode("append").parquet(src)
    into_store(spark.readStream.schema(schema).parquet(src), store, "s", ckpt).awaitTermination()
    assert rows(store.read()) == [("a", "4"), ("c", "9")]


def test_sql_surface(spark, store):
    register(spark)
    store.put(kv(spark, ("a", "1")))
    views(store, "t")
    store.put(kv(spark, ("a", "2")))
    assert spark.sql("SELECT value FROM t_state WHERE key = 'a'").first().value == "1"
    assert spark.sql("SELECT sum(records) AS n FROM t_layers").first().n == 1
    # Published test vectors.
    got = spark.sql("SELECT fnv1a64('') AS e, fnv1a64('a') AS a, fnv1a64('foobar') AS f, fnv1a64(CAST(NULL AS STRING)) AS n").first()
    assert tuple(got) == ("cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8", None)
    assert rows(spark.sql("SELECT * FROM parse_peers('0=a:1, 2 = b:2,')")) == [(0, "a:1"), (2, "b:2")]
    for bad in ("", "a:1", "x=a:1", "1=", "1=a,1=b"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM parse_peers('{bad}')").collect()


def test_spans_of_batches():
    rng = random.Random(1)
    applied, done = {}, set()
    for _ in range(300):
        batch = rng.choice([f"a-{rng.randrange(40)}", f"b{rng.randrange(9)}", "plain", "a-", "x-007", "x-7", "9"])
        assert was_applied({"applied": applied}, batch) == (batch in done)
        applied = json.loads(json.dumps(with_applied(applied, batch)))
        done.add(batch)
    assert sum(hi - lo + 1 for lo, hi in applied["a-"] if lo is not None) == sum(b.startswith("a-") and b != "a-" for b in done)
    applied = {}
    for n in range(5000):
        applied = with_applied(applied, f"stream-{n}")
    assert applied == {"stream-": [[0, 4999]]}


def test_the_newest_version_is_found_without_its_note(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", auto_flush=False)
    assert s.newest() == 0
    for k in "abc":
        s.put(spark.createDataFrame([(k, k)], "key string, value string"))
    assert s.newest() == 3 == max(s.versions())
    note = tmp_path / "s/manifests/_newest"
    for text in ("1", "99", "x", ""):
        for crc in tmp_path.glob("s/manifests/.*.crc"):
            crc.unlink()
        note.write_text(text)
        assert s.newest() == 3
    note.unlink()
    assert s.newest() == 3 and s.get("c") == "c"


def test_a_store_needs_names_that_are_taken_in_one_step(spark, monkeypatch, tmp_path):
    # As on a file system whose scheme is not listed.
    monkeypatch.setattr(Store, "_local", lambda self: False)
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}/never-made")
    assert not tmp_path.joinpath("never-made").exists()


def test_waiting_for_a_version(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    reader, writer = Store(spark, path), Store(spark, path)
    assert reader.wait_for(0) == 0
    with pytest.raises(TimeoutError):
        reader.wait_for(1, 0.05)
    at = threading.Timer(0.3, lambda: writer.put(kv(spark, ("a", "1"))))
    at.start()
    assert reader.wait_for(1, 60) == 1 and reader.get("a") == "1"
    at.join()
    with pytest.raises(TimeoutError):
        reader.wait_for(2, 0)
