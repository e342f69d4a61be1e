"""Byte formats: round trips, torn tails, damaged files, filters."""

import os
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidelog.functions.bytes import encode_record, fnv1a64
from tidelog.operators import bloom, peers
from tidelog.sources import codec
from tidelog.sources.formats import register

RECORDS = st.lists(st.tuples(st.integers(0, 1), st.binary(max_size=20), st.binary(max_size=20)), max_size=12)


@given(RECORDS)
def test_records_round_trip(data):
    blob = b"".join(codec.encode(k, key, None if k else v) for k, key, v in data)
    assert [(k, key, v) for _, k, key, v in codec.records(blob)] == [(k, key, None if k else v) for k, key, v in data]


@given(RECORDS.filter(len), st.data())
def test_a_cut_anywhere_is_seen(data, pick):
    parts = [codec.encode(*r) for r in data]
    blob = b"".join(parts)
    cut = pick.draw(st.integers(0, len(blob)))
    borders = set(np.cumsum([0, *map(len, parts)]).tolist())
    got = []
    try:
        for r in codec.records(blob[:cut]):
            got.append(r)
        assert cut in borders
    except codec.Torn as e:
        assert cut not in borders and e.offset == max(b for b in borders if b <= cut)
    assert len(got) == max(i for i, b in enumerate(sorted(borders)) if b <= cut) if len(borders) == len(parts) + 1 else True


def test_run_file():
    data = [(0, b"apple", b"red"), (0, b"banana", b"yellow"), (1, b"cherry", None), (0, b"date", b""), (0, "ü".encode(), b"x" * 500)]
    blob = codec.encode_run(data)
    assert codec.run_get(blob, b"banana") == (0, b"yellow") and codec.run_get(blob, b"date") == (0, b"")
    assert codec.run_get(blob, b"cherry") == (1, None) and codec.run_get(blob, b"elderberry") is None
    assert [k for k, _ in codec.run_index(blob)] == [k for _, k, _ in data]
    for bad in (blob[:-1], blob[:20], b"", blob[:-4] + b"\0\0\0\0", b"x" + blob):
        with pytest.raises(ValueError):
            codec.run_sections(bad)
    empty = codec.encode_run([])
    assert codec.run_get(empty, b"a") is None and codec.run_index(empty) == []


def test_bloom():
    there, absent = [b"key%d" % i for i in range(1000)], [b"absent%d" % i for i in range(1000)]
    k, m, bits = codec.bloom(there)
    assert (k, m) == (7, 10_000) and codec.bloom_test(there, k, m, bits).all()
    assert codec.bloom_test(absent, k, m, bits).sum() <= 20
    assert codec.decode_bloom(codec.encode_bloom(k, m, bits)) == (k, m, bits)
    assert codec.bloom([])[1] == 64 and not codec.bloom_test([b"a"], *codec.bloom([])).any()
    with pytest.raises(ValueError):
        codec.decode_bloom(codec.encode_bloom(k, m, bits) + b"x")


@pytest.mark.parametrize("sent", [True, False])
@pytest.mark.parametrize("groups", [[], ["g"], ["g", "h"]])
def test_packed_filters(spark, monkeypatch, groups, sent):
    if not sent:
        monkeypatch.setattr(bloom, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(bloom, "KEYS_PER_PART", 40)
    rng = random.Random(len(groups))
    data = [(rng.randrange(3), rng.choice("xy"), rng.choice([None, "", "ключ", f"k{rng.randrange(90)}"]), 1) for _ in range(500)]
    df = spark.createDataFrame(data, "g int, h string, key string, bits int")
    at = [("g", "h").index(c) for c in groups]
    held = {}
    for r in data:
        if r[2] is not None:
            held.setdefault(tuple(r[i] for i in at), set()).add(r[2].encode())
    filters = bloom.packed(df, groups)
    got = {tuple(r[: len(groups)]): r for r in filters.collect()}
    assert set(got) == set(held)
    for name, r in got.items():
        k, m, bits = codec.bloom(sorted(held[name]))
        assert (r.n_keys, r.k, r.m, bytes(r.bits)) == (len(held[name]), k, m, bits) and r.n_set == int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum())
    asked = [(rng.randrange(4), rng.choice("xyz"), f"k{i}", 2) for i in range(200)] + [(0, "x", None, 2), (0, "x", "", 2), (0, "x", "", 2)]
    want = set()
    for r in asked:
        name = tuple(r[i] for i in at)
        if r[2] is not None and name in held:
            f = got[name]
            want.add((*name, r[2], bool(codec.bloom_test([r[2].encode()], f.k, f.m, bytes(f.bits))[0])))
    answers = [tuple(r) for r in bloom.probe(filters, spark.createDataFrame(asked, "g int, h string, key string, maybe int"), groups).collect()]
    assert len(answers) == len(want) and set(answers) == want
    assert bloom.probe(filters.limit(0), df, groups).count() == 0 and bloom.packed(df.limit(0), groups).count() == 0


@pytest.mark.parametrize("key", ["", "a", "foobar", "ключ", "漢字" * 20])
def test_hash_is_one_in_both_worlds(spark, key):
    h = spark.createDataFrame([(key,)], "key string").select(fnv1a64(F.col("key")).alias("h")).first().h
    assert h.high << 32 | h.low == int(codec.fnv1a64([key.encode()])[0])


def test_encode_record_is_the_codec(spark):
    data = [(0, "k", "v"), (1, "ключ", None), (0, "", ""), (0, "x" * 300, "y" * 70_000)]
    df = spark.createDataFrame(data, "kind int, key string, value string")
    got = [bytes(r[0]) for r in df.select(encode_record(F.col("kind"), F.col("key"), F.col("value"))).collect()]
    assert sorted(got) == sorted(codec.encode(k, key.encode(), v and v.encode()) for k, key, v in data)


def test_wal_source(spark, tmp_path):
    register(spark)
    path = f"{tmp_path}/wal"
    rng = random.Random(0)
    data = [(rng.randrange(2), f"k{i}", None) for i in range(40)] + [(0, "ü", ""), (0, "v", "w")]
    df = spark.createDataFrame(data, "kind int, key string, value string")
    df.repartition(3).write.format("wal").mode("append").save(path)
    back = spark.read.format("wal").load(path)
    assert rows(back.select("kind", F.col("key").cast("string"))) == sorted(((k, key) for k, key, _ in data), key=repr)
    assert back.filter("kind = 0 AND value IS NULL").count() == 0
    first = sorted(tmp_path.joinpath("wal").glob("*.log"))[0]
    n = back.filter(F.col("file") == first.name).count()
    first.write_bytes(first.read_bytes()[:-3])
    assert spark.read.format("wal").load(str(first)).count() == n - 1
    with pytest.raises(Exception):
        spark.read.format("wal").option("torn", "fail").load(str(first)).collect()
    seqs = [r.seq for r in spark.read.format("wal").load(str(first)).orderBy("offset").collect()]
    assert seqs == list(range(n - 1))


def test_sst_source(spark, tmp_path):
    register(spark)
    path = f"{tmp_path}/sst"
    df = spark.createDataFrame([(0, "b", "1"), (0, "a", "2"), (1, "c", None)], "kind int, key string, value string")
    df.coalesce(1).write.format("sst").mode("append").save(path)
    df.limit(1).coalesce(1).write.format("sst").mode("append").save(path)
    got = rows(spark.read.format("sst").load(path).select("gen", "kind", F.col("key").cast("string"), F.col("value").cast("string")))
    assert got == [(1, 0, "a", "2"), (1, 0, "b", "1"), (1, 1, "c", None), (2, 0, "b", "1")]
    # Seven digits follow six.
    tmp_path.joinpath("sst/000002.sst").rename(tmp_path / "sst/999999.sst")
    df.limit(1).coalesce(1).write.format("sst").mode("append").save(path)
    assert max(r.gen for r in spark.read.format("sst").load(path).collect()) == 1_000_000
    tmp_path.joinpath("sst/000001.sst").write_bytes(b"no run")
    with pytest.raises(Exception):
        spark.read.format("sst").load(path).collect()
    assert spark.read.format("wal").load(f"{tmp_path}/nothing/*.log").count() == 0


@pytest.mark.parametrize("n", [0, 1, 40])
def test_lookup_in_a_run_file_reads_little(tmp_path, n):
    data = [(i % 5 == 0, b"k%03d" % i, None if i % 5 == 0 else b"v" * 2000) for i in range(n)]
    path = tmp_path / "000001.sst"
    path.write_bytes(codec.encode_run([(int(k), key, v) for k, key, v in data]))
    read = []

    class Spy:
        def __init__(self, f):
            self.f, self.seek = f, f.seek

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    with open(path, "rb") as f:
        got = list(codec.run_lookup(Spy(f), [b"k003", b"k005", b"none", b"k999"]))
    assert [(k, key, v) for _, k, key, v in got] == [(int(k), key, v) for k, key, v in data if key in (b"k003", b"k005")]
    assert n < 40 or sum(read) < 6000
    with open(path, "rb") as f:
        assert list(codec.run_lookup(f, [])) == []


def test_filters_are_handed_to_run_files(spark, tmp_path):
    register(spark)
    path = f"{tmp_path}/sst"
    for g in range(3):
        spark.createDataFrame([(g % 2, f"k{i}", f"v{g}") for i in range(g, 50)], "kind int, key string, value string").coalesce(1).write.format("sst").mode("append").save(path)
    all_ = spark.read.format("sst").load(path)
    key = lambda k: F.col("key") == F.lit(k)
    asks = [key(b"k7"), key(b"k0"), key(b"none"), F.col("key").isin(F.lit(b"k1"), F.lit(b"k49")), key(b"k7") & (F.col("gen") == 2), F.col("gen").isin(1, 3), key(b"k7") & key(b"k8"), key(b"k7") & (F.col("kind") == 0)]
    whole = all_.collect()
    want = [
        lambda r: r.key == b"k7", lambda r: r.key == b"k0", lambda r: False, lambda r: r.key in (b"k1", b"k49"), lambda r: r.key == b"k7" and r.gen == 2,
        lambda r: r.gen in (1, 3), lambda r: False, lambda r: r.key == b"k7" and r.kind == 0,
    ]
    for ask, holds in zip(asks, want):
        assert rows(all_.filter(ask)) == sorted((tuple(r) for r in whole if holds(r)), key=repr)
    # Damage in records that a lookup does not touch is not met: the file was not read in full.
    first = sorted(tmp_path.joinpath("sst").glob("*.sst"))[0]
    blob = bytearray(first.read_bytes())
    blob[:9] = b"\xff" * 9
    first.write_bytes(bytes(blob))
    assert rows(spark.read.format("sst").load(path).filter(key(b"k7") & (F.col("gen") == 1)).select("kind"))  == [(0,)]


def test_router_follows_hints_and_takes_turns():
    leader = {"now": 2}
    up = {0, 1, 2}

    def call(node):
        return None if node not in up else (True, None) if node == leader["now"] else (False, leader["now"] if node == 1 else None)

    r = peers.Router({0: "a", 1: "b", 2: "c"})
    with pytest.raises(TimeoutError):
        r.write(call)  # node 0 knows no leader and is asked again and again
    up.discard(0)
    r = peers.Router({0: "a", 1: "b", 2: "c"})
    assert r.write(call) == [0, 1, 2] and r.guess == 2
    assert r.write(call) == [2]
    leader["now"] = 1
    up.discard(2)
    assert r.write(call)[-1] == 1
    assert r.read(call) == 1 and r.guess == 1
    with pytest.raises(LookupError):
        peers.Router({}).write(call)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_generations_of_different_sizes_all_come_back(spark):
    from tidelog.plans import extra, kv

    d = "/root/testdata/sf0.1"
    held = kv._runs(spark, d).select("kind", F.concat(F.lit("key"), "key").alias("key"), F.when(F.col("kind") == 0, F.concat(F.lit("v"), "seq")).alias("value"))
    assert rows(extra.sst_roundtrip(spark, d)) == rows(held)
