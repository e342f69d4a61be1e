"""Encoding and packing of columns."""

import os
import random

import numpy as np
import pytest

PATH = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")

from pyspark.sql import functions as F  # noqa: E402

from tests.conftest import rows  # noqa: E402
from tidelog.llm.encode import decode_ids, encode_texts, sizes, slices  # noqa: E402
from tidelog.llm.packing import ANY, best_fit, fill_report, named, pack, pieces  # noqa: E402

DOCS = "doc_id bigint, text string, ids string, n_tokens int, container string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0, "y") for i, t in texts], DOCS)


def capacities(spark, *caps):
    return spark.createDataFrame([(f"c{c}", c) for c in caps], "size_name string, capacity int")


def test_encode_cases(spark):
    df = docs(spark, [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "<|endoftext|>"), (4, "a" * 300_000), (5, " ")])
    out = encode_texts(df.repartition(3), "doc_id", "text", PATH)
    assert out.columns == ["doc_id", "ids"]
    got = rows(out.select("doc_id", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first")))
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, 2, 31373), (1, 2, 31373), (2, 0, None), (3, 0, None)]
    assert len(got) == 7 and 50256 not in [i for r in out.filter("doc_id IS NULL").collect() for i in r.ids]
    back = decode_ids(out, "doc_id", "ids", PATH)
    assert rows(back) == rows(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def test_encode_nothing(spark):
    assert encode_texts(docs(spark, []), "doc_id", "text", PATH).count() == 0


def test_slices_cover_every_row():
    import pyarrow as pa

    texts = ["x" * n for n in (0, 5, 3, 0, 40, 1, 0)] + [None, "é"]
    for limit in (1, 6, 1000):
        at, seen = 0, b""
        for lo, hi, b, o in slices(pa.array(texts), limit):
            assert lo == at and len(o) == hi - lo + 1
            at, seen = hi, seen + b.tobytes()
        assert at == len(texts) and seen == "".join(t or "" for t in texts).encode()
    assert sizes(pa.array(texts).slice(1, 3), PATH).tolist() == sizes(pa.array(texts), PATH)[1:4].tolist()


def brute_best_fit(items, cap):
    free = []
    for s in sorted(items, reverse=True):
        fit = [(f, i) for i, f in enumerate(free) if f >= s]
        if fit:
            free[min(fit)[1]] -= s
        else:
            free.append(cap - s)
    return len(free)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_best_fit(seed):
    rng = random.Random(seed)
    items = [rng.choice([rng.randrange(0, 101), rng.randrange(0, 20), 0]) for _ in range(400)]
    where, caps = best_fit(np.array(items), [100])
    used = np.bincount(where, weights=items)
    assert used.max() <= 100 and len(caps) == brute_best_fit(items, 100)


@pytest.mark.parametrize("seed", range(5))
def test_several_capacities(seed):
    rng = random.Random(seed)
    items = np.array([rng.choice([rng.randrange(1, 500), rng.randrange(1, 60)]) for _ in range(600)])
    where, caps = best_fit(items, [64, 128, 512])
    used = np.bincount(where, weights=items)
    assert (used <= caps).all() and set(caps.tolist()) <= {64, 128, 512}
    smaller = np.array([max([c for c in (0, 64, 128, 512) if c < cap]) for cap in caps])
    assert (used > smaller).all()  # cut down to the least capacity that holds the contents
    _, only = best_fit(items, [512])
    assert caps.sum() <= only.sum() * 1.02


def test_pieces():
    row, piece, begin, size = pieces(np.arange(4), np.array([0, 5, 10, 23]), 10)
    assert row.tolist() == [0, 1, 2, 3, 3, 3] and size.tolist() == [0, 5, 10, 10, 10, 3]
    assert piece.tolist() == [0, 0, 0, 0, 1, 2] and begin.tolist() == [0, 0, 0, 0, 10, 20]


def test_pack(spark):
    rng = random.Random(2)
    texts = [(i % 290, None if i % 50 == 0 else "" if i % 51 == 0 else " ".join(rng.choice(["cat", "dog", "tree"]) for _ in range(rng.choice([3, 20, 90, 400]))) + "!" * (i % 3)) for i in range(300)]
    df = docs(spark, texts).repartition(3)
    out = pack(df, capacities(spark, 64, 256, 64).union(spark.createDataFrame([("bad", None), ("zero", 0)], "size_name string, capacity int")), PATH)
    got = out.collect()
    sizes_ = {}
    for i, t in texts:
        sizes_.setdefault(i, []).append(len(encode_one(t)))
    for name, largest in (("c64", 64), ("c256", 256), (ANY, 256)):
        mine = [r for r in got if r.packing == name]
        total, held = {}, {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            held.setdefault(r.container, [0, r.capacity])[0] += r.n_tokens
            assert r.n_tokens <= largest and held[r.container][1] == r.capacity
        assert total == {i: sum(n) for i, n in sizes_.items()}
        assert sum(1 for r in mine if r.piece == 0) == len(texts)
        assert all(used <= cap and cap in (64, 256) for used, cap in held.values())
        # A document that fits is in one piece.
        assert len(mine) == sum(max(1, -(-n // largest)) for ns in sizes_.values() for n in ns)
        unused = sum(c - u for u, c in held.values())
        assert unused <= 0.06 * sum(c for _, c in held.values())
    report = {r.packing: r for r in fill_report(out).collect()}
    assert report["c64"].tokens == sum(sum(n) for n in sizes_.values())


def encode_one(text):
    from tidelog.llm.bpe import automaton

    b = np.frombuffer((text or "").encode(), np.uint8)
    return automaton(PATH).encode(b, np.array([0, len(b)]))[0].tolist()


def test_pack_edges(spark):
    assert pack(docs(spark, []), capacities(spark, 8), PATH).count() == 0
    only = pack(docs(spark, [(1, None), (2, "")]), capacities(spark, 8), PATH).collect()
    assert {(r.packing, r.doc_id, r.n_tokens) for r in only} == {(p, i, 0) for p in ("c8", ANY) for i in (1, 2)}
    with pytest.raises(ValueError):
        pack(docs(spark, [(1, "a")]), capacities(spark), PATH)


def test_repeated_and_reserved_names_keep_their_packings():
    got = named({("a", 8), ("a", 16), (None, 32), ("32", 64), (ANY, 4), ("b", 2), ("b", 2), ("", 128)})
    assert sorted(c for name, (c, *_) in got.items() if name != ANY) == [2, 4, 8, 16, 32, 64, 128]
    assert got[ANY] == [2, 4, 8, 16, 32, 64, 128] and got["b"] == [2] and got["a:16"] == [16] and got[f"{ANY}:4"] == [4]
