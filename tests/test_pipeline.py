"""The pipeline's operators against brute force, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidelog.operators import consolidate as C
from tidelog.operators import replay as R
from tidelog.operators import seen as S
from tidelog.operators.blocked import contiguous_end, prefix_sum, suffix_min
from tidelog.operators.diff import difference_values, differences
from tidelog.sources.codec import bloom_test
from tidelog.operators.treetop import first_n_per_key, rounds_for

STORE = "key string, kind int, value string, seq bigint, term bigint, _side int, field string"
FIELDS = ["kind", "value", "seq", "term"]


def store(spark, data):
    return spark.createDataFrame([(*r, 1, "x") for r in data], STORE)


def test_differences_cases(spark):
    a = store(spark, [("same", 0, "v", 1, 1), ("same", 0, "v", 1, 1), ("gone", 0, "v", 1, 1), (None, 0, "v", 1, 1), ("null", 0, None, 1, None), ("empty", 0, "", 1, 1), ("all", 0, "v", 1, 1), ("\u00e9", 0, "v", 1, 1), ("nulls", None, None, None, None)])
    b = store(spark, [("same", 0, "v", 1, 1), ("new", 1, None, 2, 2), (None, 1, "w", 1, 1), ("null", 0, None, 1, 3), ("empty", 0, None, 1, 1), ("all", 1, None, 2, 2), ("e\u0301", 0, "v", 1, 1), ("nulls", None, None, None, None)])
    want = {("gone", "only_in_a"), ("new", "only_in_b"), ("null", "term"), ("empty", "value"), ("all", "kind"), ("all", "value"), ("all", "seq"), ("all", "term"), ("\u00e9", "only_in_a"), ("e\u0301", "only_in_b")}
    assert set(map(tuple, differences(a, b, ["key"], FIELDS).collect())) == want
    got = {(r.key, r.field): (r.value_a, r.value_b) for r in difference_values(a, b, ["key"], FIELDS).collect()}
    assert got["all", "seq"] == ("1", "2") and got["empty", "value"] == ("", None)


def test_differences_empty(spark):
    none, one = store(spark, []), store(spark, [("k", 0, "v", 1, 1)])
    assert rows(differences(none, none, ["key"], FIELDS)) == []
    assert rows(differences(none, one, ["key"], FIELDS)) == [("k", "only_in_b")]


def test_differences_do_not_depend_on_order(spark):
    data = [("k", i % 2, str(i), i, None) for i in range(40)]
    a, b = store(spark, data), store(spark, data[::-1])
    assert rows(differences(a, b.repartition(5), ["key"], FIELDS)) == []


RUNS = "file_id bigint, cluster_id int, gen int, key string, kind int, value string, seq bigint, index_offset bigint, rec_len int, file_no int"
LISTINGS = "file_id bigint, file_state string, listed_at bigint"


def runs_of(spark, rng, n_files=60, n=900):
    records = {}
    out = []
    for _ in range(n):
        c, seq = rng.randrange(3), rng.randrange(n // 2)
        k = records.setdefault((c, seq), (rng.choice(["hot", "hot", f"k{rng.randrange(50)}", "ß", None]), rng.randrange(2)))
        value = None if k[1] else f"v{seq}" * rng.randrange(1, 9)
        value = records.setdefault((c, seq, "v"), value)
        size = 9 + len((k[0] or "").encode()) + len((value or "").encode())
        row = (rng.randrange(n_files), c, 1, k[0], k[1], value, seq, 0, rng.choice([size, None]), 5)
        out += [row] * rng.choice([1, 1, 2])
    return spark.createDataFrame(out, RUNS), out


def test_consolidation(spark):
    rng = random.Random(3)
    df, data = runs_of(spark, rng)
    listings = [(f, s, t) for f in range(50) for t, s in enumerate(rng.choices(["live", "tmp", "dropped"], [6, 1, 1], k=rng.randrange(1, 4)))]
    latest = {}
    for f, s, t in listings:
        if t >= latest.get(f, (-1, ""))[0]:
            latest[f] = (t, s)
    live = {f for f, (_, s) in latest.items() if s == "live"}
    want = sorted({(r[1], r[6]) for r in data if r[0] in live})
    target = 1500
    done = C.consolidate(df, spark.createDataFrame(listings * 2, LISTINGS), target)
    assert sorted((r.cluster_id, r.seq) for r in done.collect()) == want
    files = C.file_ranges(done).collect()
    sizes = {(r.cluster_id, r.seq): r.rec_len for r in done.collect()}
    assert max(f.n_bytes for f in files) <= target + max(sizes.values())
    assert len(files) <= 2 * sum(sizes.values()) / target + 3 + 20
    # Ranges of (key, seq) do not overlap within a cluster.
    for c in range(3):
        spans = []
        for f in [f.file_no for f in files if f.cluster_id == c]:
            keys = sorted((r.key or "", r.seq) for r in done.filter((F.col("cluster_id") == c) & (F.col("file_no") == f)).collect())
            spans.append((keys[0], keys[-1]))
        spans.sort()
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_consolidated_files_are_sorted(spark):
    df, _ = runs_of(spark, random.Random(4))
    listings = spark.createDataFrame([(f, "live", 1) for f in range(60)], LISTINGS)
    done = C.consolidate(df, listings, 2000)
    for path in {r.p for r in done.select(F.input_file_name().alias("p")).distinct().collect()}:
        import pyarrow.parquet as pq

        t = pq.read_table(path.removeprefix("file://")).to_pylist()
        order = [(r["key"] is not None, (r["key"] or "").encode(), r["seq"]) for r in t]
        assert order == sorted(order)


def test_consolidation_empty(spark):
    none = spark.createDataFrame([], RUNS)
    assert C.consolidate(none, spark.createDataFrame([], LISTINGS)).count() == 0
    one = spark.createDataFrame([(1, 0, 1, "k", 0, "v", 1, 0, 11, 0)], RUNS)
    assert C.consolidate(one, spark.createDataFrame([], LISTINGS)).count() == 0


class Counted(int):
    compared = 0

    def __lt__(self, other):
        Counted.compared += 1
        return int(self) < int(other)

    __hash__ = int.__hash__


def test_what_is_sorted_is_not_sorted_again():
    keys = [Counted(i // 2) for i in range(1000)]
    Counted.compared = 0
    assert C.sorted_slices(keys) == [(0, 1000)] and C.merge_order(keys) == list(range(0, 1000, 2))
    # Each neighbour is compared once per call, to see that there is one slice; nothing else is.
    assert Counted.compared == 2 * 999


@pytest.mark.parametrize("seed", range(5))
def test_merging_slices(seed):
    rng = random.Random(seed)
    files = [sorted(rng.choices(range(60), k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 20))]
    keys = [(k,) for f in files for k in f]
    assert len(C.sorted_slices(keys)) <= len(files)
    order = C.merge_order(keys)
    assert [keys[i] for i in order] == sorted(set(keys))
    assert all(keys.index(keys[i]) == i for i in order) and C.merge_order([]) == []


@pytest.mark.parametrize("merge_bytes,least", [(C.MERGE_BYTES, C.LEAST_BYTES), (200, C.LEAST_BYTES), (2000, 3000)])
def test_consolidation_by_ranges_and_from_scratch_files(spark, monkeypatch, merge_bytes, least):
    monkeypatch.setattr(C, "LEAST_BYTES", least)
    rng = random.Random(7)
    df, data = runs_of(spark, rng, n=2500)
    df = df.repartition(6)
    listed = [(f, "live" if f < 50 else "tmp", 1, f % 3, f, 40, None) for f in range(60)]
    listings = spark.createDataFrame(listed, LISTINGS + ", cluster_id int, gen int, n_records int, n_bytes bigint")
    done, made = C.consolidate_files(df, listings, 1500, merge_bytes=merge_bytes)
    got = done.collect()
    want = {(r[1], r[6]): (r[3], r[4], r[5]) for r in data if r[0] < 50}
    assert len(got) == len(want) and {(r.cluster_id, r.seq): (r.key, r.kind, r.value) for r in got} == want
    ranges = {r.file_no // C.FILES_PER_RANGE for r in got}
    assert len(ranges) > 4 if least == 3000 else len(ranges) == 1
    if least == 3000:
        # The hot key is spread over several ranges.
        assert len({r.file_no // C.FILES_PER_RANGE for r in got if r.key == "hot"}) > 2
    # The listings say what the files hold.
    new = {(r.cluster_id, r.file_no): r for r in made.filter("file_state = 'live'").collect()}
    told = {(r.cluster_id, r.file_no): r for r in C.file_ranges(done).collect()}
    assert set(new) == set(told) and len({r.file_id for r in new.values()}) == len(new)
    for f, r in new.items():
        assert (r.n_records, r.n_bytes, r.min_key, r.max_key) == (told[f].n_records, told[f].n_bytes, told[f].min_key, told[f].max_key)
        keys = {x.key for x in got if (x.cluster_id, x.file_no) == f} - {None}
        assert r.file_id > 59 and (not keys or bloom_test([k.encode() for k in keys], r.bloom_k, r.bloom_m, bytes(r.bloom_bits)).all())
        assert r.gen > max(x[4] for x in listed if x[3] == r.cluster_id)
    both = listings.unionByName(made.select(*listings.columns))
    assert {r.file_id for r in C.live_files(both).collect()} == {r.file_id for r in new.values()}


@pytest.mark.parametrize("merge_bytes", [C.MERGE_BYTES, 1])
def test_consolidation_of_nulls_and_clashing_names(spark, merge_bytes):
    schema = RUNS + ", range int, listing string, part string"
    row = lambda f, c, k, s, size: (f, c, 1, k, 0, "v", s, 0, size, 5, 9, "x", "y")
    data = [row(1, None, "a", 1, 11), row(1, None, "a", 1, 11), row(2, 0, None, 2, None), row(2, 0, "a", None, 11), row(1, 0, "", 3, 10), row(None, 0, "z", 4, 11), row(3, 0, "z", 5, 11)]
    listings = spark.createDataFrame([(1, "live", 1), (1, None, None), (2, "live", None), (3, "tmp", 7), (None, "live", 9), (4, "live", 1)], LISTINGS)
    done, made = C.consolidate_files(spark.createDataFrame(data, schema).repartition(3), listings, 25, merge_bytes=merge_bytes)
    assert rows(done.select("cluster_id", "key", "seq")) == sorted([(None, "a", 1), (0, None, 2), (0, "a", None), (0, "", 3)], key=repr)
    new = made.filter("file_state = 'live'").collect()
    assert sum(r.n_records for r in new) == 4 and {r.cluster_id for r in new} == {None, 0}
    both = listings.unionByName(made.select(*listings.columns))
    assert {r.file_id for r in C.live_files(both).collect()} == {r.file_id for r in new}


def test_ranges_come_from_bytes_and_cores():
    assert [C.ranges_for(n << 20, 6) for n in (0, 1, 8, 40, 400, 4000)] == [1, 1, 2, 10, 12, 63]
    assert C.ranges_for(1 << 47, 6) == C.RANGES_MAX


LOG = "feed_id bigint, cluster_id int, idx bigint, term bigint, origin int, cmd_id bigint, op string, kind int, key string, overruled_from int, _block int"


def brute_replay(data, watermark=None):
    entries = {}
    for _, c, i, t, o, m, op, kind, key, *_ in data:
        dead = kind == 1 if kind is not None else (op or "").strip().lower() in R.DELETE_OPS
        entries[c, i, t] = (o, m, key, dead)
    out = {}
    for c in {e[0] for e in entries}:
        mine = sorted(((i, t), e) for (cc, i, t), e in entries.items() if cc == c)
        top, done, state = 0, set(), {}
        ok = []
        for (i, t), e in mine:
            if not any(t2 > t and i2 <= i for (i2, t2), _ in mine):
                ok.append((i, e))
        for i, (o, m, key, dead) in sorted(ok):
            if watermark and i > watermark[c]:
                break
            if key is None or (o, m) in done:
                continue
            done.add((o, m))
            state[key] = (i, dead)
        for key, (i, dead) in state.items():
            if not dead:
                out[c, key] = i
    return sorted((c, k, i) for (c, k), i in out.items())


def a_log(rng, n=220):
    out = []
    for c in range(2):
        term, idx = 1, 0
        commands = {}
        for _ in range(n):
            if rng.random() < 0.05:
                term += rng.randrange(1, 3)
                idx = max(0, idx - rng.randrange(4))
            idx += 1
            cmd = rng.randrange(150)
            key, dead = commands.setdefault(cmd, (rng.choice(["hot", "hot", "a", "b", "ü", ""]), rng.random() < 0.3))
            if rng.random() < 0.05:
                row = (0, c, idx, term, 0, 1000 + idx * 100 + term, "noop", None, None, 1, 2)
            else:
                op = rng.choice(["delete", "DEL", " Remove "]) if dead else rng.choice(["put", "Set", "upsert"])
                given = rng.randrange(3)
                row = (0, c, idx, term, cmd % 3, cmd, None if given == 0 else op, None if given == 1 else int(dead), key, 1, 2)
            out += [row] * rng.choice([1, 1, 2, 3])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_replay_is_the_sequential_fold(spark, seed):
    data = a_log(random.Random(seed))
    df = spark.createDataFrame(data, LOG).repartition(3)
    assert rows(R.replay(df)) == sorted(brute_replay(data), key=repr)


def test_gaps_hold_what_follows(spark):
    put = lambda i, key: (0, 0, i, 1, 0, i, "put", 0, key, 0, 0)
    df = spark.createDataFrame([put(1, "a"), put(2, "b"), put(4, "c"), put(4, "c")], LOG)
    assert rows(R.replay(df, feed_complete=False)) == [(0, "a", 1), (0, "b", 2)]
    assert rows(R.watermarks(df)) == [(0, 1, 2, 4)]
    assert rows(R.replay(df, feed_complete=True)) == [(0, "a", 1), (0, "b", 2), (0, "c", 4)]
    assert rows(R.replay(df)) == [(0, "a", 1), (0, "b", 2)]
    filled = df.union(spark.createDataFrame([put(3, "a")], LOG))
    assert rows(R.replay(filled, feed_complete=False)) == [(0, "a", 3), (0, "b", 2), (0, "c", 4)]


def test_a_missing_head_holds_everything(spark):
    put = lambda i, key: (0, 0, i, 1, 0, i, "put", 0, key, 0, 0)
    df = spark.createDataFrame([put(3, "a"), put(4, "b"), put(5, "c")], LOG)
    assert rows(R.replay(df)) == [] and rows(R.watermarks(df)) == [(0, 1, 0, 5)]
    # A log that begins behind a snapshot has its head.
    assert rows(R.replay(df, first=3)) == [(0, "a", 3), (0, "b", 4), (0, "c", 5)]
    assert rows(R.replay(df, first=4)) == [(0, "b", 4), (0, "c", 5)] and rows(R.watermarks(df, 4)) == [(0, 4, 5, 5)]


def test_overruled_entries_do_not_fill_gaps(spark):
    row = lambda i, t, key: (0, 0, i, t, 0, 100 * t + i, "put", 0, key, 0, 0)
    # Entry 3 of term 1 is overruled by entry 2 of term 2, and no other entry 3 was committed.
    df = spark.createDataFrame([row(1, 1, "a"), row(2, 2, "b"), row(3, 1, "c"), row(4, 2, "d")], LOG)
    assert rows(R.watermarks(df)) == [(0, 1, 2, 4)] and rows(R.replay(df)) == [(0, "a", 1), (0, "b", 2)]


def test_unknown_spellings_are_told(spark):
    ops = [("Put", None, "k"), ("zap", None, "k"), (" ZAP ", None, "k"), ("zap", 0, "k"), (None, None, "k"), ("zap", None, None), ("DEL", None, "k")]
    df = spark.createDataFrame([(0, 0, i, 1, 0, i, op, kind, key, 0, 0) for i, (op, kind, key) in enumerate(ops)], LOG)
    assert rows(R.unknown_ops(df)) == sorted([("zap", 2), (None, 1)], key=repr)


def test_replay_empty_and_null(spark):
    assert rows(R.replay(spark.createDataFrame([], LOG))) == []
    bad = [(0, None, 1, 1, 0, 1, "put", 0, "a", 0, 0), (0, 0, None, 1, 0, 1, "put", 0, "a", 0, 0), (0, 0, 1, None, 0, 1, "put", 0, "a", 0, 0), (0, 0, 1, 1, None, None, "put", None, "a", 0, 0)]
    assert rows(R.replay(spark.createDataFrame(bad, LOG))) == [(0, "a", 1)]


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_blocked(spark, width):
    rng = random.Random(width)
    data = [(g, o, rng.randrange(50)) for g in "ab" for o in sorted(rng.sample(range(40), 25))]
    df = spark.createDataFrame(data, "g string, o int, v int")
    least = {(g, o): min((v2 for g2, o2, v2 in data if g2 == g and o2 > o), default=None) for g, o, _ in data}
    assert {(r.g, r.o): r.x for r in suffix_min(df, ["g"], "o", "v", "x", width).collect()} == least
    sums = {(g, o): sum(v2 for g2, o2, v2 in data if g2 == g and o2 < o) for g, o, _ in data}
    assert {(r.g, r.o): r.x for r in prefix_sum(df, ["g"], "o", "v", "x", width).collect()} == sums


@pytest.mark.parametrize("first,have,end", [
    (1, range(1, 30), 29), (1, [*range(1, 12), *range(13, 30)], 11), (1, range(2, 9), 0), (5, range(1, 9), 8), (5, [1, 2, 6, 7], 4), (0, [0], 0), (-3, range(-3, 3), 2),
    (1, range(1, 32769), 32768), (1, range(1, 32770), 32769), (1, [*range(1, 32768), 32769], 32767), (1, [*range(1, 65537), 70_000], 65536), (7, [*range(7, 40_000), *range(40_001, 99_000)], 39_999),
    (1, range(40_000, 40_010), 0), (1, [*range(1, 8), *range(9, 20)], 7), (1, [*range(1, 9), *range(10, 20)], 8),
])
def test_contiguous_end(spark, first, have, end):
    data = [(g, i) for g in "ab" for i in have if g == "a" or i < first + 3] + [("a", have[0])] * 2 + [("low", first - 1)]
    got = {r.g: tuple(r)[1:] for r in contiguous_end(spark.createDataFrame(data, "g string, o int"), ["g"], "o", first).collect()}
    mine = [i for i in have if first <= i]
    assert got["a"] == (first, end, max(mine)) and "low" not in got
    if any(i < first + 3 for i in mine):
        few = [i for i in mine if i < first + 3]
        assert got["b"] == (first, min(end, max(few)), max(few))


@pytest.mark.parametrize("parts,fan_in", [(1, 64), (9, 2), (20, 3)])
def test_first_n_per_key(spark, parts, fan_in):
    rng = random.Random(parts)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", "", None, "ключ"]), rng.choice([None, *range(30)]), i, "x") for i in range(600)]
    data += data[:100] * 3
    want = set()
    for k in {r[0] for r in data} - {None}:
        want |= {(k, t, i) for t, i in sorted({(r[1], r[2]) for r in data if r[0] == k and r[1] is not None})[:3]}
    df = spark.createDataFrame(data, "key string, t int, id int, _chunk string").repartition(parts)
    got = first_n_per_key(df, "key", ["t", "id"], fan_in=fan_in).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("chunk_rows,fan_in,rounds", [(1 << 15, 8, 2), (50, 4, 2), (10, 4, 3), (5, 2, 7)])
def test_tree_rounds(spark, chunk_rows, fan_in, rounds):
    rng = random.Random(chunk_rows)
    data = [(rng.choice(["hot"] * 9 + ["a", "b"]), rng.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(data, "key string, t int, id int").repartition(4)
    top = first_n_per_key(df, "key", ["t", "id"], fan_in=fan_in, chunk_rows=chunk_rows)
    want = {(k, t, i) for k in ("hot", "a", "b") for _, t, i in sorted(r for r in data if r[0] == k)[:3]}
    assert {tuple(r) for r in top.collect()} == want
    plan = top._jdf.queryExecution().executedPlan().toString()
    # One exchange a round, and a limit where rows are read.
    final = plan.split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == rounds and final.count("WindowGroupLimit") == 2 * rounds


def test_first_n_of_nothing(spark):
    df = spark.createDataFrame([], "key string, t int, id int")
    assert first_n_per_key(df, "key", ["t", "id"]).count() == 0
    assert [rounds_for(n, 4) for n in (0, 1, 4, 5, 16, 17, 65)] == [1, 1, 1, 2, 2, 3, 4]


PROBES = "probe_id bigint, key string, maybe boolean, h int"


@pytest.mark.parametrize("per_shard", [7, 1 << 20])
def test_seen(spark, per_shard):
    rng = random.Random(per_shard)
    history = [rng.choice(["hot", f"k{rng.randrange(80)}", "ключ", "", None]) for _ in range(300)]
    probes = [(i, rng.choice(["hot", f"k{rng.randrange(400)}", "ключ", "Ключ", "", None])) for i in range(500)]
    want, before = set(), set(history) - {None}
    for i, k in probes:
        if k is not None and k in before:
            want.add(i)
        before.add(k)
    rng.shuffle(probes)
    df = spark.createDataFrame([(*p, True, 1) for p in probes + probes[:50]], PROBES)
    s = S.Seen(df, spark.createDataFrame([(k, 1) for k in history], "key string, shard int"), "probe_id", "key", per_shard)
    got = [r.id for r in s.found().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    e = s.error_rate().first()
    assert e.looked_up == len({k for _, k in probes} - {None}) == e.negatives + e.positives
    assert e.wrong == s.disproved().count() and e.error_rate < 0.1


def test_a_stored_filter_serves_later_batches(spark, tmp_path):
    history = spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string")
    S.build_filter(history, "key", 3).write.parquet(f"{tmp_path}/f")
    stored = spark.read.parquet(f"{tmp_path}/f")
    probes = spark.createDataFrame([(1, "k1", True, 0), (2, "x", True, 0), (3, "k49", True, 0), (4, "x", True, 0)], PROBES)
    assert rows(S.Seen(probes, history, "probe_id", "key", filters=(stored, 3)).found()) == [(1,), (3,), (4,)]


def test_seen_empty(spark):
    none, some = spark.createDataFrame([], PROBES), spark.createDataFrame([(1, "a", True, 0), (2, "a", True, 0)], PROBES)
    assert S.Seen(none, some, "probe_id", "key").found().count() == 0
    assert rows(S.Seen(some, none, "probe_id", "key").found()) == [(2,)]


def test_filter_rates():
    import numpy as np

    h = np.random.default_rng(1).integers(-(2**63), 2**63, 40_000)
    m, bits = S.fill(h[:20_000])
    on = S.test(h, np.frombuffer(bits, np.uint8), m, S.HASHES)
    assert on[:20_000].all() and on[20_000:].mean() < 0.012
