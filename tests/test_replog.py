"""Rules of the replicated log on small situations and against sequential evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidelog.operators import fold, messages, replog, runs, votes


def progress(spark, **clusters):
    data = [(c, i, m) for c, ms in clusters.items() for i, m in enumerate(ms)]
    return spark.createDataFrame(data, "cluster string, node int, match_idx bigint")


def log(spark, *terms, node=None):
    data = [(i + 1, t) for i, t in enumerate(terms)]
    if node is None:
        return spark.createDataFrame(data, "idx bigint, term bigint")
    return spark.createDataFrame([(node, *r) for r in data], "node int, idx bigint, term bigint")


def test_quorum_of_any_size(spark):
    got = dict(rows(replog.quorum(progress(spark, one=[7], two=[7, 3], three=[7, 3, 1], four=[9, 8, 2, 1], five=[9, 8, 7, 1, 0]))))
    assert got == {"one": 7, "two": 3, "three": 3, "four": 2, "five": 7}


def test_only_the_leaders_own_term_commits_by_counting(spark):
    # An entry of term 2 on a majority is not committed by a leader of term 4 until one of its own is.
    held = progress(spark, c=[3, 2, 2, 0, 0])
    entries = log(spark, 1, 2, 4).withColumn("cluster", F.lit("c")).union(log(spark, 1, 1).withColumn("cluster", F.lit("other")))
    got = {r.term: r.commit_idx for r in replog.commit_index(entries, held).collect()}
    assert got == {1: 1, 2: 2} and 4 not in got
    got = {r.term: r.commit_idx for r in replog.commit_index(entries, progress(spark, c=[3, 3, 3, 0, 0])).collect()}
    assert got[4] == 3


@pytest.mark.parametrize(
    "own,match,conflict,after",
    [
        ((1, 1, 2), 3, None, (1, 1, 2, 3)), ((1, 1), 2, None, (1, 1, 2, 3)), ((1, 1, 1, 1), 2, 3, (1, 1, 2, 3)),
        ((2, 2), 0, 1, (1, 1, 2, 3)), ((1, 1, 2, 3, 3), 4, None, (1, 1, 2, 3, 3)),
    ],
)
def test_matching_and_truncation(spark, own, match, conflict, after):
    leader, replica = log(spark, 1, 1, 2, 3), log(spark, *own, node=5)
    m = replog.match(leader, replica).first()
    assert (m.match_idx, m.conflict_idx, m.last_idx) == (match, conflict, len(own))
    assert rows(replog.truncated(leader, replica)) == [(5, i + 1, t) for i, t in enumerate(after)]
    assert replog.rejections(leader, replica).first().rejections == 4 - match


REPLY = "cluster string, node int, seq int, sent_term int, term int, success boolean, prev_idx bigint, n_entries bigint"


def brute_replies(progress_, lead, replies):
    state = {(c, n): [m, x] for c, n, m, x in progress_}
    fallen = set()
    for c, n, _, sent, term, ok, prev, k in sorted(replies, key=lambda r: r[2]):
        if term > lead[c]:
            fallen.add(c)
        if c in fallen or sent != lead[c]:
            continue
        if ok:
            state[c, n] = [prev + k, prev + k + 1]
        elif state[c, n][1] > 1:
            state[c, n][1] -= 1
    return sorted((c, n, m, x) for (c, n), (m, x) in state.items())


def test_each_failure_moves_the_next_index_back(spark):
    held = spark.createDataFrame([("c", 0, 0, 51), ("c", 1, 0, 3), ("c", 2, 7, 9), ("c", 3, 5, 6)], "cluster string, node int, match_idx bigint, next_idx bigint")
    leaders = spark.createDataFrame([("c", 3)], "cluster string, term int")
    fails = [("c", 0, i, 3, 3, False, 50 - i, 0) for i in range(5)] + [("c", 1, 10 + i, 3, 3, False, 2, 0) for i in range(9)]
    # A success may lower a match; failures before it count for nothing; replies of an earlier term do not count.
    more = [("c", 2, 30, 3, 3, False, 8, 0), ("c", 2, 31, 3, 3, True, 2, 2), ("c", 2, 32, 3, 3, False, 4, 0), ("c", 3, 33, 2, 3, True, 90, 5)]
    got = rows(messages.after_replies(held, leaders, spark.createDataFrame(fails + more, REPLY)))
    assert got == [("c", 0, 0, 46), ("c", 1, 0, 1), ("c", 2, 4, 4), ("c", 3, 5, 6)]


@pytest.mark.parametrize("seed", range(3))
def test_replies_are_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    held = [(c, n, rng.randrange(5), rng.randrange(1, 9)) for c in "abc" for n in range(4)]
    lead = {c: 5 for c in "abc"}
    replies = [(rng.choice("abc"), rng.randrange(4), i, rng.choice([4, 5, 5, 5]), 5, rng.random() < 0.3, rng.randrange(9), rng.randrange(3)) for i in range(120)]
    replies.append(("b", 1, 70, 5, 6, False, 1, 0))
    replies = [(c, n, i if (c, n, i) != ("b", 1, 70) else 70, *r) for c, n, i, *r in replies if i != 70 or r[1] == 6]
    rng.shuffle(replies)
    got = rows(messages.after_replies(spark.createDataFrame(held, "cluster string, node int, match_idx bigint, next_idx bigint"), spark.createDataFrame(list(lead.items()), "cluster string, term int"), spark.createDataFrame(replies, REPLY)))
    assert got == brute_replies(held, lead, replies)


def test_snapshot_replies(spark):
    held = spark.createDataFrame([("c", 0, 3, 4), ("c", 1, 9, 4), ("c", 2, 0, 1)], "cluster string, node int, match_idx bigint, next_idx bigint")
    leaders = spark.createDataFrame([("c", 3)], "cluster string, term int")
    got = [("c", 0, 1, 3, 3, 8), ("c", 1, 2, 3, 3, 5), ("c", 2, 3, 2, 3, 8), ("c", 0, 4, 3, 4, 20), ("c", 2, 5, 3, 3, 20)]
    replies = spark.createDataFrame(got, "cluster string, node int, seq int, sent_term int, term int, snapshot_idx bigint")
    assert rows(messages.after_snapshot_replies(held, leaders, replies)) == [("c", 0, 8, 9), ("c", 1, 9, 6), ("c", 2, 0, 1)]


def brute_append(node, own, message, entries):
    """(term, success, last, commit, log) after one message, step by step."""
    term, commit, snap, snap_term = node
    sent, prev, prev_term, leader_commit = message
    held = dict(own)
    last = max(held, default=snap)
    at = lambda i: snap_term if i == snap else held.get(i, -1)
    if sent < term:
        return term, False, last, commit, held
    if prev > last or at(prev) != prev_term:
        return sent, False, last, commit, held
    for i, t in entries:
        if i in held and held[i] != t:
            held = {j: u for j, u in held.items() if j < i}
        held.setdefault(i, t)
    last = max(held, default=snap)
    return sent, True, last, max(commit, min(leader_commit, last)), held


@pytest.mark.parametrize("seed", range(4))
def test_appending_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    nodes, logs, sent, entries, want = [], [], [], [], {}
    for n in range(60):
        snap, snap_term = rng.choice([(0, 0), (3, 1)])
        lead = [(i, 1 + i // 4) for i in range(1, 14)]
        end, fork = rng.randrange(snap, 15), rng.randrange(2, 16)
        own = [(i, 1 + i // 4 if i < fork else 1 + i // 6) for i in range(snap + 1, end + 1)]
        prev = rng.randrange(snap, 13)
        prev_term = dict(lead).get(prev, 0) if prev > snap else snap_term
        rest = [e for e in lead if prev < e[0] <= prev + rng.randrange(6)]
        node = (rng.choice([3, 4, 5]), rng.randrange(snap, end + 1), snap, snap_term)
        message = (4, prev, rng.choice([prev_term] * 3 + [9]), rng.randrange(15))
        nodes.append(("c", n, *node))
        logs += [("c", n, *e) for e in own]
        sent.append(("c", n, *message))
        entries += [("c", n, *e) for e in rest]
        want[n] = brute_append(node, own, message, rest)
    nodes.append(("c", 99, 1, 0, 0, 0))
    logs.append(("c", 99, 1, 1))
    rows_ = lambda data, names: spark.createDataFrame(data, f"cluster string, node int, {names}")
    given = rows_(nodes, "term int, commit_idx int, snapshot_idx int, snapshot_term int"), rows_(logs, "idx int, term int"), rows_(sent, "term int, prev_idx int, prev_term int, leader_commit int"), rows_(entries, "idx int, term int")
    got = {r.node: tuple(r)[2:] for r in messages.append_replies(*given).collect()}
    assert got == {n: w[:4] for n, w in want.items()} and {True, False} == {w[1] for w in want.values()}
    after = {}
    for r in messages.appended(*given).collect():
        assert after.setdefault(r.node, {}).setdefault(r.idx, r.term) == r.term
    assert after.pop(99) == {1: 1} and after == {n: w[4] for n, w in want.items() if w[4]}


def test_messages_to_nodes(spark):
    leaders = spark.createDataFrame([("c", 5, 0, 6, 3, 2)], "cluster string, term int, node int, commit_idx int, snapshot_idx int, snapshot_term int")
    entries = spark.createDataFrame([("c", i, 2 + i // 4) for i in range(4, 9)], "cluster string, idx int, term int")
    held = spark.createDataFrame([("c", n, 0, x) for n, x in enumerate([9, 4, 6, 3, 1])], "cluster string, node int, match_idx int, next_idx int")
    told = messages.append_args(leaders, entries, held)
    assert rows(told) == [("c", 0, 5, 8, 4, 9, 0, 6), ("c", 1, 5, 3, 2, 4, 5, 6), ("c", 2, 5, 5, 3, 6, 3, 6)]
    assert rows(messages.append_rows(entries, told).filter("node = 2")) == [("c", 2, 6, 3), ("c", 2, 7, 3), ("c", 2, 8, 4)]
    assert rows(messages.install_args(leaders, held)) == [("c", 3, 5, 0, 3, 2), ("c", 4, 5, 0, 3, 2)]
    new = messages.new_progress(spark.createDataFrame([("c", 8)], "cluster string, last_idx int"), held.select("cluster", "node"))
    assert {tuple(r)[2:] for r in new.collect()} == {(0, 9)}


def test_snapshots_have_guards(spark):
    nodes = spark.createDataFrame([("c", n, 5, 7, 3, 2) for n in range(4)], "cluster string, node int, term int, commit_idx int, snapshot_idx int, snapshot_term int")
    held = spark.createDataFrame([("c", n, i, i) for n in range(4) for i in range(4, 10)], "cluster string, node int, idx int, term int")
    asked = spark.createDataFrame([("c", 0, 3), ("c", 1, 8), ("c", 2, 7), ("c", 3, 1)], "cluster string, node int, at int")
    taken = messages.take_snapshots(nodes, held, asked)
    assert rows(taken) == [("c", 0, "nothing", 3, 2), ("c", 1, "refused", 3, 2), ("c", 2, "taken", 7, 7), ("c", 3, "nothing", 3, 2)]
    assert rows(messages.compacted(held, taken).filter("node = 2")) == [("c", 2, 8, 8, 1), ("c", 2, 9, 9, 2)]
    assert messages.compacted(held, taken).filter("node = 1").count() == 6


def test_strong_reads(spark):
    """A majority of all members at the leader's term, and none that shows a higher one."""
    cases = {
        "two_of_four": ([(1, 3, True), (2, 3, False)], 4, False), "three_of_four": ([(1, 3, True), (2, 3, True)], 4, True),
        "deposed": ([(1, 3, True), (2, 3, True), (3, 9, False)], 4, False), "late": ([(1, 2, True), (2, 2, True), (3, 2, True)], 4, False),
        "twice": ([(1, 3, True), (1, 3, True), (1, 3, True)], 4, False), "itself": ([(0, 3, True), (0, 3, True), (1, 3, False)], 3, False),
        "alone": ([], 1, True), "silent": ([], 3, False), "most_silent": ([(1, 3, True)], 5, False),
    }
    leaders = spark.createDataFrame([(c, 3, 0, 40) for c in cases], "cluster string, term int, node int, commit_idx int")
    acks = spark.createDataFrame([(c, 3, *a) for c, (told, _, _) in cases.items() for a in told] + [("silent", 2, 1, 2, True), ("silent", 2, 2, 2, True)], "cluster string, asked_term int, node int, term int, ok boolean")
    members = spark.createDataFrame([(c, n) for c, (_, size, _) in cases.items() for n in range(size)], "cluster string, node int")
    got = {r.cluster: (r.read_idx, r.confirmed) for r in messages.read_index(leaders, acks, members).collect()}
    assert got == {c: (40, ok) for c, (_, _, ok) in cases.items()}


def test_terms_behind_a_snapshot(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,), (9,), (None,)], "idx bigint")
    got = {r.idx: (r.pos, r.term) for r in replog.term_at(log(spark, 1, 1, 3), asked, 2, 1).collect()}
    assert got == {1: (-1, -1), 2: (0, 1), 3: (1, 3), 9: (7, -1)}


def sequential_votes(requests, voters):
    state = {n: [0, None] for n, _, _ in voters}
    given = set()
    for arrival, term, candidate, lt, li in sorted(requests):
        for n, last_term, last_index in voters:
            now = state[n]
            if term > now[0]:
                now[0], now[1] = term, None
            if term == now[0] and now[1] is None and (candidate == n or (lt, li) >= (last_term, last_index)):
                now[1] = candidate
                given.add((n, term, candidate, arrival))
    return given


@pytest.mark.parametrize("width", [1, 5, 10_000])
def test_votes_are_the_sequential_rule(spark, width):
    rng = random.Random(width)
    voters = [(n, rng.randrange(4), rng.randrange(9)) for n in range(5)]
    requests = [(a, 2 + a // 6 + rng.choice([0, 0, 0, -1, 1]), rng.randrange(5), rng.randrange(5), rng.randrange(9)) for a in range(200)]
    r = spark.createDataFrame(requests, "arrival bigint, term bigint, candidate int, last_log_term bigint, last_log_index bigint")
    v = spark.createDataFrame(voters, "node int, last_term int, last_index int")
    got = votes.granted(r, v, width)
    assert set(map(tuple, got.collect())) == {g for g in sequential_votes(requests, voters)}
    terms = [w.term for w in votes.winners(got, 5).collect()]
    assert len(terms) == len(set(terms))


def test_timeouts_repeat_by_seed(spark):
    nodes = spark.range(50).withColumnRenamed("id", "node")
    a, b, c = (rows(votes.timeouts(nodes, s)) for s in (1, 1, 2))
    assert a == b != c and all(150 <= t < 300 for _, t in a)


@pytest.mark.parametrize("low,high", [(0, 2), (1, 3), (3, 5), (0, 5)])
def test_partial_compaction_keeps_what_hides(spark, low, high):
    rng = random.Random(low * 7 + high)
    data = {(rng.randrange(6), rng.choice("abcdef")): rng.randrange(2) for _ in range(25)}
    r = spark.createDataFrame([(g, k, d, None if d else f"{k}{g}", g) for (g, k), d in data.items()], "gen int, key string, kind int, value string, seq int")
    part = runs.compact_partial(r, low, high)
    assert rows(runs.compact(part).select("key", "value")) == rows(runs.compact(r).select("key", "value"))
    assert part.count() <= r.count()


def test_history_and_reads(spark):
    df = spark.createDataFrame([(1, "a", 0, "x"), (2, "b", 0, ""), (3, "a", 1, None), (4, "a", 0, "y"), (4_000_000, "a", 0, "z")], "seq bigint, key string, kind int, value string")
    assert [r[1:3] for r in rows(fold.history(df)) if r[0] == "a"] == [(1, 3), (3, 4), (4, 4_000_000), (4_000_000, None)]
    assert rows(fold.as_of(df, 3).select("key", "value")) == [("b", "")]
    assert rows(fold.get(df, "a").select("value")) == [("z",)] and fold.get(df, "q").count() == 0
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("q",), (None,)], "key string")
    assert rows(fold.multi_get(df, asked)) == [("a", True, "z"), ("b", True, ""), ("q", False, None)]
    assert rows(fold.missing(df, asked)) == [("q",)]
    assert [r.position for r in fold.positioned(df.select("seq"), ["seq"]).orderBy("seq").collect()] == [0, 1, 2, 3, 4]
    assert fold.live(df.limit(0)).count() == 0 and fold.positioned(df.limit(0), ["seq"]).count() == 0


def test_offsets_of_large_and_small_runs(spark):
    rng = random.Random(5)
    data = [(g, f"k{i:04d}", 0, "v" * rng.randrange(20)) for g, n in ((1, 400), (2, 1), (3, 30)) for i in rng.sample(range(1000), n)]
    got = {(r.gen, r.key): r.offset for r in runs.index(spark.createDataFrame(data, "gen int, key string, kind int, value string")).collect()}
    want, at = {}, {}
    for g, k, _, v in sorted(data):
        want[g, k] = at.get(g, 0)
        at[g] = want[g, k] + 9 + len(k) + len(v)
    assert got == want


def test_levels_follow_the_rows():
    from tidelog.operators.blocked import levels_for

    assert [levels_for(n, 10) for n in (0, 1, 100, 101, 1000, 1001)] == [1, 1, 1, 2, 2, 3]
    assert [levels_for(n) for n in (1 << 20, 1 << 32, (1 << 32) + 1)] == [1, 1, 2]


@pytest.mark.parametrize("levels,width", [(1, 3), (2, 3), (3, 2), (2, 1000)])
def test_running_values_on_several_levels(spark, levels, width):
    from tidelog.operators.blocked import running

    rng = random.Random(width)
    data = [(g, o, rng.choice([None, *range(20)])) for g in "ab" for o in rng.sample(range(-30, 120), 60)]
    df = spark.createDataFrame(data, "g string, o int, v int")
    for how, of in (("min", min), ("max", max), ("sum", sum)):
        for back in (False, True):
            for own in (False, True):
                got = {(r.g, r.o): r.x for r in running(df, ["g"], "o", "v", "x", how, back, own, width, levels).collect()}
                for g, o, _ in data:
                    seen = [v for g2, o2, v in data if g2 == g and v is not None and ((o2 > o if back else o2 < o) or (own and o2 == o))]
                    assert got[g, o] == (of(seen) if seen else (0 if how == "sum" else None))


def test_a_tick(spark):
    states = [("c", 0, "leader", 900, 150), ("c", 1, "follower", 199, 200), ("c", 2, "candidate", 200, 200), ("c", 3, "follower", 0, 299)]
    got = {r.node: r.action for r in votes.due(spark.createDataFrame(states, "cluster string, node int, role string, silent_ms bigint, timeout_ms int")).collect()}
    assert got == {0: "replicate", 1: "wait", 2: "election", 3: "wait"}
    assert [r.node for r in votes.other_nodes(spark.createDataFrame([(0,), (1,), (2,)], "node int"), 1).orderBy("node").collect()] == [0, 2]


def test_saved_state(spark, tmp_path):
    path = f"file://{tmp_path}/n"
    nodes = lambda term: spark.createDataFrame([("c", 0, term, 1, 3, 2), ("c", 1, term, 1, 0, 0)], "cluster string, node int, term int, commit_idx int, snapshot_idx int, snapshot_term int")
    logs = spark.createDataFrame([("c", 1, 1, 1), ("c", 1, 2, 4)], "cluster string, node int, idx int, term int")
    assert messages.load(spark, path) is None
    for term in (5, 6):
        messages.save(nodes(term), logs, path)
    got = messages.load(spark, path)
    assert rows(messages.state(*got)) == [("c", 0, 6, 3, 2, 1, 3), ("c", 1, 6, 2, 4, 1, 0)]
    # A version that was not completed does not count.
    logs.limit(0).write.parquet(f"{path}/000000000003/logs")
    assert rows(messages.load(spark, path)[0]) == rows(nodes(6))
    messages.save(nodes(7), logs.limit(1), f"file://{tmp_path}/other")
    assert messages.load(spark, f"file://{tmp_path}/other")[1].count() == 1


@pytest.mark.parametrize("n", [0, 1, 300])
def test_proposals_are_numbered_in_order(spark, n):
    rng = random.Random(n)
    seqs = rng.sample(range(200_000), n)
    commands = [(rng.choice("aab"), q, q % 3, q) for q in seqs]
    leaders = spark.createDataFrame([("a", 4, 10), ("b", 2, 0), ("c", 1, 5)], "cluster string, term int, last_idx int")
    got = rows(replog.propose(leaders, spark.createDataFrame(commands, "cluster string, seq bigint, origin int, cmd_id bigint")))
    want = []
    for c, term, last in (("a", 4, 10), ("b", 2, 0)):
        want += [(c, last + i + 1, term, q % 3, q) for i, q in enumerate(sorted(q for k, q, _, _ in commands if k == c))]
    assert got == sorted(want, key=repr)


def test_what_is_sent_next(spark):
    leaders = spark.createDataFrame([("c", 3)], "cluster string, snapshot_idx int")
    end = spark.createDataFrame([("c", 8)], "cluster string, last_idx int")
    held = spark.createDataFrame([("c", n, 0, x) for n, x in enumerate([9, 8, 4, 3, 1, 11])], "cluster string, node int, match_idx int, next_idx int")
    got = [tuple(r)[2:] for r in messages.send_plan(leaders, end, held).orderBy("node").collect()]
    assert got == [(9, "heartbeat", 0), (8, "append", 1), (4, "append", 5), (3, "snapshot", 0), (1, "snapshot", 0), (11, "heartbeat", 0)]


def test_restart_and_installing_snapshots(spark):
    cols = "node int, term int, voted_for int, role string, leader int, commit_idx int, applied_idx int, snapshot_idx int"
    held = spark.createDataFrame([(n, 5, 1, "leader", 1, 9, 8, 6) for n in range(4)], cols)
    assert rows(replog.restart(held.filter("node = 0"))) == [(0, 5, 1, "follower", None, 6, 6, 6)]
    sent = spark.createDataFrame([(0, 4, 20), (1, 5, 6), (2, 7, 3), (3, 6, 20)], "node int, term int, snapshot_idx int")
    got = rows(replog.install_snapshot(held, sent))
    assert got == [(0, 5, 9, 8, 6, False), (1, 5, 9, 8, 6, True), (2, 7, 9, 8, 6, True), (3, 6, 20, 20, 20, True)]
