"""Queries of the message rules on the replicated log: every cluster, node and entry that the table has.

The leader's log of a cluster are its committed entries. A node's own log ends the earlier the greater its number, and
nodes of odd number still have the entries of deposed leaders where there are any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import messages as M
from tidelog.operators import replog, votes
from tidelog.operators.replay import committed
from tidelog.session import materialize, shared_path, table

#: What is sent next: twelfths of the log, to node 1 of every other cluster what follows its first conflict.
NEXT = "greatest(CASE WHEN node = 1 AND cluster % 2 = 1 AND conflict_idx IS NOT NULL THEN conflict_idx + 1 ELSE last_idx * element_at(array(11, 6, 11, 1, 7), node % 5 + 1) div 12 END, 1)"
#: Parts of a hundred of a cluster's log: what is committed, what the leader's snapshot holds, and what a node's does.
COMMITTED, SNAPSHOT, NODE_SNAPSHOT = 90, 10, 5


def _entries(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "replicated_log").select(F.col("cluster_id").alias("cluster"), "node", "idx", "term", "feed_id")
    return log.filter("cluster IS NOT NULL AND idx IS NOT NULL AND term IS NOT NULL AND node IS NOT NULL")


def _led(spark: SparkSession, d: str) -> DataFrame:
    """(cluster, idx, term, least): the leader's log, with the oldest term that any entry of the index had."""
    log = _entries(spark, d).select(F.col("cluster").alias("cluster_id"), "idx", "term")
    least = log.groupBy(F.col("cluster_id").alias("cluster"), "idx").agg(F.min("term").alias("least"))
    led = committed(log).select(F.col("cluster_id").alias("cluster"), "idx", "term").distinct()
    return materialize(led.join(least, ["cluster", "idx"]), "led")


def _ends(led: DataFrame) -> DataFrame:
    """(cluster, last_idx, leads): the end of each leader's log and its term."""
    return led.groupBy("cluster").agg(F.max("idx").alias("last_idx"), F.max("term").alias("leads"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("cluster", "node").distinct()


def _own(led: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, node, idx, term): the nodes' own logs."""
    ends = members.join(_ends(led), "cluster").withColumn("end", F.expr("last_idx * (10 - node) div 10"))
    term = F.when(F.col("node") % 2 == 1, F.col("least")).otherwise(F.col("term"))
    return led.join(F.broadcast(ends.select("cluster", "node", "end")), "cluster").filter("idx <= end").select("cluster", "node", "idx", term.alias("term"))


class _Case:
    """A cluster's leader in the term it leads, its nodes, and what it sends to each."""

    def __init__(self, spark: SparkSession, d: str):
        self.led = _led(spark, d)
        self.log = self.led.select("cluster", "idx", "term")
        self.members = _members(spark, d)
        self.ends = _ends(self.led)
        self.own = _own(self.led, self.members)
        part = lambda percent: F.expr(f"last_idx * {percent} div 100")
        at = self.log.join(F.broadcast(self.ends.select("cluster", part(SNAPSHOT).alias("snapshot_idx"))), "cluster").filter("idx = snapshot_idx")
        behind = at.select("cluster", F.col("term").alias("snapshot_term"))
        self.leaders = self.ends.join(behind, "cluster", "left").select(
            "cluster", F.col("leads").alias("term"), F.lit(0).alias("node"), part(COMMITTED).alias("commit_idx"),
            part(SNAPSHOT).alias("snapshot_idx"), F.coalesce("snapshot_term", F.lit(0)).alias("snapshot_term"),
        )
        self.progress = replog.match(self.log, self.own).drop("last_idx").join(self.ends, "cluster").select(
            "cluster", "node", "match_idx", F.expr(NEXT).alias("next_idx")
        )

    def nodes(self) -> DataFrame:
        """The nodes' state; the last of five has seen a later term than the leader's."""
        at = F.expr(f"last_idx * {NODE_SNAPSHOT} div 100")
        base = self.members.join(F.broadcast(self.ends), "cluster").select(
            "cluster", "node", (F.col("leads") - 1 + F.when(F.col("node") == 4, 2).otherwise(0)).alias("term"), (at + F.col("node")).alias("commit_idx"), at.alias("snapshot_idx")
        )
        held = self.own.join(F.broadcast(base.select("cluster", "node", "snapshot_idx")), ["cluster", "node"]).filter("idx = snapshot_idx")
        return base.join(held.select("cluster", "node", F.col("term").alias("snapshot_term")), ["cluster", "node"], "left").fillna(0, ["snapshot_term"])

    def kept(self) -> DataFrame:
        at = self.ends.select("cluster", F.expr(f"last_idx * {NODE_SNAPSHOT} div 100").alias("_at"))
        return self.own.join(F.broadcast(at), "cluster").filter("idx > _at").drop("_at")

    def sent(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        told = materialize(M.append_args(self.leaders, self.log, self.progress), "messages")
        return self.nodes(), self.kept(), told, M.append_rows(self.log, told)


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery as a reply of the node to the entry before it; some fail, a few show a later term."""
    feed = F.col("feed_id")
    later = F.when((feed % 4001 == 0) & (F.col("cluster") % 2 == 1), 100).otherwise(0)
    return _entries(spark, d).select(
        "cluster", "node", feed.alias("seq"), F.col("term").alias("sent_term"), (F.col("term") + later).alias("term"),
        (feed % 3 == 0).alias("success"), (F.col("idx") - 1).alias("prev_idx"), (feed % 5).alias("n_entries"),
    ).distinct()


def raft_commit(spark: SparkSession, d: str) -> DataFrame:
    c = _Case(spark, d)
    return replog.commit_index(c.log, replog.match(c.log, c.own).select("cluster", "node", "match_idx"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    c = _Case(spark, d)
    return replog.match(c.log, c.own).select("cluster", "node", "match_idx")


def raft_quorum(spark: SparkSession, d: str) -> DataFrame:
    return replog.quorum(_held(spark, d))


def raft_lag(spark: SparkSession, d: str) -> DataFrame:
    return replog.lag(_held(spark, d))


def raft_send_plan(spark: SparkSession, d: str) -> DataFrame:
    c = _Case(spark, d)
    return M.send_plan(c.leaders, c.ends, c.progress)


def raft_needs_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return raft_send_plan(spark, d).select("cluster", "node", "next_idx", (F.col("action") == "snapshot").alias("needs_snapshot"))


def raft_propose(spark: SparkSession, d: str) -> DataFrame:
    """Every command of the table proposed once more to its cluster's leader, in order of arrival."""
    c = _Case(spark, d)
    log = table(spark, d, "replicated_log").filter("key IS NOT NULL")
    commands = log.select(F.col("cluster_id").alias("cluster"), F.col("feed_id").alias("seq"), "origin", "cmd_id").distinct()
    return replog.propose(c.ends.select("cluster", (F.col("leads") + 1).alias("term"), "last_idx"), commands)


def _states(c: _Case) -> DataFrame:
    return c.nodes().select(
        "cluster", "node", "term", F.lit(0).alias("voted_for"), F.lit("leader").alias("role"), F.lit(0).alias("leader"), "commit_idx",
        (F.col("commit_idx") - F.col("node") % 2).alias("applied_idx"), "snapshot_idx",
    )


def raft_restart(spark: SparkSession, d: str) -> DataFrame:
    return replog.restart(_states(_Case(spark, d)))


def raft_install_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Every node is sent the leader's snapshot, node 2 one that it has had."""
    c = _Case(spark, d)
    end = F.when(F.col("node") == 2, 1).otherwise(F.col("snapshot_idx"))
    sent = c.members.join(F.broadcast(c.leaders.select("cluster", "term", "snapshot_idx")), "cluster")
    return replog.install_snapshot(_states(c), sent.select("cluster", "node", "term", end.alias("snapshot_idx")))


def raft_node_match(spark: SparkSession, d: str) -> DataFrame:
    c = _Case(spark, d)
    return replog.match(c.log, c.own)


def raft_node_truncate(spark: SparkSession, d: str) -> DataFrame:
    """(cluster, node, entries, terms): how long each log is after the leader's entries, and the sum of its terms."""
    c = _Case(spark, d)
    return replog.truncated(c.log, c.own).groupBy("cluster", "node").agg(F.count(F.lit(1)).alias("entries"), F.sum("term").alias("terms"))


def raft_reply(spark: SparkSession, d: str) -> DataFrame:
    c = _Case(spark, d)
    return M.after_replies(M.new_progress(c.ends, c.members), c.leaders, _replies(spark, d))


def raft_snapshot_reply(spark: SparkSession, d: str) -> DataFrame:
    c = _Case(spark, d)
    replies = _replies(spark, d).select("cluster", "node", "seq", "sent_term", "term", (F.col("prev_idx") + 1).alias("snapshot_idx"))
    return M.after_snapshot_replies(c.progress, c.leaders, replies)


def raft_append_args(spark: SparkSession, d: str) -> DataFrame:
    c = _Case(spark, d)
    return M.append_args(c.leaders, c.log, c.progress)


def raft_install_args(spark: SparkSession, d: str) -> DataFrame:
    c = _Case(spark, d)
    return M.install_args(c.leaders, c.progress)


def raft_append_reply(spark: SparkSession, d: str) -> DataFrame:
    return M.append_replies(*_Case(spark, d).sent())


def raft_appended(spark: SparkSession, d: str) -> DataFrame:
    return M.appended(*_Case(spark, d).sent())


def raft_read_index(spark: SparkSession, d: str) -> DataFrame:
    """Every leader there has been asks for a strong read with the last delivery of its term; nodes answer with the
    highest term they have delivered by then."""
    rows = _entries(spark, d)
    asks = rows.groupBy("cluster", F.col("term").alias("asked_term")).agg(F.max("feed_id").alias("at"), F.min("idx").alias("commit_idx"))
    seen = rows.groupBy("cluster", "node", "term").agg(F.min("feed_id").alias("since"))
    # The leaders of a cluster are few, and so are its nodes.
    heard = seen.join(F.broadcast(asks), "cluster").filter("since <= at").groupBy("cluster", "asked_term", "node").agg(F.max("term").alias("_seen"))
    acks = heard.select("cluster", "asked_term", "node", F.greatest("_seen", "asked_term").alias("term"), (F.col("_seen") <= F.col("asked_term")).alias("ok"))
    leaders = asks.select("cluster", F.col("asked_term").alias("term"), F.lit(0).alias("node"), "commit_idx")
    return M.read_index(leaders, acks, _members(spark, d))


def _asked(c: _Case) -> DataFrame:
    return c.members.join(F.broadcast(c.ends), "cluster").select("cluster", "node", F.expr(f"last_idx * {NODE_SNAPSHOT} div 100 + 2 * node - 2").alias("at"))


def raft_snapshot(spark: SparkSession, d: str) -> DataFrame:
    c = _Case(spark, d)
    return M.take_snapshots(c.nodes(), c.kept(), _asked(c))


def raft_compacted(spark: SparkSession, d: str) -> DataFrame:
    c = _Case(spark, d)
    return M.compacted(c.kept(), M.take_snapshots(c.nodes(), c.kept(), _asked(c)))


def raft_state(spark: SparkSession, d: str) -> DataFrame:
    c = _Case(spark, d)
    return M.state(c.nodes(), c.kept())


def raft_persist(spark: SparkSession, d: str) -> DataFrame:
    """The nodes' state after it was saved twice and loaded again."""
    c, path = _Case(spark, d), shared_path(spark, "nodes")
    M.save(c.nodes().limit(1), c.kept().limit(9), path)
    M.save(c.nodes(), c.kept(), path)
    return M.state(*M.load(spark, path))


def raft_due(spark: SparkSession, d: str) -> DataFrame:
    """What nodes do at the end of the feed, each having heard of the others with its last delivery; node 0 leads."""
    rows = table(spark, d, "replicated_log").select(F.col("cluster_id").alias("cluster"), "node", "received_at")
    heard = rows.groupBy("cluster", "node").agg(F.max("received_at").alias("heard"))
    now = rows.groupBy("cluster").agg(F.max("received_at").alias("now"))
    silent = F.expr("timestampdiff(MICROSECOND, heard, now) div 1000").alias("silent_ms")
    timeout = (F.lit(votes.TIMEOUT_MS[0]) + (F.col("node") * 37 + F.col("cluster") * 11) % (votes.TIMEOUT_MS[1] - votes.TIMEOUT_MS[0])).alias("timeout_ms")
    role = F.when(F.col("node") == 0, "leader").otherwise("follower").alias("role")
    return votes.due(heard.join(F.broadcast(now), "cluster").select("cluster", "node", role, silent, timeout))


QUERIES = {
    f.__name__: f
    for f in (
        raft_quorum, raft_lag, raft_send_plan, raft_needs_snapshot, raft_propose, raft_restart, raft_install_snapshot, raft_commit, raft_node_match, raft_node_truncate, raft_reply, raft_snapshot_reply, raft_append_args, raft_install_args, raft_append_reply,
        raft_appended, raft_read_index, raft_snapshot, raft_compacted, raft_state, raft_persist, raft_due,
    )
}

_LED = """rows_ AS (SELECT cluster_id AS cluster, node, idx, term, feed_id FROM replicated_log),
t AS (SELECT *, max(term) OVER (PARTITION BY cluster ORDER BY idx RANGE UNBOUNDED PRECEDING) AS top FROM rows_),
led AS (SELECT DISTINCT cluster, idx, term FROM t WHERE term = top),
least AS (SELECT cluster, idx, min(term) AS least FROM rows_ GROUP BY cluster, idx),
ends AS (SELECT cluster, max(idx) AS last, max(term) AS leads FROM led GROUP BY cluster),
members AS (SELECT DISTINCT cluster, node FROM rows_),
own AS (SELECT m.cluster, m.node, l.idx, CASE WHEN m.node % 2 = 1 THEN f.least ELSE l.term END AS term
    FROM members m JOIN ends z ON z.cluster = m.cluster JOIN led l ON l.cluster = m.cluster JOIN least f ON f.cluster = l.cluster AND f.idx = l.idx
    WHERE l.idx <= z.last * (10 - m.node) // 10),
matched AS (SELECT o.cluster, o.node, min(CASE WHEN o.term <> l.term THEN o.idx END) AS conflict_idx, max(CASE WHEN o.term = l.term THEN o.idx END) AS shared, max(o.idx) AS last_idx
    FROM own o LEFT JOIN led l ON l.cluster = o.cluster AND l.idx = o.idx GROUP BY o.cluster, o.node),
held AS (SELECT cluster, node, least(coalesce(shared, 0), coalesce(conflict_idx - 1, shared, 0)) AS match_idx, conflict_idx, last_idx FROM matched)"""
_LEADERS = f"""{_LED},
leaders AS (SELECT z.cluster, z.leads AS term, 0 AS node, z.last * {COMMITTED} // 100 AS commit_idx, z.last * {SNAPSHOT} // 100 AS snapshot_idx, coalesce(l.term, 0) AS snapshot_term
    FROM ends z LEFT JOIN led l ON l.cluster = z.cluster AND l.idx = z.last * {SNAPSHOT} // 100),
progress AS (SELECT h.cluster, h.node, h.match_idx, greatest(CASE WHEN h.node = 1 AND h.cluster % 2 = 1 AND h.conflict_idx IS NOT NULL THEN h.conflict_idx + 1 ELSE z.last * list_extract([11, 6, 11, 1, 7], h.node % 5 + 1) // 12 END, 1) AS next_idx FROM held h JOIN ends z ON z.cluster = h.cluster)"""
_NODES = f"""{_LEADERS},
nodes AS (SELECT m.cluster, m.node, z.leads - 1 + CASE WHEN m.node = 4 THEN 2 ELSE 0 END AS term, z.last * {NODE_SNAPSHOT} // 100 + m.node AS commit_idx,
    z.last * {NODE_SNAPSHOT} // 100 AS snapshot_idx, coalesce(o.term, 0) AS snapshot_term
    FROM members m JOIN ends z ON z.cluster = m.cluster LEFT JOIN own o ON o.cluster = m.cluster AND o.node = m.node AND o.idx = z.last * {NODE_SNAPSHOT} // 100),
kept AS (SELECT o.* FROM own o JOIN nodes n ON n.cluster = o.cluster AND n.node = o.node WHERE o.idx > n.snapshot_idx)"""
_ARGS = """SELECT p.cluster, p.node, d.term, p.next_idx - 1 AS prev_idx,
    CASE WHEN p.next_idx - 1 = d.snapshot_idx THEN d.snapshot_term ELSE coalesce((SELECT l.term FROM led l WHERE l.cluster = p.cluster AND l.idx = p.next_idx - 1), -1) END AS prev_term,
    p.next_idx AS first_idx, (SELECT count(*) FROM led l WHERE l.cluster = p.cluster AND l.idx >= p.next_idx) AS n_entries, d.commit_idx AS leader_commit
FROM progress p JOIN leaders d ON d.cluster = p.cluster WHERE p.next_idx > d.snapshot_idx"""
#: What each node does with its message: whether it is taken, and where its log then ends.
_JUDGED = f"""{_NODES}, args AS ({_ARGS}),
asked AS (SELECT n.*, a.term AS sent, a.prev_idx, a.prev_term, a.first_idx, a.leader_commit,
    coalesce((SELECT max(k.idx) FROM kept k WHERE k.cluster = n.cluster AND k.node = n.node), n.snapshot_idx) AS last,
    CASE WHEN a.prev_idx = n.snapshot_idx THEN n.snapshot_term ELSE coalesce((SELECT k.term FROM kept k WHERE k.cluster = n.cluster AND k.node = n.node AND k.idx = a.prev_idx), -1) END AS here,
    (SELECT min(k.idx) FROM kept k JOIN led l ON l.cluster = k.cluster AND l.idx = k.idx WHERE k.cluster = n.cluster AND k.node = n.node AND k.idx >= a.first_idx AND k.term <> l.term) AS clash,
    (SELECT max(l.idx) FROM led l WHERE l.cluster = n.cluster AND l.idx >= a.first_idx) AS to_idx
    FROM nodes n JOIN args a ON a.cluster = n.cluster AND a.node = n.node),
judged AS (SELECT *, sent >= term AND prev_idx <= last AND here = prev_term AS ok FROM asked),
cut AS (SELECT *, CASE WHEN ok AND clash IS NOT NULL THEN clash - 1 ELSE last END AS stays FROM judged)"""
_COUNTED = """replies AS (SELECT DISTINCT cluster, node, feed_id AS seq, term AS sent_term, term + CASE WHEN feed_id % 4001 = 0 AND cluster % 2 = 1 THEN 100 ELSE 0 END AS term,
    feed_id % 3 = 0 AS success, idx - 1 AS prev_idx, feed_id % 5 AS n_entries FROM rows_),
counted AS (SELECT r.* FROM replies r JOIN ends z ON z.cluster = r.cluster
    WHERE r.sent_term = z.leads AND NOT EXISTS (SELECT 1 FROM replies h WHERE h.cluster = r.cluster AND h.term > z.leads AND h.seq <= r.seq))"""
_TAKEN = f"""{_NODES},
judged AS (SELECT n.*, n.snapshot_idx + 2 * n.node - 2 AS upto FROM nodes n),
taken AS (SELECT j.*, CASE WHEN upto <= snapshot_idx THEN 'nothing' WHEN upto > commit_idx THEN 'refused' ELSE 'taken' END AS outcome FROM judged j),
snaps AS (SELECT t.cluster, t.node, outcome, CASE WHEN outcome = 'taken' THEN upto ELSE snapshot_idx END AS snapshot_idx, CASE WHEN outcome = 'taken' THEN k.term ELSE snapshot_term END AS snapshot_term
    FROM taken t LEFT JOIN kept k ON k.cluster = t.cluster AND k.node = t.node AND k.idx = t.upto)"""

_STATE = f"""WITH {_NODES}, l AS (SELECT cluster, node, max(idx) AS last_idx, arg_max(term, idx) AS last_term FROM kept GROUP BY cluster, node)
        SELECT n.cluster, n.node, n.term, coalesce(l.last_idx, n.snapshot_idx) AS last_idx, coalesce(l.last_term, n.snapshot_term) AS last_term, n.commit_idx, n.snapshot_idx
        FROM nodes n LEFT JOIN l ON l.cluster = n.cluster AND l.node = n.node"""

_QUORUM = f"""{_LED}, ranked AS (SELECT cluster, match_idx, row_number() OVER (PARTITION BY cluster ORDER BY match_idx DESC) AS rk, count(*) OVER (PARTITION BY cluster) AS n FROM held),
quorum AS (SELECT cluster, match_idx AS quorum_idx FROM ranked WHERE rk = n // 2 + 1)"""
_PLAN = f"""WITH {_LEADERS}, plan AS (SELECT p.cluster, p.node, p.next_idx, p.next_idx <= d.snapshot_idx AS snap, z.last FROM progress p JOIN leaders d ON d.cluster = p.cluster JOIN ends z ON z.cluster = p.cluster)"""
_STATES = f"""WITH {_NODES}, states AS (SELECT cluster, node, term, 0 AS voted_for, commit_idx, commit_idx - node % 2 AS applied_idx, snapshot_idx FROM nodes)"""

SQL = {
    "raft_quorum": f"WITH {_QUORUM} SELECT cluster, quorum_idx FROM quorum",
    "raft_lag": f"WITH {_QUORUM} SELECT h.cluster, h.node, greatest(quorum_idx - h.match_idx, 0) AS lag FROM held h JOIN quorum q ON q.cluster = h.cluster",
    "raft_send_plan": f"""{_PLAN} SELECT cluster, node, next_idx, CASE WHEN snap THEN 'snapshot' WHEN next_idx <= last THEN 'append' ELSE 'heartbeat' END AS action,
        CAST(CASE WHEN snap OR next_idx > last THEN 0 ELSE last - next_idx + 1 END AS BIGINT) AS n_entries FROM plan""",
    "raft_needs_snapshot": f"{_PLAN} SELECT cluster, node, next_idx, snap AS needs_snapshot FROM plan",
    "raft_propose": f"""WITH {_LED}, c AS (SELECT DISTINCT cluster_id AS cluster, feed_id, origin, cmd_id FROM replicated_log WHERE key IS NOT NULL)
        SELECT c.cluster, z.last + row_number() OVER (PARTITION BY c.cluster ORDER BY feed_id) AS idx, z.leads + 1 AS term, origin, cmd_id FROM c JOIN ends z ON z.cluster = c.cluster""",
    "raft_restart": f"{_STATES} SELECT cluster, node, term, voted_for, 'follower' AS role, CAST(NULL AS INTEGER) AS leader, snapshot_idx AS commit_idx, snapshot_idx AS applied_idx, snapshot_idx FROM states",
    "raft_install_snapshot": f"""{_STATES}, m AS (SELECT s.*, d.term AS sent, CASE WHEN s.node = 2 THEN 1 ELSE d.snapshot_idx END AS upto FROM states s JOIN leaders d ON d.cluster = s.cluster),
        j AS (SELECT *, sent >= term AS current, sent >= term AND upto > snapshot_idx AS newer FROM m)
        SELECT cluster, node, greatest(term, sent) AS term, CASE WHEN newer THEN upto ELSE commit_idx END AS commit_idx, CASE WHEN newer THEN upto ELSE applied_idx END AS applied_idx,
            CASE WHEN newer THEN upto ELSE snapshot_idx END AS snapshot_idx, current AS accepted FROM j""",
    "raft_state": _STATE,
    "raft_persist": _STATE,
    "raft_due": """WITH h AS (SELECT cluster_id AS cluster, node, max(received_at) AS heard FROM replicated_log GROUP BY 1, 2),
        n AS (SELECT *, max(heard) OVER (PARTITION BY cluster) AS now FROM h)
        SELECT cluster, node, CASE WHEN node = 0 THEN 'replicate' WHEN date_diff('microsecond', heard, now) // 1000 >= 150 + (node * 37 + cluster * 11) % 150 THEN 'election' ELSE 'wait' END AS action FROM n""",
    "raft_commit": f"""WITH {_LED}, r AS (SELECT cluster, match_idx, row_number() OVER (PARTITION BY cluster ORDER BY match_idx DESC) AS rk, count(*) OVER (PARTITION BY cluster) AS n FROM held)
        SELECT l.cluster, l.term, max(l.idx) AS commit_idx FROM led l JOIN r ON r.cluster = l.cluster AND r.rk = r.n // 2 + 1 WHERE l.idx <= r.match_idx GROUP BY l.cluster, l.term""",
    "raft_node_match": f"WITH {_LED} SELECT * FROM held",
    "raft_node_truncate": f"""WITH {_LED}, x AS (SELECT cluster, node, coalesce(conflict_idx - 1, last_idx) AS stays FROM held),
        u AS (SELECT o.cluster, o.node, o.term FROM own o JOIN x ON x.cluster = o.cluster AND x.node = o.node WHERE o.idx <= stays
            UNION ALL SELECT x.cluster, x.node, l.term FROM x JOIN led l ON l.cluster = x.cluster AND l.idx > x.stays)
        SELECT cluster, node, count(*) AS entries, CAST(sum(term) AS BIGINT) AS terms FROM u GROUP BY cluster, node""",
    "raft_reply": f"""WITH {_LED}, {_COUNTED},
        hit AS (SELECT cluster, node, max(seq) AS seq, arg_max(prev_idx + n_entries, seq) AS upto FROM counted WHERE success GROUP BY cluster, node),
        lost AS (SELECT c.cluster, c.node, count(*) AS n FROM counted c LEFT JOIN hit h ON h.cluster = c.cluster AND h.node = c.node WHERE NOT success AND (h.seq IS NULL OR c.seq > h.seq) GROUP BY c.cluster, c.node)
        SELECT m.cluster, m.node, coalesce(h.upto, 0) AS match_idx, CASE WHEN coalesce(h.upto, z.last) + 1 <= 1 THEN coalesce(h.upto, z.last) + 1 ELSE greatest(coalesce(h.upto, z.last) + 1 - coalesce(n, 0), 1) END AS next_idx
        FROM members m JOIN ends z ON z.cluster = m.cluster LEFT JOIN hit h ON h.cluster = m.cluster AND h.node = m.node LEFT JOIN lost x ON x.cluster = m.cluster AND x.node = m.node""",
    "raft_snapshot_reply": f"""WITH {_LEADERS}, {_COUNTED}, s AS (SELECT cluster, node, max(prev_idx + 1) AS most, arg_max(prev_idx + 1, seq) AS newest FROM counted GROUP BY cluster, node)
        SELECT p.cluster, p.node, greatest(p.match_idx, coalesce(most, p.match_idx)) AS match_idx, coalesce(newest + 1, p.next_idx) AS next_idx FROM progress p LEFT JOIN s ON s.cluster = p.cluster AND s.node = p.node""",
    "raft_append_args": f"WITH {_LEADERS} {_ARGS}",
    "raft_install_args": f"WITH {_LEADERS} SELECT p.cluster, p.node, d.term, d.node AS leader, d.snapshot_idx, d.snapshot_term FROM progress p JOIN leaders d ON d.cluster = p.cluster WHERE p.next_idx <= d.snapshot_idx",
    "raft_append_reply": f"""WITH {_JUDGED}, n AS (SELECT *, CASE WHEN ok THEN greatest(stays, coalesce(to_idx, 0)) ELSE last END AS ends_at FROM cut)
        SELECT cluster, node, greatest(term, sent) AS term, ok AS success, ends_at AS last_idx, CASE WHEN ok THEN greatest(commit_idx, least(leader_commit, ends_at)) ELSE commit_idx END AS commit_idx FROM n""",
    "raft_appended": f"""WITH {_JUDGED}
        SELECT k.cluster, k.node, k.idx, k.term FROM kept k LEFT JOIN cut c ON c.cluster = k.cluster AND c.node = k.node WHERE c.stays IS NULL OR k.idx <= c.stays
        UNION ALL SELECT c.cluster, c.node, l.idx, l.term FROM cut c JOIN led l ON l.cluster = c.cluster AND l.idx >= c.first_idx AND l.idx > c.stays WHERE c.ok""",
    "raft_read_index": f"""WITH {_LED}, asks AS (SELECT cluster, term AS asked, max(feed_id) AS upto, min(idx) AS commit_idx FROM rows_ GROUP BY cluster, term),
        seen AS (SELECT a.cluster, a.asked, r.node, max(r.term) AS saw FROM asks a JOIN rows_ r ON r.cluster = a.cluster AND r.feed_id <= a.upto GROUP BY a.cluster, a.asked, r.node),
        votes AS (SELECT cluster, asked, count(*) FILTER (saw <= asked AND node <> 0) AS ok, max(saw) AS top FROM seen GROUP BY cluster, asked),
        size AS (SELECT cluster, count(*) AS n FROM members GROUP BY cluster)
        SELECT a.cluster, a.asked AS term, a.commit_idx AS read_idx, coalesce(top <= a.asked, true) AND 2 * (coalesce(ok, 0) + 1) > n AS confirmed
        FROM asks a LEFT JOIN votes v ON v.cluster = a.cluster AND v.asked = a.asked JOIN size s ON s.cluster = a.cluster""",
    "raft_snapshot": f"WITH {_TAKEN} SELECT * FROM snaps",
    "raft_compacted": f"WITH {_TAKEN} SELECT k.cluster, k.node, k.idx, k.term, k.idx - s.snapshot_idx AS pos FROM kept k JOIN snaps s ON s.cluster = k.cluster AND s.node = k.node WHERE k.idx > s.snapshot_idx",
}
