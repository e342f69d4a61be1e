"""Queries on the replicated log: commit, matching, catch-up, elections, reads and peer lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import fold, peers, replog, votes
from tidelog.operators.replay import committed
from tidelog.operators.runs import same_state
from tidelog.plans import fixtures as X
from tidelog.session import table

PEER_LISTS = (
    "11=store-a.example:7400,14=store-b.example:7401,12=store-c.example:7400", " 6 = left:70 , ,8=right:71", "", " , , ", "store-a.example:7400", "north=left:70",
    "5=", "4=left:70,9=right:71,4=right:72", "3=left:70,5", "-8=left:70", "+2=a=b:70",
)


def raft_majority(spark: SparkSession, d: str) -> DataFrame:
    votes_ = spark.range(0, 8).select(F.explode(F.sequence(F.lit(0), F.col("id"))).alias("votes"), F.col("id").alias("size"))
    return votes_.select("votes", "size", replog.is_majority(F.col("votes"), F.col("size")).alias("majority"))


def raft_log_match(spark: SparkSession, d: str) -> DataFrame:
    return replog.match(X.log_entries(spark, d), X.replicas(spark, d))


def raft_truncate(spark: SparkSession, d: str) -> DataFrame:
    return replog.truncated(X.log_entries(spark, d), X.replicas(spark, d))


def raft_backoff(spark: SparkSession, d: str) -> DataFrame:
    return replog.rejections(X.log_entries(spark, d), X.replicas(spark, d))


def _half(spark: SparkSession, d: str) -> int:
    return table(spark, d, "events").count() // 2


def raft_term_at(spark: SparkSession, d: str) -> DataFrame:
    half = _half(spark, d)
    asked = spark.range(-1, 2 * half + 3).select(F.col("id").alias("idx"))
    return replog.term_at(X.log_entries(spark, d), asked, half, 5)


def raft_follower_commit(spark: SparkSession, d: str) -> DataFrame:
    return replog.follower_commit(_half(spark, d), X.replicas(spark, d))


def raft_roles(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0, 4).select(F.col("id").alias("role"), votes.role_name(F.col("id").cast("int")).alias("name"))


def raft_converged(spark: SparkSession, d: str) -> DataFrame:
    """(node, n_differs): keys whose live value at a replica, which has applied a part of the log, is not the leader's."""
    log = X.mutation_log(spark, d)
    n = table(spark, d, "events").count()
    ends = F.array(*[F.struct(F.lit(r).alias("node"), F.lit(n * b // 100).alias("applied")) for r, _, b in X.REPLICAS])
    each = log.select("*", F.explode(ends).alias("r"))
    held = fold.newest_per_key(each.filter(F.col("seq") <= F.col("r.applied")).withColumn("node", F.col("r.node")), ["node", "key"])
    newest = fold.newest_per_key(log).select("key", F.col("seq").alias("_last"), F.col("kind").alias("_k"), F.col("value").alias("_v"))
    nodes = newest.select("*", F.explode(F.array(*[F.lit(r) for r, _, _ in X.REPLICAS])).alias("node"))
    both = nodes.join(held.select("node", "key", "kind", "value"), ["node", "key"], "left")
    there = F.when(F.col("kind") == 0, F.col("value"))
    leads = F.when(F.col("_k") == 0, F.col("_v"))
    return both.groupBy("node").agg(F.count_if(~there.eqNullSafe(leads)).alias("n_differs"))


def vote_eligible(spark: SparkSession, d: str) -> DataFrame:
    return votes.eligible(X.vote_requests(spark, d), X.voters(spark))


def vote_grant(spark: SparkSession, d: str) -> DataFrame:
    return votes.granted(X.vote_requests(spark, d), X.voters(spark))


def vote_winner(spark: SparkSession, d: str) -> DataFrame:
    return votes.winners(vote_grant(spark, d), len(X.VOTERS))


def vote_leader_progress(spark: SparkSession, d: str) -> DataFrame:
    return votes.new_leader_progress(vote_winner(spark, d), X.voters(spark), 1000)


def cmd_match(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "replicated_log").filter(F.col("key").isNotNull())
    return replog.command_match(log, committed(table(spark, d, "replicated_log")).filter(F.col("key").isNotNull()))


def cmd_equiv(spark: SparkSession, d: str) -> DataFrame:
    """Replays of the log as it is and with every row doubled and shuffled: the same state."""
    from tidelog.operators.replay import replay

    log = table(spark, d, "replicated_log")
    return same_state(replay(log), replay(log.unionByName(log).repartition(7)))


def _lists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PEER_LISTS)), "list_id int, peers string")


def peers_parse(spark: SparkSession, d: str) -> DataFrame:
    return peers.parse(_lists(spark))


def peers_entries(spark: SparkSession, d: str) -> DataFrame:
    return peers.entries(_lists(spark))


QUERIES = {
    f.__name__: f
    for f in (
        raft_majority, raft_log_match, raft_truncate, raft_backoff,
        raft_term_at, raft_follower_commit, raft_roles, raft_converged, vote_eligible, vote_grant, vote_winner,
        vote_leader_progress, cmd_match, cmd_equiv, peers_parse, peers_entries,
    )
}

_N = "(SELECT count(*) FROM events)"
_PEERS = f"""lists AS (SELECT CAST(list_id AS INTEGER) AS list_id, peers FROM (VALUES {X._values(enumerate(PEER_LISTS))}) v(list_id, peers)),
parts AS (SELECT list_id, unnest(string_split(peers, ',')) AS e, generate_subscripts(string_split(peers, ','), 1) AS n FROM lists),
cut AS (SELECT list_id, n, trim(e) AS e, instr(trim(e), '=') AS eq, CASE WHEN instr(trim(e), '=') > 0 THEN trim(substr(trim(e), 1, instr(trim(e), '=') - 1)) END AS id_text,
    trim(substr(trim(e), instr(trim(e), '=') + 1)) AS address FROM parts WHERE trim(e) <> ''),
typed AS (SELECT *, CASE WHEN regexp_full_match(id_text, '[+-]?[0-9]+') THEN try_cast(id_text AS INTEGER) END AS id FROM cut),
entries_ AS (SELECT list_id, id, address, CASE WHEN eq = 0 THEN 'no_equals' WHEN id IS NULL THEN 'bad_id' WHEN address = '' THEN 'no_address'
    WHEN row_number() OVER (PARTITION BY list_id, id ORDER BY n) > 1 THEN 'repeated_id' END AS problem FROM typed)"""

SQL = {
    "raft_majority": "SELECT v AS votes, s AS size, 2 * v > s AS majority FROM (SELECT unnest(range(0, 8)) AS s) a, (SELECT unnest(range(0, 8)) AS v) b WHERE v <= s",
    "raft_log_match": f"WITH {X.REPLICAS_SQL} SELECT * FROM matched",
    "raft_truncate": f"""WITH {X.REPLICAS_SQL},
        kept AS (SELECT r.node, idx, term FROM replicas r JOIN matched m ON r.node = m.node WHERE conflict_idx IS NULL OR idx < conflict_idx)
        SELECT node, idx, term FROM kept UNION ALL
        SELECT m.node, e.idx, e.term FROM entries e, matched m WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.node = m.node AND k.idx = e.idx)""",
    "raft_backoff": f"WITH {X.REPLICAS_SQL} SELECT node, {_N} - match_idx AS rejections FROM matched",
    "raft_term_at": f"""WITH {X.ENTRIES_SQL}, h AS (SELECT {_N} // 2 AS half), a AS (SELECT unnest(range(-1, 2 * half + 3)) AS idx FROM h)
        SELECT a.idx, a.idx - half AS pos, CAST(CASE WHEN a.idx = half THEN 5 WHEN a.idx < half THEN -1 ELSE coalesce(term, -1) END AS BIGINT) AS term FROM a CROSS JOIN h LEFT JOIN entries e ON a.idx = e.idx""",
    "raft_follower_commit": f"WITH {X.REPLICAS_SQL} SELECT node, least(last_idx, {_N} // 2) AS commit_idx FROM ends",
    "raft_roles": "SELECT CAST(role AS BIGINT) AS role, name FROM (VALUES (0, 'follower'), (1, 'candidate'), (2, 'leader'), (3, 'unknown')) v(role, name)",
    "raft_converged": f"""WITH {X.LOG_SQL}, v AS (SELECT CAST(node AS INTEGER) AS node, {_N} * b // 100 AS applied FROM (VALUES {X._values(X.REPLICAS)}) v(node, a, b)),
        h AS (SELECT node, key, kind, value, row_number() OVER (PARTITION BY node, key ORDER BY seq DESC) AS r FROM log, v WHERE seq <= applied)
        SELECT v.node, count(*) FILTER (CASE WHEN h.kind = 0 THEN h.value END IS DISTINCT FROM CASE WHEN t.kind = 0 THEN t.value END) AS n_differs
        FROM v JOIN top t ON t.rn = 1 LEFT JOIN h ON h.node = v.node AND h.key = t.key AND h.r = 1 GROUP BY v.node""",
    "vote_eligible": f"WITH {X.VOTES_SQL} SELECT arrival, node, term, candidate, eligible FROM asked",
    "vote_grant": f"WITH {X.VOTES_SQL} SELECT node, term, candidate, arrival FROM granted",
    "vote_winner": f"WITH {X.VOTES_SQL} SELECT term, candidate, count(*) AS votes FROM granted GROUP BY term, candidate HAVING 2 * count(*) > 5",
    "vote_leader_progress": f"""WITH {X.VOTES_SQL}, w AS (SELECT term, candidate FROM granted GROUP BY term, candidate HAVING 2 * count(*) > 5)
        SELECT term, candidate AS leader, CAST(node AS INTEGER) AS node, CAST(1001 AS BIGINT) AS next_idx, CAST(CASE WHEN candidate = node THEN 1000 ELSE 0 END AS BIGINT) AS match_idx
        FROM w, (VALUES {X._values(X.VOTERS)}) v(node, a, b)""",
    "cmd_match": """
        WITH e AS (SELECT *, max(term) OVER (PARTITION BY cluster_id ORDER BY idx RANGE UNBOUNDED PRECEDING) AS top FROM replicated_log),
        p AS (SELECT DISTINCT cluster_id, idx, term, origin, cmd_id FROM e WHERE key IS NOT NULL),
        w AS (SELECT DISTINCT cluster_id, idx, origin, cmd_id FROM e WHERE term = top AND key IS NOT NULL)
        SELECT p.*, coalesce(p.origin = w.origin AND p.cmd_id = w.cmd_id, false) AS applied FROM p LEFT JOIN w ON p.cluster_id = w.cluster_id AND p.idx = w.idx""",
    "cmd_equiv": "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra",
    "peers_parse": f"""WITH {_PEERS}, g AS (SELECT list_id, count(*) AS n, count(problem) AS bad FROM entries_ GROUP BY list_id)
        SELECT l.list_id, coalesce(bad = 0, false) AS valid, CASE WHEN bad = 0 THEN n ELSE 0 END AS n_peers FROM lists l LEFT JOIN g ON l.list_id = g.list_id""",
    "peers_entries": f"WITH {_PEERS} SELECT list_id, id, address, problem FROM entries_",
}
