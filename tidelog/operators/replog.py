"""Rules of a replicated log, evaluated over recorded state and messages.

Logs are rows (node, idx, term), with a column cluster where there are several; progress is rows (cluster, node,
match_idx, next_idx). Nothing here runs a consensus: the rules are relations, each evaluated for all nodes of all
clusters at once. What nodes answer to a message, and what a leader makes of it, is in messages.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.blocked import running


def is_majority(votes: Column, size: Column) -> Column:
    return votes * 2 > size


def quorum(progress: DataFrame) -> DataFrame:
    """(cluster, quorum_idx): the highest index that a majority of the cluster's nodes holds.

    A cluster's nodes are a handful, whatever the length of its log.
    """
    by_cluster = Window.partitionBy("cluster")
    rank = F.row_number().over(by_cluster.orderBy(F.desc("match_idx"), "node"))
    size = F.count(F.lit(1)).over(by_cluster)
    ranked = progress.select("cluster", "match_idx", rank.alias("_rank"), size.alias("_size"))
    chosen = ranked.filter(F.col("_rank") == F.floor(F.col("_size") / 2) + 1)
    return chosen.select("cluster", F.col("match_idx").alias("quorum_idx"))


def commit_index(log: DataFrame, progress: DataFrame) -> DataFrame:
    """(cluster, term, commit_idx): how far a leader of each term may commit by counting, its own term only.

    `log`: (cluster, idx, term), the entries of each cluster's leader.
    """
    q = quorum(progress)
    held = log.select("cluster", "idx", "term").join(F.broadcast(q), "cluster").filter(F.col("idx") <= F.col("quorum_idx"))
    return held.groupBy("cluster", "term").agg(F.max("idx").alias("commit_idx"))


def _shared(log: DataFrame) -> list[str]:
    return ["cluster"] if "cluster" in log.columns else []


def match(leader: DataFrame, replicas: DataFrame) -> DataFrame:
    """([cluster,] node, match_idx, conflict_idx, last_idx): up to where a replica agrees with the leader, the first
    index at which terms differ (null if none), and the replica's last index."""
    on = _shared(leader)
    joined = replicas.join(leader.select(*on, "idx", F.col("term").alias("_term")), [*on, "idx"], "left")
    differs = F.when(F.col("_term").isNotNull() & (F.col("term") != F.col("_term")), F.col("idx"))
    shared = F.when(F.col("term") == F.col("_term"), F.col("idx"))
    per = joined.groupBy(*on, "node").agg(
        F.min(differs).alias("conflict_idx"), F.max(shared).alias("_shared"), F.max("idx").alias("last_idx")
    )
    end = F.least(F.coalesce("_shared", F.lit(0)), F.coalesce(F.col("conflict_idx") - 1, F.col("_shared"), F.lit(0)))
    return per.select(*on, "node", end.cast("bigint").alias("match_idx"), "conflict_idx", "last_idx")


def truncated(leader: DataFrame, replicas: DataFrame) -> DataFrame:
    """([cluster,] node, idx, term): each replica's log after it took the leader's entries: what precedes the first
    conflict is kept, also beyond the leader's end if there is no conflict, the rest is the leader's."""
    on = _shared(leader)
    # What a replica keeps is told by one number, its last kept index; a handful of rows a cluster.
    kept_to = F.coalesce(F.col("conflict_idx") - 1, "last_idx").alias("_kept")
    ends = F.broadcast(match(leader, replicas).select(*on, "node", kept_to))
    kept = replicas.join(ends, [*on, "node"]).filter(F.col("idx") <= F.col("_kept"))
    rows = leader.select(*on, "idx", "term")
    # Every row of this join is a row of the result.
    sent = rows.join(ends, on).filter(F.col("idx") > F.col("_kept")) if on else rows.join(ends, F.col("idx") > F.col("_kept"))
    return kept.select(*on, "node", "idx", "term").unionByName(sent.select(*on, "node", "idx", "term"))


def rejections(leader: DataFrame, replicas: DataFrame) -> DataFrame:
    """(node, rejections): how often a leader is rejected that starts behind its last entry and walks back by one
    until the entry before matches; index 0 always does."""
    last = leader.agg(F.max("idx").alias("_last"))
    return match(leader, replicas).join(F.broadcast(last)).select("node", (F.col("_last") - F.col("match_idx")).alias("rejections"))


def propose(leaders: DataFrame, commands: DataFrame) -> DataFrame:
    """(cluster, idx, term, origin, cmd_id): the entries that leaders (cluster, term, last_idx) append for commands
    (cluster, seq, origin, cmd_id), in order of seq behind their last entry.

    Commands are numbered in blocks of seq, so the batch of one leader may be of any size.
    """
    numbered = running(commands.withColumn("_one", F.lit(1)), ["cluster"], "seq", "_one", "_at", "sum", own=True, levels=2)
    lead = F.broadcast(leaders.select("cluster", F.col("term").cast("bigint").alias("term"), "last_idx"))
    return numbered.join(lead, "cluster").select("cluster", (F.col("last_idx") + F.col("_at")).alias("idx"), "term", "origin", "cmd_id")


def lag(progress: DataFrame) -> DataFrame:
    """(cluster, node, lag): entries that are committed and that a plain read at the node may miss."""
    q = quorum(progress)
    return progress.join(F.broadcast(q), "cluster").select(
        "cluster", "node", F.greatest(F.col("quorum_idx") - F.col("match_idx"), F.lit(0)).alias("lag")
    )


def command_match(log: DataFrame, committed: DataFrame) -> DataFrame:
    """(cluster_id, idx, term, origin, cmd_id, applied): for each proposed entry, whether its own command is what was
    committed at its index."""
    proposed = log.select("cluster_id", "idx", "term", "origin", "cmd_id").distinct()
    won = committed.select("cluster_id", "idx", F.col("origin").alias("_o"), F.col("cmd_id").alias("_c")).distinct()
    mine = (F.col("origin") == F.col("_o")) & (F.col("cmd_id") == F.col("_c"))
    return proposed.join(won, ["cluster_id", "idx"], "left").select(
        *proposed.columns, F.coalesce(mine, F.lit(False)).alias("applied")
    )


def term_at(log: DataFrame, asked: DataFrame, snapshot_idx: int = 0, snapshot_term: int = 0) -> DataFrame:
    """(idx, pos, term) for each distinct idx asked: the position behind the snapshot and the term there, the
    snapshot's own at its boundary, -1 where the log does not hold the index."""
    held = log.filter(F.col("idx") > snapshot_idx).select("idx", F.col("term").alias("_term"))
    joined = asked.select("idx").filter("idx IS NOT NULL").distinct().join(held, "idx", "left")
    term = F.when(F.col("idx") == snapshot_idx, F.lit(snapshot_term).cast("bigint")).otherwise(F.coalesce("_term", F.lit(-1).cast("bigint")))
    return joined.select("idx", (F.col("idx") - snapshot_idx).alias("pos"), term.alias("term"))


def follower_commit(leader_commit: int, logs: DataFrame) -> DataFrame:
    """(node, commit_idx): what a follower takes for committed: the leader's index, as far as its own log goes."""
    return logs.groupBy("node").agg(F.least(F.max("idx"), F.lit(leader_commit)).cast("bigint").alias("commit_idx"))


def restart(state: DataFrame) -> DataFrame:
    """The state of nodes after a restart. `state`: ([cluster,] node, term, voted_for, role, leader, commit_idx, applied_idx,
    snapshot_idx); term, vote and snapshot are durable, the rest begins anew, commit and applied at the snapshot."""
    return state.select(
        *_shared(state), "node", "term", "voted_for", F.lit("follower").alias("role"), F.lit(None).cast("int").alias("leader"),
        F.col("snapshot_idx").alias("commit_idx"), F.col("snapshot_idx").alias("applied_idx"), "snapshot_idx",
    )


def install_snapshot(state: DataFrame, messages: DataFrame) -> DataFrame:
    """([cluster,] node, term, commit_idx, applied_idx, snapshot_idx, accepted): each node after a snapshot message
    ([cluster,] node, term, snapshot_idx). One of an older term is rejected, one that is not newer than the node's own
    snapshot changes nothing but the term; else the node's whole log gives way to the snapshot."""
    on = [*_shared(state), "node"]
    sent = messages.select(*on, F.col("term").alias("_t"), F.col("snapshot_idx").alias("_s"))
    joined = state.join(sent, on)
    current = F.col("_t") >= F.col("term")
    newer = current & (F.col("_s") > F.col("snapshot_idx"))
    take = lambda c: F.when(newer, F.col("_s")).otherwise(F.col(c)).alias(c)
    return joined.select(*on, F.greatest("term", "_t").alias("term"), take("commit_idx"), take("applied_idx"), take("snapshot_idx"), current.alias("accepted"))
