"""Elections over recorded vote requests.

Requests are rows (arrival, term, candidate, last_log_term, last_log_index), voters rows (node, last_term,
last_index). A candidate's vote for itself is a request like any other, always up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.blocked import levels_for, running

ROLES = ("follower", "candidate", "leader")


def eligible(requests: DataFrame, voters: DataFrame) -> DataFrame:
    """Every request at every voter with `eligible`: the candidate's log is at least as up to date, by last term and
    then last index. The voters of a cluster are a handful."""
    at = requests.join(F.broadcast(voters))
    theirs = F.struct(F.col("last_log_term").cast("bigint"), F.col("last_log_index").cast("bigint"))
    own = F.struct(F.col("last_term").cast("bigint"), F.col("last_index").cast("bigint"))
    ok = (F.col("candidate") == F.col("node")) | (theirs >= own)
    return at.select("arrival", "node", "term", "candidate", ok.alias("eligible"))


def granted(requests: DataFrame, voters: DataFrame, width: int = 65536) -> DataFrame:
    """(node, term, candidate, arrival): the votes given. A voter denies terms below the highest it has seen, and
    gives one vote a term, to the first that is eligible. A repeated request of the candidate that has the vote would be
    granted again, which changes nothing; it gives no further row here.

    The highest term seen is a running maximum in order of arrival. It is computed in blocks of arrivals, as the
    voters are few and the requests are not.
    """
    levels = levels_for(requests.count(), width)
    seen = running(eligible(requests, voters), ["node"], "arrival", "term", "_top", "max", own=True, width=width, levels=levels)
    fresh = seen.filter(F.col("eligible") & (F.col("term") >= F.col("_top")))
    first = Window.partitionBy("node", "term").orderBy("arrival")
    return fresh.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("node", "term", "candidate", "arrival")


def winners(votes: DataFrame, size: int) -> DataFrame:
    """(term, candidate, votes): who got a majority; never two in a term."""
    counted = votes.groupBy("term", "candidate").agg(F.count(F.lit(1)).alias("votes"))
    return counted.filter(F.col("votes") * 2 > size)


def new_leader_progress(winners_: DataFrame, nodes: DataFrame, last_idx: int) -> DataFrame:
    """(term, leader, node, next_idx, match_idx): what a new leader assumes of its peers: all behind its last entry."""
    at = winners_.select("term", F.col("candidate").alias("leader")).join(F.broadcast(nodes.select("node")))
    own = F.when(F.col("leader") == F.col("node"), F.lit(last_idx)).otherwise(F.lit(0))
    return at.select("term", "leader", "node", F.lit(last_idx + 1).cast("bigint").alias("next_idx"), own.cast("bigint").alias("match_idx"))


#: The bounds of an election timeout in milliseconds; the upper one is not reached.
TIMEOUT_MS = (150, 300)


def timeouts(nodes: DataFrame, seed: int) -> DataFrame:
    """(node, timeout_ms): a timeout for each node, the same for the same seed."""
    low, high = TIMEOUT_MS
    drawn = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(high - low))
    return nodes.select("node", (F.lit(low) + drawn).cast("int").alias("timeout_ms"))


def due(states: DataFrame) -> DataFrame:
    """(cluster, node, action): what each node does at a tick, given (cluster, node, role, silent_ms, timeout_ms): a leader
    sends to its peers, another node stands for election once it has heard nothing for its timeout, else it waits."""
    action = F.when(F.col("role") == "leader", "replicate").when(F.col("silent_ms") >= F.col("timeout_ms"), "election").otherwise("wait")
    return states.select("cluster", "node", action.alias("action"))


def role_name(role):
    """The name of a role given by number."""
    return F.coalesce(F.get(F.array(*[F.lit(r) for r in ROLES]), role), F.lit("unknown"))


def other_nodes(nodes: DataFrame, node: int) -> DataFrame:
    return nodes.filter(F.col("node") != node)
