"""What a node of a replicated log answers to a message, and what a leader makes of the answers.

State and messages are rows, told apart by (cluster, node); a rule is evaluated for all nodes at once, one message to
each. Columns: nodes (cluster, node, term, commit_idx, snapshot_idx, snapshot_term), logs (cluster, node, idx, term) of
the entries behind the snapshot, leaders (cluster, term, node, commit_idx, snapshot_idx, snapshot_term), progress
(cluster, node, match_idx, next_idx). A node without a message keeps its state and gives no answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.replog import is_majority

NODE = ["cluster", "node"]


def _term_at(idx: Column, term: Column, snapshot_idx: Column, snapshot_term: Column) -> Column:
    """The term at an index: the snapshot's at its end, -1 before it and where the log has no entry."""
    return F.when(idx == snapshot_idx, snapshot_term).when(idx < snapshot_idx, F.lit(-1)).otherwise(F.coalesce(term, F.lit(-1)))


def new_progress(logs_end: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, node, match_idx, next_idx) of a leader just elected: nothing is known to match, and every node is
    asked for what follows the leader's last entry. `logs_end`: (cluster, last_idx)."""
    nxt = (F.col("last_idx") + 1).cast("bigint").alias("next_idx")
    return members.join(F.broadcast(logs_end), "cluster").select(*NODE, F.lit(0).cast("bigint").alias("match_idx"), nxt)


# -- the leader's messages -------------------------------------------------------------------------------------


def send_plan(leaders: DataFrame, logs_end: DataFrame, progress: DataFrame) -> DataFrame:
    """(cluster, node, next_idx, action, n_entries): what a leader sends to each node next: a snapshot where the next entry
    is no longer in its log, else what it has from there on, which may be nothing. `logs_end`: (cluster, last_idx)."""
    lead = F.broadcast(leaders.select("cluster", "snapshot_idx").join(logs_end.select("cluster", "last_idx"), "cluster"))
    rows = progress.join(lead, "cluster")
    snap = F.col("next_idx") <= F.col("snapshot_idx")
    n = F.when(snap, 0).otherwise(F.greatest(F.col("last_idx") - F.col("next_idx") + 1, F.lit(0)))
    action = F.when(snap, "snapshot").when(n > 0, "append").otherwise("heartbeat")
    return rows.select(*NODE, F.col("next_idx").cast("bigint").alias("next_idx"), action.alias("action"), n.cast("bigint").alias("n_entries"))


def append_args(leaders: DataFrame, log: DataFrame, progress: DataFrame) -> DataFrame:
    """(cluster, node, term, prev_idx, prev_term, first_idx, n_entries, leader_commit): the message to each node whose
    next entry the leader's log still has; the others need a snapshot. `log`: (cluster, idx, term).

    The entries are the leader's from first_idx on; see append_rows().
    """
    lead = leaders.select("cluster", F.col("term").alias("_term"), F.col("commit_idx").alias("leader_commit"), "snapshot_idx", "snapshot_term")
    asked = progress.join(F.broadcast(lead), "cluster").filter(F.col("next_idx") > F.col("snapshot_idx"))
    prev = asked.withColumn("prev_idx", F.col("next_idx") - 1)
    # A handful of rows a cluster, so the log is read once and not shuffled for them.
    behind = log.join(F.broadcast(prev.select(*NODE, "prev_idx", "snapshot_idx")), "cluster").filter(F.col("idx") > F.col("snapshot_idx"))
    told = behind.groupBy(*NODE).agg(
        F.max(F.when(F.col("idx") == F.col("prev_idx"), F.col("term"))).alias("_at"), F.count_if(F.col("idx") > F.col("prev_idx")).alias("n_entries")
    )
    joined = prev.join(told, NODE, "left")
    at = _term_at(F.col("prev_idx"), F.col("_at"), F.col("snapshot_idx"), F.col("snapshot_term"))
    return joined.select(
        *NODE, F.col("_term").alias("term"), "prev_idx", at.cast("bigint").alias("prev_term"), F.col("next_idx").alias("first_idx"),
        F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"), "leader_commit",
    )


def append_rows(log: DataFrame, messages: DataFrame) -> DataFrame:
    """(cluster, node, idx, term): the entries that go with each message of append_args()."""
    ends = F.broadcast(messages.select(*NODE, "first_idx"))
    return log.join(ends, "cluster").filter(F.col("idx") >= F.col("first_idx")).select(*NODE, "idx", "term")


def install_args(leaders: DataFrame, progress: DataFrame) -> DataFrame:
    """(cluster, node, term, leader, snapshot_idx, snapshot_term): the snapshot sent to each node whose next entry is
    behind it."""
    lead = leaders.select("cluster", "term", F.col("node").alias("leader"), "snapshot_idx", "snapshot_term")
    return progress.join(F.broadcast(lead), "cluster").filter(F.col("next_idx") <= F.col("snapshot_idx")).select(
        *NODE, "term", "leader", "snapshot_idx", "snapshot_term"
    )


# -- a node's answer -------------------------------------------------------------------------------------------


def _judged(nodes: DataFrame, logs: DataFrame, messages: DataFrame, entries: DataFrame) -> DataFrame:
    """A row for each message with what decides about it: _ok, _last, _conflict, _kept and _new_last."""
    asked = nodes.join(messages.select(*NODE, F.col("term").alias("_term"), "prev_idx", "prev_term", "leader_commit"), NODE)
    own = logs.join(asked.select(*NODE, "prev_idx"), NODE).groupBy(*NODE).agg(
        F.max("idx").alias("_max"), F.max(F.when(F.col("idx") == F.col("prev_idx"), F.col("term"))).alias("_at")
    )
    clash = logs.join(entries.select(*NODE, "idx", F.col("term").alias("_new")), [*NODE, "idx"]).filter(F.col("term") != F.col("_new"))
    first = clash.groupBy(*NODE).agg(F.min("idx").alias("_conflict"))
    sent = entries.groupBy(*NODE).agg(F.max("idx").alias("_sent"))
    rows = asked.join(own, NODE, "left").join(first, NODE, "left").join(sent, NODE, "left")
    last = F.coalesce("_max", "snapshot_idx")
    at = _term_at(F.col("prev_idx"), F.col("_at"), F.col("snapshot_idx"), F.col("snapshot_term"))
    ok = (F.col("_term") >= F.col("term")) & (F.col("prev_idx") <= last) & (at == F.col("prev_term"))
    rows = rows.withColumns({"_last": last, "_ok": ok})
    kept = F.when(F.col("_ok") & F.col("_conflict").isNotNull(), F.col("_conflict") - 1).otherwise(F.col("_last"))
    rows = rows.withColumn("_kept", kept)
    return rows.withColumn("_new_last", F.when(F.col("_ok"), F.greatest("_kept", F.coalesce("_sent", F.lit(0)))).otherwise(F.col("_last")))


def append_replies(nodes: DataFrame, logs: DataFrame, messages: DataFrame, entries: DataFrame) -> DataFrame:
    """(cluster, node, term, success, last_idx, commit_idx): each node's answer, and its state after it.

    A message of an older term is denied. The node must have the entry before the first one sent, in the same term; the
    leader's commit index is taken as far as the node's own log goes, and never lowers the node's.
    """
    rows = _judged(nodes, logs, messages, entries)
    commit = F.when(F.col("_ok"), F.greatest("commit_idx", F.least("leader_commit", "_new_last"))).otherwise(F.col("commit_idx"))
    return rows.select(
        *NODE, F.greatest("term", "_term").alias("term"), F.col("_ok").alias("success"), F.col("_new_last").alias("last_idx"), commit.alias("commit_idx")
    )


def appended(nodes: DataFrame, logs: DataFrame, messages: DataFrame, entries: DataFrame) -> DataFrame:
    """(cluster, node, idx, term): the logs after the messages. At the first entry of another term a log is cut off, and
    the entries from there on are the leader's; entries that it has are left as they are."""
    rows = _judged(nodes, logs, messages, entries).select(*NODE, "_kept", "_ok")
    kept = logs.join(rows, NODE, "left").filter(F.col("_kept").isNull() | (F.col("idx") <= F.col("_kept")))
    new = entries.join(rows, NODE).filter(F.col("_ok") & (F.col("idx") > F.col("_kept")))
    return kept.select(*NODE, "idx", "term").unionByName(new.select(*NODE, "idx", "term"))


# -- what a leader makes of answers ----------------------------------------------------------------------------


def _counted(leaders: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies to messages of the leader's own term, before the first one that shows it a higher term."""
    lead = F.broadcast(leaders.select("cluster", F.col("term").alias("_lead")))
    rows = replies.join(lead, "cluster")
    fell = rows.filter(F.col("term") > F.col("_lead")).groupBy("cluster").agg(F.min("seq").alias("_fell"))
    return rows.filter(F.col("sent_term") == F.col("_lead")).join(F.broadcast(fell), "cluster", "left").filter(
        F.col("_fell").isNull() | (F.col("seq") < F.col("_fell"))
    )


def after_replies(progress: DataFrame, leaders: DataFrame, replies: DataFrame) -> DataFrame:
    """(cluster, node, match_idx, next_idx) after replies (cluster, node, seq, sent_term, term, success, prev_idx,
    n_entries), taken in order of seq.

    A success sets the match to the last entry sent and the next index behind it; each failure moves the next index back
    by one, to 1 at least. Replies to messages of another term do not count, and none after one of a higher term, by
    which the leader has stepped down.
    """
    rows = _counted(leaders, replies)
    hit = F.when(F.col("success"), F.struct("seq", (F.col("prev_idx") + F.col("n_entries")).alias("to")))
    last = rows.groupBy(*NODE).agg(F.max(hit).alias("_hit"))
    since = rows.join(last, NODE).filter(~F.col("success") & (F.col("_hit").isNull() | (F.col("seq") > F.col("_hit.seq"))))
    missed = since.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_missed"))
    state = progress.join(last, NODE, "left").join(missed, NODE, "left")
    start = F.coalesce(F.col("_hit.to") + 1, "next_idx")
    back = F.greatest(start - F.coalesce("_missed", F.lit(0)), F.least(start, F.lit(1)))
    return state.select(*NODE, F.coalesce("_hit.to", "match_idx").alias("match_idx"), back.cast("bigint").alias("next_idx"))


def after_snapshot_replies(progress: DataFrame, leaders: DataFrame, replies: DataFrame) -> DataFrame:
    """(cluster, node, match_idx, next_idx) after replies (cluster, node, seq, sent_term, term, snapshot_idx): the node
    has the snapshot, and the match never falls; the last one's end decides what is sent next. Replies that do not count
    are those of after_replies()."""
    rows = _counted(leaders, replies)
    took = rows.groupBy(*NODE).agg(F.max("snapshot_idx").alias("_most"), F.max(F.struct("seq", "snapshot_idx")).alias("_last"))
    state = progress.join(took, NODE, "left")
    return state.select(
        *NODE, F.greatest("match_idx", F.coalesce("_most", "match_idx")).alias("match_idx"),
        F.coalesce(F.col("_last.snapshot_idx") + 1, "next_idx").cast("bigint").alias("next_idx"),
    )


def read_index(leaders: DataFrame, acks: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, term, read_idx, confirmed): the index a strong read waits for, the leader's commit index when it was
    asked, and whether the leader of that term may serve it.

    `acks`: (cluster, asked_term, node, term, ok), the answers to the leader of asked_term. An answer of a higher term
    deposes it, whatever the others say. Else it needs a majority of all members, itself and every node once that is at
    its term and agrees; members that do not answer count for the size.
    """
    size = members.groupBy("cluster").agg(F.count_distinct("node").alias("_size"))
    lead = leaders.select("cluster", F.col("term").alias("asked_term"), F.col("node").alias("_leader"), "commit_idx")
    mine = F.col("ok") & (F.col("term") == F.col("asked_term")) & (F.col("node") != F.col("_leader"))
    heard = acks.join(lead, ["cluster", "asked_term"]).groupBy("cluster", "asked_term").agg(
        F.count_distinct(F.when(mine, F.col("node"))).alias("_ok"), F.max("term").alias("_top")
    )
    rows = lead.join(heard, ["cluster", "asked_term"], "left").join(F.broadcast(size), "cluster")
    stays = F.coalesce(F.col("_top") <= F.col("asked_term"), F.lit(True))
    agreed = is_majority(F.coalesce("_ok", F.lit(0)) + 1, F.col("_size"))
    return rows.select("cluster", F.col("asked_term").alias("term"), F.col("commit_idx").alias("read_idx"), (stays & agreed).alias("confirmed"))


# -- snapshots -------------------------------------------------------------------------------------------------


def take_snapshots(nodes: DataFrame, logs: DataFrame, asked: DataFrame) -> DataFrame:
    """(cluster, node, outcome, snapshot_idx, snapshot_term) for each node asked (cluster, node, at) to take a snapshot:
    'nothing' at or below the one it has, 'refused' beyond its commit index, else 'taken'."""
    rows = nodes.join(asked.select(*NODE, "at"), NODE)
    at = logs.join(rows.select(*NODE, "at"), NODE).filter(F.col("idx") == F.col("at")).select(*NODE, F.col("term").alias("_at"))
    outcome = F.when(F.col("at") <= F.col("snapshot_idx"), "nothing").when(F.col("at") > F.col("commit_idx"), "refused").otherwise("taken")
    taken = outcome == "taken"
    return rows.join(at, NODE, "left").select(
        *NODE, outcome.alias("outcome"), F.when(taken, F.col("at")).otherwise(F.col("snapshot_idx")).alias("snapshot_idx"),
        F.when(taken, F.col("_at")).otherwise(F.col("snapshot_term")).alias("snapshot_term"),
    )


def compacted(logs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(cluster, node, idx, term, pos): what logs hold behind their snapshots (cluster, node, snapshot_idx), at which
    position; the snapshot's own end is position 0 and no entry any more."""
    return logs.join(snapshots.select(*NODE, "snapshot_idx"), NODE).filter(F.col("idx") > F.col("snapshot_idx")).select(
        *NODE, "idx", "term", (F.col("idx") - F.col("snapshot_idx")).alias("pos")
    )


# -- state -----------------------------------------------------------------------------------------------------


def state(nodes: DataFrame, logs: DataFrame) -> DataFrame:
    """(cluster, node, term, last_idx, last_term, commit_idx, snapshot_idx): what a node tells of itself."""
    last = logs.groupBy(*NODE).agg(F.max(F.struct("idx", "term")).alias("_last"))
    return nodes.join(last, NODE, "left").select(
        *NODE, "term", F.coalesce("_last.idx", "snapshot_idx").alias("last_idx"), F.coalesce("_last.term", "snapshot_term").alias("last_term"),
        "commit_idx", "snapshot_idx",
    )


def save(nodes: DataFrame, logs: DataFrame, path: str) -> None:
    """Writes what nodes must not lose, their state and logs, as one version below `path`.

    A version counts when both its tables are complete: the nodes are written last, and Spark marks a complete table.
    """
    spark = nodes.sparkSession
    name = f"{max(_saved(spark, path), default=0) + 1:012d}"
    logs.select(*NODE, "idx", "term").write.mode("overwrite").parquet(f"{path}/{name}/logs")
    nodes.write.mode("overwrite").parquet(f"{path}/{name}/nodes")


def _saved(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete versions."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    root = jvm_path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    return [int(n) for n in names if n.isdigit() and fs.exists(jvm_path(f"{path}/{n}/nodes/_SUCCESS"))]


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, logs) of the newest complete version, or None if there is none."""
    saved = _saved(spark, path)
    if not saved:
        return None
    at = f"{path}/{max(saved):012d}"
    return spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/logs")
