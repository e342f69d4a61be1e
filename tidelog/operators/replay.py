"""Commit-ordered replay of a replicated log of inserts, updates and deletes.

The steps, none of which puts a whole cluster or a hot key into one task:

1. Entries of deposed leaders are told by one number per (cluster, term): the least idx of any later term. At or
   beyond it, an entry of that term is overruled.
2. Deliveries of one command are assembled into one transaction, at the smallest idx at which it was committed.
3. A cluster's watermark is the last idx up to which no committed entry is missing, from the start of the log on.
   What lies behind a gap is held.
4. Keys do not conflict with each other, so each is replayed on its own: its last transaction at or below the watermark
   decides, and only such state is exposed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.blocked import contiguous_end, suffix_min
from tidelog.session import materialize

#: Up to so many (cluster, term) pairs, of 24 bytes each, are broadcast; beyond, the log is shuffled by them.
BROADCAST_TERMS = 1_000_000

#: The idx with which a log begins.
FIRST_IDX = 1

#: Spellings of inserts and updates, and of deletes, lower case and trimmed.
PUT_OPS = ("put", "set", "insert", "update", "upsert", "add", "write", "store", "replace", "opput", "opset", "opinsert", "opupdate")
DELETE_OPS = ("delete", "del", "remove", "rm", "tombstone", "erase", "opdelete", "opdel", "opremove")


def is_delete(kind: Column, op: Column) -> Column:
    """By kind where it is given, else by op; false if neither tells."""
    return F.coalesce(kind == 1, F.lower(F.trim(op)).isin(*DELETE_OPS), F.lit(False))


def overruled_from(firsts: DataFrame) -> DataFrame:
    """(cluster_id, term, overruled_from): the idx from which on an entry of the term is overruled; null if never.
    `firsts`: (cluster_id, term, first_idx), the least idx of each term."""
    return suffix_min(firsts, ["cluster_id"], "term", "first_idx", "overruled_from").drop("first_idx")


def unknown_ops(log: DataFrame) -> DataFrame:
    """(op, n): spellings in neither list of rows that have a key and no kind. They count as puts; this tells of them."""
    op = F.lower(F.trim("op"))
    told = log.filter(F.col("key").isNotNull() & F.col("kind").isNull() & F.coalesce(~op.isin(*PUT_OPS, *DELETE_OPS), F.lit(True)))
    return told.groupBy(op.alias("op")).agg(F.count(F.lit(1)).alias("n"))


def term_cuts(log: DataFrame) -> DataFrame:
    """(cluster_id, term, _tl_cut): overruled_from(), broadcast if small: the log need not be shuffled by term.

    The least idx of each term is written once, a row for each term: the log is read once for it, and their number, which
    is that of the cuts too, is known before anything is joined.
    """
    firsts = materialize(_whole(log).groupBy("cluster_id", "term").agg(F.min("idx").alias("first_idx")), "firsts")
    cut = overruled_from(firsts).withColumnRenamed("overruled_from", "_tl_cut")
    return F.broadcast(cut) if firsts.count() <= BROADCAST_TERMS else cut


def _whole(log: DataFrame) -> DataFrame:
    return log.filter(F.col("cluster_id").isNotNull() & F.col("idx").isNotNull() & F.col("term").isNotNull())


def committed(log: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """The rows of the log whose entries are not overruled, still with every delivery. `cuts`: term_cuts() of the log."""
    cuts = term_cuts(log) if cuts is None else cuts
    kept = _whole(log).join(cuts, ["cluster_id", "term"]).filter(F.col("_tl_cut").isNull() | (F.col("idx") < F.col("_tl_cut")))
    return kept.select(*log.columns)


def watermarks(log: DataFrame, first: int = FIRST_IDX, cuts: DataFrame | None = None) -> DataFrame:
    """(cluster_id, first, watermark, last) over the committed entries of each cluster.

    `first` is where the logs begin; entries before it, as behind a snapshot, do not count. If it is missing itself, the
    watermark is first - 1.
    """
    return contiguous_end(committed(log.select("cluster_id", "idx", "term"), cuts), ["cluster_id"], "idx", first)


def transactions(log: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """(cluster_id, key, idx, deleted): every committed command once, where it took effect.

    A command is (cluster_id, origin, cmd_id); a row that lacks origin or cmd_id is a command of its own entry. Rows
    without a key change nothing and are left out.
    """
    rows = committed(
        log.select(
            "cluster_id", "idx", "term", "origin", "cmd_id", "key", is_delete(F.col("kind"), F.col("op")).alias("_del")
        ),
        cuts,
    ).filter(F.col("key").isNotNull())
    unnamed = F.when(F.col("origin").isNull() | F.col("cmd_id").isNull(), F.col("idx"))
    # idx and the flag share one bigint, so the aggregate keeps its state in fixed-width hash-map slots.
    packed = F.col("idx") * 2 + F.col("_del").cast("bigint")
    assembled = rows.groupBy("cluster_id", "origin", "cmd_id", unnamed.alias("_own"), "key").agg(F.min(packed).alias("_at"))
    return assembled.select(
        "cluster_id", "key", F.shiftright("_at", 1).alias("idx"), (F.col("_at") % 2 == 1).alias("deleted")
    )


def replay(log: DataFrame, feed_complete: bool = False, first: int = FIRST_IDX) -> DataFrame:
    """(cluster_id, key, idx): the live keys with the idx of the command that set them.

    Only entries up to each cluster's contiguous watermark count, from `first` on; what took effect before is taken to be
    part of the state the log begins with. With `feed_complete` nothing more will
    arrive, a gap can no longer be filled and holds nothing back.

    Nulls: rows without cluster_id, idx or term are no entries; rows without a key change nothing, but count for the
    rule of terms and fill their place in the sequence; without kind the spelling of op decides. Repeated and late rows
    change nothing. An empty log gives no rows. Extra columns are ignored.
    """
    cuts = term_cuts(log)
    done = transactions(log, cuts)
    if not feed_complete:
        # One row a cluster.
        ends = watermarks(log, first, cuts).select("cluster_id", "watermark")
        done = done.join(ends, "cluster_id").filter(F.col("idx").between(F.lit(first), F.col("watermark")))
    packed = F.col("idx") * 2 + F.col("deleted").cast("bigint")
    last = done.groupBy("cluster_id", "key").agg(F.max(packed).alias("_at"))
    return last.filter(F.col("_at") % 2 == 0).select("cluster_id", "key", F.shiftright("_at", 1).alias("idx"))
