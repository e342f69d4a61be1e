"""Queries p1 to p5: the operations of a data pipeline on the store's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.consolidate import consolidate, consolidate_files
from tidelog.operators.diff import difference_counts, differences
from tidelog.operators.replay import replay, unknown_ops, watermarks
from tidelog.operators.seen import Seen
from tidelog.operators.treetop import first_n_per_key
from tidelog.session import table

FIELDS = ("kind", "value", "seq", "term")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return differences(table(spark, d, "store_a"), table(spark, d, "store_b"), ["key"], FIELDS)


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return difference_counts(table(spark, d, "store_a"), table(spark, d, "store_b"), ["key"], FIELDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate(table(spark, d, "runs"), table(spark, d, "sstables")).select("cluster_id", "seq")


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """The listings published for the consolidated files. How many there are depends on the cores."""
    listings = consolidate_files(table(spark, d, "runs"), table(spark, d, "sstables"))[1]
    return listings.filter("file_state = 'live'").select("file_id", "cluster_id", "gen", "n_records", "n_bytes", "min_key", "max_key", "bloom_k", "bloom_m")


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the published listings add up to in each cluster, and the ends of their keys."""
    return p2_files(spark, d).groupBy("cluster_id").agg(
        F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return replay(table(spark, d, "replicated_log"))


def p3_watermarks(spark: SparkSession, d: str) -> DataFrame:
    return watermarks(table(spark, d, "replicated_log"))


def p3_unknown_ops(spark: SparkSession, d: str) -> DataFrame:
    return unknown_ops(table(spark, d, "replicated_log"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    firsts = first_n_per_key(table(spark, d, "replicated_log"), "key", ["proposed_at", "feed_id"], fan_in=8)
    return firsts.select("key", "feed_id")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """The three earliest writes of each key of runs; a record counts once, whatever files hold it."""
    return first_n_per_key(table(spark, d, "runs"), "key", ["seq", "cluster_id"], fan_in=8)


def _seen(spark: SparkSession, d: str) -> Seen:
    return Seen(table(spark, d, "bloom_probes"), table(spark, d, "runs"), "probe_id", "key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).found().select(F.col("id").alias("probe_id"))


def p5_error(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).error_rate()


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """(looked_up, absent): keys that were looked up, and those among them that the history lacks, whatever the filter said."""
    return p5_error(spark, d).select("looked_up", (F.col("negatives") + F.col("wrong")).alias("absent"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_counts, p2_found, p2_files, p2_totals, p3_found, p3_watermarks, p3_unknown_ops, p4_found, p4_runs, p5_found, p5_error, p5_totals)
}

_P1 = """
WITH a AS (SELECT DISTINCT key, kind, value, seq, term FROM store_a WHERE key IS NOT NULL),
     b AS (SELECT DISTINCT key, kind, value, seq, term FROM store_b WHERE key IS NOT NULL),
     j AS (SELECT coalesce(a.key, b.key) AS key, a.key AS ka, b.key AS kb, a.kind AS k1, b.kind AS k2, a.value AS v1,
                  b.value AS v2, a.seq AS s1, b.seq AS s2, a.term AS t1, b.term AS t2
           FROM a FULL JOIN b ON a.key = b.key)
SELECT key, 'only_in_a' AS field FROM j WHERE kb IS NULL
UNION ALL SELECT key, 'only_in_b' FROM j WHERE ka IS NULL
UNION ALL SELECT key, 'kind' FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND k1 IS DISTINCT FROM k2
UNION ALL SELECT key, 'value' FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND v1 IS DISTINCT FROM v2
UNION ALL SELECT key, 'seq' FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND s1 IS DISTINCT FROM s2
UNION ALL SELECT key, 'term' FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND t1 IS DISTINCT FROM t2
"""

_COMMITTED = """
e AS (SELECT *, max(term) OVER (PARTITION BY cluster_id ORDER BY idx RANGE UNBOUNDED PRECEDING) AS top
      FROM replicated_log),
c AS (SELECT * FROM e WHERE term = top)
"""

SQL = {
    "p1_found": _P1,
    "p1_counts": f"SELECT field, count(*) AS n FROM ({_P1}) t GROUP BY field",
    "p2_found": """
        SELECT DISTINCT r.cluster_id, r.seq FROM runs r
        WHERE r.file_id IN (SELECT file_id FROM (
            SELECT file_id, file_state, row_number() OVER (PARTITION BY file_id ORDER BY listed_at DESC, file_state DESC) AS rn
            FROM sstables) t WHERE rn = 1 AND file_state = 'live')
    """,
    "p2_totals": """
        WITH live AS (SELECT file_id FROM (
            SELECT file_id, file_state, row_number() OVER (PARTITION BY file_id ORDER BY listed_at DESC, file_state DESC) AS rn
            FROM sstables) t WHERE rn = 1 AND file_state = 'live'),
        r AS (SELECT DISTINCT cluster_id, seq, key, coalesce(rec_len, strlen(key) + strlen(coalesce(value, '')) + 9) AS size FROM runs
              WHERE file_id IN (SELECT file_id FROM live))
        SELECT cluster_id, count(*) AS n_records, CAST(sum(size) AS BIGINT) AS n_bytes, min(key) AS min_key, max(key) AS max_key
        FROM r GROUP BY cluster_id
    """,
    "p3_found": f"""
        WITH {_COMMITTED},
        cmd AS (SELECT cluster_id, origin, cmd_id, key, idx, coalesce(kind = 1, regexp_matches(lower(op), 'del|rem|rm|tomb|eras')) AS del,
                       row_number() OVER (PARTITION BY cluster_id, origin, cmd_id ORDER BY idx) AS rn
                FROM c WHERE key IS NOT NULL),
        last AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, key ORDER BY idx DESC) AS pos FROM cmd WHERE rn = 1)
        SELECT cluster_id, key, idx FROM last WHERE pos = 1 AND NOT del
    """,
    "p3_watermarks": f"""
        WITH {_COMMITTED},
        i AS (SELECT DISTINCT cluster_id, idx FROM c),
        n AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY idx) AS rn,
                     min(idx) OVER (PARTITION BY cluster_id) AS first FROM i)
        SELECT cluster_id, first, max(CASE WHEN idx = first + rn - 1 THEN idx END) AS watermark, max(idx) AS last
        FROM n GROUP BY cluster_id, first
    """,
    "p3_unknown_ops": """
        SELECT lower(trim(op)) AS op, count(*) AS n FROM replicated_log
        WHERE key IS NOT NULL AND kind IS NULL AND NOT coalesce(regexp_full_match(lower(trim(op)), '(op)?(put|set|insert|update|upsert|del|delete|remove|tombstone)'), false)
        GROUP BY 1
    """,
    "p4_found": """
        WITH f AS (SELECT DISTINCT key, proposed_at, feed_id FROM replicated_log
                   WHERE key IS NOT NULL AND proposed_at IS NOT NULL)
        SELECT key, feed_id FROM (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY proposed_at, feed_id) AS rn FROM f) t WHERE rn <= 3
    """,
    "p4_runs": """
        WITH f AS (SELECT DISTINCT key, seq, cluster_id FROM runs WHERE key IS NOT NULL AND seq IS NOT NULL AND cluster_id IS NOT NULL)
        SELECT key, seq, cluster_id FROM (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq, cluster_id) AS rn FROM f) t WHERE rn <= 3
    """,
    "p5_found": """
        SELECT DISTINCT p.probe_id FROM bloom_probes p
        LEFT JOIN (SELECT key, min(probe_id) AS first FROM bloom_probes WHERE key IS NOT NULL GROUP BY key) f ON p.key = f.key
        WHERE p.key IS NOT NULL AND (f.first < p.probe_id OR p.key IN (SELECT key FROM runs WHERE key IS NOT NULL))
    """,
    "p5_totals": """
        WITH k AS (SELECT DISTINCT key FROM bloom_probes WHERE key IS NOT NULL AND probe_id IS NOT NULL)
        SELECT count(*) AS looked_up, count(*) FILTER (key NOT IN (SELECT key FROM runs WHERE key IS NOT NULL)) AS absent FROM k
    """,
}
