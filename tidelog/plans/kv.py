"""Queries on the store: folds, lookups, byte sizes, runs, compaction and Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.bytes import bloom_bits, bloom_positions, encode_record, record_length
from tidelog.operators import bloom, fold, runs
from tidelog.operators.blocked import prefix_sum
from tidelog.plans import fixtures as X
from tidelog.session import table

KEY = 7
AS_OF = 600
LOW, HIGH = 20, 60


def kv_state(spark: SparkSession, d: str) -> DataFrame:
    return fold.live(X.mutation_log(spark, d)).select("key", "value")


def kv_get_point(spark: SparkSession, d: str) -> DataFrame:
    return fold.get(X.mutation_log(spark, d), KEY).select("key", "value", "seq")


def kv_multi_get(spark: SparkSession, d: str) -> DataFrame:
    return fold.multi_get(X.order_store(spark, d), X.item_keys(spark, d))


def kv_deleted_keys(spark: SparkSession, d: str) -> DataFrame:
    return fold.deleted(X.mutation_log(spark, d)).select("key", "seq")


def kv_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    return fold.missing(X.order_store(spark, d), X.item_keys(spark, d))


def kv_state_as_of(spark: SparkSession, d: str) -> DataFrame:
    return fold.as_of(X.mutation_log(spark, d), AS_OF).select("key", "value")


def kv_history(spark: SparkSession, d: str) -> DataFrame:
    return fold.history(X.mutation_log(spark, d))


def kv_scan_ordered(spark: SparkSession, d: str) -> DataFrame:
    return fold.positioned(fold.live(X.mutation_log(spark, d)).select("key", "value"), ["key"])


def kv_scan_range(spark: SparkSession, d: str) -> DataFrame:
    return fold.between(X.mutation_log(spark, d), LOW, HIGH).select("key", "value")


def kv_scan_prefix(spark: SparkSession, d: str) -> DataFrame:
    runs_ = table(spark, d, "runs").select("key", "kind", "value", "seq").distinct()
    return fold.prefixed(runs_, "cfg/").select("key", "seq")


def kv_overlay(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    newer = judged.select(
        F.col("doc_id").alias("key"), F.when(F.col("quality").isNull(), 1).otherwise(0).alias("kind"), F.col("quality").cast("bigint").alias("value")
    )
    older = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit(0).alias("kind"), (-F.length("lang")).cast("bigint").alias("value"))
    return fold.overlay(older, newer)


def kv_aggregate(spark: SparkSession, d: str) -> DataFrame:
    state = fold.live(X.order_store(spark, d)).select("key", "value")
    return state.groupBy((F.col("key") % 10).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("most")
    )


def _texts(spark: SparkSession, d: str) -> DataFrame:
    log = X.mutation_log(spark, d)
    return log.select("seq", "kind", F.concat(F.lit("key"), F.col("key").cast("string")).alias("key"), F.when(F.col("kind") == 0, F.concat(F.lit("v"), F.col("seq").cast("string"))).alias("value"))


def wal_record_bytes(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("seq", F.hex(encode_record(F.col("kind"), F.col("key"), F.col("value"))).alias("record"))


def wal_offsets(spark: SparkSession, d: str) -> DataFrame:
    sized = _texts(spark, d).select("seq", record_length(F.col("key"), F.col("value")).alias("length"))
    return prefix_sum(sized, [], "seq", "length", "offset")


def mem_size(spark: SparkSession, d: str) -> DataFrame:
    return fold.memtable_size(_texts(spark, d), F.col("key"), F.col("value"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.flush(X.generations(spark, d))


def run_flush(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("gen", "key", "kind", "value", "seq")


def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return runs.stats(_runs(spark, d))


def run_index(spark: SparkSession, d: str) -> DataFrame:
    """Offsets over the recorded runs; the files give their own to compare with."""
    held = table(spark, d, "runs").select(F.col("file_id").alias("gen"), "key", "value", "seq", "index_offset").distinct()
    one = fold.newest_per_key(held, ["gen", "key"], ["seq"])
    found = runs.index(one).join(one.select("gen", "key", "index_offset"), ["gen", "key"])
    return found.select(F.col("gen").alias("file_id"), "key", "offset", "index_offset")


def run_probe_depth(spark: SparkSession, d: str) -> DataFrame:
    return runs.probe_depth(_runs(spark, d))


def compact_full(spark: SparkSession, d: str) -> DataFrame:
    return runs.compact(_runs(spark, d)).select("key", "value", "seq")


def compact_partial(spark: SparkSession, d: str) -> DataFrame:
    return runs.compact_partial(_runs(spark, d), 2, 5).select("gen", "key", "kind", "value", "seq")


def compact_gain(spark: SparkSession, d: str) -> DataFrame:
    return runs.gain(_runs(spark, d))


def compact_equiv(spark: SparkSession, d: str) -> DataFrame:
    part = runs.compact(runs.compact_partial(_runs(spark, d), 1, 6))
    return runs.same_state(kv_state(spark, d), part.select("key", "value"))


def bloom_hash(spark: SparkSession, d: str) -> DataFrame:
    return bloom.hashes(X.bloom_questions(spark, d))


def _m(spark: SparkSession, d: str) -> DataFrame:
    return X.bloom_keys(spark, d).agg(bloom_bits(F.count(F.lit(1))).alias("m"))


def bloom_positions_(spark: SparkSession, d: str) -> DataFrame:
    each = bloom.hashes(X.bloom_questions(spark, d)).join(F.broadcast(_m(spark, d)))
    halves = F.struct(F.col("h2").alias("high"), F.col("h1").alias("low"))
    return each.select("key", F.posexplode(bloom_positions(halves, F.col("m"))).alias("i", "pos"))


def bloom_fill(spark: SparkSession, d: str) -> DataFrame:
    keyed = _runs(spark, d).select("gen", F.concat(F.lit("key"), F.col("key").cast("string")).alias("key"))
    return bloom.fill(keyed, ["gen"])


def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    return bloom.probe(bloom.packed(X.bloom_keys(spark, d)), X.bloom_questions(spark, d))


def bloom_skip(spark: SparkSession, d: str) -> DataFrame:
    """(key, runs_read, runs_skipped): for each key, the runs whose filter lets a lookup in, and the others."""
    keyed = _runs(spark, d).select("gen", F.concat(F.lit("key"), F.col("key").cast("string")).alias("key"))
    # The generations are the entries of a manifest, eight of them here.
    gens = F.array(*[F.lit(g) for g in range(X.N_GENS)])
    asked = X.bloom_questions(spark, d).select("key", F.explode(gens).alias("gen"))
    answers = bloom.probe(bloom.packed(keyed, ["gen"]), asked, ["gen"])
    return answers.groupBy("key").agg(F.count_if("maybe").alias("runs_read"), F.count_if(~F.col("maybe")).alias("runs_skipped"))


def bloom_blobs(spark: SparkSession, d: str) -> DataFrame:
    return bloom.check_blobs(table(spark, d, "runs"), table(spark, d, "sstables"))


QUERIES = {
    f.__name__.rstrip("_"): f
    for f in (
        kv_state, kv_get_point, kv_multi_get, kv_deleted_keys, kv_missing_keys, kv_state_as_of, kv_history, kv_scan_ordered,
        kv_scan_range, kv_scan_prefix, kv_overlay, kv_aggregate, wal_record_bytes, wal_offsets, mem_size, run_flush, run_stats, run_index,
        run_probe_depth, compact_full, compact_partial, compact_gain, compact_equiv, bloom_hash, bloom_positions_, bloom_fill,
        bloom_probe, bloom_skip, bloom_blobs,
    )
}

_TEXTS = f"""{X.LOG_SQL},
texts AS (SELECT seq, kind, 'key' || key AS key, CASE WHEN kind = 0 THEN 'v' || seq END AS value FROM log)"""
_STORE = """store AS (SELECT o_orderkey AS key, o_orderstatus <> 'P' AS alive, o_totalprice AS value FROM orders),
asked AS (SELECT DISTINCT l_orderkey AS key FROM lineitem UNION SELECT l_orderkey + 10000000 FROM lineitem)"""
_GENBLOOM = f"""{X.RUNS_SQL},
{X.BLOOM_SQL},
gkeys AS (SELECT gen, 'key' || key AS key FROM kvruns),
gsize AS (SELECT gen, count(*) AS n_keys, CAST(ceil(greatest(64, 10 * count(*)) / 8.0) * 8 AS BIGINT) AS m FROM gkeys GROUP BY gen),
gpos AS (SELECT DISTINCT s.gen, (h1 + i * h2) % m AS pos FROM gkeys k JOIN halves h ON k.key = h.key JOIN gsize s ON k.gen = s.gen,
    (SELECT unnest(range(0, 7)) AS i) g)"""

SQL = {
    "kv_state": f"WITH {X.LOG_SQL} SELECT key, value FROM state",
    "kv_get_point": f"WITH {X.LOG_SQL} SELECT key, value, seq FROM state WHERE key = {KEY}",
    "kv_multi_get": f"WITH {_STORE} SELECT a.key, coalesce(s.alive, false) AS found, CASE WHEN s.alive THEN s.value END AS value FROM asked a LEFT JOIN store s ON a.key = s.key",
    "kv_deleted_keys": f"WITH {X.LOG_SQL} SELECT key, seq FROM top WHERE rn = 1 AND kind = 1",
    "kv_missing_keys": f"WITH {_STORE} SELECT key FROM asked WHERE key NOT IN (SELECT key FROM store WHERE alive)",
    "kv_state_as_of": f"WITH {X.LOG_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log WHERE seq <= {AS_OF}) SELECT key, value FROM t WHERE r = 1 AND kind = 0",
    "kv_history": f"WITH {X.LOG_SQL} SELECT key, seq AS from_seq, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS to_seq, kind, value FROM log",
    "kv_scan_ordered": f"WITH {X.LOG_SQL} SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS position FROM state",
    "kv_scan_range": f"WITH {X.LOG_SQL} SELECT key, value FROM state WHERE key >= {LOW} AND key < {HIGH}",
    "kv_scan_prefix": "SELECT key, seq FROM (SELECT key, kind, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM (SELECT DISTINCT key, kind, value, seq FROM runs) r WHERE starts_with(key, 'cfg/')) t WHERE rn = 1 AND kind = 0",
    "kv_overlay": """
        WITH l AS (SELECT doc_id AS key, max(quality) AS quality FROM labels GROUP BY doc_id)
        SELECT coalesce(l.key, d.doc_id) AS key, CASE WHEN l.key IS NOT NULL THEN CAST(l.quality AS BIGINT) ELSE -length(lang) END AS value
        FROM documents d FULL JOIN l ON d.doc_id = l.key WHERE l.key IS NULL OR l.quality IS NOT NULL""",
    "kv_aggregate": "SELECT o_orderkey % 10 AS bucket, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS most FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    "wal_record_bytes": f"""WITH {_TEXTS} SELECT seq, lpad(to_hex(kind), 2, '0') || lpad(upper(to_hex(strlen(key))), 8, '0') || hex(encode(key))
        || lpad(upper(to_hex(strlen(coalesce(value, '')))), 8, '0') || hex(encode(coalesce(value, ''))) AS record FROM texts""",
    "wal_offsets": f"""WITH {_TEXTS}, l AS (SELECT seq, CAST(9 + strlen(key) + coalesce(strlen(value), 0) AS BIGINT) AS length FROM texts)
        SELECT seq, length, CAST(coalesce(sum(length) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l""",
    "mem_size": f"""WITH {_TEXTS}, t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM texts)
        SELECT count(*) AS n_keys, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 8) AS BIGINT) AS size FROM t WHERE rn = 1""",
    "run_flush": f"WITH {X.RUNS_SQL} SELECT gen, key, kind, value, seq FROM kvruns",
    "run_stats": f"WITH {X.RUNS_SQL} SELECT gen, count(*) AS n_records, count(*) FILTER (kind = 1) AS n_tombstones, min(key) AS min_key, max(key) AS max_key FROM kvruns GROUP BY gen",
    "run_index": """
        WITH d AS (SELECT DISTINCT file_id, key, value, seq, index_offset FROM runs),
        o AS (SELECT *, row_number() OVER (PARTITION BY file_id, key ORDER BY seq DESC) AS rn FROM d)
        SELECT file_id, key, CAST(coalesce(sum(9 + strlen(key) + coalesce(strlen(value), 0)) OVER (PARTITION BY file_id ORDER BY key
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", index_offset FROM o WHERE rn = 1""",
    "run_probe_depth": f"WITH {X.RUNS_SQL} SELECT key, (SELECT max(gen) FROM kvruns) - max(gen) + 1 AS runs_read FROM kvruns GROUP BY key",
    "compact_full": f"WITH {X.RUNS_SQL} SELECT key, value, seq FROM merged WHERE pos = 1 AND kind = 0",
    "compact_partial": f"""WITH {X.RUNS_SQL},
        part AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gen DESC) AS r FROM kvruns WHERE gen BETWEEN 2 AND 5)
        SELECT gen, key, kind, value, seq FROM kvruns WHERE gen NOT BETWEEN 2 AND 5
        UNION ALL SELECT 5, key, kind, value, seq FROM part WHERE r = 1 AND (kind = 0 OR key IN (SELECT key FROM kvruns WHERE gen < 2))""",
    "compact_gain": f"""WITH {X.RUNS_SQL} SELECT count(*) AS records_in, count(*) FILTER (pos = 1 AND kind = 0) AS records_out,
        count(*) FILTER (pos > 1) AS versions_dropped, count(*) FILTER (pos = 1 AND kind = 1) AS tombstones_dropped FROM merged""",
    "compact_equiv": f"""WITH {X.RUNS_SQL}, m AS (SELECT key, value FROM merged WHERE pos = 1 AND kind = 0), s AS (SELECT key, value FROM state)
        SELECT (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM m) x) AS missing, (SELECT count(*) FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM s) y) AS extra""",
    "bloom_hash": f"WITH {X.BLOOM_SQL} SELECT key, h1, h2 FROM halves",
    "bloom_positions": f"WITH {X.BLOOM_SQL} SELECT key, CAST(i AS INTEGER) AS i, pos FROM positions",
    "bloom_fill": f"WITH {_GENBLOOM} SELECT s.gen, n_keys, m, count(*) AS n_set FROM gsize s JOIN gpos p ON s.gen = p.gen GROUP BY ALL",
    "bloom_probe": f"WITH {X.BLOOM_SQL} SELECT key, bool_and(pos IN (SELECT pos FROM filled)) AS maybe FROM positions GROUP BY key",
    "bloom_skip": f"""WITH {_GENBLOOM},
        q AS (SELECT h.key, s.gen, (h1 + i * h2) % m AS pos FROM halves h, gsize s, (SELECT unnest(range(0, 7)) AS i) g),
        a AS (SELECT q.key, q.gen, bool_and(p.pos IS NOT NULL) AS maybe FROM q LEFT JOIN gpos p ON q.gen = p.gen AND q.pos = p.pos GROUP BY ALL)
        SELECT key, count(*) FILTER (maybe) AS runs_read, count(*) FILTER (NOT maybe) AS runs_skipped FROM a GROUP BY key""",
    "bloom_blobs": """
        WITH l AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY listed_at DESC, bloom_k DESC, bloom_m DESC, bloom_bits DESC) AS rn FROM sstables WHERE file_id IS NOT NULL),
        sound AS (SELECT file_id, bloom_m AS m, hex(bloom_bits) AS bits FROM l WHERE rn = 1 AND bloom_k = 7 AND octet_length(bloom_bits) * 8 = bloom_m),
        k AS (SELECT DISTINCT r.file_id, r.key FROM runs r JOIN sound s ON s.file_id = r.file_id WHERE r.key IS NOT NULL),
        d AS (SELECT key, hex(encode(key)) AS x FROM (SELECT DISTINCT key FROM k) q),
        f AS (SELECT key, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen(key) + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::INTEGER::HUGEINT)),
            lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616) AS h FROM d),
        p AS (SELECT k.file_id, k.key, s.bits, CAST((f.h % 4294967296 + i * greatest(f.h // 4294967296, 1)) % s.m AS BIGINT) AS pos
            FROM k JOIN sound s ON s.file_id = k.file_id JOIN f ON f.key = k.key, (SELECT unnest(range(0, 7)) AS i) g),
        t AS (SELECT file_id, key, bool_and((('0x' || substr(bits, 2 * (pos // 8) + 1, 2))::INTEGER >> (pos % 8)::INTEGER) & 1 = 1) AS maybe FROM p GROUP BY file_id, key)
        SELECT file_id, count(*) AS n_keys, count(*) FILTER (NOT maybe) AS n_missing FROM t GROUP BY file_id
    """,
}
