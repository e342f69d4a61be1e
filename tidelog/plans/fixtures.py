"""The inputs of the store and log queries, derived from the tables of a data directory, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import table

N_GENS = 8
#: (node, last_term, last_index) of the voters.
VOTERS = ((0, 3, 500), (1, 2, 900), (2, 6, 10), (3, 4, 400), (4, 5, 700))
#: Percent of the log up to which a replica agrees with the leader, and percent it has in all.
REPLICAS = ((1, 100, 100), (2, 75, 100), (3, 40, 90), (4, 55, 55), (5, 0, 30))


def mutation_log(spark: SparkSession, d: str) -> DataFrame:
    """(seq, key, kind, value): the events of type error delete their user's record, all others put."""
    dies = F.col("event_type") == "error"
    return table(spark, d, "events").select(
        (F.col("event_id") + 1).alias("seq"),
        F.col("user_id").alias("key"),
        F.when(dies, 1).otherwise(0).alias("kind"),
        F.when(~dies, F.col("value")).alias("value"),
    )


def generations(spark: SparkSession, d: str) -> DataFrame:
    """The mutation log with `gen`, an eighth of it each."""
    n = table(spark, d, "events").count()
    return mutation_log(spark, d).withColumn("gen", F.expr(f"cast((seq - 1) * {N_GENS} div {n} AS int)"))


def log_entries(spark: SparkSession, d: str) -> DataFrame:
    """(idx, term, cmd_id): 700 entries a term."""
    return table(spark, d, "events").select(
        (F.col("event_id") + 1).alias("idx"), F.expr("1 + event_id div 700").alias("term"), F.col("event_id").alias("cmd_id")
    )


def replicas(spark: SparkSession, d: str) -> DataFrame:
    """(node, idx, term): replicas that follow the leader up to a point and have other terms beyond it."""
    n = table(spark, d, "events").count()
    pieces = F.array(*[F.struct(F.lit(r).alias("node"), F.lit(n * a // 100).alias("same"), F.lit(n * b // 100).alias("end")) for r, a, b in REPLICAS])
    each = log_entries(spark, d).select("idx", "term", F.explode(pieces).alias("r")).filter(F.col("idx") <= F.col("r.end"))
    term = F.when(F.col("idx") <= F.col("r.same"), F.col("term")).otherwise(F.col("term") - 1)
    return each.select("r.node", "idx", term.alias("term"))


def vote_requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS arrival",
        "1 + o_orderkey div 100 - CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS term",
        "cast(o_custkey % 5 AS int) AS candidate",
        "o_orderkey % 7 AS last_log_term",
        "cast(floor(o_totalprice) AS bigint) % 1000 AS last_log_index",
    )


def voters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOTERS, "node int, last_term int, last_index int")


def order_store(spark: SparkSession, d: str) -> DataFrame:
    """(key, kind, value, seq): orders by key; those of status P are deleted."""
    dead = F.col("o_orderstatus") == "P"
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("key"), F.when(dead, 1).otherwise(0).alias("kind"), F.when(~dead, F.col("o_totalprice")).alias("value"), F.col("o_orderkey").alias("seq")
    )


def item_keys(spark: SparkSession, d: str) -> DataFrame:
    """(key): order keys asked for, many of them repeatedly, and as many again that no order has."""
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    return keys.union(keys.select(F.col("key") + 10_000_000))


def bloom_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("key"), F.col("user_id").cast("string")).alias("key")).distinct()


def bloom_questions(spark: SparkSession, d: str) -> DataFrame:
    """(key): every key and as many absent ones."""
    users = table(spark, d, "events").select("user_id").distinct()
    name = lambda p: users.select(F.concat(F.lit(p), F.col("user_id").cast("string")).alias("key"))
    return name("key").unionByName(name("absent"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


LOG_SQL = """log AS (SELECT event_id + 1 AS seq, user_id AS key, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS kind,
    CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events),
top AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log),
state AS (SELECT key, value, seq FROM top WHERE rn = 1 AND kind = 0)"""
RUNS_SQL = f"""{LOG_SQL},
gens AS (SELECT *, CAST((seq - 1) * {N_GENS} // (SELECT count(*) FROM events) AS INTEGER) AS gen FROM log),
genrows AS (SELECT *, row_number() OVER (PARTITION BY gen, key ORDER BY seq DESC) AS rn FROM gens),
kvruns AS (SELECT gen, key, kind, value, seq FROM genrows WHERE rn = 1),
merged AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gen DESC) AS pos FROM kvruns)"""
ENTRIES_SQL = "entries AS (SELECT event_id + 1 AS idx, 1 + event_id // 700 AS term, event_id AS cmd_id FROM events)"
REPLICAS_SQL = f"""{ENTRIES_SQL},
replicas AS (SELECT CAST(node AS INTEGER) AS node, idx, CASE WHEN idx <= n * a // 100 THEN term ELSE term - 1 END AS term
    FROM entries, (VALUES {_values(REPLICAS)}) v(node, a, b), (SELECT count(*) AS n FROM events) c WHERE idx <= n * b // 100),
ends AS (SELECT r.node, min(CASE WHEN r.term <> e.term THEN r.idx END) AS conflict_idx,
    max(CASE WHEN r.term = e.term THEN r.idx END) AS shared, max(r.idx) AS last_idx
    FROM replicas r LEFT JOIN entries e ON r.idx = e.idx GROUP BY r.node),
matched AS (SELECT node, least(coalesce(shared, 0), coalesce(conflict_idx - 1, shared, 0)) AS match_idx, conflict_idx, last_idx FROM ends)"""
VOTES_SQL = f"""requests AS (SELECT o_orderkey AS arrival,
    1 + o_orderkey // 100 - CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS term, CAST(o_custkey % 5 AS INTEGER) AS candidate,
    o_orderkey % 7 AS llt, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS lli FROM orders),
asked AS (SELECT arrival, CAST(node AS INTEGER) AS node, term, candidate,
    candidate = node OR llt > last_term OR (llt = last_term AND lli >= last_index) AS eligible
    FROM requests, (VALUES {_values(VOTERS)}) v(node, last_term, last_index)),
seen AS (SELECT *, max(term) OVER (PARTITION BY node ORDER BY arrival) AS cur FROM asked),
fresh AS (SELECT *, row_number() OVER (PARTITION BY node, term ORDER BY arrival) AS n FROM seen WHERE eligible AND term >= cur),
granted AS (SELECT node, term, candidate, arrival FROM fresh WHERE n = 1)"""
_FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen(key) + 1), lambda i: ascii(substr(key, i, 1))::HUGEINT)),
    lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616)"""
BLOOM_SQL = f"""users AS (SELECT DISTINCT user_id FROM events),
keys AS (SELECT 'key' || user_id AS key FROM users),
questions AS (SELECT key FROM keys UNION ALL SELECT 'absent' || user_id FROM users),
hashed AS (SELECT key, {_FNV} AS h FROM questions),
halves AS (SELECT key, CAST(h % 4294967296 AS BIGINT) AS h1, CAST(greatest(h // 4294967296, CASE WHEN h // 4294967296 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS h2 FROM hashed),
size AS (SELECT CAST(ceil(greatest(64, 10 * count(*)) / 8.0) * 8 AS BIGINT) AS m FROM keys),
positions AS (SELECT key, i, (h1 + i * h2) % m AS pos FROM halves, size, (SELECT unnest(range(0, 7)) AS i) g),
filled AS (SELECT DISTINCT pos FROM positions WHERE key IN (SELECT key FROM keys))"""
