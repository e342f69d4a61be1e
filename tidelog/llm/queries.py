"""Queries p6 to p8 on the documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import abuse
from tidelog.llm.encode import decode_ids, encode_texts
from tidelog.llm.packing import fill_report, pack
from tidelog.session import table

#: Where the vocabulary files are; a parameter of every operator.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.json"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents, whole. A table of fewer splits than cores is spread over all cores first; that decides which task
    reads a row and nothing else."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(_documents(spark, d), "doc_id", "text", BYTE_BPE_50K)


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): every text decoded again from its ids."""
    return decode_ids(p6_ids(spark, d), "doc_id", "ids", BYTE_BPE_50K)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(_documents(spark, d), table(spark, d, "pack_sizes"), BYTE_BPE_50K)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p7_containers(spark, d))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """(packing, documents, over, whole): how many documents went into each packing, how many of its containers hold more
    than their capacity, and whether the pieces have all tokens of the documents."""
    docs = _documents(spark, d)
    tokens = encode_texts(docs, "doc_id", "text", BYTE_BPE_50K).agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("all"))
    packed = pack(docs, table(spark, d, "pack_sizes"), BYTE_BPE_50K)
    bins = packed.groupBy("packing", "container").agg(
        F.sum("n_tokens").alias("used"), F.max("capacity").alias("room"), F.count_if(F.col("piece") == 0).alias("firsts")
    )
    sums = bins.groupBy("packing").agg(
        F.sum("firsts").alias("documents"), F.count_if(F.col("used") > F.col("room")).alias("over"), F.sum("used").alias("used")
    )
    return sums.join(F.broadcast(tokens)).select("packing", "documents", "over", (F.col("used") == F.col("all")).alias("whole"))


def _abuse_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(_documents(spark, d), table(spark, d, "labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse_scores(spark, d).filter(F.col("score") >= 0.5).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _abuse_scores(spark, d).select("doc_id", "score")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_abuse_scores(spark, d))


QUERIES = {
    f.__name__: f for f in (p6_ids, p6_round_trip, p7_containers, p7_fill, p7_checks, p8_found, p8_scores, p8_rates)
}

SQL = {
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_checks": """
        WITH p AS (SELECT size_name AS packing FROM pack_sizes UNION ALL SELECT 'any')
        SELECT packing, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS over, true AS whole FROM p
    """,
}
