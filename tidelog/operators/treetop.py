"""First n rows per key by multi-level tree aggregation.

The input is cut into chunks of a fixed number of rows, and each chunk is combined where it is read: a rank limit before
the shuffle. Then the states of up to `fan_in` chunks are merged in a round, those of up to `fan_in` such groups in the
next, until there is one group. What a task receives of one key in a round are the states of about fan_in chunks or
groups, n each, however many rows the key has and however many chunks there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk.
CHUNK_ROWS = 1 << 15
#: Rounds there are at least, so that small inputs take the way of large ones.
ROUNDS_MIN = 2


def rounds_for(chunks: int, fan_in: int) -> int:
    """The number of merge rounds that bring `chunks` states down to one."""
    rounds = 1
    while chunks > fan_in:
        chunks, rounds = -(-chunks // fan_in), rounds + 1
    return rounds


def first_n_per_key(
    df: DataFrame, key: str, order: Sequence[str], n: int = 3, fan_in: int = 64, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """(key, *order): for each key its first n distinct rows by `order`, ascending.

    The last column of `order` should identify a row; a row that is repeated counts once. Rows with a null key or a
    null in any column of `order` take no part. Keys with fewer rows keep all. Extra columns are ignored; an empty
    input gives no rows.
    """
    cols = [key, *order]
    state = df.select(*cols)
    for c in cols:
        state = state.filter(F.col(c).isNotNull())
    # Of a Parquet table this reads the footers alone.
    chunks = max(1, -(-df.count() // chunk_rows))
    # Rows of a partition are numbered as they are read; blocks of them are spread over the numbers of chunks. A row's
    # chunk does not matter for the result.
    block = F.floor(F.monotonically_increasing_id() / F.lit(chunk_rows))
    state = state.withColumn("_chunk", F.pmod(F.xxhash64(block), F.lit(chunks)).cast("int"))
    rounds = max(ROUNDS_MIN, rounds_for(chunks, fan_in))
    for k in range(1, rounds + 1):
        left = -(-chunks // fan_in**k)
        state = state.withColumn("_chunk", F.lit(0) if k == rounds else F.pmod(F.col("_chunk"), F.lit(left)))
        # dense_rank, as equal rows share a rank and so count once; the limit runs before and after the exchange.
        w = Window.partitionBy(key, "_chunk").orderBy(*order)
        state = state.withColumn("_rank", F.dense_rank().over(w)).filter(F.col("_rank") <= n).drop("_rank")
        # Partitioned by (key, _chunk) already: this needs no further exchange.
        state = state.groupBy(key, "_chunk", *order).agg(F.lit(1).alias("_one")).drop("_one")
    return state.select(*cols)
