"""Running aggregates over long ordered groups, computed in blocks.

A window over a group that grows with the data runs in one task. Here the order column is cut into blocks of fixed
width: the running value inside a block comes from a window over (group, block), the part before it from one row per
block. Those rows are cut into blocks again where a group may be the whole data, so that no window ever sees more than
a width of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import materialize


#: How values are put together, and how two results are.
_HOW = {
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def _outside(blocks: DataFrame, groups: Sequence[str], how: str, back: bool, width: int, levels: int) -> DataFrame:
    """(*groups, _block, _out): for each block the aggregate of _value over the blocks before it, or behind it."""
    put, join = _HOW[how]
    order = F.desc("_block") if back else F.asc("_block")
    frame = (Window.unboundedPreceding, -1)
    if levels < 2:
        w = Window.partitionBy(*groups).orderBy(order).rowsBetween(*frame)
        return blocks.select(*groups, "_block", put("_value").over(w).alias("_out"))
    cut = blocks.withColumn("_over", F.floor(F.col("_block") / F.lit(width)).cast("bigint"))
    upper = cut.groupBy(*groups, F.col("_over").alias("_block")).agg(put("_value").alias("_value"))
    far = _outside(upper, groups, how, back, width, levels - 1).select(*groups, F.col("_block").alias("_over"), F.col("_out").alias("_far"))
    w = Window.partitionBy(*groups, "_over").orderBy(order).rowsBetween(*frame)
    near = cut.withColumn("_near", put("_value").over(w)).join(far, [*groups, "_over"])
    return near.select(*groups, "_block", join(F.col("_near"), F.col("_far")).alias("_out"))


def running(
    df: DataFrame, groups: Sequence[str], order: str, value: str, out: str, how: str, back: bool = False, own: bool = False, width: int = 65536, levels: int = 1
) -> DataFrame:
    """Adds `out`: the aggregate of `value` over the rows of the group with a smaller `order`, or a greater one if
    `back`; with the row itself if `own`. Null where there is none.

    `order` must be an integer column. Rows of one order come in any order among each other. Where groups may have more
    than width * width rows, `levels` should be 2.
    """
    put, join = _HOW[how]
    cut = df.withColumn("_block", F.floor(F.col(order) / F.lit(width)).cast("bigint"))
    blocks = cut.groupBy(*groups, "_block").agg(put(value).alias("_value"))
    far = _outside(blocks, groups, how, back, width, levels)
    w = Window.partitionBy(*groups, "_block").orderBy(F.desc(order) if back else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    joined = cut.withColumn("_near", put(value).over(w)).join(far, [*groups, "_block"])
    return joined.withColumn(out, join(F.col("_near"), F.col("_out"))).drop("_block", "_near", "_out")


def levels_for(rows: int, width: int = 65536) -> int:
    """The levels of blocks by which no window sees more than a width of rows, however they are spread over groups."""
    levels = 1
    # Blocks of one row make no fewer rows.
    while width > 1 and rows > width ** (levels + 1):
        levels += 1
    return levels


def suffix_min(df: DataFrame, groups: Sequence[str], order: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """Adds `out`: the least `value` among the rows of the group with a strictly greater `order`, else null.

    `order` must be an integer column, unique within its group.
    """
    return running(df, groups, order, value, out, "min", back=True, width=width)


#: Entries of a block of bitmap_bucket_number().
BITMAP = 32768


def _leading_ones(bits: Column) -> Column:
    """How many bits of a bitmap are set before the first that is not; the lowest bit of a byte comes first."""
    digits = F.hex(bits)
    whole = (F.length(F.regexp_extract(digits, "^(?:FF)*+", 0)) / 2).cast("bigint")
    byte = F.substring(digits, (whole * 2 + 1).cast("int"), F.lit(2))
    part = F.locate("0", F.reverse(F.lpad(F.conv(byte, 16, 2), 9, "0"))) - 1
    return whole * 8 + F.when(byte == "", F.lit(0)).otherwise(part)


def contiguous_end(df: DataFrame, groups: Sequence[str], order: str, first: int) -> DataFrame:
    """(*groups, first, watermark, last): how far `order` runs from `first` without a gap; first - 1 if that is missing.

    Values may be repeated; those below `first` do not count, and a group without others gives no row. The values become
    one bitmap for each 32768, so what is shuffled is a few KB a block and task; no group is ever in one task.
    """
    at = df.select(*groups, (F.col(order) - first + 1).cast("bigint").alias("_at")).filter("_at >= 1")
    # Written once: it is read three times, and is small.
    blocks = materialize(
        at.groupBy(*groups, F.bitmap_bucket_number("_at").alias("_block")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"), F.max("_at").alias("_last")
        ),
        "blocks",
    )
    full = blocks.filter(F.bitmap_count("_bits") == BITMAP).select(*groups, "_block")
    # The first block that is not full is the first one, or one behind a full one.
    last = blocks.groupBy(*groups).agg(F.max("_last").alias("_last"))
    after = full.select(*groups, (F.col("_block") + 1).alias("_block")).unionByName(last.select(*groups, F.lit(1).cast("bigint").alias("_block")))
    broken = after.join(full, [*groups, "_block"], "left_anti").groupBy(*groups).agg(F.min("_block").alias("_block"))
    end = broken.join(blocks.select(*groups, "_block", "_bits"), [*groups, "_block"], "left").select(
        *groups, ((F.col("_block") - 1) * BITMAP + F.coalesce(_leading_ones(F.col("_bits")), F.lit(0))).alias("_end")
    )
    start = F.lit(first).cast("bigint")
    return last.join(end, list(groups)).select(
        *groups, start.alias("first"), (F.col("_end") + first - 1).cast("bigint").alias("watermark"), (F.col("_last") + first - 1).cast("bigint").alias("last")
    )


def prefix_sum(df: DataFrame, groups: Sequence[str], order: str, value: str, out: str, width: int = 65536) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the group with a smaller `order`; 0 for the first.

    `order` must be an integer column, unique within its group.
    """
    # Of a Parquet table the count reads the footers alone; groups are taken to be parts of the data.
    levels = 1 if groups else levels_for(df.count(), width)
    summed = running(df, groups, order, value, out, "sum", width=width, levels=levels)
    return summed.withColumn(out, F.coalesce(out, F.lit(0)).cast("bigint"))
