"""Differences between two copies of a keyed dataset.

Both sides are tagged and unioned, grouped once by key with one struct per side, and the two structs are compared
by a generated higher-order expression. There is no join: the single shuffle carries one pre-aggregated row per key,
side and map task, so a key that makes up a third of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONLY_A, ONLY_B = "only_in_a", "only_in_b"


def _sides(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per key with `_a` and `_b`: the side's fields, or null where the side has no row."""
    # The greatest row stands for a key with several: copies of one row are equal, and where they are not, the
    # choice is the same whatever the order of the rows. A side's struct is never null, even if all its fields are.
    pick = F.struct(*[F.col(f) for f in fields])
    tagged = a.select(*keys, pick.alias("_row"), F.lit(0).alias("_side")).unionByName(
        b.select(*keys, pick.alias("_row"), F.lit(1).alias("_side"))
    )
    for k in keys:
        tagged = tagged.filter(F.col(k).isNotNull())
    return tagged.groupBy(*keys).agg(
        F.max(F.when(F.col("_side") == 0, F.col("_row"))).alias("_a"),
        F.max(F.when(F.col("_side") == 1, F.col("_row"))).alias("_b"),
    )


def _differing(fields: Sequence[str]) -> Column:
    """SQL generated from the field names: the names of the fields in which the two structs differ."""
    quoted = [f.replace("`", "``") for f in fields]
    cases = ", ".join(
        f"named_struct('field', '{f.replace(chr(39), chr(92) + chr(39))}', 'same', _a.`{q}` <=> _b.`{q}`)"
        for f, q in zip(fields, quoted)
    )
    return F.expr(
        f"CASE WHEN _b IS NULL THEN array('{ONLY_A}') WHEN _a IS NULL THEN array('{ONLY_B}') "
        f"ELSE transform(filter(array({cases}), c -> NOT c.same), c -> c.field) END"
    )


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(*keys, field): the keys that one side lacks, and every field in which the two sides differ.

    Nulls: rows with a null in any key take no part; in a field, null equals null and nothing else, and differs from
    an empty string. Repeated rows of a key within a side count once; if they disagree, the greatest row by the order
    of `fields` stands for them. Other columns are ignored, whatever their names. An empty side makes every key of
    the other one `only_in_*`; two empty sides give no rows.
    """
    sides = _sides(a, b, keys, fields)
    return sides.select(*keys, F.explode(_differing(fields)).alias("field"))


def difference_values(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """As differences(), with both values as strings: (*keys, field, value_a, value_b)."""
    sides = _sides(a, b, keys, fields).withColumn("_fields", _differing(fields))
    value = lambda side: F.coalesce(*[F.when(F.col("field") == f, F.col(side)[f].cast("string")) for f in fields])
    out = sides.select(*keys, "_a", "_b", F.explode("_fields").alias("field"))
    return out.select(*keys, "field", value("_a").alias("value_a"), value("_b").alias("value_b"))


def difference_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(field, n): how often each kind of difference occurs."""
    return differences(a, b, keys, fields).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
