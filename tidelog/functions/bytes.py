"""Byte formats and hashes as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published parameters of 64-bit FNV-1a, the offset basis as two halves and the prime's low part
#: (the prime is 2^40 + 0x1b3).
FNV_BASIS_HIGH, FNV_BASIS_LOW, FNV_PRIME_LOW = 0xCBF29CE4, 0x84222325, 0x1B3
MASK32 = (1 << 32) - 1

#: Of the Bloom filter format.
BLOOM_BITS_PER_KEY, BLOOM_HASHES, BLOOM_LEAST_BITS = 10, 7, 64

RECORD_OVERHEAD = 9


def length_prefix(value: Column) -> Column:
    """The four bytes, big-endian, of a value's length; null counts as empty."""
    return F.unhex(F.lpad(F.hex(F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")), 8, "0"))


def encode_record(kind: Column, key: Column, value: Column) -> Column:
    """kind:1, length:4, key, length:4, value."""
    blob = lambda c: F.coalesce(c.cast("binary"), F.unhex(F.lit("")))
    first = F.unhex(F.lpad(F.hex(kind.cast("bigint")), 2, "0"))
    return F.concat(first, length_prefix(key), blob(key), length_prefix(value), blob(value))


def record_length(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + RECORD_OVERHEAD).cast("bigint")


def fnv1a64(key: Column) -> Column:
    """struct(high, low): the two 32-bit halves of the key's 64-bit FNV-1a hash, each in a bigint.

    Kept in halves, no product leaves 64 bits, so nothing overflows in ANSI mode.
    """
    blob = key.cast("binary")
    n = F.octet_length(blob)
    byte = lambda i: F.conv(F.hex(F.substring(blob, i, F.lit(1))), 16, 10).cast("bigint")
    codes = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), byte)).otherwise(
        F.array().cast("array<bigint>")
    )
    mask, prime = F.lit(MASK32), F.lit(FNV_PRIME_LOW)

    def step(acc: Column, code: Column) -> Column:
        low = acc["low"].bitwiseXOR(code)
        product = low * prime
        # times 2^40 moves the low half eight bits into the high one
        high = acc["high"] * prime + F.shiftright(product, 32) + F.shiftleft(low.bitwiseAND(F.lit((1 << 24) - 1)), 8)
        return F.struct(high.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    start = F.struct(F.lit(FNV_BASIS_HIGH).cast("bigint").alias("high"), F.lit(FNV_BASIS_LOW).cast("bigint").alias("low"))
    return F.aggregate(codes, start, step)


def bloom_bits(n: Column) -> Column:
    """The number of bits for n keys: ten a key, 64 at least, in whole bytes."""
    bits = F.greatest(F.greatest(n, F.lit(1)) * BLOOM_BITS_PER_KEY, F.lit(BLOOM_LEAST_BITS))
    return (F.ceil(bits / 8) * 8).cast("bigint")


def bloom_positions(hash_: Column, m: Column, k: int = BLOOM_HASHES) -> Column:
    """The k bit positions of a hash from fnv1a64 in a filter of m bits."""
    step = F.when(hash_["high"] == 0, F.lit(1)).otherwise(hash_["high"])
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (hash_["low"] + i.cast("bigint") * step) % m)
