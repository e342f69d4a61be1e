"""The byte formats of log and run files: records, and the sections of a run file."""

from __future__ import annotations

import io
import os
import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np

from tidelog.functions.bytes import BLOOM_BITS_PER_KEY, BLOOM_HASHES, BLOOM_LEAST_BITS

#: The run file's footer.
MAGIC = 0x4B455354
FOOTER = struct.Struct(">QQQQI")
HEAD = struct.Struct(">BI")
LENGTH = struct.Struct(">I")
#: Of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


class Torn(ValueError):
    """A record that ends before it should; `offset` is where it starts."""

    def __init__(self, offset: int):
        super().__init__(f"torn record at byte {offset}")
        self.offset = offset


def encode(kind: int, key: bytes, value: bytes | None) -> bytes:
    value = value or b""
    return HEAD.pack(kind, len(key)) + key + LENGTH.pack(len(value)) + value


def records(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(offset, kind, key, value) of each record; a tombstone's value is None. Raises Torn at an incomplete one,
    wherever it is cut."""
    end = len(data) if end is None else end
    at = start
    while at < end:
        first = at
        if at + HEAD.size > end:
            raise Torn(first)
        kind, n = HEAD.unpack_from(data, at)
        at += HEAD.size
        if at + n + LENGTH.size > end:
            raise Torn(first)
        key = data[at : at + n]
        (m,) = LENGTH.unpack_from(data, at + n)
        at += n + LENGTH.size
        if at + m > end:
            raise Torn(first)
        value = data[at : at + m]
        at += m
        yield first, kind, key, None if kind == 1 else value


def fnv1a64(keys: list[bytes]) -> np.ndarray:
    """The hashes of many keys, byte position by byte position."""
    lengths = np.array([len(k) for k in keys], np.int64)
    flat = np.frombuffer(b"".join(keys), np.uint8)
    starts = np.cumsum(lengths) - lengths
    h = np.full(len(keys), FNV_BASIS, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > i)
            h[on] = (h[on] ^ flat[starts[on] + i]) * np.uint64(FNV_PRIME)
    return h


def _positions(h: np.ndarray, m: int, k: int) -> np.ndarray:
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    high = np.where(high == 0, np.uint64(1), high)
    return (low[:, None] + np.arange(k, dtype=np.uint64) * high[:, None]) % np.uint64(m)


def bloom_of(h: np.ndarray) -> tuple[int, int, bytes]:
    """(k, m, bits) of the filter over keys with these hashes."""
    m = -(-max(BLOOM_LEAST_BITS, BLOOM_BITS_PER_KEY * max(1, len(h))) // 8) * 8
    bits = np.zeros(m, bool)
    bits[_positions(h, m, BLOOM_HASHES).astype(np.int64).ravel()] = True
    return BLOOM_HASHES, m, np.packbits(bits, bitorder="little").tobytes()


def bloom(keys: list[bytes]) -> tuple[int, int, bytes]:
    """(k, m, bits) of the filter over the keys of a run."""
    return bloom_of(fnv1a64(keys))


def encode_bloom(k: int, m: int, bits: bytes) -> bytes:
    return struct.pack(">II", k, m) + bits


def decode_bloom(data: bytes) -> tuple[int, int, bytes]:
    """(k, m, bits); raises ValueError if the length does not fit."""
    k, m = struct.unpack_from(">II", data)
    if len(data) != 8 + m // 8:
        raise ValueError("a filter of another length")
    return k, m, data[8:]


def bloom_test(keys: list[bytes], k: int, m: int, bits: bytes) -> np.ndarray:
    on = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
    return on[_positions(fnv1a64(keys), m, k).astype(np.int64)].all(1)


def encode_run(rows: list[tuple[int, bytes, bytes | None]]) -> bytes:
    """A run file of (kind, key, value), ascending by key with one row per key: data, index, filter, footer."""
    data, index, at = [], [], 0
    for kind, key, value in rows:
        record = encode(kind, key, value)
        data.append(record)
        index.append(LENGTH.pack(len(key)) + key + struct.pack(">Q", at))
        at += len(record)
    k, m, bits = bloom([key for _, key, _ in rows])
    index_bytes, filter_bytes = b"".join(index), encode_bloom(k, m, bits)
    footer = FOOTER.pack(at, len(index_bytes), at + len(index_bytes), len(filter_bytes), MAGIC)
    return b"".join(data) + index_bytes + filter_bytes + footer


def _sections(footer: bytes, size: int) -> tuple[int, int, int, int]:
    if size < FOOTER.size:
        raise ValueError("shorter than a footer")
    *sections, magic = FOOTER.unpack(footer)
    index_at, index_len, filter_at, filter_len = sections
    if magic != MAGIC or index_at + index_len != filter_at or filter_at + filter_len + FOOTER.size != size:
        raise ValueError("not a run file")
    return index_at, index_len, filter_at, filter_len


def run_sections(data: bytes) -> tuple[int, int, int, int]:
    """(index offset, index length, filter offset, filter length); raises ValueError if the file is no run."""
    return _sections(data[-FOOTER.size :], len(data))


def _entries(data: bytes) -> list[tuple[bytes, int]]:
    at, out = 0, []
    while at < len(data):
        (n,) = LENGTH.unpack_from(data, at)
        key = data[at + 4 : at + 4 + n]
        out.append((key, struct.unpack_from(">Q", data, at + 4 + n)[0]))
        at += 12 + n
    return out


def run_index(data: bytes) -> list[tuple[bytes, int]]:
    """(key, offset) of each record of a run file."""
    at, length, _, _ = run_sections(data)
    return _entries(data[at : at + length])


def run_lookup(f: BinaryIO, keys: Iterable[bytes]) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(offset, kind, key, value) of each of the keys that an open run file has.

    Read are the footer and the filter; where the filter does not deny all keys the index, and then one record a key.
    """
    size = f.seek(0, os.SEEK_END)
    f.seek(max(0, size - FOOTER.size))
    index_at, index_len, filter_at, filter_len = _sections(f.read(FOOTER.size), size)
    f.seek(filter_at)
    wanted = sorted(set(keys))
    if not wanted:
        return
    maybe = bloom_test(wanted, *decode_bloom(f.read(filter_len)))
    wanted = [k for k, m in zip(wanted, maybe) if m]
    if not wanted:
        return
    f.seek(index_at)
    index = _entries(f.read(index_len))
    for key in wanted:
        at = bisect_left(index, key, key=lambda e: e[0])
        if at < len(index) and index[at][0] == key:
            begin, end = index[at][1], index[at + 1][1] if at + 1 < len(index) else index_at
            f.seek(begin)
            _, kind, _, value = next(records(f.read(end - begin)))
            yield begin, kind, key, value


def run_get(data: bytes, key: bytes) -> tuple[int, bytes | None] | None:
    """(kind, value) of a key in the bytes of a run file, or None."""
    for _, kind, _, value in run_lookup(io.BytesIO(data), [key]):
        return kind, value
    return None
