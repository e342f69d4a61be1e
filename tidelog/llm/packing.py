"""Packing of documents into containers of permitted capacities by variable-capacity best fit.

Items are taken in falling order of size. An item goes to the open container it leaves the least room in; if none has
room, a container is opened whose capacity costs least, the cost being the capacity per token that a look ahead over
the remaining items would fill it with. At the end every container is cut down to the least permitted capacity that
holds its contents.

Packing needs no global order: it runs where the documents are read, right behind the tokenizer, over chunks of many
thousands of items. The few containers a chunk leaves ill-filled are taken apart and packed again over all chunks. No
task holds more than a chunk of (id, size) pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.encode import sizes
from tidelog.session import materialize

#: Items of a chunk; more only lessen the number of ill-filled containers.
CHUNK_ITEMS = 200_000
#: A container filled less than this is packed again.
WELL_FILLED = 0.99
#: Items the look ahead puts into a container at most, to compare capacities.
LOOK_AHEAD = 24
ANY = "any"

SCHEMA = "packing string, doc_id bigint, piece int, from_token bigint, n_tokens int, container bigint, capacity int, well_filled boolean"


def _least_cost(size: int, caps: Sequence[int], left: dict[int, int], mask: int) -> int:
    """The capacity to open for an item: least capacity per token after a greedy look ahead; the smaller on ties."""
    best, best_cost = 0, 0.0
    for cap in caps:
        if cap < size:
            continue
        free, used = cap - size, {}
        for _ in range(LOOK_AHEAD):
            fit = mask & ((2 << free) - 2)
            while fit:
                s = fit.bit_length() - 1
                if used.get(s, 0) < left[s]:
                    break
                fit ^= 1 << s
            if not fit:
                break
            used[s] = used.get(s, 0) + 1
            free -= s
        cost = cap / max(1, cap - free)
        if not best or cost < best_cost:
            best, best_cost = cap, cost
    return best


def best_fit(item_sizes: np.ndarray, caps: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, final capacity of each container) for items of at most max(caps)."""
    caps = sorted(caps)
    order = np.argsort(-item_sizes, kind="stable")
    where = np.empty(len(item_sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]
    mask, capacity, free = 0, [], []
    joint = len(caps) > 1
    values, counts = np.unique(item_sizes, return_counts=True)
    left = dict(zip(values.tolist(), counts.tolist()))
    left_mask = sum(1 << s for s in left if s)
    for i, s in zip(order.tolist(), item_sizes[order].tolist()):
        left[s] -= 1
        if not left[s] and s:
            left_mask ^= 1 << s
        fit = mask >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            c = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            cap = _least_cost(s, caps, left, left_mask) if joint else caps[0]
            c, r = len(capacity), cap
            capacity.append(cap)
            free.append(cap)
        r -= s
        free[c] = r
        if not room[r]:
            mask |= 1 << r
        room[r].append(c)
        where[i] = c
    used = np.array(capacity, np.int64) - np.array(free, np.int64)
    allowed = np.array(caps, np.int64)
    return where, allowed[np.searchsorted(allowed, used)]


def pieces(ids: np.ndarray, n: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, piece, first token, size): only an item beyond the largest capacity is cut."""
    count = np.maximum(1, -(-n // largest))
    row = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = piece * largest
    return ids[row], piece, begin, np.minimum(n[row] - begin, largest)


class _Writer:
    """Makes batches of packed rows; container numbers are unique to the task."""

    def __init__(self, first: int):
        self.next = first

    def pack(self, name: str, caps: Sequence[int], doc, piece, begin, size, final: bool) -> pa.RecordBatch:
        # Pieces that fill the largest capacity need no search.
        full = size == max(caps)
        where = np.empty(len(size), np.int64)
        part, capacity = best_fit(size[~full], caps)
        where[~full] = part
        where[full] = len(capacity) + np.arange(int(full.sum()))
        capacity = np.concatenate([capacity, np.full(int(full.sum()), max(caps), np.int64)])
        used = np.bincount(where, weights=size, minlength=len(capacity))
        good = (used >= WELL_FILLED * capacity) | final
        base, self.next = self.next, self.next + len(capacity)
        arrays = [
            pa.array([name]).take(pa.array(np.zeros(len(where), np.int32))),
            doc,
            pa.array(piece, pa.int32()),
            pa.array(begin, pa.int64()),
            pa.array(size, pa.int32()),
            pa.array(base + where, pa.int64()),
            pa.array(capacity[where], pa.int32()),
            pa.array(good[where]),
        ]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")])


def _first_round(packings: dict[str, list[int]], path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(TaskContext.get().partitionId() << 32)
        ids, ns, held = [], [], 0

        def flush():
            doc, n = pa.chunked_array(ids).combine_chunks(), np.concatenate(ns)
            for name, caps in packings.items():
                row, piece, begin, size = pieces(np.arange(len(n)), n, max(caps))
                for lo in range(0, len(row), CHUNK_ITEMS):
                    cut = slice(lo, lo + CHUNK_ITEMS)
                    yield out.pack(name, caps, doc.take(pa.array(row[cut])), piece[cut], begin[cut], size[cut], False)

        for batch in batches:
            ids.append(batch.column(0))
            ns.append(sizes(batch.column(1), path))
            held += batch.num_rows
            if held >= CHUNK_ITEMS:
                yield from flush()
                ids, ns, held = [], [], 0
        if held:
            yield from flush()

    return run


def _second_round(packings: dict[str, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer((1 << 62) + (TaskContext.get().partitionId() << 32))
        held: list[pa.RecordBatch] = []
        at = None

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            col = lambda c: rows[c].to_numpy()
            doc = rows["doc_id"].combine_chunks()
            yield out.pack(at[0], packings[at[0]], doc, col("piece"), col("from_token"), col("n_tokens"), True)

        for batch in batches:
            # Groups are (packing, part); a batch may hold several.
            keys = list(zip(batch["packing"].to_pylist(), batch["part"].to_pylist()))
            lo = 0
            for hi in range(1, len(keys) + 1):
                if hi == len(keys) or keys[hi] != keys[lo]:
                    if at != keys[lo] and held:
                        yield from flush()
                        held = []
                    at = keys[lo]
                    held.append(batch.slice(lo, hi - lo))
                    lo = hi
        if held:
            yield from flush()

    return run


def named(listed: set[tuple[str | None, int]]) -> dict[str, list[int]]:
    """name -> capacities of each packing. A name of several capacities, and the joint packing's,
    is told apart by the capacity behind it."""
    rows = sorted({(name or str(capacity), capacity) for name, capacity in listed}, key=lambda r: (r[1], r[0]))
    names = Counter(name for name, _ in rows)
    out = {name: [capacity] for name, capacity in rows if names[name] == 1 and name != ANY}
    for name, capacity in rows:
        if names[name] > 1 or name == ANY:
            own = f"{name}:{capacity}"
            while own in out:
                own += f":{capacity}"
            out[own] = [capacity]
    out[ANY] = sorted({capacity for _, capacity in rows})
    return out


def pack(documents: DataFrame, pack_sizes: DataFrame, path: str) -> DataFrame:
    """(packing, doc_id, piece, from_token, n_tokens, container, capacity): where every document or piece went.

    One packing for each row of pack_sizes, with containers of that capacity alone, and one named "any" with
    containers of all of them. A document is cut only if it exceeds the packing's largest capacity, into full pieces
    and a rest. `container` is unique within the result.

    Null and empty texts have no tokens; they are put into some container all the same. Every row of `documents` is
    an item of its own, repeated or null ids included. Capacities that are null or not positive are ignored, and
    repeated ones count once. Without documents there are no rows; without a capacity it is an error.
    """
    # A table of permitted capacities; read with its size checked.
    listed = pack_sizes.select("size_name", "capacity").filter("capacity > 0").distinct().limit(1001).collect()
    if not 0 < len(listed) <= 1000:
        raise ValueError("pack_sizes must give 1 to 1000 capacities")
    packings = named({(r.size_name, r.capacity) for r in listed})
    rows = documents.select(F.col("doc_id").cast("bigint"), "text")
    first = materialize(rows.mapInArrow(_first_round(packings, path), SCHEMA), "packed")
    rest = first.filter("NOT well_filled")
    parts = max(1, -(-rest.count() // CHUNK_ITEMS))
    part = F.pmod(F.xxhash64("doc_id", "piece", "container"), F.lit(parts)).alias("part")
    again = (
        rest.select("packing", part, "doc_id", "piece", "from_token", "n_tokens")
        .repartition("packing", "part")
        .sortWithinPartitions("packing", "part")
        .mapInArrow(_second_round(packings), SCHEMA)
    )
    return first.filter("well_filled").unionByName(again).drop("well_filled")


def fill_report(packed: DataFrame) -> DataFrame:
    """(packing, containers, tokens, room, unused): how much of the containers' room is left over."""
    bins = packed.groupBy("packing", "container").agg(F.sum("n_tokens").alias("used"), F.max("capacity").alias("cap"))
    sums = bins.groupBy("packing").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum("cap").cast("bigint").alias("room")
    )
    return sums.withColumn("unused", 1 - F.col("tokens") / F.col("room"))
