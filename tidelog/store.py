"""A versioned key-value store over Parquet: a manifest of immutable runs.

A version is a JSON manifest that lists the layers of the store, oldest first: `tail` layers, which are batches of
mutations as they were appended, and `run` layers, which hold one record per key, sorted by key. A manifest is made
under the next number only if that number does not exist yet; a writer that comes second reads again and retries.
Readers pin a version, so they see a snapshot whatever happens after. Nothing is deleted before vacuum().

This needs a file system on which a file can be given a name only if the name is free, in one step: a local one (by
hard links) or one of RENAMES, where a rename fails if the target exists. Others, as plain object stores, are refused.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import fold

SCHEMA = "seq bigint, kind int, key string, value string"
FLUSH_BYTES = 4 << 20
RETRIES = 20
#: Schemes whose rename is one step and does not replace.
RENAMES = ("hdfs", "viewfs", "abfs", "abfss")
#: Bytes of one output file of a run; a run larger than this is several files, range-partitioned by key.
RUN_FILE_BYTES = 128 << 20


@dataclass(frozen=True)
class Result:
    """What a call gives a client: whether it was served, by whom it would be if not, and what was found."""

    success: bool
    leader_hint: int | None = None
    found: bool = False
    value: str | None = None


class Engine(Protocol):
    """What anything that stores keys and values offers."""

    def put(self, df: DataFrame) -> int: ...
    def delete(self, df: DataFrame) -> int: ...
    def get(self, key: str, version: int | None = None) -> str | None: ...
    def close(self) -> None: ...


class Conflict(RuntimeError):
    """Too many writers in the way."""


def _numbered(batch: str) -> tuple[str, int | None]:
    """A batch's stream and its number in it: the digits that its name ends with."""
    stream = batch.rstrip("0123456789")
    digits = batch[len(stream) :]
    # A number with zeros in front would not be told from the same one without.
    return (stream, int(digits)) if digits and str(int(digits)) == digits else (batch, None)


def was_applied(manifest: dict, batch: str) -> bool:
    stream, n = _numbered(batch)
    spans = manifest.get("applied", {}).get(stream, [])
    return [None, None] in spans if n is None else any(lo is not None and lo <= n <= hi for lo, hi in spans)


def with_applied(applied: dict, batch: str) -> dict:
    """`applied` with one more batch. Numbers of a stream are kept as spans, so a stream that is applied batch after batch
    is one span, however long it runs."""
    stream, n = _numbered(batch)
    spans = [tuple(s) for s in applied.get(stream, [])]
    named = [s for s in spans if s[0] is None]
    spans = sorted(s for s in spans if s[0] is not None)
    if n is None:
        named = [(None, None)]
    else:
        spans = sorted([*spans, (n, n)])
    joined: list[list[int]] = []
    for lo, hi in spans:
        if joined and lo <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], hi)
        else:
            joined.append([lo, hi])
    return applied | {stream: [list(s) for s in named] + joined}


class Store:
    def __init__(self, spark: SparkSession, path: str, auto_flush: bool = True, flush_bytes: int = FLUSH_BYTES):
        self.spark, self.path = spark, path.rstrip("/")
        self.auto_flush, self.flush_bytes = auto_flush, flush_bytes
        jvm = spark._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._local() and self._fs.getUri().getScheme() not in RENAMES:
            raise ValueError(f"two writers could both win on {self._fs.getUri().getScheme()}: a store needs file or one of {RENAMES}")
        self._fs.mkdirs(self._jpath(f"{self.path}/manifests"))

    # -- manifests ---------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        found = self._fs.listStatus(self._jpath(f"{self.path}/manifests"))
        names = [f.getPath().getName() for f in found]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def newest(self) -> int:
        """The number of the newest version, 0 if there is none: from the last one noted upwards, so the manifests need
        not be listed."""
        note = self._jpath(f"{self.path}/manifests/_newest")
        try:
            at = int(self._text(note))
        except Exception:  # not there, or being replaced: it only saves looking
            at = 0
        if not at or not self._fs.exists(self._jpath(self._file(at))):
            at = max(self.versions(), default=0)
        while self._fs.exists(self._jpath(self._file(at + 1))):
            at += 1
        return at

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _note(self, version: int) -> None:
        out = self._fs.create(self._jpath(f"{self.path}/manifests/_newest"), True)
        out.write(bytearray(str(version).encode()))
        out.close()

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest at the time of the call."""
        if version is None:
            version = self.newest()
        if version == 0:
            return {"version": 0, "layers": [], "applied": {}}
        return json.loads(self._text(self._jpath(self._file(version))))

    def _file(self, version: int) -> str:
        return f"{self.path}/manifests/{version:020d}.json"

    def _publish(self, manifest: dict) -> bool:
        """Whether the manifest became its version; false if another writer was first.

        The text is complete under another name before it appears, and a rename to a name that exists fails.
        """
        draft = self._jpath(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._jpath(self._file(manifest["version"]))
        if self._local():
            import os

            plain = lambda p: p.toUri().getPath()
            try:
                os.link(plain(draft), plain(target))
                won = True
            except FileExistsError:
                won = False
            self._fs.delete(draft, False)
            return won
        won = self._fs.rename(draft, target)
        if not won:
            self._fs.delete(draft, False)
        return won

    def _local(self) -> bool:
        return self._fs.getUri().getScheme() == "file"

    def _change(self, change: Callable[[dict], dict | None]) -> int:
        """Applies `change` to the newest manifest until one is published; the version, unchanged if it gives None."""
        for attempt in range(RETRIES):
            now = self.manifest()
            new = change(dict(now, layers=list(now["layers"])))
            if new is None:
                return now["version"]
            new["version"] = now["version"] + 1
            if self._publish(new):
                self._note(new["version"])
                return new["version"]
            time.sleep(0.01 * (attempt + 1))
        raise Conflict(f"no version published in {RETRIES} attempts")

    # -- writing -----------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, sort: bool) -> dict:
        name = f"data/{uuid.uuid4().hex}"
        writer = df.write
        if sort:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        writer.parquet(f"{self.path}/{name}")
        back = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}")
        size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 8
        row = back.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == 1).alias("dead"), F.min("key").alias("lo"),
            F.max("key").alias("hi"), F.coalesce(F.sum(size), F.lit(0)).alias("size"), F.max("seq").alias("seq"),
        ).first()
        return {"path": name, "n": row.n, "dead": row.dead, "min": row.lo, "max": row.hi, "bytes": row.size, "seq": row.seq or 0}

    def append(self, mutations: DataFrame, order: str | None = None, batch: str | None = None) -> int:
        """Appends mutations (kind, key, value) as one batch; `order` is a column whose order they take effect in.

        Rows without a key are ignored; a delete stores no value, a put without one stores an empty one. `batch` names
        the batch: one that was appended before is not appended again, which makes retries safe. The new version.
        """
        if batch is not None and was_applied(now := self.manifest(), batch):
            return now["version"]
        rows = mutations.filter(F.col("key").isNotNull())
        dead = F.col("kind") == 1
        value = F.when(~dead, F.coalesce(F.col("value").cast("string"), F.lit("")))
        plain = [F.col("kind").cast("int").alias("kind"), F.col("key").cast("string").alias("key"), value.alias("value")]
        if order is None:
            plain.append(F.monotonically_increasing_id().alias("at"))
        else:
            plain.append(F.col(order).cast("bigint").alias("at"))
        # `seq` orders the rows of a batch; between batches the manifest's order of layers decides.
        layer = self._write(rows.select(*plain).selectExpr("at AS seq", "kind", "key", "value"), False)
        if not layer["n"]:
            return self.manifest()["version"]

        def change(m: dict) -> dict | None:
            if batch is not None:
                if was_applied(m, batch):
                    return None
                m["applied"] = with_applied(m.get("applied", {}), batch)
            m["layers"].append(layer | {"type": "tail"})
            return m

        version = self._change(change)
        return self.flush() if self.auto_flush and self._tail_bytes(self.manifest(version)) >= self.flush_bytes else version

    @staticmethod
    def _tail_bytes(manifest: dict) -> int:
        return sum(x["bytes"] for x in manifest["layers"] if x["type"] == "tail")

    def put(self, df: DataFrame) -> int:
        """Appends rows (key, value) as puts."""
        return self.append(df.select(F.lit(0).alias("kind"), "key", "value"))

    def delete(self, df: DataFrame) -> int:
        """Appends tombstones for rows (key); the keys need not exist."""
        return self.append(df.select(F.lit(1).alias("kind"), "key", F.lit(None).cast("string").alias("value")))

    def _sorted(self, df: DataFrame, size: int) -> DataFrame:
        return df.repartitionByRange(max(1, -(-size // RUN_FILE_BYTES)), "key").sortWithinPartitions("key")

    def _replace(self, old: list[dict], new: dict | None) -> int:
        paths = {x["path"] for x in old}

        def change(m: dict) -> dict | None:
            at = [i for i, x in enumerate(m["layers"]) if x["path"] in paths]
            if len(at) != len(old):
                return None  # another writer replaced some of them; nothing is lost
            kept = [x for x in m["layers"] if x["path"] not in paths]
            if new is not None:
                kept.insert(at[0], new)
            m["layers"] = kept
            return m

        return self._change(change)

    def flush(self) -> int:
        """Folds the tail into one run, keeping tombstones; nothing to do if there is no tail."""
        m = self.manifest()
        tail = [x for x in m["layers"] if x["type"] == "tail"]
        if not tail:
            return m["version"]
        rows = fold.newest_per_key(self._layers(tail), order=["layer", "seq"]).select("seq", "kind", "key", "value")
        run = self._write(self._sorted(rows, self._tail_bytes(m)), True) | {"type": "run"}
        return self._replace(tail, run)

    def compact(self) -> int:
        """Merges all runs to one without tombstones; nothing to do below two runs. The tail takes no part."""
        m = self.manifest()
        runs = [x for x in m["layers"] if x["type"] == "run"]
        if len(runs) < 2:
            return m["version"]
        rows = fold.live(self._layers(runs), order=["layer", "seq"]).select("seq", "kind", "key", "value")
        run = self._write(self._sorted(rows, sum(x["bytes"] for x in runs)), True) | {"type": "run"}
        return self._replace(runs, run)

    def vacuum(self) -> int:
        """Deletes data that the newest version does not use, and the manifests before it; how much was deleted.

        Readers of older versions must have ended, and no writer may be at work.
        """
        m = self.manifest()
        used = {x["path"].split("/")[1] for x in m["layers"]}
        n = 0
        data = self._jpath(f"{self.path}/data")
        if self._fs.exists(data):
            for f in self._fs.listStatus(data):
                if f.getPath().getName() not in used:
                    n += int(self._fs.delete(f.getPath(), True))
        for v in self.versions()[:-1]:
            n += int(self._fs.delete(self._jpath(self._file(v)), False))
        return n

    # -- reading -----------------------------------------------------------------------------------------------

    def _layers(self, layers: list[dict]) -> DataFrame:
        """(layer, seq, kind, key, value) of the given layers, oldest first."""
        out = None
        for i, x in enumerate(layers):
            df = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{x['path']}").select(F.lit(i).alias("layer"), "*")
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], f"layer int, {SCHEMA}")

    def _may_hold(self, layer: dict, low: str | None, high: str | None) -> bool:
        """By the manifest's least and greatest key, compared by bytes as Spark does."""
        code = lambda s: s.encode()
        if not layer["n"]:
            return False
        return (high is None or code(layer["min"]) <= code(high)) and (low is None or code(layer["max"]) >= code(low))

    def _state(self, version: int | None, low: str | None = None, high: str | None = None) -> DataFrame:
        layers = [x for x in self.manifest(version)["layers"] if self._may_hold(x, low, high)]
        rows = self._layers(layers)
        if low is not None:
            rows = rows.filter(F.col("key") >= low)
        if high is not None:
            rows = rows.filter(F.col("key") <= high)
        if len(layers) == 1 and layers[0]["type"] == "run":
            return rows.filter("kind = 0")  # a run has one record per key: no fold
        return fold.live(rows, order=["layer", "seq"])

    def read(self, version: int | None = None) -> DataFrame:
        """(key, value): the live rows, by default of the newest version."""
        return self._state(version).select("key", "value")

    def get(self, key: str, version: int | None = None) -> str | None:
        """The value of a key, or None. Layers that cannot hold it are not read."""
        row = self._state(version, key, key).select("value").first()
        return None if row is None else row.value

    def lookup(self, key: str, version: int | None = None) -> Result:
        """As get(), telling an empty value from an absent one by `found`."""
        value = self.get(key, version)
        return Result(True, found=value is not None, value=value)

    def wait_for(self, version: int, seconds: float = 2.0) -> int:
        """The newest version once it is at least `version`, as others publish it; a TimeoutError after `seconds`."""
        end = time.monotonic() + seconds
        while (now := self.newest()) < version:
            if time.monotonic() >= end:
                raise TimeoutError(f"version {version} was not published within {seconds} s, the newest is {now}")
            time.sleep(0.01)
        return now

    def close(self) -> None:
        """Nothing is held between calls, so there is nothing to release; the tail stays a tail."""

    def multi_get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """(key, found, value) for each distinct key asked for."""
        rows = self._layers(self.manifest(version)["layers"])
        asked = keys.select("key").filter("key IS NOT NULL").distinct()
        held = fold.live(rows.join(asked, "key", "left_semi"), order=["layer", "seq"]).select("key", "value", F.lit(True).alias("_f"))
        return asked.join(held, "key", "left").select("key", F.coalesce("_f", F.lit(False)).alias("found"), "value")

    def scan(self, low: str | None = None, high: str | None = None, version: int | None = None) -> DataFrame:
        """(key, value) of the live rows with low <= key <= high, ordered by key."""
        return self._state(version, low, high).select("key", "value").orderBy("key")

    def size(self, version: int | None = None) -> dict:
        """Counts from the manifest: runs, tail batches, records, tombstones, bytes."""
        layers = self.manifest(version)["layers"]
        return {
            "runs": sum(x["type"] == "run" for x in layers), "tails": sum(x["type"] == "tail" for x in layers),
            "records": sum(x["n"] for x in layers), "tombstones": sum(x["dead"] for x in layers), "bytes": sum(x["bytes"] for x in layers),
        }
