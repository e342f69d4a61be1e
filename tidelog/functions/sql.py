"""The functions as SQL functions of a session, and a store's state as views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog.sources import codec

MAX_ID = 2**31 - 1


def _fnv1a64(keys: pd.Series) -> pd.Series:
    held = keys.notna()
    out = pd.Series([None] * len(keys), dtype=object)
    raw = [k.encode() if isinstance(k, str) else bytes(k) for k in keys[held]]
    out[held.to_numpy()] = [f"{h:016x}" for h in codec.fnv1a64(raw).tolist()]
    return out


def _bloom_test(keys: pd.Series, k: pd.Series, m: pd.Series, bits: pd.Series) -> pd.Series:
    def one(key, k, m, bits):
        if any(pd.isna(x) if np.isscalar(x) or x is None else False for x in (key, k, m, bits)):
            return None
        return bool(codec.bloom_test([key.encode() if isinstance(key, str) else bytes(key)], int(k), int(m), bytes(bits))[0])

    return pd.Series([one(*x) for x in zip(keys, k, m, bits)], dtype=object)


class ParsePeers:
    """parse_peers('0=host:port,...') gives a row (id, address) per peer; a bad list is an error."""

    def eval(self, text: str):
        seen = set()
        for entry in (e.strip() for e in (text or "").split(",")):
            if not entry:
                continue
            id_text, equals, address = (x.strip() for x in entry.partition("="))
            if not equals or not id_text.lstrip("+-").isdecimal() or abs(int(id_text)) > MAX_ID or not address or int(id_text) in seen:
                raise ValueError(f"not a peer, or one that was named before: {entry!r}")
            seen.add(int(id_text))
            yield int(id_text), address
        if not seen:
            raise ValueError("no peers")


def register(spark: SparkSession) -> None:
    """fnv1a64(key) -> hex string, bloom_test(key, k, m, bits) -> boolean, and the table function parse_peers(text)."""
    spark.udf.register("fnv1a64", F.pandas_udf(_fnv1a64, "string"))
    spark.udf.register("bloom_test", F.pandas_udf(_bloom_test, "boolean"))
    spark.udtf.register("parse_peers", F.udtf(ParsePeers, returnType="id int, address string"))


def views(store, prefix: str = "kv", version: int | None = None) -> None:
    """Temporary views <prefix>_state (key, value) and <prefix>_layers of one version of a store."""
    pinned = store.manifest(version)["version"]
    store.read(pinned).createOrReplaceTempView(f"{prefix}_state")
    layers = [(x["type"], x["path"], x["n"], x["dead"], x["min"], x["max"], x["bytes"]) for x in store.manifest(pinned)["layers"]]
    schema = "type string, path string, records bigint, tombstones bigint, min_key string, max_key string, bytes bigint"
    store.spark.createDataFrame(layers, schema).createOrReplaceTempView(f"{prefix}_layers")
