"""Encoding of a whole column of texts, in Arrow batches and without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.bpe import automaton

#: Texts are encoded in slices of about this many bytes, which bounds a worker's memory; a longer text is a slice.
SLICE_BYTES = 4 << 20
#: Lists of ids that are decoded together.
DECODE_ROWS = 512


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) of consecutive rows; null texts are empty."""
    text = text.cast(pa.large_binary()).fill_null(b"")
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def sizes(text: pa.Array, path: str) -> np.ndarray:
    """The number of tokens of each text."""
    a = automaton(path)
    parts = [np.diff(a.encode(b, o, counts_only=True)) for _, _, b, o in slices(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str, out: str = "ids") -> DataFrame:
    """(id_col, out): the token ids of each text under the vocabulary file `path`, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text. Every row gives
    one row, repeated ids and null ids included; texts may be of any length. Extra columns are ignored. `path` must
    be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b, o in slices(batch.column(1)):
                ids, offsets = automaton(path).encode(b, o)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], [id_col, out])

    rows = df.select(F.col(id_col), F.col(text_col))
    schema = T.StructType([rows.schema[0], T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    return rows.mapInArrow(run, schema)


def decode_ids(df: DataFrame, id_col: str, ids_col: str, path: str, out: str = "text") -> DataFrame:
    """(id_col, out): the text that each list of ids stands for; a null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.int32())).fill_null([])
            for lo in range(0, len(lists), DECODE_ROWS):
                part = lists.slice(lo, DECODE_ROWS)
                offsets = part.offsets.to_numpy().astype(np.int64)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                data, ends = automaton(path).decode_lists(ids, offsets - offsets[0])
                texts = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                try:
                    texts = texts.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:  # ids that do not end with a whole character
                    texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), texts], [id_col, out])

    rows = df.select(F.col(id_col), F.col(ids_col))
    schema = T.StructType([rows.schema[0], T.StructField(out, T.StringType(), False)])
    return rows.mapInArrow(run, schema)
