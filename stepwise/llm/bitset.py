"""A broadcast filter of fixed size over 64-bit keys.

It only saves work: a key that it lets through is still joined exactly.  Its
size does not depend on the data; with very many keys it lets more through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm import textops as tx

BITS = 27                   # default size: 16 MB
_BUCKET = 32_768            # bits of one bitmap of the engine


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = tx.mix64(keys.astype(np.int64).view(tx.U64))
    return [(h >> tx.U64(64 - bits)).astype(np.int64), (h & tx.U64((1 << bits) - 1)).astype(np.int64)]


def build(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bits of all keys (one long column without nulls)."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(key, bits)))], ["place"])

    maps = (keys.mapInArrow(places, "place long")
            # the engine's buckets and positions count from 1
            .groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits")))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for bucket, part in zip(*maps.toArrow().to_pydict().values()):
        at = (bucket - 1) * _BUCKET // 8
        out[at:at + len(part)] = np.frombuffer(part, np.uint8)
    return out


def contains(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for p in _places(keys, (len(filled) * 8).bit_length() - 1):
        ok &= (filled[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return ok


def lets_through(filled: np.ndarray, keys: pa.Array) -> np.ndarray:
    """``contains`` of a nullable column; a null is never let through."""
    return contains(filled, keys.fill_null(0).to_numpy()) & ~np.asarray(keys.is_null())


def passing(rows: DataFrame, key_col: str, filled, wanted: bool) -> DataFrame:
    """Rows whose key the filter (a broadcast of ``build``) lets through, or the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(lets_through(filled.value, batch.column(key_col)) == wanted))
    return rows.mapInArrow(run, rows.schema)
