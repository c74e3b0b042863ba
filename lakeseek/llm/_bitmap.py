"""Bit maps over a whole column, sized by its keys and merged without the driver holding the column."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as tx

#: Bits of the least and the largest map; a key takes ``PER_KEY`` of them.
LEAST, MOST, PER_KEY = 16, 27, 12
_CHUNK = 1 << 14
_U = np.uint64


def _places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = tx.mix(values.view(_U))
    mask = _U((1 << bits) - 1)
    return (h & mask).astype(np.int64), (h >> _U(64 - bits)).astype(np.int64)


def bits_for(keys: int) -> int | None:
    """Bits (as a power of two) of a map for so many keys; None if it would be larger than ``MOST`` allows."""
    bits = max(LEAST, math.ceil(math.log2(max(1, PER_KEY * keys))))
    return bits if bits <= MOST else None


def bit_map(df: DataFrame, column: str, keys: int | None = None) -> np.ndarray | None:
    """Bloom filter (two hashes) of a bigint column of ``keys`` rows, which are counted if not given.

    None where the keys are too many for a broadcast of 16 MB: the caller then
    joins with the column itself.
    """
    bits = bits_for(df.count() if keys is None else keys)
    if bits is None:
        return None
    size = 1 << (bits - 3)

    def merged(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "bits"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(size, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64), bits):
                np.bitwise_or.at(packed, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield merged({k: packed[k * _CHUNK : (k + 1) * _CHUNK] for k in range(-(-size // _CHUNK)) if packed[k * _CHUNK : (k + 1) * _CHUNK].any()})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = np.frombuffer(b, np.uint8)
                total[k] = total[k] | now if k in total else now
        yield merged(total)

    out = np.zeros(size, np.uint8)
    kind = "chunk int, bits binary"
    for k, b in df.select(column).repartition(8, column).mapInArrow(collect, kind).repartition(8, "chunk").mapInArrow(join, kind).collect():
        out[k * _CHUNK : k * _CHUNK + len(b)] = np.frombuffer(b, np.uint8)
    return out


def holds(bitmap: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    """False for values that the column certainly lacks; without a map, none."""
    if bitmap is None:
        return np.ones(len(values), bool)
    bits = (len(bitmap) * 8).bit_length() - 1
    a, b = _places(values, bits)
    first = (bitmap[a >> 3] >> (a & 7).astype(np.uint8)) & 1
    out = first.astype(bool)
    on = np.flatnonzero(out)
    b = b[on]
    out[on] = ((bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
    return out
