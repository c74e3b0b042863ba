"""Rows sent between tasks as packed arrays: a row for each chunk of documents and bucket of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _text as tx

_U = np.uint64


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> dict[int, list[tuple]]:
    """Rows of a task by one of their columns."""
    out: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            out.setdefault(row[column], []).append(row)
    return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit hash, by its upper half."""
    return ((h.view(_U) >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def content_name(ids: np.ndarray) -> int:
    """A number for a sequence of 64-bit ids, the same whenever and wherever it is made."""
    with np.errstate(over="ignore"):
        total = (tx.mix(ids.view(_U)) * np.arange(1, 2 * len(ids), 2, dtype=_U)).sum(dtype=_U)
    return int(tx.mix(np.array([total], _U)).view(np.int64)[0])


def split_rows(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of the runs of an ascending array of buckets."""
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)).tolist():
        yield b, int(edge[b]), int(edge[b + 1])


def batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)
