"""Whole-batch text scanning with numpy.

Texts are looked at as UTF-8 bytes. A batch of Arrow strings is one byte
buffer with offsets, so words, lines and their 64-bit hashes come from a few
array passes over the buffer, and no Python object is made per word.

Null texts count as empty. A slice holds about ``SLICE_BYTES`` of text and at
least one whole document; the byte scan inside goes on in pieces, so the size
of one text is bounded by memory for its own words only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
PIECE_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C55 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.empty(n, _U), np.empty(n, _U)
    up[0] = down[0] = 1
    have = 1
    with np.errstate(over="ignore"):
        while have < n:
            k = min(have, n - have)
            up[have : have + k] = up[:k] * _U(pow(_BASE, have, 1 << 64))
            down[have : have + k] = down[:k] * _U(pow(inverse, have, 1 << 64))
            have += k
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Word bytes: all but white space; or ASCII letters and digits with every byte above ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


class Words:
    """Words of a slice of documents.

    ``start``/``end``: byte range of each word in ``buf``; ``hash``: its 64-bit
    hash; ``off``: document ``d`` owns words ``off[d]:off[d + 1]``.
    """

    __slots__ = ("buf", "doc_off", "start", "end", "hash", "off")

    def __init__(self, buf, doc_off, start, end, hashes, off):
        self.buf, self.doc_off, self.start, self.end, self.hash, self.off = buf, doc_off, start, end, hashes, off

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)


def range_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, which must be in ascending order of start and end."""
    out = np.zeros(len(start), _U)
    if not len(start):
        return out
    with np.errstate(over="ignore"):
        lo = 0
        while lo < len(start):
            base = int(start[lo])
            hi = max(lo + 1, int(np.searchsorted(end, base + PIECE_BYTES, "right")))
            stop = int(end[hi - 1])
            up, down = powers(stop - base + 1)
            total = np.empty(stop - base + 1, _U)
            total[0] = 0
            np.cumsum(code[buf[base:stop]] * up[: stop - base], out=total[1:])
            s = start[lo:hi] - base
            out[lo:hi] = (total[end[lo:hi] - base] - total[s]) * down[s]
            lo = hi
    return mix(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    import sys

    kept = sys.__dict__.setdefault("_lakeseek_powers", [])
    if not kept or len(kept[0]) < n:
        kept[:] = _powers(max(n, PIECE_BYTES + 4096))
    return kept[0], kept[1]


def scan(buf: np.ndarray, doc_off: np.ndarray, member: np.ndarray = NOT_SPACE, lower: bool = False, hashed: bool = True) -> Words:
    """Words of the documents ``buf[doc_off[d]:doc_off[d + 1]]``: maximal runs of ``member`` bytes."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(buf, doc_off, none, none, np.zeros(0, _U), np.zeros(len(doc_off), np.int64))
    inside = member[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = doc_off[:-1][(doc_off[:-1] < n) & (np.diff(doc_off) > 0)]
    first[edges] = inside[edges]
    last = inside
    last = last.copy()
    last[:-1] &= ~inside[1:]
    tails = doc_off[1:][np.diff(doc_off) > 0] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    code = _BYTE_CODE[_LOWER] if lower else _BYTE_CODE
    hashes = range_hash(buf, start, end, code) if hashed else np.zeros(0, _U)
    return Words(buf, doc_off, start, end, hashes, np.searchsorted(start, doc_off))


def lines(buf: np.ndarray, doc_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the ``\\n``-split lines; an empty document has one empty line."""
    cut = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([doc_off[:-1], cut + 1]), kind="stable")
    end = np.sort(np.concatenate([doc_off[1:], cut]), kind="stable")
    doc = np.searchsorted(doc_off, start, "right") - 1
    keep = end >= start
    return start[keep], end[keep], doc[keep]


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over ``off[d]:off[d + 1]``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and offsets of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        wide, kind = np.int32, column.type
    else:
        wide, kind = np.int64, column.type
    if not (pa.types.is_string(kind) or pa.types.is_large_string(kind)):
        return texts(column.cast(pa.string()))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive row ranges of about ``size`` bytes of text, with their buffers and offsets."""
    buf, off = texts(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield batch.slice(lo, hi - lo), buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def together(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of several batches, of about ``size`` bytes of text, as one."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        held.append(batch)
        have += batch.column(batch.schema.get_field_index(column)).nbytes
        if have >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, have = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def repeats(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys
