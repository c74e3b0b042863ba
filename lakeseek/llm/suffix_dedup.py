"""Exact substring deduplication with families of suffix arrays.

A byte goes if a ``length``-byte string that covers it also starts somewhere
else. The suffixes that enter suffix arrays are sampled by content: every
``length``-byte string has an anchor, the place of its least ``gram``-byte
hash, which lies at the same offset in every equal string. So equal strings
are found at anchors of equal grams, and nothing is lost.

1. Anchors' grams are counted by distinct place; the rest look at grams that
   occur at two places or more, told by a bit map of their number's size, or
   by joins of narrow rows where they are too many for one.
2. An anchor's context is all that a string holding its gram can reach. Equal
   contexts are one entry; if it occurs at two places, all of it goes.
3. Entries meet by gram. Each task keeps logarithmic families of suffix
   arrays, one after the other and each of bounded size: the suffixes of a new batch (those that start a ``length``-byte
   string within an entry) are sorted by the 64-bit fingerprint of their first
   ``length`` bytes, merge-scanned against every level, and levels of like
   size are merged, so a suffix is merged a logarithmic number of times.
   Grams with more than ``hot_entries`` entries don't meet in one task; the
   fingerprints of their strings are counted by an aggregation instead.
4. Covered ranges go back to the documents, which are cut and hashed.

Texts that occur twice or more are one text here, and go whole if they are
long enough. A place is known by a 64-bit hash of text and position.

Edge cases: a null text is empty; texts shorter than ``length`` stay whole;
repeated rows are copies of each other; an empty table gives no rows; very
long texts are treated whole; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._bitmap import bit_map, holds
from ._shared import drop, small_batches, written

_U = np.uint64
_I = np.int64
GRAM = 64
HOT_ENTRIES = 50_000
#: Suffixes that meet in one family; merging its levels takes some hundred bytes for each.
FAMILY_SUFFIXES = 1_500_000
SLICE_BYTES = 1 << 20


def text_key(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit key of each text."""
    size = np.diff(off)
    h = np.zeros(len(size), _U)
    some = size > 0
    h[some] = tx.range_hash(buf, off[:-1][some], off[1:][some], tx._BYTE_CODE)
    return tx.mix(h + size.astype(_U) * _U(0x9E3779B97F4A7C15)).view(_I)


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` values in a row."""
    n = len(v)
    pad = -n % w
    x = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, _U)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, byte positions and documents of the anchors of a slice."""
    n = len(buf)
    w = length - gram + 1
    at, hashes = [], []
    step = tx.PIECE_BYTES
    doc_end = np.repeat(off[1:], np.diff(off))
    up, down = tx.powers(step + length + 8)
    with np.errstate(over="ignore"):
        for lo in range(0, max(0, n - length + 1), step):
            hi = min(n, lo + step + length - 1)
            total = np.zeros(hi - lo + 1, _U)
            np.cumsum(tx._BYTE_CODE[buf[lo:hi]] * up[: hi - lo], out=total[1:])
            m = hi - lo - gram + 1
            h = (total[gram:] - total[:m]) * down[:m]
            h ^= h >> _U(29)
            h *= _U(0xBF58476D1CE4E5B9)
            h ^= h >> _U(32)
            key = (h & ~_U((1 << 20) - 1)) | np.arange(m, dtype=_U)
            low = (_window_min(key, w) & _U((1 << 20) - 1)).astype(_I)
            starts = np.arange(lo, lo + len(low))
            low = low[starts + length <= doc_end[starts]]
            if len(low):
                low = low[np.concatenate([[True], low[1:] != low[:-1]])]
                at.append(low + lo)
                hashes.append(h[low])
    if not at:
        none = np.zeros(0, _I)
        return none.astype(_U), none, none
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    at, one = np.unique(at, return_index=True)
    return hashes[one], at, np.searchsorted(off, at, "right") - 1


def places(key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tx.mix(key.view(_U) * _U(0xD1342543DE82EF95) + pos.astype(_U)).view(_I)


class Family:
    """Levels of sorted suffix fingerprints; sizes grow geometrically from the last level to the first."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Takes a batch in; returns the suffixes, old and new, whose leading strings are now known to repeat."""
        order = np.argsort(key, kind="stable")
        key, suffix = key[order], suffix[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        same = ~first
        twin = same.copy()
        twin[:-1] |= same[1:]
        found = [suffix[twin]]
        for level, owner in self.levels:
            at = np.searchsorted(level, key)
            at[at == len(level)] = 0
            hit = level[at] == key if len(level) else np.zeros(len(key), bool)
            found += [suffix[hit], owner[at[hit]]]
        self.levels.append((key[first], suffix[first]))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            (k2, s2), (k1, s1) = self.levels.pop(), self.levels.pop()
            k, s = np.concatenate([k1, k2]), np.concatenate([s1, s2])
            order = np.argsort(k, kind="stable")
            k, s = k[order], s[order]
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            self.levels.append((k[first], s[first]))
        return np.concatenate(found)


def entry_windows(gram: np.ndarray, left: np.ndarray, column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the strings within entries, their entries and their starts."""
    buf, off = tx.texts(column.cast(pa.binary()).view(pa.string()))
    size = np.diff(off)
    n = np.maximum(0, size - length + 1)
    ends = np.cumsum(n)
    entry = np.repeat(np.arange(len(n)), n)
    start = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    at = off[:-1][entry] + start
    h = tx.range_hash(buf, at, at + length, tx._BYTE_CODE)
    with np.errstate(over="ignore"):
        h = tx.mix(h + gram.view(_U)[entry] * _U(0x9E3779B97F4A7C15) + (left[entry] - start).astype(_U))
    return h, entry, start


def covered_ranges(batches: Iterator[pa.RecordBatch], length: int, suffixes: int = FAMILY_SUFFIXES) -> Iterator[pa.RecordBatch]:
    """Of entries, all of a gram in one task, the ranges around their anchors that repeated strings cover.

    Equal strings have one gram and one fingerprint, so whole grams meet in
    families of about ``suffixes``, and a gram of more in several families, each
    of a range of its fingerprints.
    """
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    if table is None or not table.num_rows:
        return
    gram = table["gram"].to_numpy()
    n = np.maximum(0, pc.fill_null(pc.binary_length(table["body"]), 0).to_numpy().astype(_I) - length + 1)
    order = np.argsort(gram, kind="stable")
    gram, total = gram[order], np.concatenate([[0], np.cumsum(n[order])])
    edge = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]]))
    lo = 0
    while lo < len(order):
        fits = int(np.searchsorted(total[edge], total[lo] + suffixes, "right")) - 1
        hi = int(edge[max(fits, int(np.searchsorted(edge, lo, "right")))])
        part = table.take(pa.array(order[lo:hi])).combine_chunks().to_batches()[0]
        left, size = part["left"].to_numpy(zero_copy_only=False).astype(_I), np.diff(tx.texts(part["body"].view(pa.string()))[1])
        whole = part["twice"].to_numpy(zero_copy_only=False) & (size >= length)
        low, high = np.where(whole, 0, 1 << 40), np.where(whole, size - length, -1)
        ranges = max(1, -(-int(total[hi] - total[lo]) // suffixes))
        for k in range(ranges):
            family = Family()
            for base in range(0, hi - lo, 4096):
                some = part.slice(base, 4096)
                key, entry, start = entry_windows(some["gram"].to_numpy(), left[base : base + 4096], some["body"], length)
                suffix = (base + entry) * 4096 + start
                if ranges > 1:
                    on = (key >> _U(32)) * _U(ranges) >> _U(32) == _U(k)
                    key, suffix = key[on], suffix[on]
                hits = family.add(key, suffix)
                np.minimum.at(low, hits >> 12, hits & 4095)
                np.maximum.at(high, hits >> 12, hits & 4095)
        on = high >= 0
        yield pa.RecordBatch.from_arrays([pa.array(part["context"].to_numpy()[on]), pa.array((low - left)[on]), pa.array((high + length - left)[on])], names=["context", "lo", "hi"])
        lo = hi


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, gram: int = GRAM, hot_entries: int = HOT_ENTRIES, with_text: bool = False, map_keys: int = 8_000_000) -> DataFrame:
    """One row a document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, ``kept`` (binary)."""
    small_batches(docs.sparkSession)
    if not 8 <= gram <= length:
        raise ValueError("gram must lie between 8 and length")
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    reach = length - gram

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, off in tx.slices(batch, "text", SLICE_BYTES):
                h, at, doc = anchors(buf, off, length, gram)
                place = places(text_key(buf, off)[doc], at - off[doc])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(_I)), pa.array(place)], names=["gram", "place"])

    found = docs.select("text").mapInArrow(grams, "gram long, place long").groupBy("gram").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a < b")
    found = written(found.select("gram"), "grams")
    n_grams = found.count()
    bits = bit_map(found, "gram", n_grams) if n_grams <= map_keys else None
    repeated = sc.broadcast(bits)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = repeated.value
        seen: set[int] = set()
        for batch in batches:
            for part, buf, off in tx.slices(batch, "text", SLICE_BYTES):
                h, at, doc = anchors(buf, off, length, gram)
                if part.num_columns > 1:  # the places that are wanted are given
                    given = [np.asarray(p, _I) + o for p, o in zip(part.column(1).to_pylist(), off[:-1].tolist())]
                    on = np.isin(at, np.concatenate(given))
                else:
                    on = holds(bits, h.view(_I))
                h, at, doc = h[on], at[on], doc[on]
                start, end = np.maximum(at - reach, off[doc]), np.minimum(at + gram + reach, off[doc + 1])
                with np.errstate(over="ignore"):
                    c = tx.range_hash(buf, start, end, tx._BYTE_CODE)
                    c = tx.mix(c + h * _U(3) + (at - start).astype(_U) * _U(0xD1342543DE82EF95)).view(_I)
                raw = buf.tobytes()
                body: list[bytes | None] = []
                for x, s, e in zip(c.tolist(), start.tolist(), end.tolist()):
                    if x in seen:
                        body.append(None)
                    else:
                        if len(seen) < 500_000:
                            seen.add(x)
                        body.append(raw[s:e])
                pos = at - off[doc]
                key = text_key(buf, off)[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(_I)), pa.array(c), pa.array(key), pa.array(pos.astype(np.int32)), pa.array((at - start).astype(np.int32)), pa.array(places(key, pos)), pa.array(body, pa.binary())],
                    names=["gram", "context", "key", "pos", "left", "place", "body"],
                )

    texts = docs.select("text")
    if bits is None:  # too many grams for a map: those of each text by joins, of narrow rows first

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, buf, off in tx.slices(batch, "text", SLICE_BYTES):
                    h, at, doc = anchors(buf, off, length, gram)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(_I)), pa.array(text_key(buf, off)[doc]), pa.array(at - off[doc])], names=["gram", "key", "pos"])

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, buf, off in tx.slices(batch, "text", SLICE_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array(text_key(buf, off)), part.column(0)], names=["key", "text"])

        wanted = texts.mapInArrow(narrow, "gram long, key long, pos long").join(found, "gram", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("at"))
        texts = texts.mapInArrow(keyed, "key long, text string").join(wanted, "key").select("text", "at")
    rows = written(texts.mapInArrow(contexts, "gram long, context long, key long, pos int, left int, place long, body binary"), "anchors")
    entries = rows.groupBy("gram", "context").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max("left").alias("left"), F.first("body", ignorenulls=True).alias("body"))
    entries = entries.select("gram", "context", "left", "body", (F.col("a") < F.col("b")).alias("twice"))
    hot = [r[0] for r in rows.groupBy("gram").agg(F.approx_count_distinct("context").alias("n")).where(F.col("n") > hot_entries).select("gram").take(1)]

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return covered_ranges(batches, length)

    if length + reach + 1 > 4096:
        raise ValueError("length is too great for the packed suffix places")
    kinds = "context long, lo long, hi long"
    if not hot:
        covered = entries.repartition("gram").mapInArrow(cover, kinds)
    else:
        many = rows.groupBy("gram").agg(F.approx_count_distinct("context").alias("n")).where(F.col("n") > hot_entries).select("gram")
        cold = entries.join(many, "gram", "left_anti").repartition("gram").mapInArrow(cover, kinds)

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    left = part.column(2).to_numpy(zero_copy_only=False).astype(_I)
                    key, entry, start = entry_windows(part.column(0).to_numpy(zero_copy_only=False), left, part.column(3), length)
                    context = part.column(1).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(_I)), pa.array(context[entry]), pa.array(start - left[entry])], names=["string", "context", "lo"])

        heated = entries.join(many, "gram", "left_semi")
        strings = heated.mapInArrow(windows, "string long, context long, lo long")
        again = strings.groupBy("string").agg(F.min("context").alias("a"), F.max("context").alias("b")).where("a < b").select("string")
        far = strings.join(again, "string").groupBy("context").agg(F.min("lo").alias("lo"), (F.max("lo") + length).alias("hi"))
        full = heated.where(F.col("twice") & (F.length("body") >= length)).select("context", (-F.col("left")).cast("long").alias("lo"), (F.length("body") - F.col("left")).cast("long").alias("hi"))
        covered = cold.unionByName(far).unionByName(full).groupBy("context").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = rows.select("context", "key", "pos").distinct().join(covered, "context").select("key", F.struct((F.col("pos") + F.col("lo")).alias("s"), (F.col("pos") + F.col("hi")).alias("e")).alias("span"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, off in tx.slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(text_key(buf, off)), pa.array(np.diff(off))], names=["key", "n"])

    copies = docs.select("text").mapInArrow(keys, "key long, n long").groupBy("key").agg(F.count("*").alias("k"), F.max("n").alias("n")).where(f"k > 1 and n >= {length}")
    spans = spans.unionByName(copies.select("key", F.struct(F.lit(0).cast("long").alias("s"), F.col("n").alias("e")).alias("span")))
    spans = written(spans.groupBy("key").agg(F.collect_list("span").alias("spans")), "spans")
    drop(spark, found, rows)
    marked = sc.broadcast(bit_map(spans, "key"))

    def split(clean: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = marked.value
            for batch in batches:
                for part, buf, off in tx.slices(batch, "text", SLICE_BYTES):
                    key = text_key(buf, off)
                    on = holds(bits, key)
                    if clean:
                        part = part.filter(pa.array(~on))
                        yield report(part, [None] * part.num_rows)
                    else:
                        part = part.filter(pa.array(on))
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(key[on])], names=["doc_id", "text", "key"])

        return run

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def report(part: pa.RecordBatch, lists: list) -> pa.RecordBatch:
        buf, off = tx.texts(part.column(1))
        raw = buf.tobytes()
        removed, count, digest, kept = [], [], [], []
        for a, b, spans in zip(off[:-1].tolist(), off[1:].tolist(), lists):
            body, cuts = raw[a:b], []
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if cuts and s <= cuts[-1][1]:
                    cuts[-1][1] = max(cuts[-1][1], e)
                else:
                    cuts.append([s, e])
            at, left = 0, []
            for s, e in cuts:
                left.append(body[at:s])
                at = e
            left.append(body[at:])
            rest = b"".join(left)
            removed.append(len(body) - len(rest))
            count.append(len(cuts))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        arrays = [part.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
        if with_text:
            arrays.append(pa.array(kept, pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in tx.slices(batch, "text", SLICE_BYTES):
                yield report(part, part.column(2).to_pylist())

    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    clean = docs.mapInArrow(split(True), out)
    touched = docs.mapInArrow(split(False), f"doc_id {kind}, text string, key long").join(spans, "key", "left").select("doc_id", "text", "spans")
    return clean.unionByName(touched.mapInArrow(cut, out))
