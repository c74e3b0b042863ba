"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the normalised words of all test items. Training words are
streamed through it and the longest match that ends at each word is tracked; a
window is ``window`` consecutive words of an item, or a whole shorter item.

Only words that follow each other somewhere in an item can move the automaton
past length one, so numpy marks those stretches first and the automaton walks
them alone. Its results are those of a walk over all words.

Items are cut into shards of about ``SHARD_WORDS`` words, whose automata are
built by tasks and written to the shared folder. A worker loads a shard once
and keeps ``KEPT_SHARDS`` of them, so neither the driver nor a worker holds a
benchmark of any size whole; what all shards hit is put together.

Edge cases: null and empty texts have no words; an item without words has no
window; items count once an id. Item ids are compared as strings; a null item
id is left out of the id list, but its words count, and all items of null ids
are one in ``n_items``. Repeated documents are judged each; very long texts are
scanned whole; an empty table gives no rows, and an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import sys
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._shared import file_system, shared_dir, small_batches, tidied

#: Words of the items of one automaton; an item of more is an automaton by itself. A loaded one takes some 100 MB.
SHARD_WORDS, KEPT_SHARDS = 150_000, 2
#: Text that is led through all shards together, where there are several.
TOGETHER_BYTES = 32 << 20


class SuffixAutomaton:
    """Generalised suffix automaton over integer sequences, one after the other from the root."""

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _new(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        twin = self._new(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    def extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        at = self._new({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = at
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[at] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return at


class Index:
    """Automaton, word numbers and the items of each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = 10):
        self.window = window
        buf, off = tx.texts(pa.array([t for _, t in items], pa.string()))
        w = tx.scan(buf, off, tx.ALNUM, lower=True)
        self.vocab = np.unique(w.hash)
        ids = np.searchsorted(self.vocab, w.hash)
        sam = self.sam = SuffixAutomaton()
        seqs = [ids[a:b].tolist() for a, b in zip(w.off[:-1], w.off[1:])]
        for seq in seqs:
            last = 0
            for c in seq:
                last = sam.extend(last, c)
        n = len(sam.link)
        self.full: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        pairs = set()
        for k, seq in enumerate(seqs):
            pairs.update(zip(seq, seq[1:]))
            at = 0
            for i, c in enumerate(seq, 1):
                at = sam.step[at][c]
                if i >= window:
                    self.full.setdefault(self.at_window(at), set()).add(k)
            if 0 < len(seq) < window:
                while sam.length[sam.link[at]] >= len(seq):
                    at = sam.link[at]
                short.setdefault(at, []).append((len(seq), k))
        order = sorted(range(n), key=sam.length.__getitem__)
        self.short: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        if short:
            for v in order:
                up = self.short[sam.link[v]] if v else []
                self.short[v] = up + short[v] if v in short else up
        self.least = min([window, *(len(s) for s in seqs if s)])
        # one table of all steps takes a fraction of the memory of one a state
        self.flat = {v << 32 | c: to for v, step in enumerate(sam.step) for c, to in step.items()}
        self.pairs = np.unique(np.array([a * (len(self.vocab) + 1) + b for a, b in pairs], np.int64))
        self.names = [None if i is None else str(i) for i, _ in items]

    def state(self) -> dict:
        """What a walk needs, as plain values: workers know this class by value, so pickle finds no name for it."""
        return {**self.__dict__, "sam": (self.sam.link, self.sam.length)}

    @classmethod
    def of(cls, state: dict) -> Index:
        """The automaton of a ``state``; it walks, but takes no further items."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        index.sam = SuffixAutomaton()
        index.sam.step, (index.sam.link, index.sam.length) = [], state["sam"]
        return index

    def at_window(self, v: int) -> int:
        """The state of the last ``window`` words of a match at ``v``."""
        link, length = self.sam.link, self.sam.length
        while length[link[v]] >= self.window:
            v = link[v]
        return v

    def walk(self, ids: list[int], hit: np.ndarray, base: int, found: set[int]) -> None:
        """Streams words; marks covered ones in ``hit[base:]`` and adds items to ``found``."""
        get, link, length = self.flat.get, self.sam.link, self.sam.length
        v = l = 0
        for i, c in enumerate(ids):
            to = get(v << 32 | c)
            while to is None and v:
                v = link[v]
                l = length[v]
                to = get(v << 32 | c)
            if to is not None:
                v = to
                l += 1
            if l >= self.window:
                hit[base + i - self.window + 1 : base + i + 1] = True
                found |= self.full.get(self.at_window(v), ())
            for size, k in self.short[v]:
                if size <= l:
                    hit[base + i - size + 1 : base + i + 1] = True
                    found.add(k)


def hits(index: Index, w: tx.Words) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Covered words of a slice, and the items found by document."""
    hit = np.zeros(len(w.hash), bool)
    found: dict[int, set[int]] = {}
    if not len(index.vocab) or not len(w.hash):
        return hit, found
    at = np.searchsorted(index.vocab, w.hash)
    at[at == len(index.vocab)] = 0
    known = index.vocab[at] == w.hash
    doc_first = np.zeros(len(w.hash), bool)
    doc_first[w.off[:-1][w.counts > 0]] = True
    joined = np.zeros(len(w.hash), bool)
    where = np.flatnonzero(known[1:] & known[:-1] & ~doc_first[1:]) + 1
    if len(index.pairs):
        pair = at[where - 1] * (len(index.vocab) + 1) + at[where]
        k = np.searchsorted(index.pairs, pair)
        k[k == len(index.pairs)] = 0
        joined[where[index.pairs[k] == pair]] = True
    start = np.flatnonzero(known & ~joined)
    stop = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
    long = stop - start >= index.least
    start, stop = start[long], stop[long]
    doc = np.searchsorted(w.off, start, "right") - 1
    for a, b, d in zip(start.tolist(), stop.tolist(), doc.tolist()):
        index.walk(at[a:b].tolist(), hit, a, found.setdefault(d, set()))
    return hit, found


def build_shards(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10, shard_words: int = SHARD_WORDS) -> list[str]:
    """Builds the automata of a benchmark table in tasks; returns their files."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).distinct()
    words = items.select(F.sum(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))).alias("n")).first()["n"] or 0
    path = f"{shared_dir(spark)}/automata"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda x: (x[0] is None, x[0] or "", x[1] or ""))
        ctx, names = TaskContext.get(), []
        while rows:
            n, k = 0, 0
            while k < len(rows) and (not k or n < shard_words):
                n += len((rows[k][1] or "").split())
                k += 1
            name = f"{root}/{ctx.partitionId()}-{len(names)}.pickle"
            draft = f"{name}.{ctx.taskAttemptId()}"
            state = Index(rows[:k], window).state()
            with fs.open_output_stream(draft) as f:
                f.write(pickle.dumps(state, pickle.HIGHEST_PROTOCOL))
            fs.move(draft, name)
            names.append(f"{path}/{ctx.partitionId()}-{len(names)}.pickle")
            rows = rows[k:]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    tasks = max(1, math.ceil(words / shard_words))
    return sorted(r[0] for r in items.repartition(tasks, "id", "text").mapInArrow(tidied(build), "file string").collect())


def _load(file: str) -> Index:
    """An automaton, from this worker's memory if it is one of the last used."""
    kept: OrderedDict = sys.__dict__.setdefault("_lakeseek_automata", OrderedDict())
    if file in kept:
        kept.move_to_end(file)
    else:
        while len(kept) >= KEPT_SHARDS:
            kept.popitem(last=False)
        fs, name = file_system(file)
        with fs.open_input_stream(name) as f:
            kept[file] = Index.of(pickle.loads(f.read()))
    return kept[file]


def all_hits(files: Sequence[str], w: tx.Words) -> tuple[np.ndarray, dict[int, set[str | None]]]:
    """Covered words of a slice and the ids of the items found by document, over all shards."""
    hit = np.zeros(len(w.hash), bool)
    found: dict[int, set[str | None]] = {}
    for file in files:
        index = _load(file)
        now, some = hits(index, w)
        hit |= now
        for d, items in some.items():
            if items:
                found.setdefault(d, set()).update(index.names[k] for k in items)
    return hit, found


def scanned(batches: Iterator[pa.RecordBatch], text: str, files: Sequence[str]) -> Iterator[tuple]:
    """Slices with their words, hits and items; larger ones where several shards must be loaded for each."""
    size = tx.SLICE_BYTES
    if len(files) > KEPT_SHARDS:
        batches, size = tx.together(batches, text, TOGETHER_BYTES), TOGETHER_BYTES
    for batch in batches:
        for part, buf, off in tx.slices(batch, text, size):
            w = tx.scan(buf, off, tx.ALNUM, lower=True)
            yield part, buf, off, w, *all_hits(files, w)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a document: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``."""
    small_batches(docs.sparkSession)
    files = build_shards(benchmark, window=window, shard_words=shard_words)
    docs = docs.select(F.col(doc_id), F.col(text))
    schema = docs.select(doc_id).schema.add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for part, _, _, w, hit, found in scanned(batches, text, files):
            n_hit = tx.per_doc(hit, w.off)
            n_items = np.zeros(len(n_hit), np.int64)
            digest = [none] * len(n_hit)
            for d, items in found.items():
                n_items[d] = len(items)
                digest[d] = hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.counts.astype(np.int64)), pa.array(n_hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array(n_hit > 0)], names=schema.names)

    return docs.mapInArrow(tidied(run), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the spans that test items cover.

    A span runs from the first to the last byte of adjoining covered words; it
    is cut out, with one blank left in its place. A document is dropped where
    covered words exceed ``max_coverage`` of its words. Columns stay as they are.
    """
    small_batches(docs.sparkSession)
    files = build_shards(benchmark, window=window, shard_words=shard_words)
    schema, names = docs.schema, docs.columns
    where = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off, w, hit, _ in scanned(batches, text, files):
            n_hit = tx.per_doc(hit, w.off)
            if n_hit.any():
                column = part.column(where).to_pylist()
                for d in np.flatnonzero(n_hit):
                    a, b = w.off[d], w.off[d + 1]
                    out, at = [], int(off[d])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
                    for s, e in zip(edge[::2], edge[1::2]):
                        out.append(buf[at : w.start[a + s]].tobytes())
                        at = int(w.end[a + e - 1])
                    out.append(buf[at : off[d + 1]].tobytes())
                    column[d] = b" ".join(out).decode("utf-8", "ignore")
                arrays = list(part.columns)
                arrays[where] = pa.array(column, part.schema.field(where).type)
                part = pa.RecordBatch.from_arrays(arrays, schema=part.schema)
                keep = n_hit <= max_coverage * w.counts
                if not keep.all():
                    part = part.filter(pa.array(keep))
            yield part

    return docs.mapInArrow(tidied(run), schema)
