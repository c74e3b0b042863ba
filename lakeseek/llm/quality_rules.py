"""Quality rules as a short-circuit cascade.

Each rule looks at the documents that all rules before it kept. The order is
found on a bounded sample: every rule's seconds per document and the share it
rejects are measured there, and rules run by rejections per second. The
verdict is a conjunction, so the order changes the time only, never a verdict;
``rejected_by`` names the rule that came first in the order of that run.

Edge cases: a null or empty text has no words and fails the base; repeated
rows are judged one by one; other columns pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx
from ._shared import small_batches, tidied

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 5
#: Text looked at together; the arrays of a pass take some thirty times as much memory.
SLICE_BYTES = 1 << 19


class Slice:
    """Documents under judgement, with what the rules share, made at first use."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self._kept: dict[str, object] = {}

    def get(self, name: str, make: Callable[[], object]):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def words(self) -> tx.Words:
        return self.get("words", lambda: tx.scan(self.buf, self.off))

    def take(self, rows: np.ndarray) -> Slice:
        """The given documents alone."""
        size = np.diff(self.off)[rows]
        off = np.concatenate([[0], np.cumsum(size)])
        if len(rows) == len(self.off) - 1:
            return self
        at = np.repeat(self.off[:-1][rows] - off[:-1], size) + np.arange(off[-1])
        return Slice(self.buf[at], off)


def base_counts(s: Slice) -> dict[str, np.ndarray]:
    """The five base counts of every document of a slice."""
    buf, off, w = s.buf, s.off, s.words
    lead = (buf & 0xC0) != 0x80
    start, end, doc = tx.lines(buf, off)
    total = np.concatenate([[0], np.cumsum(tx.NOT_SPACE[buf])])
    full = total[end] > total[start]
    start, end, doc = start[full], end[full], doc[full]
    with np.errstate(over="ignore"):
        key = tx.range_hash(buf, start, end, tx._BYTE_CODE) + tx.mix(doc)
        n_docs = len(off) - 1
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        repeated = np.zeros(len(w.hash), bool)
        if len(w.hash) >= WINDOW:
            h = np.zeros(len(w.hash) - WINDOW + 1, np.uint64)
            for j in range(WINDOW):
                h = h * np.uint64(0xFF51AFD7ED558CCD) + w.hash[j : len(h) + j]
            word_doc = np.repeat(np.arange(n_docs), w.counts)
            whole = word_doc[: len(h)] == word_doc[WINDOW - 1 :]
            marked = np.zeros(len(h), bool)
            marked[whole] = tx.repeats(tx.mix(h[whole]) + tx.mix(word_doc[: len(h)][whole]))
            for j in range(WINDOW):
                repeated[j : len(h) + j] |= marked
    return {
        "n_words": w.counts,
        "word_chars": tx.per_doc(lead & tx.NOT_SPACE[buf], off),
        "n_symbols": tx.per_doc(_SYMBOL[buf], off),
        "n_dup_lines": np.bincount(doc[again], minlength=n_docs),
        "n_repeat_words": tx.per_doc(repeated, w.off),
    }


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


@dataclass(frozen=True)
class Rule:
    """``rejects(slice, counts)`` marks the documents to reject."""

    name: str
    rejects: Callable[[Slice, dict[str, np.ndarray]], np.ndarray]


def _symbols(s, c):
    return 10 * c["n_symbols"] > 3 * c["n_words"]


def _word_length(s, c):
    return (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"])


def _dup_lines(s, c):
    start, end, doc = tx.lines(s.buf, s.off)
    total = np.concatenate([[0], np.cumsum(tx.NOT_SPACE[s.buf])])
    n = np.bincount(doc[total[end] > total[start]], minlength=len(s.off) - 1)
    return (2 * c["n_dup_lines"] > n) & (c["n_dup_lines"] >= 3)


def _shouting(s, c):
    upper = tx.per_doc((s.buf >= 65) & (s.buf <= 90), s.off)
    lower = tx.per_doc((s.buf >= 97) & (s.buf <= 122), s.off)
    return upper > lower


def _exclaims(s, c):
    return 10 * tx.per_doc(s.buf == 33, s.off) > 5 * c["n_words"]


def _stutter(s, c):
    w = s.words
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.off[:-1][w.counts > 0]] = False
    return 10 * tx.per_doc(same, w.off) > 3 * c["n_words"]


RULES = (Rule("stutter", _stutter), Rule("symbols", _symbols), Rule("word_length", _word_length), Rule("dup_lines", _dup_lines), Rule("shouting", _shouting), Rule("exclaims", _exclaims))


def judge(s: Slice, counts: dict[str, np.ndarray], rules: tuple[Rule, ...]) -> np.ndarray:
    """Number of the first rule in ``rules`` that rejects each document, 0 for the base, -1 for none."""
    verdict = np.where(base_failed(counts), 0, -1)
    alive = np.flatnonzero(verdict < 0)
    for k, rule in enumerate(rules, 1):
        if not len(alive):
            break
        bad = rule.rejects(s.take(alive), {n: v[alive] for n, v in counts.items()})
        verdict[alive[bad]] = k
        alive = alive[~bad]
    return verdict


def plan(sample: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejections per second on the sample; ties stay in the given order."""
    if not sample:
        return rules
    buf, off = tx.texts(pa.array(sample, pa.string()))
    s = Slice(buf, off)
    counts = base_counts(s)
    alive = np.flatnonzero(~base_failed(counts))
    s, counts = s.take(alive), {n: v[alive] for n, v in counts.items()}
    gain = {}
    for r in rules:
        began = time.perf_counter()
        bad = r.rejects(s, counts)
        gain[r.name] = float(bad.sum()) / max(time.perf_counter() - began, 1e-6)
    return tuple(sorted(rules, key=lambda r: -gain[r.name]))


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 512) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``kept`` and ``rejected_by``.

    ``sample_rows`` bounds the sample, the whole texts of least hash, from which the order of rules is planned;
    all documents are judged, on their whole texts. Input columns of these
    names are replaced.
    """
    new = [*COUNTS, "base_failed", "kept", "rejected_by"]
    docs = docs.drop(*[c for c in new if c in docs.columns])
    small_batches(docs.sparkSession)
    sample = [r[0] for r in docs.select(text).orderBy(F.xxhash64(text), text).limit(sample_rows).collect()]
    ordered = plan(sample, rules)
    names = ["base", *(r.name for r in ordered)]
    schema = T.StructType(list(docs.schema.fields))
    for n in COUNTS:
        schema = schema.add(n, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("rejected_by", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in tx.slices(batch, text, SLICE_BYTES):
                s = Slice(buf, off)
                counts = base_counts(s)
                verdict = judge(s, counts, ordered)
                more = [pa.array(counts[n].astype(np.int64)) for n in COUNTS]
                more += [pa.array(base_failed(counts)), pa.array(verdict < 0), pa.array([names[v] if v >= 0 else None for v in verdict], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *new])

    return docs.mapInArrow(tidied(run), schema)


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id, base counts, ``base_failed``, ``kept`` and the rule that rejected it."""
    return quality_rules(docs.select(F.col(doc_id), F.col(text)), text).drop(text)
