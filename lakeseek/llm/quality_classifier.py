"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages, ``PASSAGE`` words each; every passage of the
whole text is encoded. Gated attention (Ilse et al., 2018) weighs the encoded
passages, and the weighted sum is scored. Only document labels are needed:
encoder, attention and scorer are trained together, by plain numpy with Adam.

Passages are described by the shapes of their words (case, last character,
length, repetition), never by labels, language, source or id.

The model is fitted on a bounded sample of labelled training rows: those of
least hash, ``max_documents`` at most, and no more than hold ``max_passages``
passages together (the first row counts whatever its length). A chosen row is
encoded whole, and every document is scored on all its passages.

Edge cases: a null or empty text is one empty passage and gets the score of
that; null labels are left out; without labels of both kinds, every score is
the share of label 1 (0.5 without any label); repeated rows are scored each;
an id labelled twice counts with its lesser label; very long texts are bags of
many passages; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx
from ._shared import drop, small_batches, written

PASSAGE = 48
_LAST = np.zeros(256, np.int64)  # letters and bytes above ASCII
for _k, _chars in enumerate((b",;:", b".?", b"!", b"|", b"#*$%&<>", b"0123456789"), 1):
    _LAST[list(_chars)] = _k
_KINDS = int(_LAST.max()) + 1
_SHAPES = 4 * _KINDS
FEATURES = _SHAPES + 5 + 4 + 2


def describe(w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a slice, and the offsets of the documents' passages."""
    counts = w.counts
    n_pass = np.maximum(1, -(-counts // PASSAGE))
    off = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(off[-1])
    n = len(w.start)
    x = np.zeros((total, FEATURES), np.float32)
    if n:
        doc = np.repeat(np.arange(len(counts)), counts)
        passage = off[:-1][doc] + (np.arange(n) - w.off[:-1][doc]) // PASSAGE
        upper = np.concatenate([[0], np.cumsum((w.buf >= 65) & (w.buf <= 90))])
        ups = upper[w.end] - upper[w.start]
        size = w.end - w.start
        first = w.buf[w.start]
        title = (ups == 1) & (first >= 65) & (first <= 90)
        shout = (ups >= 2) & (2 * ups >= size)
        case = np.where(shout, 2, np.where(title, 1, np.where(ups > 0, 3, 0)))
        shape = case * _KINDS + _LAST[w.buf[w.end - 1]]
        x[:, :_SHAPES] = np.bincount(passage * _SHAPES + shape, minlength=total * _SHAPES).reshape(total, _SHAPES)
        band = np.searchsorted(np.array([2, 4, 7, 12]), size, "right")
        x[:, _SHAPES : _SHAPES + 5] = np.bincount(passage * 5 + band, minlength=total * 5).reshape(total, 5)
        for k in range(1, 5):
            same = np.zeros(n, bool)
            same[k:] = (w.hash[k:] == w.hash[:-k]) & (doc[k:] == doc[:-k])
            x[:, _SHAPES + 4 + k] = np.bincount(passage[same], minlength=total)
        words = np.bincount(passage, minlength=total).astype(np.float32)
        x[:, :-2] /= np.maximum(words, 1)[:, None]
        x[:, -2] = words / PASSAGE
    x[:, -1] = 1
    return x, off


def _segments(v: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.add.reduceat(v, off[:-1], axis=0)


def forward(m: dict[str, np.ndarray], x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of the bags, and what the gradient needs."""
    h = np.tanh(x @ m["W"])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * g) @ m["w"]
    size = np.diff(off)
    bag = np.repeat(np.arange(len(size)), size)
    e = np.exp(e - np.maximum.reduceat(e, off[:-1])[bag])
    a = e / _segments(e, off)[bag]
    z = _segments(h * a[:, None], off)
    logit = np.clip(z @ m["c"] + m["d"][0], -30, 30)
    return 1 / (1 + np.exp(-logit)), (h, t, g, a, z, bag)


def fit(x: np.ndarray, off: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 40, batch: int = 128, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Trains on bags ``x[off[d]:off[d + 1]]`` with labels ``y``."""
    rng = np.random.default_rng(seed)
    std = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    m = {"W": std(x.shape[1], hidden), "V": std(hidden, gate), "U": std(hidden, gate), "w": std(gate), "c": std(hidden), "d": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    x = x.astype(np.float64)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            pick = np.sort(order[lo : lo + batch])
            size = np.diff(off)[pick]
            o = np.concatenate([[0], np.cumsum(size)])
            rows = np.repeat(off[:-1][pick] - o[:-1], size) + np.arange(o[-1])
            xb, yb = x[rows], y[pick]
            p, (h, t, g, a, z, bag) = forward(m, xb, o)
            dl = (p - yb) / len(pick)
            dz = dl[:, None] * m["c"]
            da = (h * dz[bag]).sum(1)
            de = a * (da - _segments(a * da, o)[bag])
            dt, dg = de[:, None] * m["w"] * g * (1 - t * t), de[:, None] * m["w"] * t * g * (1 - g)
            dh = a[:, None] * dz[bag] + dt @ m["V"].T + dg @ m["U"].T
            grad = {"c": z.T @ dl, "d": np.array([dl.sum()]), "w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "W": xb.T @ (dh * (1 - h * h))}
            step += 1
            now = rate * (0.5 ** (epoch // 15))
            for k, d in grad.items():
                d = d + 1e-4 * m[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                m[k] = m[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_documents: int = 6000, max_passages: int = 1_000_000) -> dict[str, np.ndarray]:
    """The model, fitted on the training fold: labelled rows whose crc32(id as text) mod 4 is not 2."""
    small_batches(docs.sparkSession)
    fold = F.crc32(F.col(doc_id).cast("string")) % 4
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isNotNull() & (fold != 2)).groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_documents)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in tx.slices(batch, "_t"):
                x, o = describe(tx.scan(buf, off))
                bags = [x[a:b].tobytes() for a, b in zip(o[:-1], o[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), pa.array(bags, pa.binary()), part.column(2), pa.array(np.diff(o))], names=["id", "bag", "y", "n"])

    bags = written(rows.mapInArrow(encode, "id string, bag binary, y int, n long").withColumn("h", F.xxhash64("id")).withColumn("b", F.xxhash64("bag")), "bags")
    # rows that repeat an id may be many, so the least are taken again, by what is narrow
    least = bags.select("h", "id", "b", "n").orderBy("h", "id", "b").limit(max_documents).collect()
    total = np.cumsum([r["n"] for r in least]) if least else np.zeros(0)
    last = max(1, int(np.searchsorted(total, max_passages, "right")))
    found = []
    if least:
        end = least[min(last, len(least)) - 1]
        found = bags.where(F.struct("h", "id", "b") <= F.struct(F.lit(end["h"]), F.lit(end["id"]), F.lit(end["b"]))).select("id", "bag", "y").dropDuplicates().collect()
    drop(docs.sparkSession, bags)
    found.sort(key=lambda r: (r[0], bytes(r[1])))
    y = np.array([r[2] for r in found], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return {"W": np.zeros((FEATURES, 1)), "V": np.zeros((1, 1)), "U": np.zeros((1, 1)), "w": np.zeros(1), "c": np.zeros(1), "d": np.array([np.log(share / (1 - share))])}
    bags = [np.frombuffer(r[1], np.float32).reshape(-1, FEATURES) for r in found]
    off = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return fit(np.concatenate(bags), off, y)


def classify(docs: DataFrame, model: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row a document: id, ``held_out``, ``score``, ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.items()})
    docs = docs.select(F.col(doc_id), F.col(text), (F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % 4 == 2).alias("held_out"))
    schema = T.StructType([docs.schema[0], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, buf, off in tx.slices(batch, text):
                score, _ = forward(m, *describe(tx.scan(buf, off)))
                score = score.astype(float)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Trains on the training fold and scores all documents."""
    return classify(docs, train(docs, labels, **options))
