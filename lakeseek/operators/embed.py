"""Embeddings: native hash vectors by default, models as plug-ins that run on workers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EmbeddingError
from ..functions import expr
from .batches import small_batches, tidied


Texts = Sequence[str]
Vectors = list[list[float]]
Weights = list[dict[int, float]]


class DenseEmbedder(Protocol):
    """A model: ``dimension``, and vectors for documents and for queries. It is made on each worker by a factory."""

    dimension: int

    def embed_documents(self, texts: Texts) -> Vectors: ...

    def embed_queries(self, texts: Texts) -> Vectors: ...


class SparseEmbedder(Protocol):
    """A model that gives term ids and weights."""

    def embed_documents(self, texts: Texts) -> Weights: ...

    def embed_queries(self, texts: Texts) -> Weights: ...


def _md5_bucket(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def _sha1_bucket(word: str) -> int:
    return int(hashlib.sha1(word.encode()).hexdigest()[:8], 16)


#: Ways to hash: the words of a text (as a column), and the number of a word.
WORDS: dict[str, tuple[Callable[[Column], Column], Callable[[str], int]]] = {
    "md5": (expr.tokens, _md5_bucket),
    "sha1": (lambda x: F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""), _sha1_bucket),
}


def _cells(df: DataFrame, keys: list[str], text: str, size: int, way: str, build: Callable[[np.ndarray, np.ndarray, int], tuple[list[pa.Array], np.ndarray | None]], fields: list[T.StructField]) -> DataFrame:
    """The columns ``keys`` and what ``build`` makes of each batch's (row, bucket) pairs: a row function, without a shuffle."""
    small_batches(df.sparkSession)
    words, number = WORDS[way]
    names = [*keys, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            lists = batch.column(len(keys))
            n = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            coded = lists.flatten().dictionary_encode()
            found = []
            for w in coded.dictionary.to_pylist():
                if (b := known.get(w)) is None:
                    b = number(w) % size
                    if len(known) < 200_000:
                        known[w] = b
                found.append(b)
            bucket = np.array(found, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if found else np.zeros(0, np.int64)
            columns, keep = build(np.repeat(np.arange(batch.num_rows), n), bucket, batch.num_rows)
            given = batch.columns[: len(keys)]
            yield pa.RecordBatch.from_arrays([*(c if keep is None else c.take(pa.array(keep)) for c in given), *columns], names=names)

    rows = df.select(*keys, F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("_w"))
    return rows.mapInArrow(tidied(run), T.StructType([*(df.schema[k] for k in keys), *fields]))


def hash_sparse(df: DataFrame, key: str, text: str, size: int = 1_000_000, way: str = "md5") -> DataFrame:
    """(``key``, ``indices``, ``values``): counts by hashed word, by ascending index; no row for a text without words."""

    def build(row: np.ndarray, bucket: np.ndarray, n: int):
        cell, count = np.unique(row * size + bucket, return_counts=True)
        off = np.searchsorted(cell, np.arange(n + 1) * size)
        keep = np.flatnonzero(np.diff(off))
        off = pa.array(np.append(off[:-1][keep], off[-1]).astype(np.int32))
        return [pa.ListArray.from_arrays(off, pa.array(cell % size)), pa.ListArray.from_arrays(off, pa.array(count.astype(float)))], keep

    return _cells(df, [key], text, size, way, build, [T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType()))])


def hash_dense(df: DataFrame, key: str, text: str, dimension: int = 64, way: str = "md5") -> DataFrame:
    """(``key``, ``dense``): counts in ``dimension`` buckets, of length one; a text without words gives zeros."""
    return add_hash_dense(df.select(key, text), text, dimension, way).select(key, "dense")


def add_hash_dense(df: DataFrame, text: str, dimension: int = 64, way: str = "md5") -> DataFrame:
    """All columns and ``dense``."""

    def build(row: np.ndarray, bucket: np.ndarray, n: int):
        count = np.bincount(row * dimension + bucket, minlength=n * dimension).reshape(n, dimension).astype(float)
        norm = np.sqrt((count * count).sum(axis=1, keepdims=True))
        count /= np.where(norm > 0, norm, 1)
        return [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dimension), pa.array(count.ravel()))], None

    return _cells(df, df.columns, text, dimension, way, build, [T.StructField("dense", T.ArrayType(T.DoubleType()))])


def model_dense(df: DataFrame, text: str, make: Callable[[], DenseEmbedder], queries: bool = False, batch: int = 32) -> DataFrame:
    """All columns and ``dense``, by a model that each worker makes once; wrong numbers or lengths of vectors are errors."""
    names = df.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "dense array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        call = model.embed_queries if queries else model.embed_documents
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                texts = [t or "" for t in part.column(names.index(text)).to_pylist()]
                got = call(texts)
                if len(got) != len(texts) or any(len(v) != model.dimension for v in got):
                    raise EmbeddingError(f"{len(got)} vectors for {len(texts)} texts, or of a dimension other than {model.dimension}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([[float(x) for x in v] for v in got], pa.list_(pa.float64()))], names=[*names, "dense"])

    return df.mapInArrow(run, schema)


def model_sparse(df: DataFrame, text: str, make: Callable[[], SparseEmbedder], queries: bool = False, batch: int = 64) -> DataFrame:
    """All columns and ``sparse``: term ids and weights by ascending id, without weights of zero or less; no term, no vector."""
    names = df.columns
    kind = pa.struct([("indices", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "sparse struct<indices:array<bigint>,values:array<double>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        call = model.embed_queries if queries else model.embed_documents
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                texts = [t or "" for t in part.column(names.index(text)).to_pylist()]
                got = call(texts)
                if len(got) != len(texts):
                    raise EmbeddingError(f"{len(got)} sparse vectors for {len(texts)} texts")
                cells = [sorted((int(i), float(w)) for i, w in v.items() if w > 0) for v in got]
                out = [{"indices": [i for i, _ in c], "values": [w for _, w in c]} if c else None for c in cells]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], names=[*names, "sparse"])

    return df.mapInArrow(run, schema)


def unit(vector: Sequence[float]) -> list[float]:
    """A vector of length one; zeros stay."""
    n = math.sqrt(sum(x * x for x in vector))
    return [x / n for x in vector] if n else list(vector)
