"""The engine: ingest DataFrames of documents, retrieve for batches of queries, list histories."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import ConfigurationError
from ..functions import expr
from ..functions.types import document_type as typed
from ..functions.types import normalise_type, utc_now
from ..operators import search
from ..operators.chunk import chunk_documents
from ..operators.embed import add_hash_dense, hash_dense, model_dense, model_sparse
from ..operators.expand import expand
from ..sources.files import pdf_chunks, read_documents
from .filters import TemporalFilter, every, metadata, require
from .store import Store

RESULT = ["query_id", "rank", "chunk_id", "content", "score", "score_origin", "rrf_score", "chunk_type", "chunk_role", "document_id", "document_type", "version", "is_active", "valid_from", "valid_to", "hierarchy", "parent_chunk_id", "parent_content", "source", "metadata", "extra"]


def retrieve_from(
    points: DataFrame,
    queries: DataFrame,
    s: Settings,
    limit: int = 5,
    where=None,
    include_parents: bool = True,
    dense: Callable[[DataFrame], DataFrame] | None = None,
    rerank: Callable[[list[tuple[str, str]]], list[float]] | None = None,
    sparse: Callable[[DataFrame], DataFrame] | None = None,
    stored: tuple[DataFrame, DataFrame] | None = None,
    near: DataFrame | None = None,
) -> DataFrame:
    """The whole pipeline over current points for (``query_id``, ``query``) rows and optional ``variant`` rows.

    ``queries`` may hold several rows of one ``query_id``: ``variant`` 0 is the
    query itself, the rest are expansions. Every variant is searched twice,
    all lists are fused, the pool is reranked by the query itself, and parents
    are looked up. ``stored``: postings and statistics of the collection, if a store keeps them.
    ``near``: (``point_id``, ``dense``) of the searchable points, where ``points`` doesn't hold
    vectors: those that are made by the way would be made for every use of ``points``.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if "variant" not in queries.columns:
        queries = queries.withColumn("variant", F.lit(0))
    active = every(F.col("searchable"), where)
    searchable = points.where(active)
    both = F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant").cast("string"))
    asked = queries.withColumn("_key", both)
    as_queries = asked.select(F.col("_key").alias("query_id"), "query")
    vectors = hash_dense(as_queries, "query_id", "query", s.dense_dimension) if dense is None else dense(as_queries)
    near = search.dense_topk(vectors, (searchable if near is None else near).where(F.col("dense").isNotNull()), s.per_query_limit)
    if sparse is not None:
        words = search.sparse_dot_topk(sparse(as_queries).where(F.col("sparse").isNotNull()), searchable.where(F.col("sparse").isNotNull()), s.per_query_limit)
    else:
        words = search.bm25_topk(as_queries, searchable, s.per_query_limit, collection=points if s.idf_scope == "collection" else None, k1=s.bm25_k1, b=s.bm25_b, stored=stored if s.idf_scope == "collection" else None)
    names = asked.select(F.col("_key"), F.col("query_id").alias("_q"), "variant")
    lists = []
    for offset, found in enumerate((near, words)):
        lists.append(found.join(names, found["query_id"] == names["_key"]).select(F.col("_q").alias("query_id"), "point_id", "rank", (2 * F.col("variant") + offset).alias("list_no")))
    every_list = lists[0].unionByName(lists[1])
    fused = every_list.groupBy("query_id", "point_id").agg(expr.rrf_score(F.collect_list(F.struct("list_no", F.col("rank").cast("long").alias("rank"))), s.rrf_k).alias("rrf_score"), F.min("rank").alias("best_rank"))
    pool = search.first_rows(fused, s.candidate_pool_size, "position", F.round("rrf_score", 12).desc(), F.col("best_rank").asc(), F.col("point_id").asc())
    pool = pool.join(points, "point_id").join(queries.where("variant = 0").select("query_id", "query"), "query_id")
    if rerank is not None:
        hits = search.rerank_model(pool, limit, rerank, s.rerank_fail_open, most=s.rerank_max_chars)
    elif s.rerank_backend == "overlap":
        hits = search.rerank_overlap(pool, limit, most=s.rerank_max_chars)
    else:
        hits = search.unranked(pool, limit)
    hits = search.attach_parents(hits, points) if include_parents else hits.withColumn("parent_content", F.lit(None).cast("string"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return hits.select(
        "query_id", "rank", F.col("point_id").alias("chunk_id"), blank("content").alias("content"), "score", "score_origin", "rrf_score", blank("chunk_type").alias("chunk_type"), blank("chunk_role").alias("chunk_role"),
        blank("document_id").alias("document_id"), blank("document_type").alias("document_type"), F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("is_active", F.lit(False)).alias("is_active"),
        F.col("valid_from_iso").alias("valid_from"), F.col("valid_to_iso").alias("valid_to"), "hierarchy", F.col("parent_point_id").alias("parent_chunk_id"), "parent_content", blank("source").alias("source"), F.col("meta").alias("metadata"), F.col("chunk_extra").alias("extra"),
    )


def build_points(chunks: DataFrame) -> DataFrame:
    """Point ids of chunks and of their parents from document, version and sequence."""
    ids = expr.point_id(F.col("document_id"), F.col("version"), F.col("sequence"))
    parent = F.when(F.col("parent_sequence").isNotNull(), expr.point_id(F.col("document_id"), F.col("version"), F.col("parent_sequence")))
    return chunks.withColumn("point_id", ids).withColumn("parent_point_id", parent)


class Lakeseek:
    """A store with settings and optional plug-ins.

    ``embedder``, ``sparse_embedder``: factories of models, called on workers;
    ``reranker``: a function that scores pairs; ``complete``: a language model for expansion.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, embedder: Callable | None = None, sparse_embedder: Callable | None = None, reranker: Callable | None = None, complete: Callable[[str], str] | None = None):
        self.spark, self.s = spark, settings or Settings.from_env()
        self.embedder, self.sparse_embedder, self.reranker, self.complete = embedder, sparse_embedder, reranker, complete
        if self.s.dense_backend == "plugin" and embedder is None:
            raise ConfigurationError("dense_backend 'plugin' needs an embedder")
        if self.s.sparse_backend == "plugin" and sparse_embedder is None:
            raise ConfigurationError("sparse_backend 'plugin' needs a sparse embedder")
        if self.s.rerank_backend == "plugin" and reranker is None:
            raise ConfigurationError("rerank_backend 'plugin' needs a reranker")
        if self.s.expansion_backend == "plugin" and complete is None:
            raise ConfigurationError("expansion_backend 'plugin' needs a language model")
        self.store = Store(spark, path)
        self.store.ensure_ready(embedder().dimension if embedder else self.s.dense_dimension)

    def __enter__(self) -> Lakeseek:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open; closing is for symmetry with other stores."""

    def ingest(self, docs: DataFrame, now: datetime | None = None, ingest_id: str | None = None) -> DataFrame:
        """Ingests (document_id, document_type, content[, source, meta, seq]) rows as new versions; returns (document_id, version).

        Rows of one document become successive versions in the order of ``seq``.
        An ``ingest_id`` makes a repeated call the same ingest: what it made is returned, and nothing is made again.
        """
        for name, kind in (("source", "string"), ("meta", "string"), ("seq", "long")):
            if name not in docs.columns:
                docs = docs.withColumn(name, F.lit(None).cast(kind))
        docs = docs.select("document_id", typed(F.col("document_type")).alias("document_type"), "source", "content", "meta", "seq")
        order = Window.partitionBy("document_id").orderBy(F.col("seq").asc_nulls_first(), F.xxhash64("content"))
        numbered = docs.withColumn("_nth", F.row_number().over(order))

        def chunks() -> DataFrame:
            last = self.store.latest().select("document_id", F.col("version").alias("_last"))
            new = numbered.join(last, "document_id", "left")
            return chunk_documents(new.withColumn("version", (F.coalesce("_last", F.lit(0)) + F.col("_nth")).cast("int")).drop("_nth", "_last", "seq"), self.s)

        return self._write(chunks, now, ingest_id)

    def _write(self, make: Callable[[], DataFrame], now: datetime | None, ingest_id: str | None = None) -> DataFrame:
        """Embeds chunks of new versions, appends them, then their events; ``make`` gives the chunks once the store is claimed."""
        now, ingest = now or utc_now(), ingest_id or uuid.uuid4().hex
        ts = now.timestamp()
        with self.store.claim():
            if ingest_id is None or not self.store.knows(ingest):
                chunks = build_points(make())
                if self.embedder is None:
                    chunks = add_hash_dense(chunks, "content", self.s.dense_dimension)
                else:
                    chunks = model_dense(chunks, "content", self.embedder)
                if self.sparse_embedder is None:
                    chunks = chunks.withColumn("sparse", F.lit(None).cast("struct<indices:array<bigint>,values:array<double>>"))
                else:
                    chunks = model_sparse(chunks, "content", self.sparse_embedder)
                points = chunks.withColumn("valid_from", F.lit(ts)).withColumn("valid_from_iso", F.lit(now.isoformat())).withColumn("ingest_id", F.lit(ingest)).withColumn("meta", F.coalesce("meta", F.lit("{}"))).withColumn("n_words", F.size(expr.tokens(F.col("content"))).cast("long"))
                self.store.upsert(points, ingest, again=ingest_id is not None)
                new = self.store.points().where(F.col("ingest_id") == ingest).select("document_id", "version").distinct()
                self.store.append_ingests(new.select("document_id", "version", F.lit(ingest).alias("ingest_id"), F.lit(ts).alias("ts"), F.lit(now.isoformat()).alias("ts_iso")))
        return self.store.events().where((F.col("ingest_id") == ingest) & (F.col("kind") == "ingest")).select("document_id", "version")

    def ingest_text(self, content: str, document_type: str, metadata: Mapping[str, Any] | None = None, source_name: str = "", now: datetime | None = None) -> str:
        """Ingests one text; its id is ``document_id`` of the metadata, else from the source name, else random."""
        if not (content or "").strip():
            raise ValueError("content must not be blank")
        kind = normalise_type(document_type)
        if kind == "pdf":
            raise ValueError("PDF can't be ingested as text")
        meta = dict(metadata or {})
        try:
            json.dumps(meta)
        except TypeError as e:
            raise ValueError(f"metadata can't be written as JSON: {e}") from e
        given = meta.pop("document_id", None)
        row = [(given, source_name or None, kind, source_name or "inline", content, json.dumps(meta, ensure_ascii=False))]
        df = self.spark.createDataFrame(row, "given string, name string, document_type string, source string, content string, meta string")
        derived = expr.slug(expr.stem(F.col("name")))
        name = given or (df.select(F.when(derived != "", derived)).first()[0] if source_name else None) or uuid.uuid4().hex
        self.ingest(df.select(F.lit(str(name)).alias("document_id"), "document_type", "source", "content", "meta"), now)
        return str(name)

    def ingest_document(self, path: str, document_type: str, metadata: Mapping[str, Any] | None = None) -> str:
        """Ingests one file; its id is ``document_id`` of the metadata, else from the file name."""
        kind = normalise_type(document_type)
        meta = dict(metadata or {})
        if kind == "pdf" or path.lower().endswith(".pdf") and kind in ("legal", "text"):
            return self._ingest_pdf(path, kind, meta)
        row = read_documents(self.spark, path, document_type).first()
        return self.ingest_text(row["content"], document_type, {"document_id": row["document_id"]} | meta, row["source"])

    def ingest_pdfs(self, paths: str | list[str], document_type: str = "pdf", metadata: Mapping[str, Any] | None = None, now: datetime | None = None) -> DataFrame:
        """Ingests PDF files, each read and chunked by the task that holds it; ids come from the file names, or one file's from the metadata."""
        kind, meta = normalise_type(document_type), dict(metadata or {})
        given = meta.pop("document_id", None)
        found = pdf_chunks(self.spark, paths, kind, str(meta.get("domain", "")), self.s)
        if given is not None:
            found = found.withColumn("document_id", F.lit(str(given)))
        found = found.withColumn("meta", F.lit(json.dumps(meta, ensure_ascii=False)))

        def chunks() -> DataFrame:
            last = self.store.latest().select("document_id", F.col("version").alias("_last"))
            return found.join(last, "document_id", "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_last")

        return self._write(chunks, now)

    def _ingest_pdf(self, path: str, kind: str, meta: dict) -> str:
        return self.ingest_pdfs(path, kind, meta).first()["document_id"]

    def retrieve(self, queries: DataFrame, limit: int = 5, temporal_filter: Any = None, metadata_filter: Mapping[str, Any] | None = None, include_parent_context: bool = True) -> DataFrame:
        """Result rows for (``query_id``, ``query``) rows."""
        if limit < 1:
            raise ValueError("limit must be at least 1")
        require(self.s.required_filter_keys, metadata_filter)
        where = every(TemporalFilter.of(temporal_filter).predicate(), metadata(metadata_filter))
        dense = None if self.embedder is None else lambda q: model_dense(q, "query", self.embedder, queries=True)
        sparse = None if self.sparse_embedder is None else lambda q: model_sparse(q, "query", self.sparse_embedder, queries=True)
        return retrieve_from(self.store.current(), queries.withColumn("query", expr.strip(F.col("query"))), self.s, limit, where, include_parent_context, dense, self.reranker, sparse, self.store.postings())

    def retrieve_one(self, query: str, limit: int = 5, temporal_filter: Any = None, metadata_filter: Mapping[str, Any] | None = None, include_parent_context: bool = True) -> list[dict]:
        """Result dictionaries for one query, best first, with expansion if there is a language model."""
        if not (query or "").strip():
            raise ValueError("query must not be blank")
        variants = expand(query.strip(), self.complete, self.s.num_query_expansions) if self.complete and self.s.expansion_backend != "none" else []
        df = self.spark.createDataFrame([("q", k, v) for k, v in enumerate([query.strip(), *variants])], "query_id string, variant int, query string")
        rows = self.retrieve(df, limit, temporal_filter, metadata_filter, include_parent_context).orderBy("rank").collect()
        out = []
        for r in rows:
            d = r.asDict(recursive=True)
            d.pop("query_id"), d.pop("rank")
            out.append(d | {"metadata": json.loads(d["metadata"] or "{}"), "extra": json.loads(d["extra"] or "{}")})
        return out

    def history(self, document_id: str) -> list[dict]:
        """Versions of a document in order; an unknown one has none."""
        return [r.asDict() for r in self.store.history(document_id).drop("document_id").orderBy("version").collect()]
