"""Adapters of public model libraries to the plug-in interfaces.

A library is imported when a worker, or for language models the driver, first
needs it; none is a dependency. Instances are small and can be sent to workers:
``lambda: FastEmbedDense("...")`` is a factory for ``Lakeseek``. Calls that fail in
passing are tried again; what fails for good is an error of the engine.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence
from typing import Any

from ..errors import ConfigurationError, EmbeddingError, QueryExpansionError, RerankingError
from ..functions.retry import retry

API_CHARS = 8192


def library(name: str) -> Any:
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise ConfigurationError(f"this adapter needs the {name.split('.')[0]} package") from e


def with_prefix(texts: Sequence[str], model: str, query: bool) -> list[str]:
    """Texts with the prefix that E5 models want; others get them as they are."""
    return [("query: " if query else "passage: ") + t for t in texts] if "e5" in model.lower() else list(texts)


def for_api(texts: Sequence[str], most: int = API_CHARS) -> list[str]:
    """At most ``most`` characters each; a blank text becomes one blank."""
    return [t[:most] if t.strip() else " " for t in texts]


def positive(indices: Sequence, values: Sequence) -> dict[int, float]:
    return {int(i): float(w) for i, w in zip(indices, values) if float(w) > 0}


class _Lazy:
    """Makes its model at first use and leaves it behind when it is sent elsewhere."""

    error: type[Exception] = EmbeddingError
    _model: Any = None

    def make(self) -> Any:
        raise NotImplementedError

    @property
    def model(self) -> Any:
        if self._model is None:
            self._model = self.make()
        return self._model

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_model"}

    def call(self, what: Callable[[], Any]) -> Any:
        try:
            return retry(what)
        except ConfigurationError:
            raise
        except Exception as e:
            raise self.error(f"{type(e).__name__}: {e}") from e


class FastEmbedDense(_Lazy):
    """Dense vectors by fastembed; E5 models get their prefixes."""

    def __init__(self, name: str = "intfloat/multilingual-e5-large", dimension: int = 1024, batch: int = 32):
        self.name, self.dimension, self.batch = name, dimension, batch

    def make(self) -> Any:
        return library("fastembed").TextEmbedding(model_name=self.name)

    def _embed(self, texts: Sequence[str], query: bool) -> list[list[float]]:
        given = with_prefix(texts, self.name, query)
        return self.call(lambda: [[float(x) for x in v] for v in self.model.embed(given, batch_size=self.batch)])

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        return self._embed(texts, False)

    def embed_queries(self, texts: Sequence[str]) -> list[list[float]]:
        return self._embed(texts, True)


class FastEmbedSparse(_Lazy):
    """Term weights by fastembed, such as BM25 without the inverse document frequency."""

    def __init__(self, name: str = "Qdrant/bm25", batch: int = 64):
        self.name, self.batch = name, batch

    def make(self) -> Any:
        return library("fastembed").SparseTextEmbedding(model_name=self.name)

    def embed_documents(self, texts: Sequence[str]) -> list[dict[int, float]]:
        return self.call(lambda: [positive(v.indices, v.values) for v in self.model.embed(list(texts), batch_size=self.batch)])

    def embed_queries(self, texts: Sequence[str]) -> list[dict[int, float]]:
        return self.call(lambda: [positive(v.indices, v.values) for v in self.model.query_embed(list(texts))])


class BgeM3(_Lazy):
    """Dense vectors of BGE-M3; ``sparse`` gives its lexical weights by the same interface."""

    dimension = 1024

    def __init__(self, name: str = "BAAI/bge-m3", sparse: bool = False, batch: int = 32):
        self.name, self.sparse, self.batch = name, sparse, batch

    def make(self) -> Any:
        return library("FlagEmbedding").BGEM3FlagModel(self.name)

    def embed_documents(self, texts: Sequence[str]) -> list:
        out = self.call(lambda: self.model.encode(list(texts), batch_size=self.batch, return_dense=not self.sparse, return_sparse=self.sparse))
        if self.sparse:
            return [positive(w.keys(), w.values()) for w in out["lexical_weights"]]
        return [[float(x) for x in v] for v in out["dense_vecs"]]

    embed_queries = embed_documents


class CohereDense(_Lazy):
    """Dense vectors by Cohere's service, in batches of ``batch``."""

    def __init__(self, key: str | None = None, name: str = "embed-multilingual-v3.0", dimension: int = 1024, batch: int = 96):
        self.key, self.name, self.dimension, self.batch = key, name, dimension, batch

    def make(self) -> Any:
        return library("cohere").ClientV2(api_key=self.key)

    def _embed(self, texts: Sequence[str], kind: str) -> list[list[float]]:
        given, out = for_api(texts), []
        for lo in range(0, len(given), self.batch):
            part = given[lo : lo + self.batch]
            got = self.call(lambda part=part: self.model.embed(texts=part, model=self.name, input_type=kind, embedding_types=["float"]))
            out += [[float(x) for x in v] for v in got.embeddings.float_]
        return out

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        return self._embed(texts, "search_document")

    def embed_queries(self, texts: Sequence[str]) -> list[list[float]]:
        return self._embed(texts, "search_query")


class _Reranker(_Lazy):
    """Scores (query, text) pairs; pairs of one query go together."""

    error = RerankingError

    def together(self, query: str, texts: list[str]) -> list[float]:
        raise NotImplementedError

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        by: dict[str, list[int]] = {}
        for k, (q, _) in enumerate(pairs):
            by.setdefault(q, []).append(k)
        out = [0.0] * len(pairs)
        for q, rows in by.items():
            got = self.call(lambda q=q, rows=rows: self.together(q, [pairs[k][1] for k in rows]))
            if len(got) != len(rows):
                raise RerankingError(f"{len(got)} scores for {len(rows)} texts")
            for k, x in zip(rows, got):
                out[k] = float(x)
        return out


class FastEmbedReranker(_Reranker):
    def __init__(self, name: str = "jinaai/jina-reranker-v2-base-multilingual"):
        self.name = name

    def make(self) -> Any:
        return library("fastembed.rerank.cross_encoder").TextCrossEncoder(model_name=self.name)

    def together(self, query: str, texts: list[str]) -> list[float]:
        return list(self.model.rerank(query, texts))


class BgeReranker(_Reranker):
    def __init__(self, name: str = "BAAI/bge-reranker-v2-m3"):
        self.name = name

    def make(self) -> Any:
        return library("FlagEmbedding").FlagReranker(self.name)

    def together(self, query: str, texts: list[str]) -> list[float]:
        got = self.model.compute_score([[query, t] for t in texts], normalize=True)
        return list(got) if isinstance(got, (list, tuple)) or hasattr(got, "__len__") else [got]


class CohereReranker(_Reranker):
    def __init__(self, key: str | None = None, name: str = "rerank-v3.5"):
        self.key, self.name = key, name

    def make(self) -> Any:
        return library("cohere").ClientV2(api_key=self.key)

    def together(self, query: str, texts: list[str]) -> list[float]:
        got = self.model.rerank(model=self.name, query=query, documents=for_api(texts, 16_000), top_n=len(texts))
        out = [0.0] * len(texts)
        for r in got.results:
            out[r.index] = float(r.relevance_score)
        return out


class _Language(_Lazy):
    error = QueryExpansionError

    def say(self, prompt: str) -> str:
        raise NotImplementedError

    def __call__(self, prompt: str) -> str:
        return self.call(lambda: self.say(prompt)) or ""


class OpenAiLanguage(_Language):
    """Any service with OpenAI's interface; ``base_url`` names another."""

    def __init__(self, name: str, key: str | None = None, base_url: str | None = None):
        self.name, self.key, self.base_url = name, key, base_url

    def make(self) -> Any:
        return library("openai").OpenAI(api_key=self.key, base_url=self.base_url)

    def say(self, prompt: str) -> str:
        return self.model.chat.completions.create(model=self.name, messages=[{"role": "user", "content": prompt}]).choices[0].message.content


class AnthropicLanguage(_Language):
    def __init__(self, name: str, key: str | None = None, most_tokens: int = 512):
        self.name, self.key, self.most_tokens = name, key, most_tokens

    def make(self) -> Any:
        return library("anthropic").Anthropic(api_key=self.key)

    def say(self, prompt: str) -> str:
        reply = self.model.messages.create(model=self.name, max_tokens=self.most_tokens, messages=[{"role": "user", "content": prompt}])
        return "".join(getattr(part, "text", "") for part in reply.content)


class CohereLanguage(_Language):
    def __init__(self, name: str = "command-r", key: str | None = None):
        self.name, self.key = name, key

    def make(self) -> Any:
        return library("cohere").ClientV2(api_key=self.key)

    def say(self, prompt: str) -> str:
        reply = self.model.chat(model=self.name, messages=[{"role": "user", "content": prompt}])
        return "".join(getattr(part, "text", "") for part in reply.message.content)
