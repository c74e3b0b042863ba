"""Settings that change results, with their bounds; ``LAKESEEK_*`` variables override defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from .errors import ConfigurationError

#: Texts that the chunkers write into contents; part of embeddings and tests.
LABELS = {
    "context": "Kontext",
    "above": "Übergeordneter Textkontext",
    "capped": "\n… [Inhalt für Parent-Kontext gekürzt]",
    "file": "Datei",
    "json_path": "JSON-Pfad",
    "json_doc": "JSON-Dokument",
    "json_shape": "Strukturübersicht",
    "part": "Teil",
    "table_part": "Tabellen-Teil",
    "schema": "Schema für Tabelle",
    "data": "Daten für Tabelle",
    "batch": "Batch",
    "misc": "Allgemeine Dump-Anweisungen",
    "page": "Seite",
}

_BOUNDS = {"chunk_max_tokens": (64, None), "parent_max_tokens": (256, None), "table_hard_max_tokens": (256, None), "num_query_expansions": (1, 8), "rrf_k": (1, None), "per_query_limit": (1, None), "candidate_pool_size": (1, None), "chunk_overlap_tokens": (0, None), "min_chunk_tokens": (1, None)}
_CHOICES = {"tokenizer_backend": {"heuristic", "hf"}, "dense_backend": {"hash", "plugin"}, "sparse_backend": {"bm25", "plugin"}, "rerank_backend": {"overlap", "plugin", "none"}, "expansion_backend": {"none", "plugin"}, "idf_scope": {"collection", "filtered"}}


@dataclass(frozen=True)
class Settings:
    """``keep_tables_whole`` keeps tables up to ``table_hard_max_tokens`` in one chunk; off, they are resplit like text above 1.5 times ``chunk_max_tokens``."""

    chunk_max_tokens: int = 480
    chunk_overlap_tokens: int = 64
    parent_max_tokens: int = 1800
    min_chunk_tokens: int = 24
    table_hard_max_tokens: int = 4000
    keep_tables_whole: bool = False
    strip_leading_comments: bool = False
    tokenizer_backend: str = "heuristic"
    tokenizer_model: str = ""
    per_query_limit: int = 50
    candidate_pool_size: int = 50
    rrf_k: int = 60
    required_filter_keys: tuple[str, ...] = ()
    dense_backend: str = "hash"
    dense_dimension: int = 64
    sparse_backend: str = "bm25"
    idf_scope: str = "collection"
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rerank_backend: str = "overlap"
    rerank_fail_open: bool = False
    rerank_max_chars: int = 16_000
    expansion_backend: str = "none"
    num_query_expansions: int = 3
    labels: Mapping[str, str] = field(default_factory=lambda: dict(LABELS))

    def __post_init__(self):
        for name, (low, high) in _BOUNDS.items():
            v = getattr(self, name)
            if v < low or high is not None and v > high:
                raise ConfigurationError(f"{name}={v} is out of bounds")
        for name, allowed in _CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ConfigurationError(f"{name} must be one of {sorted(allowed)}")

    @classmethod
    def from_env(cls, **given) -> Settings:
        for f in fields(cls):
            raw = os.environ.get(f"LAKESEEK_{f.name.upper()}")
            if raw is not None and f.name not in given and f.name != "labels":
                given[f.name] = raw.lower() in ("1", "true", "yes") if f.type == "bool" else int(raw) if f.type == "int" else float(raw) if f.type == "float" else tuple(x for x in raw.split(",") if x) if f.name == "required_filter_keys" else raw
        return cls(**given)
