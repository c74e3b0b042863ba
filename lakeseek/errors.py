"""Errors of the engine; wrong arguments raise ``ValueError``."""


class LakeseekError(Exception):
    """Base of all errors below."""


class ConfigurationError(LakeseekError):
    pass


class DocumentLoadError(LakeseekError):
    pass


class ChunkingError(LakeseekError):
    pass


class EmbeddingError(LakeseekError):
    pass


class StoreError(LakeseekError):
    pass


class StoreConnectionError(StoreError):
    pass


class QueryExpansionError(LakeseekError):
    pass


class RerankingError(LakeseekError):
    pass
