"""Errors by who can mend them: the caller, the infrastructure, or the data."""


class InvalidQueryError(ValueError):
    """The query or its bound is not valid."""


class ConfigurationError(Exception):
    """The configuration is missing, malformed or asks for what is not installed."""


class SourceConfigurationError(ValueError):
    """A source is described wrongly."""


class SourceReadError(Exception):
    """A source cannot be read; nothing of it counts."""


class SourceFileTooLargeError(SourceReadError):
    """A file is over the bound."""


class IngestionError(Exception):
    """A document cannot be processed."""


class UnsupportedDocumentFormatError(IngestionError):
    """The suffix names no known format."""


class ChunkingError(ValueError):
    """The chunk bound is not positive."""


class EmbeddingError(Exception):
    """A vector has the wrong length or a value that is not finite."""


class EmbeddingConfigurationError(EmbeddingError):
    """The embedding model cannot be loaded or run."""


class StoreError(Exception):
    """The store cannot be read or written."""


class UnsupportedSchemaVersionError(StoreError):
    """The store was written under another schema version."""


class StoreConflictError(StoreError):
    """Another writer has published what this one would overwrite."""


class IndexUnavailableError(Exception):
    """The lexical index is missing."""


class VectorIndexUnavailableError(Exception):
    """Vector search is not enabled or not built."""


class VectorIndexIncompatibleError(Exception):
    """Vectors of another model than the active index's."""


class HybridFusionError(ValueError):
    """One side of a fusion broke its contract."""


class EvaluationDatasetError(ValueError):
    """The golden set is malformed or names a chunk that does not exist."""


class EvaluationRunnerError(ValueError):
    """A search returned a chunk twice."""
