"""Providers of embeddings: for documents as columns, for a query on the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.errors import EmbeddingConfigurationError
from tidewater.functions.fingerprints import embedding_fingerprint
from tidewater.functions.vectors import digest_vector


class EmbeddingProvider(Protocol):
    provider_type: str
    model_id: str
    model_revision: str | None
    dimension: int

    def embed_documents(self, text: Column) -> Column: ...

    def embed_query(self, text: str) -> list[float]: ...


def fingerprint_of(p: EmbeddingProvider) -> str:
    return embedding_fingerprint(p.provider_type, p.model_id, p.model_revision, p.dimension)


class DigestProvider:
    """Deterministic vectors without a model, for tests."""

    provider_type, model_id, model_revision = "fake", "digest", None

    def __init__(self, dimension: int = 8):
        if dimension <= 0:
            raise EmbeddingConfigurationError("dimension must be positive")
        self.dimension = dimension

    def embed_documents(self, text: Column) -> Column:
        return digest_vector(text, self.dimension).cast("array<float>")

    def embed_query(self, text: str) -> list[float]:
        digest = hashlib.sha256(text.encode()).digest()
        return [digest[i % 32] / 255 * 2 - 1 for i in range(self.dimension)]


def _sentence_udf(model_id: str, device: str | None):
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(model_id, device=device)
        for batch in batches:
            yield pd.Series(list(model.encode_document(batch.tolist())))

    # the annotations as types, not text
    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, "array<float>")


class SentenceTransformersProvider:
    """A local sentence model; the package is optional and loaded once a worker."""

    provider_type, model_revision = "sentence_transformers", None

    def __init__(self, model_id: str = "sentence-transformers/all-MiniLM-L6-v2", device: str | None = None):
        self.model_id, self.device = model_id, device
        self._model = self._load()
        self.dimension = self._model.get_sentence_embedding_dimension()

    def _load(self):
        try:
            from sentence_transformers import SentenceTransformer

            return SentenceTransformer(self.model_id, device=self.device)
        except Exception as error:
            raise EmbeddingConfigurationError(f"cannot load {self.model_id}: {error}") from error

    def embed_documents(self, text: Column) -> Column:
        return _sentence_udf(self.model_id, self.device)(text)

    def embed_query(self, text: str) -> list[float]:
        return [float(x) for x in self._model.encode_query(text)]
