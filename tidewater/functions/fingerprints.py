"""Digests of what processing or embedding depends on."""

from __future__ import annotations

import hashlib
import json

# fixed values: versions that stored fingerprints hold
NORMALIZATION_VERSION = "newline-v1"
CHUNKING_VERSION = "section-aware-v1"
EMBEDDING_TEXT_VERSION = "title-section-content-v1"


def _digest(**facts: object) -> str:
    return hashlib.sha256(json.dumps(facts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def processing_fingerprint(document_format: str, max_chunk_chars: int) -> str:
    return _digest(
        normalization_version=NORMALIZATION_VERSION, chunking_version=CHUNKING_VERSION, document_format=document_format, max_chunk_chars=max_chunk_chars, overlap=None
    )


def embedding_fingerprint(provider_type: str, model_id: str, model_revision: str | None, dimension: int) -> str:
    return _digest(provider_type=provider_type, model_id=model_id, model_revision=model_revision, dimension=dimension, embedding_text_version=EMBEDDING_TEXT_VERSION)
