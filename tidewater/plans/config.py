"""Settings from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from tidewater.errors import ConfigurationError
from tidewater.plans.service import STRATEGIES
from tidewater.sources.files import MAX_FILE_BYTES

DEFAULT_MODEL = "sentence-transformers/all-MiniLM-L6-v2"


@dataclass(frozen=True)
class Config:
    source_id: str
    root: Path
    db_path: Path
    max_file_size_bytes: int = MAX_FILE_BYTES
    max_chunk_chars: int = 1000
    default_strategy: str = "lexical"
    embeddings_enabled: bool = False
    provider: str = "sentence_transformers"
    model_id: str = DEFAULT_MODEL


def _section(raw: dict, name: str, allowed: tuple[str, ...] | None) -> dict:
    found = raw.get(name, {})
    if allowed is not None and (extra := set(found) - set(allowed)):
        raise ConfigurationError(f"[{name}] has unknown keys: {sorted(extra)}")
    return found


def load_config(path: str | Path) -> Config:
    """Reads a configuration; relative paths start at its folder. Unknown sections and unknown keys of source and persistence are ignored, others are refused."""
    path = Path(path)
    if not path.is_file():
        raise ConfigurationError(f"no such file: {path}")
    try:
        raw = tomllib.loads(path.read_text("utf-8"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as error:
        raise ConfigurationError(f"not TOML: {error}") from error
    source, store = _section(raw, "source", None), _section(raw, "persistence", None)
    processing, retrieval = _section(raw, "processing", ("max_chunk_chars",)), _section(raw, "retrieval", ("default_strategy",))
    embeddings = _section(raw, "embeddings", ("enabled", "provider", "model_id"))

    def place(value: object, name: str) -> Path:
        if not isinstance(value, str) or not value.strip():
            raise ConfigurationError(f"{name} must be a path")
        return (path.resolve().parent / value).resolve() if not Path(value).is_absolute() else Path(value)

    found = Config(
        source_id=source.get("source_id", ""),
        root=place(source.get("root"), "source.root"),
        db_path=place(store.get("db_path"), "persistence.db_path"),
        max_file_size_bytes=source.get("max_file_size_bytes", MAX_FILE_BYTES),
        max_chunk_chars=processing.get("max_chunk_chars", 1000),
        default_strategy=retrieval.get("default_strategy", "lexical"),
        embeddings_enabled=embeddings.get("enabled", False),
        provider=embeddings.get("provider", "sentence_transformers"),
        model_id=embeddings.get("model_id", DEFAULT_MODEL),
    )
    positive = all(isinstance(x, int) and x > 0 for x in (found.max_file_size_bytes, found.max_chunk_chars))
    if not isinstance(found.source_id, str) or not found.source_id or not positive or found.default_strategy not in STRATEGIES:
        raise ConfigurationError("source_id, a bound or the default strategy is not valid")
    if found.embeddings_enabled and (found.provider not in ("sentence_transformers", "fake") or not found.model_id.strip()):
        raise ConfigurationError("the embedding provider or its model is not valid")
    return found
