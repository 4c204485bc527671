"""Columns for text: normalisation, identities, formats, display."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.errors import UnsupportedDocumentFormatError

UNIT = "\x1f"
ID_DIGITS = 24
FORMATS = {".md": "markdown", ".txt": "plain_text"}


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR become LF; nothing else changes."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _named(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(UNIT, *parts), 256), 1, ID_DIGITS))


def document_id(source_id: Column, path: Column) -> Column:
    """The identity of a document: its source and normalised path."""
    return _named("doc_", source_id, path)


def section_identity(section_path: Column) -> Column:
    return F.array_join(section_path, UNIT)


def chunk_id(document: Column, section_path: Column, occurrence: Column, ordinal_in_section: Column) -> Column:
    """The identity of a chunk: place, not content."""
    return _named("chunk_", document, section_identity(section_path), occurrence.cast("string"), ordinal_in_section.cast("string"))


def path_problem(path: Column) -> Column:
    """Why a relative path is not acceptable, or null."""
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashes, "/"), lambda p: p != ".")
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "empty")
        .when(slashes.startswith("/") | slashes.rlike("^[A-Za-z]:"), "absolute")
        .when(F.array_contains(parts, ""), "empty segment")
        .when(F.array_contains(parts, ".."), "parent traversal")
        .when(F.size(parts) == 0, "no segment")
    )


def normalized_path(path: Column) -> Column:
    """Forward slashes, without "." segments; null where path_problem() finds one."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != ".")
    return F.when(path_problem(path).isNull(), F.array_join(parts, "/"))


def document_format(path: Column) -> Column:
    """markdown or plain_text by suffix, null for others."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    out = F.lit(None).cast("string")
    for end, name in FORMATS.items():
        out = F.when(suffix == end, name).otherwise(out)
    return out


def title(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def embedding_text(title: Column, section_path: Column, text: Column) -> Column:
    """Title, headings unless at the root, and text, a line each."""
    return F.concat_ws("\n", title, F.when(F.size(section_path) > 0, F.array_join(section_path, " ")), text)


def excerpt(text: Column, width: int = 200) -> Column:
    """White space collapsed; cut after `width` characters, with dots."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[\s\x1c-\x1f\x85\p{Z}]+", " "), "^ | $", "")
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("..."))).otherwise(flat)


def section_display(section_path: Column) -> Column:
    return F.when(F.size(section_path) > 0, F.array_join(section_path, " > ")).otherwise("(root)")


def path_of(path: str) -> str:
    """normalized_path() of one path on the driver; ValueError where it has none."""
    parts = [p for p in path.replace("\\", "/").split("/") if p != "."]
    if not path.strip() or not parts or "" in parts or ".." in parts or re.match("[A-Za-z]:", path):
        raise ValueError(f"not a relative path: {path!r}")
    return "/".join(parts)


def format_of(path: str) -> str:
    for end, name in FORMATS.items():
        if path.lower().endswith(end):
            return name
    raise UnsupportedDocumentFormatError(f"no format for {path!r}")


def id_of(prefix: str, *parts: object) -> str:
    """document_id() or chunk_id() of single values on the driver."""
    if not str(parts[0]).strip() or any(isinstance(p, int) and p < 0 for p in parts):
        raise ValueError(f"not an identity: {parts!r}")
    return prefix + hashlib.sha256(UNIT.join(map(str, parts)).encode()).hexdigest()[:ID_DIGITS]
