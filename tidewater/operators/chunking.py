"""Documents to section-aware chunks of bounded length."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.errors import ChunkingError
from tidewater.functions.text import chunk_id, content_hash, normalize_newlines

# fixed patterns of the format
HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*))?")
CLOSING_MARKS = re.compile(r"(?:^|[ \t])#+[ \t]*$")
FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")


def _heading(line: str) -> tuple[int, str] | None:
    """(level, title) of a heading; a line without a title is none."""
    found = HEADING.fullmatch(line)
    if not found:
        return None
    title = CLOSING_MARKS.sub("", (found[2] or "").strip()).rstrip()
    return (len(found[1]), title) if title else None


def sections(text: str) -> Iterator[tuple[tuple[str, ...], int, int]]:
    """(headings, start, end) of the parts of a Markdown text that headings open; they cover it in order."""
    open_headings: dict[int, str] = {}
    fence = ""
    start = at = 0
    for line in text.splitlines(keepends=True):
        said = line.rstrip("\n")
        if fence:
            mark = said.strip()
            if len(mark) >= len(fence) and mark == fence[0] * len(mark):
                fence = ""
        elif opened := FENCE.match(said):
            fence = opened[1]
        elif found := _heading(said):
            if at > start:
                yield tuple(open_headings.values()), start, at
            start = at
            level, title = found
            open_headings = {k: v for k, v in open_headings.items() if k < level} | {level: title}
        at += len(line)
    if at > start:
        yield tuple(open_headings.values()), start, at


def cuts(text: str, bound: int) -> list[int]:
    """Where to cut a section: between paragraphs if they fit into the bound, else between lines, else anywhere."""
    lines = text.splitlines(keepends=True)
    ends = [0]
    for line in lines:
        ends.append(ends[-1] + len(line))
    blank = [line.rstrip("\n") == "" for line in lines]
    starts = [k for k in range(len(lines)) if k == 0 or (blank[k - 1] and not blank[k])]
    possible = [0]
    for first, after in pairwise([*starts, len(lines)]):
        if ends[after] - ends[first] <= bound:
            possible.append(ends[after])
            continue
        for k in range(first, after):
            possible += [*range(ends[k] + bound, ends[k + 1], bound), ends[k + 1]]
    chosen = [0]
    for before, here in pairwise(possible):
        if here - chosen[-1] > bound and before > chosen[-1]:
            chosen.append(before)
    return [*chosen, len(text)] if text else []


def chunks(documents: DataFrame, *, max_chunk_chars: int = 1000) -> DataFrame:
    """Chunks of documents (document_id, text, format): chunk_id, document_id, section_path,
    section_occurrence, ordinal, ordinal_in_section, text, content_hash, char_count.

    Markdown is parted by its headings, other formats are one section at the root. Joined in
    order, a document's chunks are its text with normalised newlines. Null and empty texts have none.
    """
    if max_chunk_chars <= 0:
        raise ChunkingError("max_chunk_chars must be positive")

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text:
                    continue
                seen: Counter = Counter()
                ordinal = 0
                for path, start, end in sections(text) if kind == "markdown" else [((), 0, len(text))]:
                    part = text[start:end]
                    for k, (a, b) in enumerate(pairwise(cuts(part, max_chunk_chars))):
                        rows.append((doc, list(path), seen[path], ordinal, k, part[a:b]))
                        ordinal += 1
                    seen[path] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["document_id", "section_path", "section_occurrence", "ordinal", "ordinal_in_section", "text"])

    schema = "document_id string, section_path array<string>, section_occurrence int, ordinal int, ordinal_in_section int, text string"
    cut_up = documents.select("document_id", normalize_newlines(F.col("text")).alias("text"), "format").mapInArrow(cut, schema)
    identity = chunk_id(F.col("document_id"), F.col("section_path"), F.col("section_occurrence"), F.col("ordinal_in_section"))
    return cut_up.select(identity.alias("chunk_id"), *cut_up.columns, content_hash(F.col("text")).alias("content_hash"), F.length("text").alias("char_count"))
