"""From raw documents to a published snapshot."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.errors import EmbeddingError, IngestionError, SourceConfigurationError, StoreConflictError, UnsupportedDocumentFormatError, VectorIndexIncompatibleError
from tidewater.functions import text
from tidewater.functions.fingerprints import processing_fingerprint
from tidewater.functions.vectors import valid_vector
from tidewater.operators import lexical, vector
from tidewater.operators.chunking import chunks
from tidewater.operators.embeddings import EmbeddingProvider, fingerprint_of
from tidewater.plans.sync import classify
from tidewater.sources.store import SCHEMAS, Store, due

#: The indexed fields, in the order of postings.field.
FIELDS = ["title", "relative_path", "section", "text"]
#: How often a sync or rebuild begins again because another writer came first.
ATTEMPTS = 5


@dataclass(frozen=True)
class IngestionResult:
    source_id: str
    discovered: int
    created: int
    updated: int
    reprocessed: int
    unchanged: int
    deleted: int
    embedding_fingerprint: str | None = None
    vector_reindexed: int | None = None

    def as_dict(self) -> dict:
        return asdict(self)


def processed(raw: DataFrame, *, max_chunk_chars: int, now: datetime) -> DataFrame:
    """Documents of raw (source_id, relative_path, content) with their text and format."""
    path = text.normalized_path(F.col("relative_path"))
    d = raw.select("source_id", path.alias("relative_path"), text.normalize_newlines(F.col("content")).alias("text"), F.col("relative_path").alias("given"))
    d = d.withColumn("format", text.document_format(F.col("relative_path")))
    kinds = F.create_map(*[x for f in text.FORMATS.values() for x in (F.lit(f), F.lit(processing_fingerprint(f, max_chunk_chars)))])
    return d.select(
        text.document_id(F.col("source_id"), F.col("relative_path")).alias("document_id"),
        "source_id",
        "relative_path",
        text.title(F.col("relative_path")).alias("title"),
        text.content_hash(F.col("text")).alias("content_hash"),
        F.lit(now).cast("timestamp").alias("ingested_at"),
        F.lit(None).cast("string").alias("document_type"),
        kinds[F.col("format")].alias("processing_fingerprint"),
        "text",
        "format",
        "given",
    )


def indexed(chunk_rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the fields that search reads."""
    named = chunk_rows.join(documents.select("document_id", "relative_path", "title"), "document_id")
    return named.withColumn("section", F.array_join("section_path", " "))


def embedded(chunk_rows: DataFrame, documents: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """(chunk_id, document_id, embedding)"""
    whole = text.embedding_text(F.col("title"), F.col("section_path"), F.col("text"))
    return indexed(chunk_rows, documents).select("chunk_id", "document_id", provider.embed_documents(whole).alias("embedding"))


def _refuse(found: DataFrame, condition: Column, error: type[Exception], label: str) -> None:
    if bad := found.filter(condition).head():
        raise error(f"{label}: {bad[0]}")


def _incoming(store: Store, source_id: str, raw: DataFrame, max_chunk_chars: int, now: datetime) -> DataFrame:
    """raw's documents, kept for the sync; rows that are of another source, have no path or format, or share a path with other content are refused."""
    found = processed(raw, max_chunk_chars=max_chunk_chars, now=now).persist()
    try:
        _refuse(found.select("source_id"), ~F.col("source_id").eqNullSafe(F.lit(source_id)), IngestionError, f"not of source {source_id}")
        _refuse(found.select("given", "relative_path", "text"), F.col("relative_path").isNull() | F.col("text").isNull(), IngestionError, "not a relative path, or no content")
        _refuse(found.select("given", "format"), F.col("format").isNull(), UnsupportedDocumentFormatError, "no format for")
        versions = found.groupBy("relative_path").agg(F.min("content_hash").alias("a"), F.max("content_hash").alias("b"))
        _refuse(versions, F.col("a") != F.col("b"), IngestionError, "several contents for")
    except Exception:
        found.unpersist()
        raise
    return found


def _again(write: Callable):
    """write(), begun anew from the last manifest if another writer has changed what it would."""
    for _ in range(ATTEMPTS - 1):
        try:
            return write()
        except StoreConflictError:
            continue
    return write()


def ingest(
    store: Store,
    source_id: str,
    raw: DataFrame,
    *,
    max_chunk_chars: int = 1000,
    provider: EmbeddingProvider | None = None,
    source_type: str = "local_filesystem",
    display_name: str | None = None,
    keep_missing: bool = False,
    now: datetime | None = None,
) -> IngestionResult:
    """Makes raw (source_id, relative_path, content) the snapshot of a source; nothing changes if any of it fails.

    Only new and changed documents are chunked, indexed, embedded and written, chunked once; the rest stays where it is. Documents
    that are missing are deleted, unless keep_missing; then only the documents of raw are looked up, by their ids. If a vector index is active, what is written must be
    embedded by its model; without an active one, vectors are not written. If another writer publishes a change of this source or of the vector index
    meanwhile, the sync begins again from that; other sources don't matter.
    """
    store.require_writable()
    if not source_id.strip():
        raise SourceConfigurationError("source_id must not be blank")
    found = _incoming(store, source_id, raw, max_chunk_chars, now or datetime.now(UTC))
    try:
        return _again(lambda: _sync(store, source_id, found, max_chunk_chars, provider, {"source_type": source_type, "display_name": display_name}, keep_missing))
    finally:
        found.unpersist()


def _sync(store: Store, source_id: str, found: DataFrame, max_chunk_chars: int, provider: EmbeddingProvider | None, about: dict, keep_missing: bool) -> IngestionResult:
    base = store.manifest()
    view, active = store.pinned(base), base["vector"]
    discovered = found.count()
    now_once = found.dropDuplicates(["document_id"])
    before = view.of_documents("documents", now_once, source_id) if keep_missing else view.table("documents", source_id)
    status = classify(before, now_once).persist()
    try:
        counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
        n = {s: counts.get(s, 0) for s in ("created", "updated", "reprocessed", "unchanged", "deleted")}
        writes = n["created"] + n["updated"] + n["reprocessed"]

        fingerprint = fingerprint_of(provider) if provider else None
        if active and fingerprint and discovered and fingerprint != active["fingerprint"]:
            raise VectorIndexIncompatibleError("the provider is not the active index's; rebuild the vectors")
        if active and not fingerprint and writes:
            raise VectorIndexIncompatibleError("a vector index is active, so what is written must be embedded")

        entry = {"parts": [], "stats": {"chunks": 0, "tokens": 0}} | copy.deepcopy(base["sources"].get(source_id, {})) | about
        of = lambda *kinds: status.filter(F.col("status").isin(*kinds)).select("document_id")
        if writes or n["deleted"]:
            changed = now_once.join(of("created", "updated", "reprocessed"), "document_id", "left_semi") if writes else None
            gone = of("updated", "reprocessed", "deleted") if n["updated"] + n["reprocessed"] + n["deleted"] else None
            tables, stats = _part(store, view, source_id, changed, gone, max_chunk_chars, provider if active else None, pivots(view))
            if active and writes:
                _check_vectors(store, tables["vectors"], active["dimension"])
            entry["parts"].append({"tables": tables, "rows": writes + n["updated"] + n["reprocessed"] + n["deleted"]})
            entry["stats"] = {k: entry["stats"][k] + stats[k] for k in stats}
            if (k := due([p["rows"] for p in entry["parts"]])) > 1:
                entry["parts"][-k:] = _merged(store, source_id, entry["parts"], k)
    finally:
        status.unpersist()
    if entry != base["sources"].get(source_id):
        store.commit(base, {source_id: entry})
    return IngestionResult(source_id, discovered, **n, embedding_fingerprint=fingerprint if active else None, vector_reindexed=writes if active and provider else None)


def _part(store: Store, view: Store, source_id: str, changed: DataFrame | None, gone: DataFrame | None, max_chunk_chars: int, provider: EmbeddingProvider | None, around: list[list[float]]) -> tuple[dict, dict]:
    """Writes what is new and what is gone: (tables, what chunks and tokens there are more). What is known of gone documents is looked up by their ids."""
    tables, stats, fewer = {}, {"chunks": 0, "tokens": 0}, None
    if gone is not None:
        tables["gone"] = store.write("gone", source_id, gone)
        ids = store.at("gone", [tables["gone"]])
        lost = view.of_documents("lengths", ids, source_id)
        for key, value in _sizes(lost).items():
            stats[key] -= value
        old = indexed(view.of_documents("chunks", ids, source_id), view.of_documents("documents", ids, source_id))
        fewer = lexical.postings(old, FIELDS).groupBy("term").agg((-F.count("*")).alias("n_chunks"))
    if changed is not None:
        tables["documents"] = store.write("documents", source_id, changed)
        tables["chunks"] = store.write("chunks", source_id, chunks(changed.select("document_id", "text", "format"), max_chunk_chars=max_chunk_chars))
        chunk_rows, documents = store.at("chunks", [tables["chunks"]]), store.at("documents", [tables["documents"]])
        tables |= lexical_tables(store, source_id, chunk_rows, documents, fewer)
        if provider:
            tables |= vector_tables(store, source_id, embedded(chunk_rows, documents, provider), around)
        for key, value in _sizes(store.at("lengths", [tables["lengths"]])).items():
            stats[key] += value
    elif fewer is not None:
        tables["blocks"] = store.write("blocks", source_id, _corrections(fewer))
    return tables, stats


def lexical_tables(store: Store, source_id: str, chunk_rows: DataFrame, documents: DataFrame, fewer: DataFrame | None = None) -> dict:
    """Writes the index of chunks: postings, the blocks they make up, with corrections (term, n_chunks) for what is gone, and lengths."""
    named = indexed(chunk_rows, documents)
    tables = {"postings": store.write("postings", source_id, lexical.postings(named, FIELDS, more=["document_id"]))}
    found = lexical.blocks(store.at("postings", [tables["postings"]]))
    tables["blocks"] = store.write("blocks", source_id, found if fewer is None else found.unionByName(_corrections(fewer)))
    tables["lengths"] = store.write("lengths", source_id, lexical.lengths(named, FIELDS, more=["document_id"]))
    return tables


def vector_tables(store: Store, source_id: str, rows: DataFrame, around: list[list[float]]) -> dict:
    """Writes vectors (chunk_id, document_id, embedding), grouped around the index's pivots, and the groups."""
    at = store.write("vectors", source_id, vector.grouped(rows, around))
    return {"vectors": at, "groups": store.write("groups", source_id, vector.group_rows(store.at("vectors", [at])))}


def pivots(view: Store) -> list[list[float]]:
    """The pivots of the active vector index, of which there are vector.PIVOTS at most."""
    at = (view.manifest()["vector"] or {}).get("pivots")
    return [list(r["center"]) for r in view.at("pivots", [at]).orderBy("number").collect()] if at else []


def choose_pivots(store: Store, rows: DataFrame) -> tuple[str, list[list[float]]]:
    """Pivots for rows (chunk_id, embedding): their table and they themselves."""
    chosen = vector.pivots_of(rows)
    return store.write("pivots", "", store.reading.createDataFrame(list(enumerate(chosen)), SCHEMAS["pivots"])), chosen


def _corrections(fewer: DataFrame) -> DataFrame:
    """Rows of blocks that say how many chunks fewer have a term; their block, -1, has no postings."""
    return fewer.select("term", F.lit(-1).alias("block"), "n_chunks", F.lit(None).cast("int").alias("max_frequency"), F.lit(None).cast("long").alias("min_length"))


def _sizes(lengths: DataFrame) -> dict:
    n, total = lengths.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return {"chunks": n, "tokens": total}


def stats_of(store: Store, parts: list[dict]) -> dict:
    """A source's stats from its lengths."""
    return _sizes(store.live("lengths", parts))


def _merged(store: Store, source_id: str, parts: list[dict], k: int) -> list[dict]:
    """The last k parts as one, without what is gone among them; of what is gone before them, the ids and corrections stay."""
    last, first = parts[-k:], k == len(parts)
    tables = {}
    for name in ("documents", "chunks", "postings", "lengths", "vectors"):
        if any(name in p["tables"] for p in last):
            tables[name] = store.write(name, source_id, store.live(name, last))
    if "vectors" in tables:
        tables["groups"] = store.write("groups", source_id, vector.group_rows(store.at("vectors", [tables["vectors"]])))
    new = lexical.blocks(store.at("postings", [tables["postings"]])) if "postings" in tables else None
    if not first and any("gone" in p["tables"] for p in last):
        tables["gone"] = store.write("gone", source_id, store.live("gone", last).distinct())
        both = [store.live("blocks", last).select("term", "n_chunks"), *([new.select("term", (-F.col("n_chunks")).alias("n_chunks"))] if new else [])]
        fewer = reduce(DataFrame.unionByName, both).groupBy("term").agg(F.sum("n_chunks").alias("n_chunks")).filter("n_chunks <> 0")
        new = new.unionByName(_corrections(fewer)) if new else _corrections(fewer)
    if new is not None:
        tables["blocks"] = store.write("blocks", source_id, new)
    rows = sum(store.at(name, [tables[name]]).count() for name in ("documents", "gone") if name in tables)
    return [{"tables": tables, "rows": rows}] if rows else []


def _check_vectors(store: Store, at: str, dimension: int) -> None:
    _refuse(store.at("vectors", [at]).select("chunk_id", "embedding"), ~valid_vector(F.col("embedding"), dimension), EmbeddingError, "not a vector of the index")


def rebuild_lexical(store: Store) -> int:
    """Makes postings, blocks and lengths of all sources anew from their chunks, without the sources' files, each source as one part: the number of chunks."""
    store.require_writable()

    def rebuild() -> int:
        base, made = store.manifest(), {}
        for source_id, entry in base["sources"].items():
            parts = [{"tables": {n: t for n, t in p["tables"].items() if n not in ("postings", "blocks", "lengths")}, "rows": p["rows"]} for p in entry["parts"]]
            parts = _merged(store, source_id, parts, len(parts)) if parts else []
            for part in parts:
                part["tables"] |= lexical_tables(store, source_id, store.at("chunks", [part["tables"]["chunks"]]), store.at("documents", [part["tables"]["documents"]]))
            made[source_id] = entry | {"parts": parts, "stats": stats_of(store, parts)}
        store.commit(base, made)
        return sum(e["stats"]["chunks"] for e in made.values())

    return _again(rebuild)


def rebuild_vectors(store: Store, provider: EmbeddingProvider) -> tuple[str, int]:
    """Embeds all chunks of all sources anew, once, and makes that model the active one: (fingerprint, number of chunks). Pivots are chosen from all vectors."""
    store.require_writable()
    vector_of = {"fingerprint": fingerprint_of(provider), "dimension": provider.dimension}

    def rebuild() -> int:
        base = store.manifest()
        after, made = copy.deepcopy(base), []
        for source_id, entry in after["sources"].items():
            for k, part in enumerate(entry["parts"]):
                if "chunks" in part["tables"]:
                    rows = embedded(store.live("chunks", entry["parts"], k), store.live("documents", entry["parts"], k), provider)
                    at = store.write("vectors", source_id, vector.grouped(rows, []))
                    _check_vectors(store, at, provider.dimension)
                    made.append((source_id, part, at))
        whole = store.at("vectors", [at for *_, at in made]).select("chunk_id", "document_id", "embedding") if made else store.reading.createDataFrame([], SCHEMAS["vectors"])
        path, around = choose_pivots(store, whole)
        for source_id, part, at in made:
            part["tables"] |= vector_tables(store, source_id, store.at("vectors", [at]).select("chunk_id", "document_id", "embedding"), around)
        # of all sources, so nothing may have been published meanwhile
        store.publish(after | {"vector": vector_of | {"pivots": path}})
        return whole.count()

    return vector_of["fingerprint"], _again(rebuild)
