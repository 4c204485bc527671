"""Stores of earlier versions, brought to this one step by step."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from tidewater.errors import StoreConflictError, UnsupportedSchemaVersionError
from tidewater.sources.store import SCHEMA_VERSION, SCHEMAS, Store


def migrate(store: Store) -> dict:
    """Takes the store through all steps from its version to this one: the manifest then.

    A step writes what it makes beside what is there and publishes a manifest of the next version, so one that fails leaves the version
    before, and a later opening goes on from it. If another writer is migrating too, its step counts.
    Documents, their times and fingerprints, chunks and vectors stay as they are.
    """
    while (manifest := store.manifest())["schema_version"] != SCHEMA_VERSION:
        if (step := STEPS.get(manifest["schema_version"])) is None:
            raise UnsupportedSchemaVersionError(f"schema version {manifest['schema_version']}; this is {SCHEMA_VERSION}")
        try:
            store.publish(step(store, manifest))
        except StoreConflictError:
            continue
    return manifest


def _deltas(store: Store, manifest: dict) -> dict:
    """1 to 2: a source's tables are lists of (path, delta). Postings and lengths of version 1 lack their documents and are left out, as
    version 2 allows; the next step makes them anew."""
    kept = ("documents", "chunks", "vectors")
    sources = {k: {**{x: e[x] for x in ("source_type", "display_name")}, "delta": 1, "tables": {n: [[e["tables"][n], 1]] for n in kept if n in e["tables"]}} for k, e in manifest["sources"].items()}
    return manifest | {"schema_version": 2, "sources": sources}


def _parts(store: Store, manifest: dict) -> dict:
    """2 to 3: deltas become one part, whose documents, chunks and vectors are those of the only delta, or else written
    without what is gone; postings, their blocks and lengths are made anew from the chunks, and vectors grouped around pivots."""
    from tidewater.plans.ingest import choose_pivots, lexical_tables, stats_of, vector_tables

    sources, active, around = {}, manifest["vector"], []
    if active:
        rows = [_live(store, "vectors", e).select("chunk_id", "embedding") for e in manifest["sources"].values() if "vectors" in e["tables"]]
        path, around = choose_pivots(store, reduce(DataFrame.unionByName, rows, store.reading.createDataFrame([], "chunk_id string, embedding array<float>")))
        active = active | {"pivots": path}
    for source_id, entry in manifest["sources"].items():
        tables = {}
        for name in ("documents", "chunks"):
            found = entry["tables"].get(name, [])
            if len(found) == 1 and not entry["tables"].get("gone"):
                tables[name] = found[0][0]
            elif found:
                tables[name] = store.write(name, source_id, _live(store, name, entry))
        if "chunks" in tables:
            tables |= lexical_tables(store, source_id, store.at("chunks", [tables["chunks"]]), store.at("documents", [tables["documents"]]))
        if active and "vectors" in entry["tables"]:
            tables |= vector_tables(store, source_id, _live(store, "vectors", entry).select("chunk_id", "document_id", "embedding"), around)
        parts = [{"tables": tables, "rows": store.at("documents", [tables["documents"]]).count()}] if "documents" in tables else []
        sources[source_id] = {"source_type": entry["source_type"], "display_name": entry["display_name"], "parts": parts, "stats": stats_of(store, parts)}
    return manifest | {"schema_version": 3, "vector": active, "sources": sources}


def _live(store: Store, name: str, entry: dict) -> DataFrame:
    """The rows that count of a table of version 2."""
    out = store.reading.createDataFrame([], SCHEMAS[name])
    gone = entry["tables"].get("gone", [])
    for path, delta in entry["tables"][name]:
        df = store.at(name, [path])
        later = [p for p, d in gone if d > delta]
        out = out.unionByName(df.join(store.at("gone", later), "document_id", "left_anti").select(df.columns) if later else df)
    return out


#: By the version that a step starts from.
STEPS: dict[int, Callable[[Store, dict], dict]] = {1: _deltas, 2: _parts}
