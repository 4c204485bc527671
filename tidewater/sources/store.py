"""Snapshots of sources as Parquet, published by numbered manifests of which each can be made once."""

from __future__ import annotations

import copy
import hashlib
import json
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import StoreConflictError, StoreError, UnsupportedSchemaVersionError
from tidewater.sources.shared_files import SharedFolder

SCHEMA_VERSION = 3
SCHEMAS = {
    "documents": "document_id string, source_id string, relative_path string, title string, content_hash string, ingested_at timestamp, document_type string, processing_fingerprint string",
    "chunks": "chunk_id string, document_id string, section_path array<string>, section_occurrence int, ordinal int, ordinal_in_section int, text string, content_hash string, char_count int",
    "postings": "term string, block int, chunk_id string, document_id string, frequency int, length long, places array<long>",
    "blocks": "term string, block int, n_chunks long, max_frequency int, min_length long",
    "lengths": "chunk_id string, document_id string, length long",
    "vectors": "chunk_id string, document_id string, embedding array<float>, pivot int, pivot_distance double",
    "groups": "pivot int, n long, least double, most double",
    "pivots": "number int, center array<float>",
    "gone": "document_id string",
}
#: Reading by these skips row groups and pages.
SORTED = {"documents": ["document_id"], "chunks": ["document_id"], "lengths": ["document_id"], "vectors": ["pivot", "pivot_distance"], "postings": ["term", "block"], "blocks": ["term"]}
#: A chunk is found by its id through these, without its document.
BLOOM = {"chunks": "chunk_id"}
#: So many document ids at most become conditions of a scan; more are joined.
LOOKUP = 1000
#: A folder with this file is a store of version 1 or 2.
OLD_MANIFEST = "MANIFEST.json"
_MANIFESTS = "manifests"


class Store:
    """A folder of immutable tables by source, at any URI that Spark reads, and numbered manifests of those that count.

    A sync adds a part: the rows of new and changed documents, and the ids of documents that are gone or replaced, in `gone`. A
    row counts unless a later part's `gone` has its document. The next manifest publishes all of it at once; what did
    not change stays where it is. A manifest's file can be made by one writer only, so of two that began from the same
    one the second is refused, or, if they changed different sources, goes on from the first. The tables of parts that
    no manifest names any more are removed by collect().

    The manifest has for each source: parts, oldest first ({"tables": name -> path, "rows": documents and ids of gone ones}), and stats (chunks, and
    their tokens in all), and of the active vector index its model's fingerprint, dimension and pivots. A store of an earlier version is brought to this one when it is opened for writing.
    """

    def __init__(self, spark: SparkSession, path: str | Path, *, read_only: bool = False):
        self.spark, self.read_only, self._pinned = spark, read_only, None
        self.files = SharedFolder(spark, path)
        self.reading = _reading_session(spark)
        if read_only and not (self._numbers() or self.files.exists(OLD_MANIFEST)):
            raise StoreError(f"no store at {path}")
        if not read_only:
            self.files.make(_MANIFESTS)
        version = self.manifest()["schema_version"]
        if version != SCHEMA_VERSION:
            if read_only:
                raise UnsupportedSchemaVersionError(f"schema version {version}; this is {SCHEMA_VERSION}, and a store is only migrated when it is opened for writing")
            from tidewater.plans.migration import migrate

            migrate(self)

    # --- manifests ---------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return [int(name[:-5]) for name, _ in self.files.entries(_MANIFESTS) if name.endswith(".json") and name[:-5].isdigit()]

    def manifest(self) -> dict:
        """The last one; its `number` is 0 before the first."""
        if self._pinned is not None:
            return copy.deepcopy(self._pinned)
        try:
            if numbers := self._numbers():
                return json.loads(self.files.read(_name(max(numbers)))) | {"number": max(numbers)}
            if self.files.exists(OLD_MANIFEST):
                return json.loads(self.files.read(OLD_MANIFEST)) | {"number": 0}
        except ValueError as error:
            raise StoreError(f"cannot read the manifest: {error}") from error
        return {"schema_version": SCHEMA_VERSION, "number": 0, "vector": None, "sources": {}}

    def pinned(self, manifest: dict | None = None) -> Store:
        """This store as a manifest has it, whatever is published meanwhile; for reading only."""
        view = copy.copy(self)
        view._pinned, view.read_only = manifest or self.manifest(), True
        return view

    def publish(self, manifest: dict) -> dict:
        """Makes a manifest, changed from the one with its number, the next one; StoreConflictError if there is a next one already."""
        self.require_writable()
        after = manifest | {"number": manifest["number"] + 1}
        if not self.files.create(_name(after["number"]), json.dumps(after, indent=1)):
            raise StoreConflictError(f"manifest {after['number']} has been published by another writer")
        return after

    def commit(self, base: dict, sources: dict[str, dict]) -> dict:
        """Publishes entries of sources, made from the manifest base. If others have published meanwhile, but neither these sources nor the
        vector index, it goes on from theirs; else StoreConflictError."""
        while True:
            last = self.manifest()
            if last["vector"] != base["vector"] or any(last["sources"].get(s) != base["sources"].get(s) for s in sources):
                raise StoreConflictError(f"another writer has changed {', '.join(sources)} or the vector index")
            try:
                return self.publish(last | {"sources": last["sources"] | sources})
            except StoreConflictError:
                continue

    def require_writable(self) -> None:
        if self.read_only:
            raise StoreError("the store is open for reading only")

    def collect(self, *, grace_seconds: float = 86_400) -> list[str]:
        """Removes manifests but the last, and tables that no manifest left names, if they are older than the grace time, which must be longer than
        any sync or search takes: what was removed."""
        self.require_writable()
        before = (time.time() - grace_seconds) * 1000
        last = self.manifest()["number"]
        removed = []
        for name, changed in self.files.entries(_MANIFESTS):
            if changed < before and name != _name(last).rpartition("/")[2]:
                removed.append(f"{_MANIFESTS}/{name}")
        left = [json.loads(self.files.read(f"{_MANIFESTS}/{n}")) for n, _ in self.files.entries(_MANIFESTS) if n.endswith(".json") and f"{_MANIFESTS}/{n}" not in removed]
        named = {path for m in left for path in named_tables(m)}
        if last and self.files.exists(OLD_MANIFEST):
            removed.append(OLD_MANIFEST)
        for table in SCHEMAS:
            removed += [f"{table}/{name}" for name, changed in self.files.entries(table) if changed < before and f"{table}/{name}" not in named]
        for name in removed:
            self.files.remove(name)
        return removed

    # --- tables ------------------------------------------------------------------

    def table(self, name: str, source_id: str | None = None) -> DataFrame:
        """The rows that count of one source's table or of all."""
        out = self.reading.createDataFrame([], SCHEMAS[name])
        for k, entry in self.manifest()["sources"].items():
            if source_id in (None, k):
                out = out.unionByName(self.live(name, entry["parts"]))
        return out

    def live(self, name: str, parts: list[dict], only: int | None = None) -> DataFrame:
        """The rows that count of a table of parts, or of the one at `only`."""
        out = self.reading.createDataFrame([], SCHEMAS[name])
        # parts after which the same ids are gone are read together
        together: dict[tuple, list[str]] = {}
        for k, part in enumerate(parts):
            if name in part["tables"] and only in (None, k):
                later = tuple(p["tables"]["gone"] for p in parts[k + 1 :] if "gone" in p["tables"]) if "document_id" in SCHEMAS[name] and name != "gone" else ()
                together.setdefault(later, []).append(part["tables"][name])
        for gone, paths in together.items():
            df = self.at(name, paths)
            out = out.unionByName(df.join(self.at("gone", gone), "document_id", "left_anti").select(df.columns) if gone else df)
        return out

    def at(self, name: str, paths) -> DataFrame:
        return self.reading.read.schema(SCHEMAS[name]).parquet(*[f"{self.files.uri}/{p}" for p in paths])

    def of_documents(self, name: str, ids: DataFrame, source_id: str) -> DataFrame:
        """The rows that count of the documents whose ids (document_id) are given. Few ids become a condition, which skips what is sorted by
        them; more are joined, and only the rows that match leave the scan."""
        few = ids.select("document_id").limit(LOOKUP + 1).collect()
        rows = self.table(name, source_id)
        if len(few) <= LOOKUP:
            return rows.filter(F.col("document_id").isin([r[0] for r in few]))
        return rows.join(ids.select("document_id").distinct(), "document_id", "left_semi").select(rows.columns)

    def stats(self) -> tuple[float, float]:
        """The number of chunks and their mean length in tokens, from the manifest."""
        known = [s["stats"] for s in self.manifest()["sources"].values()]
        n, total = sum(s["chunks"] for s in known), sum(s["tokens"] for s in known)
        return float(n), total / n if n else 0.0

    def write(self, name: str, source_id: str, df: DataFrame) -> str:
        """Writes a table of a source; it counts once a manifest names it."""
        self.require_writable()
        at = f"{name}/{hashlib.sha256(source_id.encode()).hexdigest()[:16]}-{uuid.uuid4().hex}"
        rows = df.select([c.split()[0] for c in SCHEMAS[name].split(", ")])
        writer = (rows.sortWithinPartitions(*SORTED[name]) if name in SORTED else rows).write
        if name in BLOOM:
            writer = writer.option(f"parquet.bloom.filter.enabled#{BLOOM[name]}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.files.uri}/{at}")
        return at


def _name(number: int) -> str:
    return f"{_MANIFESTS}/{number:020d}.json"


def named_tables(manifest: dict) -> list[str]:
    """The paths that a manifest of any version names."""
    found = []
    for entry in manifest["sources"].values():
        for part in entry.get("parts", []):
            found += part["tables"].values()
        for of in entry.get("tables", {}).values():
            found += [of] if isinstance(of, str) else [path for path, _ in of]
    return [*found, *filter(None, [(manifest["vector"] or {}).get("pivots")])]


def _reading_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of spark, in which long lists of ids reach the scan as values, not as a range; its settings are its own."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(LOOKUP + 1))
    return own


# --- parts -------------------------------------------------------------------------

#: So many parts of like size become one.
FAN = 4


def tier(rows: int) -> int:
    """The size class of a part: powers of FAN."""
    n = 0
    while rows >= FAN:
        rows, n = rows // FAN, n + 1
    return n


def due(sizes: list[int]) -> int:
    """How many of the last parts of these sizes, oldest first, should become one part; 0 or 1: none.

    The new part takes in those before it that are of smaller tiers, so tiers fall from old to new; FAN parts of one
    tier become one of the next. A row is so rewritten once when it comes and once a tier, of which there are as many as the logarithm of all rows.
    """
    k = 1
    while True:
        now = tier(sum(sizes[-k:]))
        before = sizes[:-k]
        smaller = next((i for i, s in enumerate(reversed(before)) if tier(s) >= now), len(before))
        same = next((i for i, s in enumerate(reversed(before[: len(before) - smaller])) if tier(s) != now), len(before) - smaller)
        more = smaller + (same if same >= FAN - 1 else 0)
        if not more:
            return k
        k += more
