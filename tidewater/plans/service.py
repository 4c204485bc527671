"""The public search: one query, one strategy, one result with its status."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.errors import IndexUnavailableError, InvalidQueryError, StoreError, VectorIndexIncompatibleError, VectorIndexUnavailableError
from tidewater.functions.text import section_display
from tidewater.functions.tokens import phrases
from tidewater.operators import fusion, lexical, vector
from tidewater.operators.embeddings import EmbeddingProvider, fingerprint_of
from tidewater.plans.ingest import pivots
from tidewater.sources.store import Store

# fixed values of the public interface
STRATEGIES = ("lexical", "vector", "hybrid")
MAX_PUBLIC_RESULTS = 25
TIE = ["relative_path", "ordinal", "chunk_id"]


def hits_of(strategy: str, matches: DataFrame) -> DataFrame:
    """Matches of any strategy in one shape: what the other side would give is null."""
    native = {"lexical": {"lexical_rank": "rank", "bm25_score": "score"}, "vector": {"vector_rank": "rank", "vector_distance": "distance"}, "hybrid": {}}[strategy]
    kinds = {"lexical_rank": "int", "vector_rank": "int", "bm25_score": "double", "vector_distance": "double", "rrf_score": "double"}
    have = set(matches.columns)
    added = {c: F.col(native[c]).cast(kind) if c in native else (F.col(c) if c in have else F.lit(None)).cast(kind) for c, kind in kinds.items()}
    return matches.select(*[c for c in matches.columns if c not in ("score", "distance", *kinds)], *[v.alias(k) for k, v in added.items()])


@dataclass(frozen=True)
class RetrievalResult:
    """status: success, empty, or partial where max_results cut the ranking."""

    strategy: str
    status: str
    results: list[dict] = field(default_factory=list)
    requested_max_results: int = 10
    truncated: bool = False
    truncation_reason: str | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, default=str)


def status_of(found: int, max_results: int) -> str:
    """What a result says of so many matches: partial where the bound cuts them."""
    return "partial" if found > max_results else "success" if found else "empty"


def status_column(found: Column, max_results: int) -> Column:
    """status_of() of a column: a table of what it says of 0 to max_results + 1, beyond which nothing changes."""
    says = F.array(*[F.lit(status_of(k, max_results)) for k in range(max_results + 2)])
    return F.get(says, F.least(found, F.lit(max_results + 1)).cast("int"))


def result_of(strategy: str, hits: list[dict], max_results: int) -> RetrievalResult:
    """hits are one more than asked for if there are more."""
    more = len(hits) > max_results
    return RetrievalResult(strategy, status_of(len(hits), max_results), hits[:max_results], max_results, more, "max_results" if more else None)


class KnowledgeService:
    """Searches a store. Vector and hybrid search need the provider of the active vector index; they never fall back."""

    def __init__(self, store: Store, provider: EmbeddingProvider | None = None, *, default_strategy: str = "lexical"):
        self.store, self.provider, self.default_strategy = store, provider, default_strategy

    def _details(self, view: Store) -> DataFrame:
        docs = view.table("documents").select("document_id", "source_id", "relative_path", "title")
        return view.table("chunks").join(docs, "document_id")

    def index(self, view: Store) -> lexical.Index:
        """The lexical index of a pinned store; IndexUnavailableError if a part has none."""
        if any("postings" not in p["tables"] for s in view.manifest()["sources"].values() for p in s["parts"] if "chunks" in p["tables"]):
            raise IndexUnavailableError("a source has no postings; rebuild the lexical index")
        return lexical.Index(view.table("postings"), view.table("blocks"), view.stats())

    def lexical(self, query: str, n: int, view: Store | None = None) -> DataFrame:
        lexical.checked_query(query, n)
        view = view or self.store.pinned()
        return lexical.search(self.index(view), query, tie=TIE, details=self._details(view), max_results=n, near="document_id")

    def vector(self, query: str, n: int, view: Store | None = None) -> DataFrame:
        stripped = lexical.checked_query(query, n)
        view = view or self.store.pinned()
        asked = self.embedded_query(view, stripped)
        groups = vector.groups_of(view.table("groups"), pivots(view))
        return vector.nearest(view.table("vectors"), asked, details=self._details(view), tie=TIE, max_results=n, near="document_id", groups=groups)

    def embedded_query(self, view: Store, query: str) -> list[float]:
        """The query's vector by the active index's model."""
        if self.provider is None:
            raise VectorIndexUnavailableError("vector search needs an embedding provider")
        active = view.manifest()["vector"]
        if active is None:
            raise VectorIndexUnavailableError("no vector index has been built")
        if fingerprint_of(self.provider) != active["fingerprint"]:
            raise VectorIndexIncompatibleError("the provider is not the active index's; rebuild the vectors")
        asked = self.provider.embed_query(query)
        if len(asked) != active["dimension"]:
            raise VectorIndexIncompatibleError("the query's vector has another length than the index's")
        return asked

    def hybrid(self, query: str, n: int) -> DataFrame:
        lexical.checked_query(query, n)
        if self.provider is None:
            raise VectorIndexUnavailableError("hybrid search needs an embedding provider")
        k, view = fusion.candidate_count(n), self.store.pinned()
        return fusion.fuse(self.lexical(query, k, view), self.vector(query, k, view), max_results=n, tie=TIE)

    def search(self, query: str, *, strategy: str | None = None, max_results: int = 10) -> RetrievalResult:
        lexical.checked_query(query, max_results, MAX_PUBLIC_RESULTS)
        chosen = strategy or self.default_strategy
        if chosen not in STRATEGIES:
            raise InvalidQueryError(f"no such strategy: {chosen}")
        matches = getattr(self, chosen)(query, max_results + 1)
        hits = hits_of(chosen, matches).withColumn("section", section_display(F.col("section_path"))).orderBy("rank")
        return result_of(chosen, [checked(r.asDict(recursive=True), "chunk_id", "document_id") for r in hits.collect()], max_results)

    def search_each(self, queries: dict[str, str], strategy: str, max_results: int) -> DataFrame:
        """(query_id, chunk_id, rank): what search() finds for each of many queries (query_id -> query), in one plan."""
        for query in queries.values():
            lexical.checked_query(query, max_results, MAX_PUBLIC_RESULTS)
        if strategy not in STRATEGIES:
            raise InvalidQueryError(f"no such strategy: {strategy}")
        view = self.store.pinned()
        details = self._details(view)
        n = max_results if strategy != "hybrid" else fusion.candidate_count(max_results + 1)
        found = {}
        if strategy != "vector":
            scored = lexical.bm25_each(self.index(view), {q: phrases(text.strip()) for q, text in queries.items()})
            found["lexical"] = lexical.best_each(scored, "score", details, TIE, n, "chunk_id")
        if strategy != "lexical":
            asked = [(q, self.embedded_query(view, text.strip())) for q, text in queries.items()]
            pairs = vector.pairs_each(view.table("vectors"), vector.groups_of(view.table("groups"), pivots(view)), asked, n).withColumnRenamed("query", "query_id")
            found["vector"] = lexical.best_each(pairs, "distance", details, TIE, n, "chunk_id")
        whole = found[strategy] if strategy != "hybrid" else fusion.fuse(found["lexical"], found["vector"], max_results=max_results, tie=TIE, hash_col=None, by=["query_id"])
        return whole.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))

    def get_document(self, document_id: str) -> dict | None:
        return _one(self.store.table("documents").filter(F.col("document_id") == document_id), "document_id")

    def get_chunk(self, chunk_id: str) -> dict | None:
        """Row groups whose Bloom filter doesn't have the id are skipped."""
        return _one(self.store.table("chunks").filter(F.col("chunk_id") == chunk_id), "chunk_id", "document_id")

    def documents_of(self, source_id: str) -> DataFrame:
        return checked_rows(self.store.table("documents", source_id), "document_id").orderBy("relative_path")

    def chunks_of(self, document_id: str) -> DataFrame:
        return checked_rows(self.store.table("chunks").filter(F.col("document_id") == document_id), "chunk_id", "document_id").orderBy("ordinal")


def _one(found: DataFrame, *ids: str) -> dict | None:
    row = found.head()
    return checked(row.asDict(recursive=True), *ids) if row else None


# fixed forms of stored values
_FORMS = {"document_id": r"doc_[0-9a-f]{24}", "chunk_id": r"chunk_[0-9a-f]{24}", "content_hash": r"[0-9a-f]{64}", "processing_fingerprint": r"[0-9a-f]{64}"}


_NAMES, _COUNTS = ("source_id", "relative_path", "title"), ("ordinal", "section_occurrence", "ordinal_in_section")


def checked(row: dict, *ids: str) -> dict:
    """A row as read from the store; StoreError if it is not what was once written: ids and digests have their form, a chunk's
    text its digest and length, names are not blank and numbers not negative."""
    wrong = [c for c, form in _FORMS.items() if (c in ids or c in row) and not re.fullmatch(form, row.get(c) or "")]
    wrong += [c for c in _NAMES if c in row and not (row[c] or "").strip()]
    wrong += [c for c in _COUNTS if c in row and (row[c] is None or row[c] < 0)]
    if "text" in row and (not row["text"] or hashlib.sha256(row["text"].encode()).hexdigest() != row["content_hash"] or len(row["text"]) != row["char_count"]):
        wrong.append("text")
    if wrong:
        raise StoreError(f"a stored row is corrupt in {', '.join(sorted(wrong))}: {row.get(ids[0]) if ids else ''}")
    return row


def checked_rows(rows: DataFrame, *ids: str) -> DataFrame:
    """rows by the rules of checked(), as a condition that Spark evaluates where the rows are: reading one that breaks them fails with the columns'
    names. It is a filter, so leaving columns out does not leave it out."""
    have = set(rows.columns)
    right = {c: F.col(c).rlike(f"^(?:{form})\\z") for c, form in _FORMS.items() if c in have}
    right |= {c: F.col(c).rlike(r"\S") for c in _NAMES if c in have}
    right |= {c: F.col(c) >= 0 for c in _COUNTS if c in have}
    if "text" in have:
        right["text"] = (F.length("text") > 0) & (F.sha2("text", 256) == F.col("content_hash")) & (F.length("text") == F.col("char_count"))
    wrong = F.concat_ws(", ", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in sorted(right.items())])
    message = F.concat(F.lit("a stored row is corrupt in "), wrong, F.lit(": "), F.coalesce(F.col(ids[0]), F.lit("")))
    return rows.filter(F.when(wrong == "", F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
