"""Evaluation of the public search by a golden set of queries."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from fractions import Fraction
from pathlib import Path

from pyspark.sql import functions as F

from tidewater.errors import EvaluationDatasetError, EvaluationRunnerError
from tidewater.functions.text import UNIT, id_of, path_of
from tidewater.operators.evaluation import CATEGORIES, query_metrics
from tidewater.plans.service import STRATEGIES, KnowledgeService


@dataclass(frozen=True)
class GoldenQuery:
    query_id: str
    query: str
    category: str
    relevant: tuple[str, ...]


@dataclass(frozen=True)
class GoldenDataset:
    source_id: str
    max_chunk_chars: int
    queries: tuple[GoldenQuery, ...]

    @staticmethod
    def load(path: str | Path) -> GoldenDataset:
        """Reads and checks a golden set; references become chunk ids by identity alone."""
        try:
            data = json.loads(Path(path).read_text("utf-8"))
            queries = tuple(GoldenQuery(q["query_id"], q["query"], q["category"], tuple(map(_reference, q["relevant"]))) for q in data["queries"])
            found = GoldenDataset(data["source_id"], int(data["max_chunk_chars"]), queries)
        except (OSError, KeyError, TypeError, ValueError) as error:
            raise EvaluationDatasetError(f"not a golden set: {error}") from error
        ids = [q.query_id for q in queries]
        wrong = [q.query_id for q in queries if not q.query_id.strip() or not q.query.strip() or not q.relevant or len(set(q.relevant)) < len(q.relevant) or q.category not in CATEGORIES]
        if wrong or not ids or len(set(ids)) < len(ids) or found.max_chunk_chars <= 0:
            raise EvaluationDatasetError(f"not a golden set: {wrong or 'queries are missing or repeated'}")
        return found


def _reference(r: dict) -> str:
    document = id_of("doc_", r["source_id"], path_of(r["relative_path"]))
    return id_of("chunk_", document, UNIT.join(r["section_path"]), r["section_occurrence"], r["ordinal_in_section"])


def recall_at_k(retrieved: list[str], relevant: list[str], k: int) -> float:
    if not relevant:
        raise ValueError("nothing is relevant")
    wanted = set(relevant)
    return len(wanted & set(retrieved[:k])) / len(wanted)


def reciprocal_rank(retrieved: list[str], relevant: list[str]) -> float:
    return next((1 / n for n, x in enumerate(retrieved, 1) if x in set(relevant)), 0.0)


def _mean(values: list[float]) -> float:
    return float(sum(map(Fraction, values)) / len(values)) if values else 0.0


@dataclass(frozen=True)
class Report:
    k: int
    total_queries: int
    strategies: list[dict]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def run_evaluation(service: KnowledgeService, dataset: GoldenDataset, *, strategies: tuple[str, ...] = STRATEGIES, k: int = 5) -> Report:
    """Recall at k and mean reciprocal rank, by strategy and category. Every reference must exist before anything runs. All queries of a strategy are
    searched by one plan, and measured by another; the driver gets what the report lists."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark = service.store.reading
    golden = spark.createDataFrame([(q.query_id, c) for q in dataset.queries for c in q.relevant], "query_id string, id string")
    chunks = service.store.table("chunks").select(F.col("chunk_id").alias("id"))
    if gone := golden.join(chunks, "id", "left_anti").head():
        raise EvaluationDatasetError(f"a relevant chunk does not exist: {gone[0]}")
    out = []
    for strategy in strategies:
        hits = service.search_each({q.query_id: q.query for q in dataset.queries}, strategy, k).collect()
        found = {q.query_id: [h["chunk_id"] for h in sorted(hits, key=lambda h: h["rank"]) if h["query_id"] == q.query_id] for q in dataset.queries}
        if twice := [q for q, got in found.items() if len(set(got)) < len(got)]:
            raise EvaluationRunnerError(f"{twice[0]}/{strategy}: a chunk came twice")
        retrieved = spark.createDataFrame([(q, c, n) for q, got in found.items() for n, c in enumerate(got, 1)], "query_id string, id string, rank int")
        metrics = {r["query_id"]: r for r in query_metrics(retrieved, golden, k).collect()}
        rows = [{"query_id": q.query_id, "category": q.category, "relevant_chunk_ids": list(q.relevant), "retrieved_chunk_ids": found[q.query_id], **{m: metrics[q.query_id][m] for m in ("recall_at_k", "reciprocal_rank")}} for q in dataset.queries]
        of = lambda some: {"query_count": len(some), "mean_recall_at_k": _mean([r["recall_at_k"] for r in some]), "mrr": _mean([r["reciprocal_rank"] for r in some])}
        breakdown = [{"category": c} | of([r for r in rows if r["category"] == c]) for c in CATEGORIES]
        out.append({"strategy": strategy} | of(rows) | {"category_breakdown": breakdown, "query_results": rows})
    return Report(k, len(dataset.queries), out)
