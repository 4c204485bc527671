"""Reciprocal rank fusion of a lexical and a vector ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.errors import HybridFusionError
from tidewater.operators.lexical import MAX_RESULTS, ranked

RRF_K = 60


def candidate_count(max_results: int) -> int:
    return min(3 * max_results, MAX_RESULTS)


def contract_breaches(lexical: DataFrame, vector: DataFrame, id_col: str = "chunk_id", hash_col: str | None = "content_hash", by: list[str] | None = None) -> DataFrame:
    """(id, problem): ids that a side holds twice, or of which the sides hold different content; of each query apart, if `by` names its columns."""
    key = [*(by or []), id_col]
    twice = [side.groupBy(*key).count().filter("count > 1").select(id_col, F.lit(f"{name} repeats it").alias("problem")) for name, side in (("lexical", lexical), ("vector", vector))]
    found = twice[0].unionByName(twice[1])
    if hash_col:
        both = lexical.select(*key, F.col(hash_col).alias("a")).join(vector.select(*key, F.col(hash_col).alias("b")), key)
        found = found.unionByName(both.filter("a <> b").select(id_col, F.lit("content differs").alias("problem")))
    return found


def fuse(lexical: DataFrame, vector: DataFrame, *, max_results: int, tie: list[str], id_col: str = "chunk_id", hash_col: str | None = "content_hash", check: bool = True, by: list[str] | None = None) -> DataFrame:
    """Of two rankings with rank (and score, distance): the union by 1/(60 + rank), lexical term first, with each side's rank and score or null.
    With `by`, rankings of many queries, fused each by itself."""
    if check and (bad := contract_breaches(lexical, vector, id_col, hash_col, by).head()):
        raise HybridFusionError(f"{bad[0]}: {bad[1]}")
    key = [*(by or []), id_col]
    same = [c for c in lexical.columns if c not in ("rank", "score")]
    a = lexical.select(*same, F.col("rank").alias("lexical_rank"), F.col("score").alias("bm25_score"))
    b = vector.select(*[F.col(c).alias(f"_{c}") if c not in key else c for c in same], F.col("rank").alias("vector_rank"), F.col("distance").alias("vector_distance"))
    both = a.join(b, key, "full_outer")
    term = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    details = [c if c in key else F.coalesce(c, f"_{c}").alias(c) for c in same]
    fused = both.select(*details, (term("lexical_rank") + term("vector_rank")).alias("rrf_score"), "lexical_rank", "vector_rank", "bm25_score", "vector_distance")
    order = [F.desc("rrf_score"), F.least("lexical_rank", "vector_rank"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("vector_rank"), *tie]
    if by:
        return fused.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= max_results)
    return ranked(fused.orderBy(*order).limit(max_results), order)
