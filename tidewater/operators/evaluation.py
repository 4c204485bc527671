"""Recall and reciprocal rank of rankings against a golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: categories of golden queries
CATEGORIES = ["lexical", "semantic", "mixed"]


def query_metrics(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall_at_k, reciprocal_rank) of retrieved (query_id, id, rank) and relevant (query_id, id); queries without a hit score 0."""
    golden = relevant.select("query_id", "id").distinct()
    hits = golden.join(retrieved.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    found = F.count(F.when(F.col("rank") <= k, 1))
    return hits.groupBy("query_id").agg((found / F.count("*")).alias("recall_at_k"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def judged_metrics(retrieved: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """query_metrics() where relevance is a property of the hit: of retrieved (query_id, rank, relevant) and judged (query_id, n_relevant), at
    most one row a query with n_relevant over 0. The relevant rows are counted, not paired with the queries."""
    rank = F.when(F.col("relevant"), F.col("rank"))
    hits = retrieved.groupBy("query_id").agg(F.count(F.when(rank <= k, 1)).alias("found"), F.min(rank).alias("first"))
    both = judged.join(hits, "query_id", "left")
    return both.select("query_id", (F.coalesce("found", F.lit(0)) / F.col("n_relevant")).alias("recall_at_k"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def category_breakdown(metrics: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, query_count, mean_recall_at_k, mrr); every category has a row. categories: (query_id, category)."""
    spark = metrics.sparkSession
    found = metrics.join(categories, "query_id").groupBy("category").agg(F.count("*").alias("query_count"), F.avg("recall_at_k").alias("mean_recall_at_k"), F.avg("reciprocal_rank").alias("mrr"))
    every = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return every.join(found, "category", "left").fillna(0).fillna(0.0)
