"""What changes when a full snapshot of a source replaces an earlier one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ["created", "updated", "reprocessed", "unchanged", "deleted"]


def classify(before: DataFrame, now: DataFrame, fingerprint: str = "processing_fingerprint") -> DataFrame:
    """(document_id, source_id, status) of the documents of both snapshots, by content and processing."""
    keys = ["document_id", "source_id", "content_hash", fingerprint]
    b = before.select(*[F.col(c).alias(f"b_{c}") for c in keys])
    n = now.select(*[F.col(c).alias(f"n_{c}") for c in keys])
    both = b.join(n, F.col("b_document_id") == F.col("n_document_id"), "full_outer")
    status = (
        F.when(F.col("b_document_id").isNull(), "created")
        .when(F.col("n_document_id").isNull(), "deleted")
        .when(F.col("b_content_hash") != F.col("n_content_hash"), "updated")
        .when(F.col(f"b_{fingerprint}") != F.col(f"n_{fingerprint}"), "reprocessed")
        .otherwise("unchanged")
    )
    return both.select(F.coalesce("n_document_id", "b_document_id").alias("document_id"), F.coalesce("n_source_id", "b_source_id").alias("source_id"), status.alias("status"))


def merge(before: DataFrame, now: DataFrame, status: DataFrame) -> DataFrame:
    """The rows of before that stay as they are, and those of now that are new or changed."""
    same = status.filter("status = 'unchanged'").select("document_id")
    written = status.filter("status in ('created', 'updated', 'reprocessed')").select("document_id")
    return before.join(same, "document_id", "left_semi").unionByName(now.join(written, "document_id", "left_semi"))
