"""A training corpus from documents: quality rules, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.decontamination import contaminated
from tidewater.llm.line_dedup import dedup_lines
from tidewater.llm.ngram_join import similar_documents
from tidewater.llm.packing import pack
from tidewater.llm.quality import SAYS, quality
from tidewater.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines; null and empty texts fail. Repeated rows are judged alike."""
    kept = quality(docs).filter("quality.kept").withColumn("text", F.col("quality.cleaned"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur earlier, up to one changed, missing or extra word in ten; those without a word left go,
    null and empty texts too. Rows with one id and text count as one document and stay both."""
    kept = dedup_lines(docs, edits_in=10).drop("line_dedup").filter(F.col("text").rlike(SAYS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id. Of rows with one id, a representative's, the first text
    stays. Documents with a null id, or without a word, are alike to none and stay."""
    groups = similar_documents(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    rest = docs.join(groups, "doc_id", "left_anti").select(docs.columns)
    named = rest.filter("doc_id is not null")
    first = named.groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNull(), *[F.col(f"`{c}`") for c in docs.columns if c != "doc_id"])).alias("first"))
    one = first.select(*[F.col("doc_id") if c == "doc_id" else F.col("first").getField(c).alias(c) for c in docs.columns])
    return one.unionByName(rest.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs; null and empty texts stay. All rows of an id go if one of them has an item; a row
    with a null id goes if any such row has one."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_found"]), "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; null and empty texts hold the end token alone. Every row is packed."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=0)


#: In this order; each works on all that the one before it kept.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Alignment and tokenization have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
