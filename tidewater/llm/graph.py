"""Connected components by alternating stars; no vertex's neighbours meet in one task's memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import with_groups, written


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of each vertex of edges (u, v), component its smallest
    reachable vertex. Loops and repeated edges don't matter; rows with a null are
    ignored; no edges give no rows.

    Each round hooks a vertex's larger neighbours, then its smaller ones, to the
    smallest; minima are pre-aggregated, written and joined back, so a hub with most
    of the edges is split by adaptive execution. It ends when a round changes nothing.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    pairs, before = written(pairs, "edges"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large")
        small = with_groups(large, ["u"], F.min("v").alias("m"), name="smallest").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = written(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).distinct()
        before = now
