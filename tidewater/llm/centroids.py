"""Centroid clustering in whole numbers, with dot products that are kept and changed rather than made anew."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import removed, written_at
from tidewater.sources.tables import spread

#: Integers up to this keep every dot product and squared distance of 64 components within 63 bits.
_LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, *, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<int>): floor(scale * x) of each component x, as a double, of the vectors that have exactly `dims`
    components, none of them null, NaN or infinite. Components of over 2**27 / scale are refused as well: squared distances
    between such vectors are no longs."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: F.floor(c.cast("double") * scale))
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < _LARGEST / scale)
    kept = vectors.filter(F.coalesce((F.size(F.col(f"`{vector_col}`")) == dims) & F.forall(F.col(f"`{vector_col}`"), fits), F.lit(False)))
    return kept.select(F.col(f"`{id_col}`").alias("id"), x.cast("array<int>").alias("v"))


def clusters(vectors: DataFrame, *, k: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """K-means over integers: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that
    whole_vectors() keeps.

    The k vectors with the smallest hex sha256 of "seed:id" are the first centroids, in that order. Each round gives every vector the nearest
    centroid by squared distance, the smaller number of equal ones, and replaces each centroid that has vectors by the
    floor of their mean; then vectors are assigned once more. `distance` is squared, `cluster_inertia` and `inertia` its sums over the
    cluster and over all; the digest is that of the centroid's components, joined by commas.

    A vector's row keeps its exact dot products with all centroids. When centroids move, each product changes by the
    moved components alone, and the nearest is chosen from products and norms: a round costs a product for each nonzero change, not for each
    component, and nothing once no centroid moves. Rows are written to the shared folder after a round, which cuts
    their lineage, and the round before is removed. Only k sums of a task leave it; the driver holds k centroids.

    Null ids are kept and come last among candidates for first centroids; of equal ids the smaller vector comes first; repeated
    rows are vectors of their own. With fewer than k vectors there are as many centroids; an empty table gives an empty one. Sums that pass 63 bits are null.
    Extra columns are not read.
    """
    if k < 1 or rounds < 0 or not 1 <= dims <= 64:
        raise ValueError("k must be positive, rounds not negative and dims from 1 to 64")
    spark = vectors.sparkSession
    at = written_at(spread(whole_vectors(vectors, dims=dims, scale=scale, id_col=id_col, vector_col=vector_col)), "vectors")
    state = spark.read.parquet(at)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.orderBy(F.asc_nulls_last(rank), "v").limit(k).select("v").collect()
    now = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    before = np.zeros_like(now)
    for done in range(rounds + 1):
        if done and (now == before).all():
            break
        earlier, at = at, written_at(_moved(state, before, now), "centroid-round")
        state, before = spark.read.parquet(at), now
        removed(spark, earlier)
        if done < rounds:
            now = _means(state, now)
    return _described(state, before, id_col)


def _of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _moved(state: DataFrame, before: np.ndarray, now: np.ndarray) -> DataFrame:
    """(id, v, dots, cluster) of the rows after centroids moved."""
    k, dims = now.shape
    changes = [(j, np.flatnonzero(d), d[d != 0]) for j, d in enumerate(now - before) if d.any()]
    norms = (now * now).sum(1)
    known = "dots" in state.columns

    def move(batches):
        for batch in batches:
            v = _of(batch.column("v"), dims)
            dots = _of(batch.column("dots"), k) if known else np.zeros((len(v), k), np.int64)
            for j, places, by in changes:
                dots[:, j] += v[:, places] @ by
            nearest = (norms - 2 * dots).argmin(1) if k else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * k, pa.int32()), pa.array(dots.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists, pa.array(nearest.astype(np.int32))], ["id", "v", "dots", "cluster"])

    schema = f"id {state.schema['id'].dataType.simpleString()}, v array<int>, dots array<bigint>, cluster int"
    return state.mapInArrow(move, schema)


def _means(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """The floors of the means of each cluster's vectors; empty clusters keep their centroid."""
    k, dims = now.shape

    def sums(batches):
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v, of = _of(batch.column("v"), dims), batch.column("cluster").to_numpy()
            for j in np.unique(of):
                own = v[of == j]
                total[j] += own.sum(0)
                n[j] += len(own)
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dims, pa.int32()), pa.array(total[some].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), lists], ["cluster", "n", "total"])

    parts = state.select("cluster", "v").mapInArrow(sums, "cluster int, n long, total array<bigint>")
    each = [F.sum(F.get("total", F.lit(i)).cast("decimal(20,0)")).alias(f"t{i}") for i in range(dims)]
    means = now.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():
        means[row["cluster"]] = [int(row[f"t{i}"]) // row["n"] for i in range(dims)]
    return means


def _described(state: DataFrame, now: np.ndarray, id_col: str) -> DataFrame:
    """Distances from the kept products, and their sums."""
    if not len(now):
        return state.select(F.col("id").alias(id_col), "cluster", *[F.lit(None).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit(None).cast("string").alias("centroid_sha256"))
    norms = F.array(*[F.lit(int(n)).cast("long") for n in (now * now).sum(1)])
    own = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    distance = own - 2 * F.get("dots", F.col("cluster")) + F.get(norms, F.col("cluster"))
    found = state.select(F.col("id").alias(id_col), "cluster", distance.alias("distance"))
    sums = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect())

    def whole(n: int) -> Column:
        return F.lit(int(n) if n < 1 << 63 else None).cast("long")

    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    digests = [F.sha2(F.lit(",".join(map(str, row))), 256) for row in now.tolist()]
    return found.select("*", of([whole(sums.get(j, 0)) for j in range(len(now))]).alias("cluster_inertia"), whole(sum(sums.values())).alias("inertia"), of(digests).alias("centroid_sha256"))
