"""Exact nearest neighbours by Euclidean distance, with groups of vectors around pivots that the triangle inequality rules out."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.vectors import l2_distance, valid_vector
from tidewater.operators.lexical import best_with_details
from tidewater.sources.tables import shared_folder, written

#: So many vectors at most are pivots of a table.
PIVOTS = 64
#: What is taken off and put on bounds, since distances are rounded: a share of them.
_SLACK = 1e-6


@dataclass(frozen=True)
class Group:
    """Vectors around a pivot: how many, and how far the nearest and the farthest are from it."""

    pivot: int
    center: tuple[float, ...]
    n: int
    least: float
    most: float

    def distance(self, query: list[float]) -> float:
        return math.dist(self.center, query)

    def bound(self, query: list[float]) -> float:
        """No vector of the group is nearer to the query."""
        d = self.distance(query)
        return max(0.0, d - self.most, self.least - d)


def pivots_of(vectors: DataFrame, *, n: int = PIVOTS, id_col: str = "chunk_id", vector_col: str = "embedding") -> list[list[float]]:
    """n vectors of the table, those with the smallest hashes of their ids, equal ones once. Which ones they are changes what is skipped, not what is found."""
    sample = vectors.orderBy(F.xxhash64(id_col), vector_col).limit(n).select(vector_col).collect()
    return [list(v) for v in dict.fromkeys(tuple(r[0]) for r in sample)]


def grouped(vectors: DataFrame, pivots: list[list[float]], *, vector_col: str = "embedding") -> DataFrame:
    """vectors with `pivot`, the number of the nearest pivot, and `pivot_distance`, on the map side. Vectors must be of the pivots' length and finite.
    Without pivots both are null."""
    if not pivots:
        return vectors.withColumns({"pivot": F.lit(None).cast("int"), "pivot_distance": F.lit(None).cast("double")})
    centers = np.array(pivots, np.float64)
    norms = (centers * centers).sum(1)

    def assign(batches):
        for batch in batches:
            column = batch.column(vector_col)
            v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
            nearest = (norms - 2 * v @ centers.T).argmin(1) if len(v) else np.empty(0, np.int64)
            far = np.sqrt(((v - centers[nearest]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(far)], [*batch.schema.names, "pivot", "pivot_distance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(assign, f"{schema}, pivot int, pivot_distance double")


def group_rows(rows: DataFrame) -> DataFrame:
    """(pivot, n, least, most) of grouped() rows, one for each pivot that has some."""
    return rows.groupBy("pivot").agg(F.count("*").alias("n"), F.min("pivot_distance").alias("least"), F.max("pivot_distance").alias("most"))


def groups_of(rows: DataFrame, pivots: list[list[float]]) -> list[Group]:
    """Groups from group_rows() of one table or of several with the same pivots; there are PIVOTS at most.
    None where vectors were grouped without pivots."""
    whole = rows.groupBy("pivot").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
    if any(r["pivot"] is None for r in whole):
        return []
    return [Group(r["pivot"], tuple(pivots[r["pivot"]]), r["n"], r["least"], r["most"]) for r in whole]


def within_reach(vectors: DataFrame, groups: list[Group], query: list[float], k: int, *, vector_col: str = "embedding") -> DataFrame:
    """The rows of grouped() vectors that can be among the k nearest, those that tie with the last one included.

    The nearest groups with k vectors give a distance that the k-th nearest does not pass. By the triangle inequality a vector is no nearer than its pivot's
    distance from the query and its own from the pivot differ; so whole groups are left out, and of others all but a ring, by
    conditions on the sorted columns of the table.
    """
    near, have = [], 0
    for g in sorted(groups, key=lambda g: (g.bound(query), g.distance(query))):
        if have < k:
            near.append(g.pivot)
            have += g.n
    tried = vectors.filter(F.col("pivot").isin(near)).select(_distance_to(query, vector_col).alias("d")).orderBy("d").limit(k).agg(F.count("*"), F.max("d")).first()
    if tried[0] < k:
        return vectors
    reach = tried[1] * (1 + _SLACK)
    rings = [(F.col("pivot") == g.pivot) & F.col("pivot_distance").between(*_ring(g.distance(query), reach)) for g in groups if g.bound(query) <= reach + _SLACK * g.most]
    return vectors.filter(reduce(lambda a, b: a | b, rings))


def _ring(distance: float, reach: float) -> tuple[float, float]:
    return (distance - reach) - _SLACK * distance, (distance + reach) + _SLACK * distance


def _distance_to(query: list[float], vector_col: str) -> Column:
    return l2_distance(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))


def nearest(
    vectors: DataFrame, query: list[float], *, details: DataFrame, tie: list[str], max_results: int = 10, id_col: str = "chunk_id", vector_col: str = "embedding", near: str | None = None, groups: list[Group] | None = None
) -> DataFrame:
    """The nearest chunks with details' columns, distance and rank. Distances alone pick what details are looked up for; `near` as in best_with_details().
    With the groups of grouped() vectors, only those within reach have their distance computed; the result is the same."""
    some = within_reach(vectors, groups, query, max_results, vector_col=vector_col) if groups else vectors
    rows = some.select(id_col, *([near] if near else []), _distance_to(query, vector_col).alias("distance"))
    return best_with_details(rows, "distance", details, tie, max_results, id_col, near=near)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str, query_col: str, vector_col: str = "embedding", block: int = 500, n_pivots: int = PIVOTS) -> DataFrame:
    """(query, id, distance, rank): for each row of queries (query, vector) its k nearest vectors, ties by id; rows of one query count as one. Vectors that
    are null, not finite or of another length than most are no one's neighbours, nor do such queries have any.

    A stated query set against all rows, in blocks of about `block` queries, of which the driver holds one at a time. Vectors are grouped around pivots and
    written once; each block is answered as by pairs_each(), and if there are several, its result is written before the next.
    """
    spark = vectors.sparkSession
    size = vectors.filter(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("size")).count().orderBy(F.desc("count"), "size").first()
    dims = size[0] if size else 0
    kept = vectors.filter(valid_vector(F.col(vector_col), dims)).select(id_col, vector_col)
    asked = queries.filter(valid_vector(F.col(vector_col), dims)).select(F.col(query_col).alias("query"), F.col(vector_col).alias("asked")).dropDuplicates(["query"])
    pivots = pivots_of(kept, n=n_pivots, id_col=id_col, vector_col=vector_col)
    rows = written(grouped(kept, pivots, vector_col=vector_col).sortWithinPartitions("pivot"), "grouped")
    groups = groups_of(group_rows(rows), pivots)
    kind = asked.schema["query"].dataType.simpleString()

    def answer(part: DataFrame) -> DataFrame:
        held = [(r["query"], list(r["asked"])) for r in part.collect()]
        return _best(pairs_each(rows, groups, held, k, id_col=id_col, vector_col=vector_col, kind=kind), k, id_col)

    blocks = -(-asked.count() // block)
    if blocks <= 1:
        return answer(asked)
    at = f"{shared_folder(spark)}/nearest-{uuid.uuid4().hex}"
    # dealt round robin, so blocks are of like size whatever the ids are
    numbered = asked.repartition(blocks).withColumn("block", F.spark_partition_id())
    numbered.write.partitionBy("block").parquet(f"{at}/queries")
    for b in range(numbered.rdd.getNumPartitions()):
        part = spark.read.schema(numbered.schema).parquet(f"{at}/queries").filter(F.col("block") == b).drop("block")
        answer(part).write.mode("append").parquet(f"{at}/found")
    return spark.read.parquet(f"{at}/found")


def reaches(vectors: DataFrame, groups: list[Group], asked: np.ndarray, k: int, *, vector_col: str = "embedding") -> np.ndarray:
    """For each query a distance that its k-th nearest does not pass, infinite where that is not known: the k-th nearest of the vectors of the group
    that is nearest to it, and of as many more as have k."""
    starts: list[set[int]] = []
    for q in asked.tolist():
        near, have = set(), 0
        for g in sorted(groups, key=lambda g: (g.bound(q), g.distance(q))):
            if have >= k:
                break
            near.add(g.pivot)
            have += g.n
        starts.append(near)
    by_pivot = {g.pivot: np.array([i for i, near in enumerate(starts) if g.pivot in near], np.int64) for g in groups}

    def least(batches):
        best = np.full((len(asked), k), np.inf)
        for batch in batches:
            for rows, pivot, v in _slices(batch, vector_col):
                if len(some := by_pivot.get(pivot, ())):
                    best[some] = np.sort(np.concatenate([best[some], _distances(v, asked[some])[1].T], axis=1), axis=1)[:, :k]
        found = np.argwhere(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(best[found[:, 0], found[:, 1]])], ["i", "d"])

    reach = np.full(len(asked), np.inf)
    ranked_rows = vectors.filter(F.col("pivot").isin([p for p, some in by_pivot.items() if len(some)])).select("pivot", vector_col).mapInArrow(least, "i long, d double")
    last = ranked_rows.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy("d"))).filter(F.col("place") == k)
    for row in last.select("i", "d").collect():
        reach[row["i"]] = row["d"]
    return reach


def _slices(batch: pa.RecordBatch, vector_col: str):
    """(rows, pivot, vectors) of each pivot in a batch; None of vectors without pivots."""
    v = batch.column(vector_col).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    pivots = np.array([-1 if p is None else p for p in batch.column("pivot").to_pylist()], np.int64)
    for p in np.unique(pivots):
        rows = np.flatnonzero(pivots == p)
        yield rows, int(p) if p >= 0 else None, v[rows]


def _distances(v: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all pairs by one product of matrices, as lower and upper bounds that cover its rounding, which grows with the vectors' lengths."""
    a, b = (v * v).sum(1)[:, None], (asked * asked).sum(1)[None, :]
    d, off = np.sqrt(np.maximum(a + b - 2 * v @ asked.T, 0)), _SLACK * (np.sqrt(a) + np.sqrt(b))
    return d - off, d + off


def pairs_each(vectors: DataFrame, groups: list[Group], asked: list[tuple], k: int, *, id_col: str = "chunk_id", vector_col: str = "embedding", kind: str = "string") -> DataFrame:
    """(query, id, distance) of pairs of which each query's k nearest, and those that tie with the last of them, are part, for queries (query, vector)
    that the driver holds, at most a block of them, with vectors of one length.

    A task compares its vectors with the queries whose reach their group is in, by products of matrices, and keeps for each query those that may be among
    the k nearest of the batch; the distances of these are then computed one by one. `groups` may be empty.
    """
    spark = vectors.sparkSession
    queries = spark.createDataFrame([(i, q, [float(x) for x in v]) for i, (q, v) in enumerate(asked)], f"i long, query {kind}, asked array<double>")
    matrix = np.array([v for _, v in asked], np.float64).reshape(len(asked), -1)
    reach = reaches(vectors, groups, matrix, k, vector_col=vector_col) if groups and len(asked) else np.full(len(asked), np.inf)
    bounds = {g.pivot: np.array([g.bound(q) - _SLACK * g.distance(q) for q in matrix.tolist()]) for g in groups}

    def meet(batches):
        for batch in batches:
            for rows, pivot, v in _slices(batch, vector_col):
                some = np.flatnonzero(bounds[pivot] <= reach) if pivot in bounds else np.arange(len(matrix))
                if not len(some):
                    continue
                lower, upper = _distances(v, matrix[some])
                last = np.minimum(np.partition(upper, k - 1, axis=0)[k - 1] if len(v) > k else np.inf, reach[some])
                at, q = np.nonzero(lower <= last)
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows[at])), batch.column(vector_col).take(pa.array(rows[at])), pa.array(some[q])], [id_col, vector_col, "i"])

    schema = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, `{vector_col}` {vectors.schema[vector_col].dataType.simpleString()}, i long"
    near = vectors.select(id_col, vector_col, "pivot").mapInArrow(meet, schema).join(F.broadcast(queries), "i")
    return near.select("query", id_col, l2_distance(F.col(vector_col), F.col("asked")).alias("distance"))


def _best(pairs: DataFrame, k: int, id_col: str) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", id_col))).filter(F.col("rank") <= k)
