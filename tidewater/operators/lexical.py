"""BM25 over an inverted index with positions, as DataFrames; the best chunks without scoring every hit."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.errors import InvalidQueryError
from tidewater.functions.tokens import phrases, tokens

#: n, the number of chunks, and their mean length; (0, 0) of none.
Stats = tuple[float, float]
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MAX_RESULTS = 50
#: A place is its field's number times this, and its position.
FIELD = 1 << 32
#: So many candidates at most are broadcast to the postings of terms that make none.
CANDIDATES = 100_000
#: Of so many chunks at most that tie for the last places of a result, document ids are collected, to read details by them.
FEW = 1000


@dataclass(frozen=True)
class Index:
    """postings: (term, block, id, more columns, frequency, length, places) of each chunk and term in it; blocks: (term, block, n_chunks,
    max_frequency, min_length), whose n_chunks of a term add up to its chunks, corrections of a negative number included."""

    postings: DataFrame
    blocks: DataFrame
    stats: Stats


def _said(docs: DataFrame, fields: list[str], ids: list[str]) -> DataFrame:
    """(ids, said: an array of tokens for each field, length)"""
    said = docs.select(*ids, F.array(*[tokens(F.col(f)) for f in fields]).alias("said"))
    return said.withColumn("length", F.aggregate("said", F.lit(0).cast("long"), lambda n, t: n + F.size(t)))


def _places(said: Column) -> Column:
    """Every token with its place."""
    at = lambda t, k, i: F.struct(t.alias("term"), (k.cast("long") * FIELD + i).alias("place"))
    return F.flatten(F.transform(said, lambda of, k: F.transform(of, lambda t, i: at(t, k, i))))


def block_of(frequency: Column, length: Column) -> Column:
    """The class of a posting by what it can add to a score: half octaves of its frequency, quarter octaves of its chunk's length. Its order is
    no one's concern; what a class holds is close together, so its largest frequency and smallest length bound it well."""
    return (F.floor(2 * F.log2(frequency.cast("double"))) * 1000 + F.floor(4 * F.log2(F.greatest(length, F.lit(1)).cast("double")))).cast("int")


def _with_block(rows: DataFrame, ids: list[str]) -> DataFrame:
    rows = rows.withColumn("frequency", F.size("places"))
    return rows.select("term", block_of(F.col("frequency"), F.col("length")).alias("block"), *ids, "frequency", "length", "places")


def postings(docs: DataFrame, fields: list[str], id_col: str = "chunk_id", more: list[str] | None = None) -> DataFrame:
    """The postings of an Index: where each token of each row stands."""
    ids = [id_col, *(more or [])]
    each = _said(docs, fields, ids).select(*ids, "length", F.explode(_places(F.col("said"))).alias("t")).select(*ids, "length", "t.*")
    return _with_block(each.groupBy("term", *ids, "length").agg(F.sort_array(F.collect_list("place")).alias("places")), ids)


def marked(docs: DataFrame, fields: list[str], terms: list[str], id_col: str = "chunk_id", more: list[str] | None = None) -> DataFrame:
    """(ids, length, hits array<struct<term, places>>) of every row: its length and where the given terms stand, without a shuffle.

    Only the given terms' tokens become structs, and a row's are found once: an alias used inside a lambda is else put in its
    place and computed again for every term, so they are an array of one that is transformed."""
    ids, wanted = [id_col, *(more or [])], sorted(set(terms))
    at = lambda t, k, i: F.when(t.isin(wanted), F.struct(t.alias("term"), (k.cast("long") * FIELD + i).alias("place")))
    found = F.flatten(F.transform("said", lambda of, k: F.filter(F.transform(of, lambda t, i: at(t, k, i)), lambda t: t.isNotNull())))
    of = lambda found, term: F.transform(F.filter(found, lambda t: t["term"] == term), lambda t: t["place"])
    each = lambda found: F.transform(F.array(*map(F.lit, wanted)).cast("array<string>"), lambda term: F.struct(term.alias("term"), of(found, term).alias("places")))
    hits = F.element_at(F.transform(F.array(found), lambda found: F.filter(each(found), lambda h: F.size(h["places"]) > 0)), 1)
    return _said(docs, fields, ids).select(*ids, "length", hits.alias("hits"))


def index_of(marked_rows: DataFrame, id_col: str = "chunk_id", more: list[str] | None = None) -> Index:
    """The part of an index that the terms of marked() make up, from its rows, which should be written."""
    ids = [id_col, *(more or [])]
    rows = _with_block(marked_rows.select(*ids, "length", F.explode("hits").alias("h")).select(*ids, "length", "h.*"), ids)
    return Index(rows, blocks(rows), stats_of(marked_rows))


def blocks(rows: DataFrame) -> DataFrame:
    """The blocks of an Index."""
    return rows.groupBy("term", "block").agg(F.count("*").alias("n_chunks"), F.max("frequency").alias("max_frequency"), F.min("length").alias("min_length"))


def term_counts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(term, n_chunks, n_places): in how many rows, and how often in all, each token stands. One grouping, which pre-aggregates."""
    said = F.concat(*[tokens(F.col(f)) for f in fields])
    count = lambda chunks, places: lambda t: F.struct(t.alias("term"), F.lit(chunks).alias("c"), F.lit(places).alias("p"))
    rows = docs.select(said.alias("t")).select(F.explode(F.concat(F.transform("t", count(0, 1)), F.transform(F.array_distinct("t"), count(1, 0)))).alias("x"))
    return rows.groupBy("x.term").agg(F.sum("x.c").alias("n_chunks"), F.sum("x.p").alias("n_places"))


def lengths(docs: DataFrame, fields: list[str], id_col: str = "chunk_id", more: list[str] | None = None) -> DataFrame:
    """(id, more columns of the row, length): tokens over all fields."""
    total = sum((F.size(tokens(F.col(f))) for f in fields[1:]), F.size(tokens(F.col(fields[0]))))
    return docs.select(id_col, *(more or []), total.cast("long").alias("length"))


def corpus_stats(doc_lengths: DataFrame) -> DataFrame:
    """One row: n, the number of chunks, and mean, their mean length."""
    return doc_lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))


def stats_of(doc_lengths: DataFrame) -> Stats:
    """corpus_stats() as two numbers."""
    n, mean = corpus_stats(doc_lengths).first()
    return float(n), float(mean or 0.0)


# --- scores ------------------------------------------------------------------------


def idf_of(n: float, n_with: float) -> float:
    idf = math.log((n - n_with + 0.5) / (n_with + 0.5)) if 0 <= n_with <= n else 0.0
    return idf if idf > 0 else LEAST_IDF


def _part(idf: float, frequency: Column, length: Column, mean: float) -> Column:
    """What a phrase of that frequency adds: more for more, less in longer chunks."""
    f = frequency.cast("double")
    return F.lit(idf) * (f * F.lit(K1 + 1)) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean)))


def _bound(idf: float, frequency: float, length: float, mean: float) -> float:
    """_part() of numbers."""
    return idf * (frequency * (K1 + 1)) / (frequency + K1 * (1 - B + B * length / mean))


def phrase_matches(rows: DataFrame, asked: list[str], ids: list[str]) -> DataFrame:
    """(ids, length, frequency): how often the tokens of a phrase stand next to each other within a field, from the postings of its
    terms, which meet as one row each; places of different fields are too far apart to be neighbours."""
    terms = sorted(set(asked))
    met = rows.filter(F.col("term").isin(terms)).groupBy(*ids, "length").agg(F.collect_list(F.struct("term", "places")).alias("met"))
    start = lambda term, k: F.transform(F.filter("met", lambda x: x["term"] == term)[0]["places"], lambda p: p - k)
    starts = reduce(F.array_intersect, [start(term, k) for k, term in enumerate(asked)])
    return met.filter(F.size("met") == len(terms)).select(*ids, "length", F.size(starts).alias("frequency")).filter("frequency > 0")


@dataclass(frozen=True)
class Plan:
    """How a query is scored: its phrases by number, idf of each, what is read of each term (None: all its blocks), the
    score below which a chunk is not among the best, and the terms of which a chunk must have one, if there are others and a phrase of several tokens is none of them."""

    single: dict[str, list[int]]
    several: dict[int, list[str]]
    idf: dict[int, float]
    read: dict[str, list[int] | None]
    threshold: float
    essential: frozenset[str] | None = None


def plan(index: Index, asked: list[list[str]], ids: list[str], top: int | None = None, slack: float = 0.0) -> Plan:
    """Decides what must be read for the `top` best chunks; all of them without it.

    Blocks bound what their postings can add. From each term's best blocks the threshold is learnt: the top-th best sum of what
    is in them, below which no chunk's whole score can be, as nothing that is added is negative. A block is left out if
    its bound, with the best that all other phrases could add, stays below that. So every posting of a chunk that reaches the threshold is
    read, chunks that tie with it included, and the best are the same, with the same scores. Terms that together stay below it make no
    candidates; their postings count only for chunks that have another term, if those are few. Phrases of several tokens are read whole.
    """
    if sum(map(len, asked)) > 10_000:
        raise InvalidQueryError("the query has too many words")
    n, mean = index.stats
    single: dict[str, list[int]] = {}
    for p, phrase in enumerate(asked):
        if len(phrase) == 1:
            single.setdefault(phrase[0], []).append(p)
    several = {p: phrase for p, phrase in enumerate(asked) if len(phrase) > 1}
    heads = index.blocks.filter(F.col("term").isin(sorted(single))) if single else index.blocks.limit(0)
    heads = heads.groupBy("term", "block").agg(F.sum("n_chunks").alias("n"), F.max("max_frequency").alias("f"), F.min("min_length").alias("length")).collect()
    n_with = {t: sum(h["n"] for h in heads if h["term"] == t) for t in single}
    idf = {p: idf_of(n, n_with[t]) for t, of in single.items() for p in of}
    counts = {tuple(s): phrase_matches(index.postings, s, ids).count() for s in several.values()}
    idf |= {p: idf_of(n, counts[tuple(s)]) for p, s in several.items()}
    everything = Plan(single, several, idf, dict.fromkeys(single), 0.0)
    if not top or not single or not mean:
        return everything

    weight = {t: sum(idf[p] for p in of) for t, of in single.items()}
    bounds = {t: sorted(((_bound(weight[t], h["f"], h["length"], mean), h["block"], h["n"]) for h in heads if h["term"] == t and h["f"]), reverse=True) for t in single}
    if sum(len(b) for b in bounds.values()) < 2:
        return everything
    first = {}
    for t, of in bounds.items():
        first[t], have = [], 0
        for _, block, k in of:
            if have < top:
                first[t].append(block)
                have += k
    tried = scores(index, Plan(single, several, idf, first, 0.0), ids).orderBy("score").limit(top).agg(F.count("*"), -F.max("score")).first()
    if tried[0] < top:
        return everything
    threshold = tried[1] * (1 - 1e-9) - slack
    most = {t: max((b for b, *_ in of), default=0.0) for t, of in bounds.items()}
    total = sum(most.values()) + sum(idf[p] * (K1 + 1) for p in several)
    read = {t: [block for bound, block, _ in of if bound + total - most[t] >= threshold] for t, of in bounds.items()}
    least, below = 0.0, set()
    for t in sorted(most, key=most.get):
        if (least := least + most[t]) >= threshold:
            break
        below.add(t)
    essential = frozenset(t for t in single if t not in below and read[t])
    n_candidates = sum(k for t in essential for _, block, k in bounds[t] if block in read[t])
    few = below and not several and n_candidates <= CANDIDATES
    return Plan(single, several, idf, {t: None if len(read[t]) == len(of) else read[t] for t, of in bounds.items()}, threshold, essential if few else None)


def read_by(rows: DataFrame, read: dict[str, list[int] | None]) -> DataFrame:
    """The postings of those blocks, by conditions that reach the scan."""
    whole = sorted(t for t, of in read.items() if of is None)
    conditions = [F.col("term").isin(whole)] if whole else []
    conditions += [(F.col("term") == t) & F.col("block").isin(of) for t, of in sorted(read.items()) if of]
    return rows.filter(reduce(lambda a, b: a | b, conditions)) if conditions else rows.limit(0)


def scored_rows(index: Index, how: Plan, ids: list[str]) -> DataFrame:
    """The postings (term, ids, frequency, length) that a plan scores."""
    rows = read_by(index.postings, how.read).select("term", *ids, "frequency", "length")
    if how.essential is None:
        return rows
    sure = F.col("term").isin(sorted(how.essential))
    candidates = rows.filter(sure).select(ids[0]).distinct()
    return rows.filter(sure).unionByName(rows.filter(~sure).join(F.broadcast(candidates), ids[0], "left_semi").select(rows.columns))


def scores(index: Index, how: Plan, ids: list[str]) -> DataFrame:
    """(ids, score) by a plan; contributions are added in the query's order, so equal chunks tie to the last bit."""
    mean = index.stats[1] or 1.0
    kept = scored_rows(index, how, ids)
    one = lambda p: F.struct(F.lit(p).alias("phrase"), _part(how.idf[p], F.col("frequency"), F.col("length"), mean).alias("part"))
    of_term = F.coalesce(*[F.when(F.col("term") == t, F.array(*map(one, of))) for t, of in how.single.items()]) if how.single else None
    parts = [kept.select(*ids, of_term.alias("parts"))] if how.single else []
    parts += [phrase_matches(index.postings, s, ids).select(*ids, F.array(one(p)).alias("parts")) for p, s in how.several.items()]
    rows = reduce(DataFrame.unionByName, parts)
    summed = rows.groupBy(*ids).agg(F.sort_array(F.flatten(F.collect_list("parts"))).alias("parts"))
    return summed.select(*ids, (-F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"])).alias("score"))


def bm25(index: Index, asked: list[list[str]], id_col: str = "chunk_id", *, more: list[str] | None = None, top: int | None = None, slack: float = 0.0) -> DataFrame:
    """(id, more columns, score) of the chunks with any phrase; lower is better. A phrase asked twice counts twice. With `top`, only
    chunks that can be among that many best, `slack` less than the last of them included, have their score and must be there."""
    ids = [id_col, *(more or [])]
    if not asked:
        return index.postings.select(*ids, F.lit(0.0).alias("score")).limit(0)
    return scores(index, plan(index, asked, ids, top, slack), ids)


def checked_query(query: str, max_results: int, most: int = MAX_RESULTS) -> str:
    """The stripped query; InvalidQueryError if it is blank or the bound is not in 1 to most."""
    if not query.strip():
        raise InvalidQueryError("query must not be blank")
    if not 1 <= max_results <= most:
        raise InvalidQueryError(f"max_results must be from 1 to {most}")
    return query.strip()


def search(index: Index, query: str, *, tie: list[str], details: DataFrame, max_results: int = 10, id_col: str = "chunk_id", near: str | None = None) -> DataFrame:
    """The best chunks with details' columns, score and rank; ties go by `tie`, columns of details. `near` as in best_with_details()."""
    asked = phrases(checked_query(query, max_results))
    scored = bm25(index, asked, id_col, more=[near] if near else None, top=max_results)
    return best_with_details(scored, "score", details, tie, max_results, id_col, near=near)


def bm25_each(index: Index, asked: dict[str, list[list[str]]], id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score) of each query's chunks, as bm25() gives them, for a set of queries that the driver holds (query_id -> phrases).

    Each distinct phrase is matched once: those of one token are postings as they are, those of several meet in one
    grouping. The words of the set are joined to the postings, as a condition of the scan where they are few.
    """
    spark, (n, mean) = index.postings.sparkSession, index.stats
    number = {phrase: p for p, phrase in enumerate(dict.fromkeys(tuple(x) for of in asked.values() for x in of))}
    words = [(p, k, term, len(phrase)) for phrase, p in number.items() for k, term in enumerate(phrase)]
    query = spark.createDataFrame(words, "phrase int, k int, term string, size int")
    terms = sorted({w[2] for w in words})
    rows = index.postings.filter(F.col("term").isin(terms)) if len(terms) <= FEW else index.postings
    met = rows.join(query, "term")
    one = met.filter("size = 1").select("phrase", id_col, "length", "frequency")
    several = met.filter("size > 1").groupBy("phrase", "size", id_col, "length").agg(F.collect_list(F.transform("places", lambda p: p - F.col("k"))).alias("starts"))
    common = F.aggregate("starts", F.col("starts")[0], F.array_intersect)
    several = several.filter(F.size("starts") == F.col("size")).select("phrase", id_col, "length", F.size(common).alias("frequency")).filter("frequency > 0")
    matches = one.unionByName(several)
    # one number a phrase of the set
    n_with = dict(matches.groupBy("phrase").count().collect())
    weights = [(q, place, number[tuple(x)], idf_of(n, n_with.get(number[tuple(x)], 0))) for q, of in asked.items() for place, x in enumerate(of)]
    weighed = matches.join(spark.createDataFrame(weights, "query_id string, place int, phrase int, idf double"), "phrase")
    f = F.col("frequency").cast("double")
    part = F.col("idf") * (f * F.lit(K1 + 1)) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(mean or 1.0)))
    summed = weighed.groupBy("query_id", id_col).agg(F.sort_array(F.collect_list(F.struct("place", part.alias("part")))).alias("parts"))
    return summed.select("query_id", id_col, (-F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"])).alias("score"))


def best_each(scored: DataFrame, by: str, details: DataFrame, tie: list[str], n: int, id_col: str) -> DataFrame:
    """The n rows of each query of scored (query_id, id, by) that come first, with rank and the columns of details that break ties. Those that
    tie by `by` for the last places meet details; tasks keep a query's best before the exchange."""
    of_query = Window.partitionBy("query_id")
    few = scored.withColumn("_place", F.rank().over(of_query.orderBy(by))).filter(F.col("_place") <= n).drop("_place")
    known = few.join(details.select(*dict.fromkeys([id_col, *tie])), id_col)
    return known.withColumn("rank", F.row_number().over(of_query.orderBy(by, *tie))).filter(F.col("rank") <= n)


def best_with_details(scored: DataFrame, by: str, details: DataFrame, tie: list[str], n: int, id_col: str, digits: int | None = None, near: str | None = None) -> DataFrame:
    """The n rows of scored (id, by) that come first by `by`, ties by columns of details, with details' columns and rank.

    The n-th score is found first. Only ids up to it meet the columns that break ties, and only the n chosen ones meet the rest.
    `digits` rounds scores before they are compared. `near` is a column of both by which details are sorted: its values are then collected, if
    no more than FEW rows are left, so that the scan of details reads only where they are; else details are joined.
    """
    value = F.round(by, digits) if digits else F.col(by)
    last = scored.select(value.alias("_v")).orderBy("_v").limit(n).agg(F.max("_v").alias("_last"))
    few = scored.join(F.broadcast(last), value <= F.col("_last")).drop("_last")
    if near:
        rows = few.limit(FEW + 1).collect()
        if len(rows) <= FEW:
            few = scored.sparkSession.createDataFrame(rows, few.schema).drop(near)
            details = details.filter(F.col(near).isin(sorted({r[near] for r in rows})))
        else:
            few = few.drop(near)
    breaking = list(dict.fromkeys([id_col, *tie]))
    best = few.join(details.select(breaking), id_col).orderBy(value, *tie).limit(n)
    chosen = details.join(F.broadcast(best.select(id_col, by)), id_col)
    return ranked(chosen, [value, *tie])


def ranked(best: DataFrame, order: list) -> DataFrame:
    """Numbers the few rows of a result from 1."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
