import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidewater.errors import HybridFusionError, InvalidQueryError
from tidewater.functions.tokens import phrases
from tidewater.operators import fusion, lexical, vector


def test_bm25_is_that_of_a_full_text_index(spark):
    rng = random.Random(1)
    words = ["pay", "payments-service", "MAX_RETRY", "Café", "retry", "a.md", "/health/ready", "ς", "straße", "漢字", "the", "²"]
    rows = [(f"c{k}", " ".join(rng.choices(words, k=rng.randint(1, 3))), " ".join(rng.choices(words, k=rng.randint(1, 30)))) for k in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, text, tokenize=\"unicode61 tokenchars '_-'\")")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    docs = spark.createDataFrame(rows, "chunk_id string, title string, text string").cache()
    fields = ["title", "text"]
    rows = lexical.postings(docs, fields).cache()
    index = lexical.Index(rows, lexical.blocks(rows), lexical.stats_of(lexical.lengths(docs, fields)))
    for query in ["pay", "retry retry cafe", "/health/ready a.md", "payments", "Σ STRASSE straße", "²", "the pay 漢字"]:
        match = " OR ".join(f'"{w}"' for w in query.split())
        expected = dict(db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", [match]).fetchall())
        asked = phrases(query)
        got = dict(lexical.bm25(index, asked).collect())
        assert got.keys() == expected.keys(), query
        assert all(abs(got[k] - v) < 1e-9 for k, v in expected.items()), query
        # the same of an index of the query's own terms
        own = lexical.index_of(lexical.marked(docs, fields, [t for phrase in asked for t in phrase]).cache())
        assert dict(lexical.bm25(own, asked).collect()) == got, query


def test_pruned_search_reads_less_and_finds_the_same(spark):
    """Texts of many lengths, a word in all of them, some rare ones, and many equal texts that tie for the last places."""
    rng = random.Random(2)
    texts = [" ".join(["common"] * rng.randint(1, 6) + [f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 80))] + ["rare"] * (k % 97 == 0) + ["some"] * (k % 7 == 0)) for k in range(1500)]
    texts += ["common rare"] * 40 + ["common some words"] * 60
    docs = spark.createDataFrame([(f"c{k:05d}", t) for k, t in enumerate(texts)], "chunk_id string, text string").cache()
    rows = lexical.postings(docs, ["text"]).cache()
    index = lexical.Index(rows, lexical.blocks(rows), lexical.stats_of(lexical.lengths(docs, ["text"])))
    for query, less in [("rare", 0.9), ("common", 0.5), ("common rare", 0.5), ("some common rare common", 0.5), ("common w1 w2 nothing", 1), ("rare/common some", 1), ("common/rare", 1)]:
        asked = phrases(query)
        whole = lexical.bm25(index, asked).collect()
        for top in (1, 10, 45):
            how = lexical.plan(index, asked, ["chunk_id"], top)
            hits = rows.filter(F.col("term").isin(list(how.single))).count()
            read = lexical.scored_rows(index, how, ["chunk_id"]).count() if how.single else 0
            assert read <= hits * (less if top <= 10 else 1)
            found = {r["chunk_id"]: r["score"] for r in lexical.bm25(index, asked, top=top).collect()}
            last = sorted(r["score"] for r in whole)[min(top, len(whole)) - 1]
            best = {r["chunk_id"]: r["score"] for r in whole if r["score"] <= last}
            # all that tie for the last place are there, with the same bits
            assert best.items() <= found.items() and all(s > last for c, s in found.items() if c not in best)
        got = [lexical.search(index, query, tie=["chunk_id"], details=docs, max_results=45).select("chunk_id", "score", "rank").collect(), lexical.ranked(lexical.bm25(index, asked).orderBy("score", "chunk_id").limit(45), ["score", "chunk_id"]).collect()]
        assert sorted(map(tuple, got[0]), key=lambda r: r[2]) == sorted(map(tuple, got[1]), key=lambda r: r[2])


def test_a_filter_on_blocks_reaches_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(f"c{k}", "a " * (k % 9 + 1) + "b " * (k % 50)) for k in range(400)], "chunk_id string, text string")
    lexical.postings(docs, ["text"]).sortWithinPartitions("term", "block").write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    index = lexical.Index(rows, lexical.blocks(rows), lexical.stats_of(lexical.lengths(docs, ["text"])))
    how = lexical.plan(index, [["a"]], ["chunk_id"], 3)
    assert any(of is not None for of in how.read.values())
    plan = lexical.scores(index, how, ["chunk_id"])._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "EqualTo(term" in pushed and "block" in pushed.split("PushedFilters", 1)[1] and "places" not in pushed.split("ReadSchema", 1)[1]


def test_queries_without_tokens_and_bad_bounds(spark):
    assert phrases("!! ...") == []
    for query, n in [("", 5), ("  ", 5), ("x", 0), ("x", 51)]:
        with pytest.raises(InvalidQueryError):
            lexical.checked_query(query, n)


def test_nearest_takes_ties_by_path(spark):
    details = spark.createDataFrame([("a", "z.md"), ("b", "y.md"), ("c", "x.md")], "chunk_id string, relative_path string")
    v = spark.createDataFrame([("a", [0.0, 3.0]), ("b", [3.0, 0.0]), ("c", [9.0, 9.0])], "chunk_id string, embedding array<float>")
    got = vector.nearest(v, [0.0, 0.0], details=details, tie=["relative_path", "chunk_id"], max_results=2).collect()
    assert [(r.chunk_id, r["rank"], r.distance) for r in got] == [("b", 1, 3.0), ("a", 2, 3.0)]


def test_nearest_each_in_blocks(spark):
    v = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(30)], "vec_id long, embedding array<float>")
    asked = v.filter("vec_id % 7 = 0")
    one = vector.nearest_each(v, asked, 3, id_col="vec_id", query_col="vec_id").orderBy("query", "rank").collect()
    many = vector.nearest_each(v, asked, 3, id_col="vec_id", query_col="vec_id", block=2).orderBy("query", "rank").collect()
    assert one == many and len(one) == 15


def test_pivots_leave_out_what_is_too_far(spark, tmp_path):
    """Vectors in clusters, many equal ones that tie, one group with far members: fewer distances, and the same neighbours as a scan."""
    rng = random.Random(3)
    rows = [(k, [rng.gauss(5 * (k % 40), 0.4), rng.gauss(-3 * (k % 7), 0.4), rng.gauss(0, 0.4)]) for k in range(2000)] + [(3000 + k, [1.0, 2.0, 3.0]) for k in range(30)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()
    details = v.select("vec_id", (-F.col("vec_id")).alias("place"))
    pivots = vector.pivots_of(v, n=40, id_col="vec_id")
    vector.grouped(v, pivots).sortWithinPartitions("pivot", "pivot_distance").write.parquet(str(tmp_path / "v"))
    kept = spark.read.parquet(str(tmp_path / "v"))
    groups = vector.groups_of(vector.group_rows(kept), pivots)
    assert sum(g.n for g in groups) == 2030
    for query in (rows[17][1], [1.0, 2.0, 3.0], [1000.0, 0.0, 0.0], [90.0, -8.0, 0.1]):
        reached = vector.within_reach(kept, groups, query, 10)
        assert reached.count() <= 0.35 * 2030
        assert "pivot_distance" in reached._jdf.queryExecution().executedPlan().toString().split("PushedFilters", 1)[1].split("ReadSchema")[0]
        found = [vector.nearest(t, query, details=details, tie=["place"], max_results=10, id_col="vec_id", groups=g).select("vec_id", "rank", "distance").orderBy("rank").collect() for t, g in ((kept, groups), (v, None))]
        assert found[0] == found[1] and len(found[0]) == 10
    assert vector.nearest(kept, rows[0][1], details=details, tie=["place"], max_results=50, id_col="vec_id", groups=groups).count() == 50
    assert vector.within_reach(kept, groups, rows[0][1], 3000).count() == 2030

    asked = v.filter("vec_id % 50 = 0").unionByName(spark.createDataFrame([(None, [1.0, 2.0, 3.0]), (9001, [1.0]), (9002, None)], v.schema))
    got = vector.nearest_each(v.unionByName(spark.createDataFrame([(8001, [float("nan")] * 3), (8002, [1.0]), (8003, None)], v.schema)), asked, 5, id_col="vec_id", query_col="vec_id", block=7, n_pivots=40)
    near = lambda a, b: math.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)))
    floats = [(r["vec_id"], list(r["embedding"])) for r in v.collect()]
    want = {}
    for q, a in [*[(i, e) for i, e in floats if i % 50 == 0], (None, [1.0, 2.0, 3.0])]:
        want[q] = [i for _, i in sorted((near(e, a), i) for i, e in floats)[:5]]
    found = {}
    for r in sorted(got.collect(), key=lambda r: (str(r["query"]), r["rank"])):
        found.setdefault(r["query"], []).append(r["vec_id"])
    assert found == want
    few = [(q["vec_id"], list(q["embedding"])) for q in asked.filter("vec_id < 9000").collect()]
    pairs = vector.pairs_each(kept, groups, few, 5, id_col="vec_id", kind="long").count()
    assert pairs <= 0.1 * 2030 * len(few)
    # far from the origin, where products of matrices round most
    apart = spark.createDataFrame([(k, [1e6 + k % 13 * 1e-3, 1e6, -1e6 + k // 13 * 1e-3]) for k in range(300)], "vec_id long, embedding array<double>")
    got = {(r["query"], r["vec_id"]) for r in vector.nearest_each(apart, apart.filter("vec_id % 50 = 0"), 4, id_col="vec_id", query_col="vec_id", n_pivots=9).collect()}
    rows = [(r["vec_id"], list(r["embedding"])) for r in apart.collect()]
    assert got == {(q, i) for q, a in rows if q % 50 == 0 for _, i in sorted((near(e, a), i) for i, e in rows)[:4]}
    alone = vector.pairs_each(kept, [], few, 5, id_col="vec_id", kind="long")
    assert {(r["query"], r["vec_id"]) for r in vector._best(alone, 5, "vec_id").collect()} == {(q, i) for q, of in want.items() if q is not None for i in of}


def sides(spark):
    lex = spark.createDataFrame([("A", "a.md", 0, "h1", 1, -2.0), ("B", "b.md", 0, "h2", 2, -1.0)], "chunk_id string, relative_path string, ordinal int, content_hash string, rank int, score double")
    vec = spark.createDataFrame([("B", "b.md", 0, "h2", 1, 0.1), ("C", "c.md", 0, "h3", 2, 0.2)], "chunk_id string, relative_path string, ordinal int, content_hash string, rank int, distance double")
    return lex, vec


def test_fusion_by_hand(spark):
    lex, vec = sides(spark)
    got = fusion.fuse(lex, vec, max_results=3, tie=["relative_path", "ordinal", "chunk_id"]).collect()
    assert [r.chunk_id for r in got] == ["B", "A", "C"]
    assert got[0].rrf_score == 1 / 62 + 1 / 61 and got[1].vector_rank is None and got[2].bm25_score is None


def test_fusion_refuses_broken_sides(spark):
    lex, vec = sides(spark)
    for a, b in [(lex.union(lex), vec), (lex, vec.withColumn("content_hash", F.lit("x")))]:
        with pytest.raises(HybridFusionError):
            fusion.fuse(a, b, max_results=3, tie=["chunk_id"])


def test_hits_are_found_once_a_row_whatever_the_number_of_terms(spark):
    docs = spark.createDataFrame([("a", "The the of x"), ("b", "é thé"), ("c", None)], "chunk_id string, text string")
    got = lexical.marked(docs, ["text", "chunk_id"], ["the", "of", "a", "nowhere"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # outside of the lambda over terms
    hits = plan[plan.index("AS length") :]
    assert hits.count("flatten(") == 1 and hits.index("flatten(") < hits.index("lambdafunction(")
    found = {r.chunk_id: (r.length, [(h.term, list(h.places)) for h in r.hits]) for r in got.collect()}
    assert found == {"a": (5, [("a", [lexical.FIELD]), ("of", [2]), ("the", [0, 1])]), "b": (3, [("the", [1])]), "c": (1, [])}


def test_ascii_tokens_are_those_of_the_general_rule(spark):
    from tidewater.functions.tokens import TOKEN, folded, tokens

    texts = ["".join(map(chr, range(128))), "A_b-C 9z\tx--y\n", "K İ ß Ａ", "naïve Ŝ ² ½ é", "", "\x7f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    general = F.regexp_extract_all(folded(F.col("t")), F.lit(TOKEN), F.lit(0))
    assert all(a == b for a, b in df.select(tokens(F.col("t")), general).collect())
