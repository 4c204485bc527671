"""The registered queries of the retrieval engine and their SQL.

Documents stand for a corpus: source is the source id, the path is made from the
id, and each document is one chunk at the root unless the query is about chunking.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import fingerprints, text, tokens, vectors
from tidewater.operators import chunking, evaluation, fusion, lexical, vector
from tidewater.sources.tables import spread, written

QUERY = "the of/the stupid Émentre and"
FIELDS = ["title", "relative_path", "section", "text"]
BOUND = 400


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _path() -> Column:
    """A path for each document: folders by language, now and then with what normalisation takes away."""
    doc = F.col("doc_id").cast("string")
    name = F.concat(F.lit("doc"), doc, F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".TXT"))
    return F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(".\\"), F.col("lang"), F.lit("\\.\\"), name)).otherwise(F.concat(F.col("lang"), F.lit("/"), name))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: chunk_id, document_id, source_id, relative_path, title, section_path, section, ordinal, text, content_hash."""
    d = _table(spark, sf_dir, "documents").withColumn("relative_path", text.normalized_path(_path()))
    d = d.withColumn("document_id", text.document_id(F.col("source"), F.col("relative_path")))
    root = F.array().cast("array<string>")
    return d.select(
        text.chunk_id(F.col("document_id"), root, F.lit(0), F.lit(0)).alias("chunk_id"),
        "document_id",
        F.col("source").alias("source_id"),
        "relative_path",
        text.title(F.col("relative_path")).alias("title"),
        root.alias("section_path"),
        F.lit("").alias("section"),
        F.lit(0).alias("ordinal"),
        "text",
        text.content_hash(F.col("text")).alias("content_hash"),
        "doc_id",
    )


#: The same in SQL.
CORPUS = r"""
d AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.TXT' END AS suffix FROM documents),
p AS (SELECT doc_id, source AS source_id, text, lang || '/doc' || doc_id || suffix AS relative_path, 'doc' || doc_id || suffix AS title FROM d),
i AS (SELECT *, 'doc_' || substr(sha256(source_id || chr(31) || relative_path), 1, 24) AS document_id FROM p),
corpus AS (SELECT *, 'chunk_' || substr(sha256(document_id || chr(31) || chr(31) || '0' || chr(31) || '0'), 1, 24) AS chunk_id, sha256(text) AS content_hash FROM i)
"""


def _sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_tokens(expr: str) -> str:
    """tokens() in SQL."""
    a, b = map(_sql_literal, tokens.fold_table())
    return f"regexp_extract_all(regexp_replace(translate(lower({expr}), {a}, {b}), '{tokens.LOOSE_ACCENT}', '', 'g'), '[\\p{{L}}\\p{{N}}\\p{{Co}}_-]+')"


#: Tokens of each field with their places, chunk lengths and corpus numbers.
INDEX = f"""
fields AS (
  SELECT chunk_id, 0 AS field, {_sql_tokens("title")} AS t FROM corpus
  UNION ALL SELECT chunk_id, 1, {_sql_tokens("relative_path")} FROM corpus
  UNION ALL SELECT chunk_id, 3, {_sql_tokens("text")} FROM corpus),
tok AS (SELECT chunk_id, field, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS position FROM fields),
len AS (SELECT chunk_id, sum(len(t))::BIGINT AS length FROM fields GROUP BY chunk_id),
stats AS (SELECT count(*) AS n, avg(length) AS mean FROM len)
"""


def _bm25_sql(query: str, limit: int | None) -> str:
    """WITH parts that end in lex (chunk_id, score, ...details, rank)."""
    asked = tokens.phrases(query)
    parts = []
    for p, phrase in enumerate(asked):
        joins = "".join(f" JOIN tok t{k} ON t{k}.chunk_id = t0.chunk_id AND t{k}.field = t0.field AND t{k}.position = t0.position + {k} AND t{k}.term = {_sql_literal(w)}" for k, w in enumerate(phrase) if k)
        parts.append(f"SELECT {p} AS phrase, t0.chunk_id, count(*) AS f FROM tok t0{joins} WHERE t0.term = {_sql_literal(phrase[0])} GROUP BY t0.chunk_id")
    top = f"WHERE rank <= {limit}" if limit else ""
    return f"""
freq AS ({" UNION ALL ".join(parts)}),
spread AS (SELECT phrase, count(*) AS w FROM freq GROUP BY phrase),
weighed AS (
  SELECT phrase, chunk_id, f::DOUBLE AS f, length, mean,
    CASE WHEN ln((n - w + 0.5::DOUBLE) / (w + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - w + 0.5::DOUBLE) / (w + 0.5::DOUBLE)) END AS idf
  FROM freq JOIN spread USING (phrase) JOIN len USING (chunk_id), stats),
scored AS (
  SELECT chunk_id, -sum(idf * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)) ORDER BY phrase) AS score
  FROM weighed GROUP BY chunk_id),
lex AS (
  SELECT * FROM (SELECT chunk_id, score, doc_id, relative_path, row_number() OVER (ORDER BY round(score, 9), relative_path, chunk_id) AS rank FROM scored JOIN corpus USING (chunk_id)) {top})"""


def _index(spark: SparkSession, sf_dir: str, asked: list[list[str]], more: list[str]) -> lexical.Index:
    """The index of the corpus, as far as a query's terms go: one pass over the texts, of which only lengths and hits are written."""
    terms = [t for phrase in asked for t in phrase]
    return lexical.index_of(written(lexical.marked(corpus(spark, sf_dir), FIELDS, terms, more=more), "marked"), more=more)


# --- identities, formats, text -------------------------------------------------


def document_identity(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "document_id", "relative_path", "title")


def content_hash(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "content_hash", F.length("text").cast("long").alias("char_count"))


def chunk_identity(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "chunk_id", "document_id")


def normalize_newlines(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    mixed = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    plain = text.normalize_newlines(mixed)
    return d.select("doc_id", F.sha2(plain, 256).alias("hash"), (text.normalize_newlines(plain) == plain).alias("idempotent"))


def path_normalize(spark, sf_dir):
    raw = F.concat(F.when(F.col("page_id") % 4 == 0, "./").when(F.col("page_id") % 4 == 1, "/").when(F.col("page_id") % 4 == 2, "C:").otherwise(""), F.regexp_replace("url", "^https?://", ""))
    p = _table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"))
    return p.select("page_id", text.normalized_path(F.col("raw")).alias("path"), text.path_problem(F.col("raw")).alias("problem"))


def format_dispatch(spark, sf_dir):
    c = corpus(spark, sf_dir).withColumn("format", text.document_format(F.col("relative_path")))
    return c.groupBy("format").agg(F.count("*").alias("n"))


def excerpt(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


def processing_fingerprint(spark, sf_dir):
    c = corpus(spark, sf_dir).withColumn("format", text.document_format(F.col("relative_path")))
    value = F.when(F.col("format") == "markdown", fingerprints.processing_fingerprint("markdown", 1000)).otherwise(fingerprints.processing_fingerprint("plain_text", 1000))
    return c.select("doc_id", value.alias("fingerprint"))


def embedding_fingerprint(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.size("embedding").alias("dimension")).groupBy("dimension").agg(F.count("*").alias("n"))
    known = {d: fingerprints.embedding_fingerprint("fake", "digest", None, d) for (d,) in e.select("dimension").collect()}
    of = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return e.select("dimension", "n", of[F.col("dimension")].alias("fingerprint"))


# --- chunking --------------------------------------------------------------------


def conversation_markdown(spark, sf_dir) -> DataFrame:
    """A Markdown document for each conversation: a heading, and a section for each turn, by role."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    body = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("\n\n## "), t["role"], F.lit("\n\n"), t["text"])), "")
    return turns.select("conv_id", F.col("conv_id").cast("string").alias("document_id"), F.concat(F.lit("# conv"), body).alias("text"), F.lit("markdown").alias("format"))


def markdown_sections(spark, sf_dir):
    got = chunking.chunks(conversation_markdown(spark, sf_dir), max_chunk_chars=1_000_000)
    return got.select(F.col("document_id").cast("long").alias("conv_id"), F.array_join("section_path", "/").alias("section"), "section_occurrence", "ordinal", "content_hash")


def _plain(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text", F.lit("plain_text").alias("format"))


def greedy_pack_chunks(spark, sf_dir):
    got = chunking.chunks(_plain(spark, sf_dir), max_chunk_chars=BOUND)
    return got.select(F.col("document_id").cast("long").alias("doc_id"), "ordinal", "char_count", "content_hash")


def hard_split_chunks(spark, sf_dir):
    one_line = _plain(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    got = chunking.chunks(one_line, max_chunk_chars=1000)
    return got.select(F.col("document_id").cast("long").alias("doc_id"), "ordinal", "content_hash")


def chunk_reconstruction(spark, sf_dir):
    parts = chunking.chunks(_plain(spark, sf_dir), max_chunk_chars=BOUND).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return parts.select(F.col("document_id").cast("long").alias("doc_id"), F.sha2(whole, 256).alias("hash"))


# --- embeddings --------------------------------------------------------------------


def embedding_text(spark, sf_dir):
    headed = F.array(F.lit("Part"), F.col("source_id"))
    path = F.when(F.col("doc_id") % 2 == 0, headed).otherwise(F.col("section_path"))
    c = corpus(spark, sf_dir).withColumn("section_path", path)
    return c.select("doc_id", text.section_display(F.col("section_path")).alias("section"), F.sha2(text.embedding_text(F.col("title"), F.col("section_path"), F.col("text")), 256).alias("hash"))


def fake_embedding(spark, sf_dir):
    v = _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(vectors.digest_vector(F.col("text"), 40)).alias("i", "value"))
    return v.select("item_id", "i", "value")


def vector_validation(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 7 == 1, F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(F.col("embedding")).alias("v"))
    return e.select("vec_id", vectors.valid_vector(F.col("v"), 64).alias("valid"))


# --- sync --------------------------------------------------------------------------


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An earlier and an incoming snapshot: of the earlier one, every 7th document is missing; of the incoming, every 11th, while every 5th has other text and every 3rd other processing."""
    c = corpus(spark, sf_dir).select("doc_id", "document_id", "source_id", "content_hash", F.lit("p1").alias("fingerprint"))
    before = c.filter("doc_id % 7 <> 0")
    changed = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash"))
    now = c.filter("doc_id % 11 <> 0").withColumn("content_hash", changed).withColumn("fingerprint", F.when(F.col("doc_id") % 3 == 0, "p2").otherwise("p1"))
    return before, now


def sync_classification(spark, sf_dir):
    from tidewater.plans.sync import classify

    before, now = _snapshots(spark, sf_dir)
    return classify(before, now, "fingerprint").groupBy("source_id", "status").agg(F.count("*").alias("n"))


def sync_deletes(spark, sf_dir):
    before, now = _snapshots(spark, sf_dir)
    return before.join(now, "document_id", "left_anti").select("document_id", "source_id")


def sync_merge(spark, sf_dir):
    from tidewater.plans.sync import classify, merge

    before, now = _snapshots(spark, sf_dir)
    return merge(before, now, classify(before, now, "fingerprint")).select("document_id", "content_hash", "fingerprint")


def vector_rebuild_input(spark, sf_dir):
    c = corpus(spark, sf_dir)
    embedded = text.embedding_text(F.col("title"), F.col("section_path"), F.col("text"))
    return c.select("chunk_id", F.posexplode(vectors.digest_vector(embedded, 8)).alias("i", "value"))


# --- lexical -------------------------------------------------------------------------


def token_postings(spark, sf_dir):
    return lexical.term_counts(corpus(spark, sf_dir), FIELDS)


def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(lexical.lengths(corpus(spark, sf_dir), FIELDS)).select("n", F.round("mean", 9).alias("mean"))


def _bm25(query: str):
    def run(spark, sf_dir):
        asked = tokens.phrases(query)
        return lexical.bm25(_index(spark, sf_dir, asked, ["doc_id"]), asked, more=["doc_id"]).select("doc_id", F.round("score", 9).alias("score"))

    return run


def _lexical(spark, sf_dir, n: int) -> DataFrame:
    asked = tokens.phrases(QUERY)
    details = corpus(spark, sf_dir).select("chunk_id", "doc_id", "relative_path", "content_hash")
    # equal chunks in theory can differ in the last bit between engines; ties go by the rounded score
    scored = lexical.bm25(_index(spark, sf_dir, asked, ["doc_id"]), asked, more=["doc_id"], top=n, slack=1e-8)
    return lexical.best_with_details(scored, "score", details, ["relative_path", "chunk_id"], n, "chunk_id", digits=9, near="doc_id")


def lexical_topk(spark, sf_dir):
    """A top-k report."""
    return _lexical(spark, sf_dir, 10).select("rank", "doc_id", "relative_path", F.round("score", 9).alias("score"))


# --- vector, hybrid --------------------------------------------------------------------


def _vector(spark, sf_dir, n: int) -> DataFrame:
    """Vectors belong to the document with their id; the query is vector 0."""
    e = _table(spark, sf_dir, "embeddings")
    asked = list(e.filter("vec_id = 0").orderBy("label").first()["embedding"])
    details = corpus(spark, sf_dir).select("chunk_id", F.col("doc_id"), "relative_path", "content_hash")
    of_doc = e.join(details.select("chunk_id", "doc_id"), F.col("vec_id") == F.col("doc_id")).select("chunk_id", "embedding")
    return vector.nearest(of_doc, asked, details=details, tie=["relative_path", "chunk_id"], max_results=n)


def knn_l2(spark, sf_dir):
    """A top-k report."""
    return _vector(spark, sf_dir, 10).select("rank", "doc_id", F.round("distance", 9).alias("distance"))


def knn_batch(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    got = vector.nearest_each(e, e.filter("vec_id % 50 = 0"), 5, id_col="vec_id", query_col="vec_id")
    return got.select("query", "vec_id", "rank", F.round("distance", 9).alias("distance"))


def _hybrid(spark, sf_dir, n: int) -> DataFrame:
    limit = fusion.candidate_count(n)
    side = ["chunk_id", "doc_id", "relative_path", "content_hash", "rank"]
    return fusion.fuse(_lexical(spark, sf_dir, limit).select(*side, "score"), _vector(spark, sf_dir, limit).select(*side, "distance"), max_results=n, tie=["relative_path", "chunk_id"], check=False)


def hybrid_search(spark, sf_dir):
    """A top-k report: BM25 and nearest vectors, fused."""
    return _hybrid(spark, sf_dir, 10).select("rank", "doc_id", F.round("rrf_score", 12).alias("rrf_score"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lexical_rank", "vector_rank")])


def rrf_fusion(spark, sf_dir):
    """A top-k report: two rankings of the corpus, by length and by place, fused; many fused scores tie."""
    d = corpus(spark, sf_dir).select("chunk_id", "doc_id", "relative_path", "content_hash", F.length("text").alias("n"))

    def side(first: Column, value: str) -> DataFrame:
        few = d.orderBy(first, "doc_id").limit(50)
        return few.withColumn("rank", F.row_number().over(Window.orderBy(first, "doc_id"))).withColumn(value, F.col("n").cast("double")).drop("n")

    got = fusion.fuse(side(F.desc("n"), "score"), side(F.col("doc_id") % 97, "distance"), max_results=40, tie=["relative_path", "chunk_id"])
    return got.select("rank", "doc_id", F.round("rrf_score", 12).alias("rrf_score"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lexical_rank", "vector_rank")])


def rrf_contract_check(spark, sf_dir):
    c = corpus(spark, sf_dir).select("chunk_id", "content_hash", "doc_id")
    left = c.unionByName(c.filter("doc_id % 10 = 0"))
    right = c.withColumn("content_hash", F.when(F.col("doc_id") % 9 == 0, "other").otherwise(F.col("content_hash"))).filter("doc_id % 2 = 0")
    return fusion.contract_breaches(left, right).distinct()


def truncation_status(spark, sf_dir):
    """What a public bound of 5 says of the matches of each source's documents."""
    asked = [["stupid"], ["idiot"]]
    found = lexical.bm25(_index(spark, sf_dir, asked, ["source_id"]), asked, more=["source_id"])
    every = _table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id")).agg(F.lit(0).alias("zero"))
    n = every.join(found.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "left")
    from tidewater.plans.service import status_column

    hits = F.coalesce("n", F.lit(0))
    return n.select("source_id", F.least(hits, F.lit(5)).alias("shown"), status_column(hits, 5).alias("status"))


def hit_projection(spark, sf_dir):
    from tidewater.plans.service import hits_of

    got = hits_of("lexical", _lexical(spark, sf_dir, 10))
    absent = [F.col(c).isNull().alias(f"no_{c}") for c in ("vector_rank", "vector_distance", "rrf_score")]
    return got.select("rank", "doc_id", "lexical_rank", F.round("bm25_score", 9).alias("bm25_score"), *absent)


# --- lookups, evaluation ------------------------------------------------------------------


def document_lookup(spark, sf_dir):
    of = _table(spark, sf_dir, "documents").filter("doc_id = 7").select("source", "lang").first()
    wanted = text.id_of("doc_", of["source"], text.path_of(f"./{of['lang']}/doc7.TXT"))
    return corpus(spark, sf_dir).filter(F.col("document_id") == wanted).select("document_id", "doc_id", "title")


def documents_for_source(spark, sf_dir):
    return corpus(spark, sf_dir).filter("source_id = 'src3'").select("document_id", "relative_path", F.row_number().over(Window.partitionBy("source_id").orderBy("relative_path")).alias("place"))


def chunks_for_document(spark, sf_dir):
    got = chunking.chunks(conversation_markdown(spark, sf_dir), max_chunk_chars=1_000_000).filter("document_id = '3'")
    return got.select("ordinal", "char_count")


def golden_resolve(spark, sf_dir):
    """References of labelled documents, resolved to chunks by identity alone; which of them exist."""
    labels = _table(spark, sf_dir, "labels").select("doc_id")
    d = labels.join(_table(spark, sf_dir, "documents"), "doc_id").withColumn("relative_path", text.normalized_path(_path()))
    doc = text.document_id(F.col("source"), F.col("relative_path"))
    occurrence = F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)
    asked = d.select("doc_id", text.chunk_id(doc, F.array().cast("array<string>"), occurrence, F.lit(0)).alias("chunk_id"))
    known = corpus(spark, sf_dir).select("chunk_id", F.lit(True).alias("exists"))
    return asked.join(known, "chunk_id", "left").select("doc_id", "chunk_id", F.coalesce("exists", F.lit(False)).alias("exists"))


def _judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Metrics of knn_batch: a query's relevant vectors are all those of its label, itself too."""
    e = _table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0")
    got = vector.nearest_each(e, asked, 5, id_col="vec_id", query_col="vec_id").select(F.col("query").alias("query_id"), "vec_id", "rank")
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    hits = got.join(e.select("vec_id", "label"), "vec_id").join(own, "query_id").select("query_id", "rank", (F.col("label") == F.col("own")).alias("relevant"))
    judged = own.join(e.groupBy(F.col("label").alias("own")).agg(F.count("*").alias("n_relevant")), "own").select("query_id", "n_relevant")
    category = F.element_at(F.array(*map(F.lit, evaluation.CATEGORIES)), (F.col("label") % 2 + 1).cast("int"))
    return evaluation.judged_metrics(hits, judged, 5), asked.select(F.col("vec_id").alias("query_id"), category.alias("category"))


def recall_at_k(spark, sf_dir):
    return _judged(spark, sf_dir)[0].select("query_id", F.round("recall_at_k", 9).alias("recall_at_k"))


def mrr(spark, sf_dir):
    return _judged(spark, sf_dir)[0].select("query_id", F.round("reciprocal_rank", 9).alias("reciprocal_rank"))


def category_breakdown(spark, sf_dir):
    metrics, categories = _judged(spark, sf_dir)
    got = evaluation.category_breakdown(metrics, categories)
    return got.select("category", "query_count", F.round("mean_recall_at_k", 9).alias("mean_recall_at_k"), F.round("mrr", 9).alias("mrr"))


_NAMES = """document_identity content_hash chunk_identity normalize_newlines path_normalize format_dispatch excerpt processing_fingerprint
embedding_fingerprint markdown_sections greedy_pack_chunks hard_split_chunks chunk_reconstruction embedding_text fake_embedding vector_validation
sync_classification sync_deletes sync_merge vector_rebuild_input token_postings corpus_stats lexical_topk knn_l2 knn_batch hybrid_search
rrf_fusion rrf_contract_check truncation_status hit_projection document_lookup documents_for_source chunks_for_document golden_resolve recall_at_k mrr category_breakdown""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: globals()[name] for name in _NAMES}
    return found | {"bm25_term": _bm25("stupid"), "bm25_multi": _bm25("stupid the Worthless stupid"), "bm25_phrase": _bm25("of/the and/the")}


_JUDGED = """
asked AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0),
near AS (
  SELECT * FROM (SELECT q.vec_id AS query, e.vec_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS rank FROM asked q, embeddings e) WHERE rank <= 5),
golden AS (SELECT a.vec_id AS query_id, a.label, e.vec_id AS id FROM asked a JOIN embeddings e ON a.label = e.label),
metrics AS (
  SELECT query_id, any_value(label) AS label, count(rank) / count(*) AS recall_at_k, coalesce(1 / min(rank), 0) AS reciprocal_rank
  FROM golden g LEFT JOIN near n ON n.query = g.query_id AND n.vec_id = g.id GROUP BY query_id)
"""
_SNAPSHOTS = """
before AS (SELECT doc_id, document_id, source_id, content_hash, 'p1' AS fingerprint FROM corpus WHERE doc_id % 7 <> 0),
now AS (SELECT doc_id, document_id, source_id, CASE WHEN doc_id % 5 = 0 THEN sha256(content_hash || 'x') ELSE content_hash END AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 'p2' ELSE 'p1' END AS fingerprint FROM corpus WHERE doc_id % 11 <> 0),
status AS (
  SELECT coalesce(n.document_id, b.document_id) AS document_id, coalesce(n.source_id, b.source_id) AS source_id,
    CASE WHEN b.document_id IS NULL THEN 'created' WHEN n.document_id IS NULL THEN 'deleted' WHEN b.content_hash <> n.content_hash THEN 'updated' WHEN b.fingerprint <> n.fingerprint THEN 'reprocessed' ELSE 'unchanged' END AS status
  FROM before b FULL JOIN now n USING (document_id))
"""
_HYBRID = """,
vec AS (
  SELECT * FROM (SELECT c.chunk_id, c.doc_id, c.relative_path, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance,
    row_number() OVER (ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), c.relative_path, c.chunk_id) AS rank
  FROM embeddings e JOIN corpus c ON e.vec_id = c.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0 ORDER BY label LIMIT 1) q) WHERE rank <= {limit})"""


def oracle_sql() -> dict[str, str]:
    fp = fingerprints.processing_fingerprint
    conv = """
turns AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS occurrence FROM conversations),
parts AS (
  SELECT conv_id, 'conv' AS section, 0 AS occurrence, 0 AS ordinal, '# conv' || chr(10) || chr(10) AS said FROM turns WHERE k = 1
  UNION ALL SELECT conv_id, 'conv/' || role, occurrence, k, '## ' || role || chr(10) || chr(10) || text || CASE WHEN k < n THEN chr(10) || chr(10) ELSE '' END FROM turns)"""
    bm25 = lambda q: f"WITH {CORPUS}, {INDEX}, {_bm25_sql(q, None)} SELECT doc_id, round(score, 9) AS score FROM lex"
    return {
        "document_identity": f"WITH {CORPUS} SELECT doc_id, document_id, relative_path, title FROM corpus",
        "content_hash": "SELECT doc_id, sha256(text) AS content_hash, length(text)::BIGINT AS char_count FROM documents",
        "chunk_identity": f"WITH {CORPUS} SELECT doc_id, chunk_id, document_id FROM corpus",
        "normalize_newlines": "SELECT doc_id, sha256(text) AS hash, true AS idempotent FROM documents",
        "path_normalize": """WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN './' WHEN 1 THEN '/' WHEN 2 THEN 'C:' ELSE '' END || regexp_replace(url, '^https?://', '') AS raw FROM pages),
p AS (SELECT *, list_filter(string_split(raw, '/'), lambda x: x <> '.') AS parts FROM r),
j AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'empty' WHEN raw LIKE '/%' OR regexp_matches(raw, '^[A-Za-z]:') THEN 'absolute' WHEN list_contains(parts, '') THEN 'empty segment' WHEN list_contains(parts, '..') THEN 'parent traversal' WHEN len(parts) = 0 THEN 'no segment' END AS problem FROM p)
SELECT page_id, CASE WHEN problem IS NULL THEN array_to_string(parts, '/') END AS path, problem FROM j""",
        "format_dispatch": "SELECT CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'plain_text' END AS format, count(*) AS n FROM documents GROUP BY 1",
        "excerpt": """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, CASE WHEN length(flat) > 200 THEN substr(flat, 1, 200) || '...' ELSE flat END AS excerpt FROM f""",
        "processing_fingerprint": f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{fp('markdown', 1000)}' ELSE '{fp('plain_text', 1000)}' END AS fingerprint FROM documents",
        "embedding_fingerprint": f"SELECT len(embedding)::INT AS dimension, count(*) AS n, sha256('{{\"dimension\":' || len(embedding) || ',\"embedding_text_version\":\"{fingerprints.EMBEDDING_TEXT_VERSION}\",\"model_id\":\"digest\",\"model_revision\":null,\"provider_type\":\"fake\"}}') AS fingerprint FROM embeddings GROUP BY len(embedding)",
        "markdown_sections": f"WITH {conv} SELECT conv_id, section, occurrence::INT AS section_occurrence, ordinal::INT AS ordinal, sha256(said) AS content_hash FROM parts",
        "greedy_pack_chunks": f"""WITH RECURSIVE
l AS (SELECT doc_id, i, string_split(text, chr(10))[i] || CASE WHEN i < len(string_split(text, chr(10))) THEN chr(10) ELSE '' END AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
whole AS (SELECT doc_id, length(text) <= {BOUND} AS fits FROM documents),
a AS (SELECT doc_id, i, j, substr(line, j, {BOUND}) AS atom FROM l, unnest(range(1, length(line) + 1, {BOUND})) AS v(j) WHERE line <> ''),
n AS (SELECT *, length(atom) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM a),
walk AS (
  SELECT doc_id, k, size AS used, 0 AS ordinal, atom FROM n WHERE k = 1
  UNION ALL SELECT n.doc_id, n.k, CASE WHEN used + size > {BOUND} THEN size ELSE used + size END, CASE WHEN used + size > {BOUND} THEN ordinal + 1 ELSE ordinal END, n.atom FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.k = w.k + 1),
c AS (SELECT doc_id, ordinal, string_agg(atom, '' ORDER BY k) AS said FROM walk GROUP BY doc_id, ordinal)
SELECT doc_id, ordinal::INT AS ordinal, length(said)::INT AS char_count, sha256(said) AS content_hash FROM c""",
        "hard_split_chunks": """WITH t AS (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)
SELECT doc_id, (i // 1000)::INT AS ordinal, sha256(substr(t, i + 1, 1000)) AS content_hash FROM t, unnest(range(0, length(t), 1000)) AS u(i)""",
        "chunk_reconstruction": "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text <> ''",
        "embedding_text": f"""WITH {CORPUS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Part > ' || source_id ELSE '(root)' END AS section,
sha256(title || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Part ' || source_id || chr(10) ELSE '' END || text) AS hash FROM corpus""",
        "fake_embedding": """SELECT item_id, i::INT AS i, ('0x' || substr(sha256(text), ((i % 32) * 2 + 1)::INT, 2))::INT::DOUBLE / 255.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE AS value FROM benchmark, range(40) AS r(i)""",
        "vector_validation": "SELECT vec_id, vec_id % 7 <> 0 AND vec_id % 7 <> 1 AND len(embedding) = 64 AS valid FROM embeddings",
        "sync_classification": f"WITH {CORPUS}, {_SNAPSHOTS} SELECT source_id, status, count(*) AS n FROM status GROUP BY source_id, status",
        "sync_deletes": f"WITH {CORPUS}, {_SNAPSHOTS} SELECT document_id, source_id FROM before WHERE document_id NOT IN (SELECT document_id FROM now)",
        "sync_merge": f"WITH {CORPUS}, {_SNAPSHOTS} SELECT document_id, content_hash, fingerprint FROM now",
        "vector_rebuild_input": f"""WITH {CORPUS} SELECT chunk_id, i::INT AS i, ('0x' || substr(sha256(title || chr(10) || text), (i * 2 + 1)::INT, 2))::INT::DOUBLE / 255.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE AS value FROM corpus, range(8) AS r(i)""",
        "token_postings": f"WITH {CORPUS}, {INDEX} SELECT term, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_places FROM tok GROUP BY term",
        "corpus_stats": f"WITH {CORPUS}, {INDEX} SELECT n, round(mean, 9) AS mean FROM stats",
        "bm25_term": bm25("stupid"),
        "bm25_multi": bm25("stupid the Worthless stupid"),
        "bm25_phrase": bm25("of/the and/the"),
        "lexical_topk": f"WITH {CORPUS}, {INDEX}, {_bm25_sql(QUERY, 10)} SELECT rank::INT AS rank, doc_id, relative_path, round(score, 9) AS score FROM lex",
        "knn_l2": f"WITH {CORPUS} {_HYBRID.format(limit=10)} SELECT rank::INT AS rank, doc_id, round(distance, 9) AS distance FROM vec",
        "knn_batch": f"WITH {_JUDGED} SELECT query, vec_id, rank::INT AS rank, round(distance, 9) AS distance FROM near",
        "hybrid_search": f"""WITH {CORPUS}, {INDEX}, {_bm25_sql(QUERY, 30)} {_HYBRID.format(limit=30)},
f AS (
  SELECT coalesce(l.doc_id, v.doc_id) AS doc_id, coalesce(l.relative_path, v.relative_path) AS p, chunk_id, l.rank AS a, v.rank AS b,
    coalesce(1::DOUBLE / (60 + l.rank), 0) + coalesce(1::DOUBLE / (60 + v.rank), 0) AS s
  FROM lex l FULL JOIN vec v USING (chunk_id)),
r AS (SELECT *, row_number() OVER (ORDER BY s DESC, least(a, b), a NULLS LAST, b NULLS LAST, p, chunk_id) AS rank FROM f)
SELECT rank::INT AS rank, doc_id, round(s, 12) AS rrf_score, coalesce(a, 0)::INT AS lexical_rank, coalesce(b, 0)::INT AS vector_rank FROM r WHERE rank <= 10""",
        "rrf_fusion": f"""WITH {CORPUS},
a AS (SELECT chunk_id, doc_id, relative_path, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS a FROM corpus QUALIFY a <= 50),
b AS (SELECT chunk_id, doc_id, relative_path, row_number() OVER (ORDER BY doc_id % 97, doc_id) AS b FROM corpus QUALIFY b <= 50),
f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.relative_path, b.relative_path) AS p, chunk_id, a, b, coalesce(1::DOUBLE / (60 + a), 0) + coalesce(1::DOUBLE / (60 + b), 0) AS s FROM a FULL JOIN b USING (chunk_id))
SELECT row_number() OVER (ORDER BY s DESC, least(a, b), a NULLS LAST, b NULLS LAST, p, chunk_id)::INT AS rank, doc_id, round(s, 12) AS rrf_score, coalesce(a, 0)::INT AS lexical_rank, coalesce(b, 0)::INT AS vector_rank
FROM f ORDER BY 1 LIMIT 40""",
        "rrf_contract_check": f"""WITH {CORPUS} SELECT chunk_id, 'lexical repeats it' AS problem FROM corpus WHERE doc_id % 10 = 0
UNION SELECT chunk_id, 'content differs' FROM corpus WHERE doc_id % 9 = 0 AND doc_id % 2 = 0""",
        "truncation_status": f"""WITH {CORPUS}, {INDEX}, found AS (SELECT DISTINCT chunk_id FROM tok WHERE term IN ('stupid', 'idiot')),
n AS (SELECT source_id, count(f.chunk_id) AS n FROM corpus LEFT JOIN found f USING (chunk_id) GROUP BY source_id)
SELECT source_id, least(n, 5) AS shown, CASE WHEN n = 0 THEN 'empty' WHEN n > 5 THEN 'partial' ELSE 'success' END AS status FROM n""",
        "hit_projection": f"""WITH {CORPUS}, {INDEX}, {_bm25_sql(QUERY, 10)} SELECT rank::INT AS rank, doc_id, rank::INT AS lexical_rank,
round(score, 9) AS bm25_score, true AS no_vector_rank, true AS no_vector_distance, true AS no_rrf_score FROM lex""",
        "document_lookup": f"WITH {CORPUS} SELECT document_id, doc_id, title FROM corpus WHERE doc_id = 7",
        "documents_for_source": f"WITH {CORPUS} SELECT document_id, relative_path, row_number() OVER (ORDER BY relative_path)::INT AS place FROM corpus WHERE source_id = 'src3'",
        "chunks_for_document": f"WITH {conv} SELECT ordinal::INT AS ordinal, length(said)::INT AS char_count FROM parts WHERE conv_id = 3",
        "golden_resolve": f"""WITH {CORPUS} SELECT doc_id, 'chunk_' || substr(sha256(document_id || chr(31) || chr(31) || CASE WHEN doc_id % 13 = 0 THEN '1' ELSE '0' END || chr(31) || '0'), 1, 24) AS chunk_id,
doc_id % 13 <> 0 AS exists FROM corpus JOIN (SELECT doc_id FROM labels) USING (doc_id)""",
        "recall_at_k": f"WITH {_JUDGED} SELECT query_id, round(recall_at_k, 9) AS recall_at_k FROM metrics",
        "mrr": f"WITH {_JUDGED} SELECT query_id, round(reciprocal_rank, 9) AS reciprocal_rank FROM metrics",
        "category_breakdown": f"""WITH {_JUDGED}, c AS (SELECT unnest(['lexical', 'semantic', 'mixed']) AS category), m AS (SELECT *, CASE label % 2 WHEN 0 THEN 'lexical' ELSE 'semantic' END AS category FROM metrics)
SELECT category, count(query_id) AS query_count, round(coalesce(avg(recall_at_k), 0), 9) AS mean_recall_at_k, round(coalesce(avg(reciprocal_rank), 0), 9) AS mrr FROM c LEFT JOIN m USING (category) GROUP BY category""",
    }
