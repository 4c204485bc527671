"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import language_id, toxicity
from tidewater.llm.centroids import clusters
from tidewater.llm.chat import format_windows, read_back
from tidewater.llm.decontamination import contaminated
from tidewater.llm.line_dedup import dedup_lines
from tidewater.llm.ngram_join import similar_documents
from tidewater.llm.packing import pack
from tidewater.llm.prefix_trie import placed_turns, trie, turn_digests
from tidewater.llm.quality import BOILERPLATE_PHRASES, NAVIGATION_PHRASES, SENTENCE_END, phrase_pattern, quality
from tidewater.llm.shared import written
from tidewater.llm.substring_dedup import remove_repeated
from tidewater.llm.token_counts import token_counts
from tidewater.llm.warc import id_of_record, read_archives, resolved, write_archives
from tidewater.sources.tables import spread

TOKENIZER = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def fold(of: int) -> Column:
    """crc32 of the doc_id as text, modulo `of`; null ids belong to no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of, F.lit(-1))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "removed_chars"]
    return quality(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *[f"quality.{c}" for c in asked])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated(documents(spark, sf_dir), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = r"\### Assistant: </turn> ok"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], turns.schema)
    read = read_back(format_windows(turns.unionByName(extra), budget=512, history=128))
    whole = F.sort_array(F.collect_list(F.struct("window", "turns", "loss_text")))
    by_conv = read.groupBy("conv_id").agg(whole.alias("parts"), F.sum("formatted_chars").alias("formatted_chars"))
    turns_text = F.transform(F.flatten(F.transform("parts", lambda p: p["turns"])), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("parts", lambda p: p["loss_text"]), "")
    n_turns = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.size(p["turns"]))
    return by_conv.select(
        "conv_id",
        n_turns.alias("n_turns"),
        F.sha2(F.array_join(turns_text, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        F.size("parts").cast("long").alias("n_windows"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), unit="word", units_per_edit=8)
    return kept.select("doc_id", "line_dedup.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), limit=1024)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), size=1024, end_id=0)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir), width=5, percent=80)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.filter(fold(4) != 2))
    return language_id.predict(docs, model, keep=[(fold(4) == 2).alias("held_out")])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(labels.filter(fold(5) != 0), docs=docs)
    return toxicity.score(docs, model, keep=[(fold(5) == 0).alias("held_out")])


def rebuilt(placed: DataFrame, conversations: DataFrame) -> DataFrame:
    """Placed turns of conversations that share beginnings: of each conv_id c the first h turns of conversation c - c % 20, then c's own
    after its first h; h is crc32(c) % 4. What is known of a first conversation is a row of three turns at most."""
    h, first = F.crc32(F.col("conv_id").cast("string")) % 4, F.col("conv_id") - F.col("conv_id") % 20
    heads = placed.filter((F.col("conv_id") % 20 == 0) & (F.col("place") <= 3)).groupBy(F.col("conv_id").alias("first"))
    heads = written(heads.agg(F.max("place").alias("n_head"), F.collect_list(F.struct("place", "digest", "words")).alias("head")), "heads")
    begun = conversations.select("conv_id", first.alias("first"), h.alias("h")).join(heads, "first")
    begun = begun.select("conv_id", F.explode(F.filter("head", lambda t: t["place"] <= F.col("h"))).alias("t")).select("conv_id", "t.*")
    own = placed.withColumns({"first": first, "h": h}).filter("place > h").join(heads.select("first", "n_head"), "first", "left")
    place = F.col("place") - F.col("h") + F.least("h", F.coalesce("n_head", F.lit(0)))
    return begun.unionByName(own.select("conv_id", place.alias("place"), "digest", "words"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    placed = placed_turns(turn_digests(turns))
    conversations = written(placed.select("conv_id").distinct(), "conversation-ids")
    return trie(rebuilt(placed, conversations), conversations)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = resolved(read_archives(write_archives(pages, least_bytes=100), payload=False)).filter("type in ('response', 'revisit')")
    of = lambda c: id_of_record(F.col(c), pages.schema["page_id"].dataType.simpleString()).alias
    return records.select(of("record_id")("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), of("refers_to")("refers_to"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, seed="3", dims=64, scale=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_decontamination": op4_decontamination,
        "op5_line_dedup": op5_line_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_packing": op7_packing,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_language_id": op9_language_id,
        "op10_toxicity": op10_toxicity,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_warc": op12_warc,
        "op13_centroid_clusters": op13_centroid_clusters,
    }


#: The same counts by text functions of DuckDB; lines and windows are unnested.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, string_split(t, chr(10)) AS lines FROM d),
grams AS (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS g FROM w, unnest(range(1, len(words) - 3)) AS u(i)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
judged AS (
  SELECT doc_id, t, words, lines, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS said,
    list_filter(lines, lambda x: NOT regexp_matches(x, '[^\x20\x09-\x0D]') OR (
      regexp_matches(x, '[SENTENCE_END]')
      AND 5 * len(regexp_extract_all(x, '[#*$%&|<>]')) <= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
      AND 10 * len(regexp_extract_all(x, '[!?]{2,}')) <= 3 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
      AND NOT (len(regexp_extract_all(x, '(^| )[|»›•·→]+( |$)')) >= 3
        AND 5 * len(regexp_extract_all(x, '(^| )[|»›•·→]+( |$)')) >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
      AND NOT (regexp_matches(x, '(?i)[NAVIGATION]') AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 10)
      AND NOT regexp_matches(x, '(?i)[BOILERPLATE]')
    )) AS passed
  FROM w),
facts AS (
  SELECT j.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(said) - len(list_distinct(said)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(said)::BIGINT AS n_lines, (len(lines) - len(passed))::BIGINT AS n_failed_lines,
    length(regexp_replace(array_to_string(passed, chr(10)), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS kept_chars
  FROM judged j LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * (word_chars - kept_chars) <= word_chars AS kept,
  n_lines, n_failed_lines, word_chars - kept_chars AS removed_chars
FROM facts
"""

for _name, _pattern in (("SENTENCE_END", SENTENCE_END), ("NAVIGATION", phrase_pattern(NAVIGATION_PHRASES)), ("BOILERPLATE", phrase_pattern(BOILERPLATE_PHRASES))):
    OP1_SQL = OP1_SQL.replace(f"[{_name}]", _pattern.replace("'", "''"))

#: Turns and loss from the table; windows by a recursive walk over each conversation's prefix sums, anew from each 64 budgets on.
OP3_SQL = r"""
WITH RECURSIVE
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
ranked AS (
  SELECT conv_id, role, text, row_number() OVER o AS k,
    (strlen(role) + strlen(text) + len(regexp_extract_all(role || text, '[\\<>]')) + strlen('<turn|n|>') + strlen('</turn>') + 3) // 4 AS tokens,
    length(role) + length(text) + len(regexp_extract_all(role || text, '[\\<>]')) + length('<turn|n|>') + length('</turn>') AS chars
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY k) AS through FROM ranked),
room AS (
  SELECT conv_id, role = 'system' AS has_system, greatest(1, 512 - 128 - CASE WHEN role = 'system' THEN tokens ELSE 0 END) AS room FROM summed WHERE k = 1),
walk AS (
  SELECT conv_id, k, k AS first, 0::HUGEINT AS before FROM summed WHERE k = 1
  UNION ALL
  SELECT s.conv_id, s.k, CASE WHEN s.through - w.before > r.room OR (s.through - s.tokens) // 32768 > w.before // 32768 THEN s.k ELSE w.first END,
    CASE WHEN s.through - w.before > r.room OR (s.through - s.tokens) // 32768 > w.before // 32768 THEN s.through - s.tokens ELSE w.before END
  FROM walk w JOIN summed s ON s.conv_id = w.conv_id AND s.k = w.k + 1 JOIN room r ON r.conv_id = w.conv_id),
starts AS (SELECT DISTINCT conv_id, first, before FROM walk),
shown AS (
  SELECT s.conv_id, sum(t.chars) AS chars
  FROM starts s JOIN room r USING (conv_id) JOIN summed t ON t.conv_id = s.conv_id
  LEFT JOIN walk w ON w.conv_id = t.conv_id AND w.k = t.k
  WHERE w.first = s.first OR (t.k = 1 AND r.has_system) OR (t.k < s.first AND s.before - (t.through - t.tokens) <= 128)
  GROUP BY s.conv_id),
whole AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss
  FROM ranked GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars,
  (SELECT count(*) FROM starts s WHERE s.conv_id = whole.conv_id)::BIGINT AS n_windows
FROM whole JOIN shown USING (conv_id)
"""

#: Lines by words; deletion variants by lists; earliest first.
OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line, len(string_split(text, chr(10))) AS n_lines
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM l),
named AS (SELECT doc_id, line_no, words, array_to_string(words, ' ') AS said, row_number() OVER (ORDER BY doc_id, line_no) AS pos FROM w WHERE len(words) > 0),
firsts AS (SELECT said, min(pos) AS pos, any_value(words) AS words FROM named GROUP BY said),
variants AS (
  SELECT pos, i, len(words) AS n, array_to_string(list_concat(words[1 : i - 1], words[i + 1 : len(words)]), ' ') AS v
  FROM firsts, unnest(range(1, len(words) + 1)) AS u(i) WHERE len(words) >= 8),
near AS (
  SELECT a.pos FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i AND a.n = b.n AND b.pos < a.pos
  UNION SELECT a.pos FROM variants a JOIN firsts b ON a.v = b.said AND len(b.words) >= 8 AND b.pos < a.pos
  UNION SELECT b.pos FROM variants a JOIN firsts b ON a.v = b.said AND len(b.words) >= 8 AND a.pos < b.pos),
fate AS (
  SELECT w.doc_id, w.line_no, w.line, w.n_lines, n.pos IS NOT NULL AND n.pos <> f.pos AS repeated, n.pos IN (SELECT pos FROM near) AS near
  FROM w LEFT JOIN named n USING (doc_id, line_no) LEFT JOIN firsts f USING (said))
SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (repeated)::BIGINT AS n_repeated, count(*) FILTER (near)::BIGINT AS n_near,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT coalesce(repeated, false) AND NOT coalesce(near, false)), '')) AS kept_sha256
FROM fate GROUP BY doc_id
"""



#: A prefix is the digests of its turns in a row; nodes are put together from prefixes, subtrees by what they start with.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM t),
ids AS (SELECT DISTINCT conv_id FROM t),
crc AS (
  WITH RECURSIVE bits AS (SELECT n::UBIGINT AS n, n::UBIGINT AS c, 0 AS k FROM range(256) r(n)
    UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8)
  SELECT list(c ORDER BY n) AS entries FROM bits WHERE k = 8),
h AS (
  SELECT conv_id, conv_id - conv_id % 20 AS first, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: xor(entries[(xor(c, b) & 255)::INT + 1], c >> 8)), 4294967295::UBIGINT) % 4 AS h FROM ids, crc),
turns AS (
  SELECT h.conv_id, 0 AS own, p.place, p.digest, p.words FROM h JOIN placed p ON p.conv_id = h.first AND p.place <= h.h
  UNION ALL SELECT h.conv_id, 1, p.place, p.digest, p.words FROM h JOIN placed p ON p.conv_id = h.conv_id AND p.place > h.h),
prefixes AS (
  SELECT conv_id, string_agg(digest, '') OVER w AS node, row_number() OVER w AS depth, words FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)
  UNION ALL SELECT conv_id, '', 0, 0 FROM ids),
nodes AS (SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, CASE WHEN node <> '' THEN left(node, length(node) - 64) END AS up FROM prefixes GROUP BY node),
ends AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM prefixes GROUP BY conv_id) GROUP BY node),
children AS (SELECT up AS node, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
subtrees AS (
  SELECT a.node, sum((b.n_convs - 1) * b.words) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes a JOIN nodes b ON starts_with(b.node, a.node) LEFT JOIN children c ON c.node = b.node GROUP BY a.node)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, u.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.node = n.up LEFT JOIN children c ON c.node = n.node LEFT JOIN ends e ON e.node = n.node JOIN subtrees s ON s.node = n.node
"""

OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha256(t) AS payload_digest, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM d
"""


def _op13_sql(k: int, rounds: int) -> str:
    """Rounds one after another; products of integers this small are exact in doubles, and so are the floors of their means."""
    near = "SELECT vec_id, any_value(v) AS v, arg_min(j, d * {k} + j) AS j, min(d) AS d FROM (SELECT x.vec_id, x.row, x.v, c.j, list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v) AS d FROM kept x, c{r} c) GROUP BY row, vec_id"
    means = "SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT j, list(floor(t / n) ORDER BY i) AS v FROM (SELECT j, i, sum(v[i]) AS t, count(*) AS n FROM a{r}, range(1, 65) AS u(i) GROUP BY j, i) GROUP BY j) m USING (j)"
    steps = "".join(f", a{r} AS MATERIALIZED ({near.format(r=r, k=k)})" + (f", c{r + 1} AS MATERIALIZED ({means.format(r=r)})" if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v FROM kept ORDER BY sha256('3:' || vec_id), v LIMIT {k}){steps}
SELECT vec_id, j::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (j)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op3_chat_formatting": OP3_SQL, "op5_line_dedup": OP5_SQL, "op11_prefix_trie": OP11_SQL, "op12_warc": OP12_SQL, "op13_centroid_clusters": _op13_sql(8, 10)}
