"""Near-duplicate documents by an exact Jaccard join of word n-grams: a grouped prefix join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.graph import components
from tidewater.llm.shared import as_bytes, shingle_set, with_groups, written

#: Buckets of at most so many sets are small. This moves costs only.
SMALL = 64


def _commonness(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """For each of 2^bits hash cells, how often n-grams of all documents fall there.

    Cells order the n-grams: one that many documents share lifts its cell over the others, so
    prefixes hardly hold it. Of N n-grams in all, one stands out if more documents share it than the cells' counts
    differ by chance, about the root of N / 2^bits. Whatever the order, results are the same.
    """

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            sets = [shingle_set(text, width) for text in as_bytes(batch.column(0))]
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["cell", "n"])

    counted = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << bits, np.int64)
    table[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return np.minimum(table, (1 << 32) - 1).astype(np.uint32)


def _digest(values: np.ndarray) -> int:
    """A signed 64-bit digest of an array."""
    import xxhash

    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def _prefixes(docs: DataFrame, commonness: np.ndarray, width: int, percent: int) -> DataFrame:
    """(doc_id, n, set_key, group_key, prefix): prefix is the rarest n - ceil(percent * n / 100) + 1 n-grams,
    group_key stands for size and prefix together; a batch gives each group's prefix once."""
    sent = docs.sparkSession.sparkContext.broadcast(commonness)

    def cut(batches):
        common = sent.value
        shift = np.uint64(65 - len(common).bit_length())
        for batch in batches:
            rows, seen = [], set()
            for known, text in zip(batch.column(0).is_valid().to_pylist(), as_bytes(batch.column(1)), strict=True):
                grams = shingle_set(text, width)
                n = len(grams)
                if not n or not known:
                    rows.append((n, None, None, None))
                    continue
                rank = common[(grams >> shift).astype(np.int64)]
                length = n - -(-percent * n // 100) + 1
                prefix = grams[np.lexsort((grams, rank))[:length]]
                group = _digest(np.append(prefix, np.uint64(n)))
                rows.append((n, _digest(grams), group, None if group in seen else prefix.view(np.int64)))
                seen.add(group)
            n, sets, groups, prefixes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.int64()), pa.array(groups, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "n", "set_key", "group_key", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"doc_id {kind}, n long, set_key long, group_key long, prefix array<long>")


def _packed(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed): the compressed texts of nodes."""

    def pack(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [z.compress(t) for t in as_bytes(batch.column(1).fill_null(""))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["node", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(pack, f"node {kind}, packed binary").join(nodes, "node", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """pairs (node, lead) with shared and both sizes, counted on whole sets."""
    first = pairs.join(texts.withColumnRenamed("packed", "p"), "node")
    both = first.join(texts.select(F.col("node").alias("lead"), F.col("packed").alias("q")), "lead")

    def count(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        known, of_known = None, None
        for batch in batches:
            nodes, leads, out = batch.column(0), batch.column(1).to_pylist(), []
            for lead, p, q in zip(leads, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if q != known:  # rows come sorted by lead where they were joined by sorting
                    known, of_known = q, shingle_set(z.decompress(q), width)
                grams = shingle_set(z.decompress(p), width)
                out.append((len(np.intersect1d(grams, of_known, assume_unique=True)), len(grams), len(of_known)))
            shared, n, m = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([nodes, batch.column(1), *(pa.array(x, pa.int64()) for x in (shared, n, m))], ["node", "lead", "shared", "n", "m"])

    kind = pairs.schema["node"].dataType.simpleString()
    return both.select("node", "lead", "p", "q").mapInArrow(count, f"node {kind}, lead {kind}, shared long, n long, m long")


def similar_documents(
    docs: DataFrame, *, width: int = 5, percent: int = 80, pivots: int = 1, small: int = SMALL, cell_bits: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least
    `percent` / 100 between their sets of word n-grams: (doc_id, n_shingles,
    component_id), component_id the smallest id reachable.

    N-grams are ordered rare first, by counts over all documents. Two similar sets
    share one of their rarest n - ceil(percent n / 100) + 1 n-grams, the prefix.
    Documents with the same prefix and size are one group; groups that share a
    prefix n-gram with another are kept, then expand to their distinct sets. Sets that hold too few shared
    prefix n-grams for the sizes in a bucket leave it. In each bucket of an
    n-gram, every set that shares enough is verified against the smallest id, so the pairs
    are as many as the bucket's rows at most; sets left outside its component go on to `pivots`
    more sets near the smallest. What is still in different components is then
    compared pair by pair, unless the n-grams they could share are too few or the distances to the bucket's first set differ by more than a
    link allows (Jaccard distance is a metric). So no link is lost and
    no bucket of linked copies is squared. What is known of a bucket (its size, its first set, its components) comes from
    groupings that pre-aggregate, are written and joined back, so adaptive execution can split a bucket that many sets share.

    `pivots`, `small` (the size up to which sets meet in a bucket whatever else they share) and `cell_bits` (counts are kept
    in 2^cell_bits cells; 4 bytes each are broadcast) change costs, not results. Texts are lower-cased A-Z; words are split at ASCII white space. Null and
    empty texts: no n-grams, linked with nothing. Fewer than `width` words: one n-gram of
    all. Very long texts: a text's n-grams are held in its task. Rows with the same id are one document in the links; each has its
    row. A null id: component null, linked with nothing. Extra columns are not read. An empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(_prefixes(docs, _commonness(docs, width, cell_bits), width, percent), "prefixes")
    sets = rows.filter("set_key is not null").groupBy("n", "set_key").agg(F.min("doc_id").alias("node"), F.min("group_key").alias("group_key"))
    sets = written(sets, "sets")

    grams = rows.select(F.explode("prefix").alias("gram"), "group_key")
    ends = F.min("group_key").alias("lo"), F.max("group_key").alias("hi")
    shared = with_groups(grams, ["gram"], *ends, name="shared-grams", having="lo < hi").select("gram", "group_key").distinct()
    alike = sets.groupBy("group_key").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("group_key").alias("gram"), "group_key")
    buckets = shared.withColumn("alike", F.lit(False)).unionByName(alike.withColumn("alike", F.lit(True)))
    buckets = written(buckets.join(sets.select("group_key", "node", "n"), "group_key").select("gram", "node", "n", "alike"), "buckets")
    members = written(_enough(buckets, percent, small), "enough")
    first = with_groups(members, ["gram"], F.min(F.struct("node", "n")).alias("first"), name="first")
    members = written(first.withColumn("lead", F.col("first.node")).withColumn("lead_n", F.col("first.n")).drop("first"), "members")

    near = f"100 * shared >= {percent} * (n + m - shared)"
    stars = _stars(members, percent)
    texts = written(_packed(docs, members.select("node").distinct()), "texts")
    tested = written(_verified(stars, texts, width), "stars")
    links = tested.filter(near).select(F.col("node").alias("u"), F.col("lead").alias("v"))
    linked = components(links)

    apart = (1 - F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("apart")
    known = members.join(tested.select("node", "lead", apart), ["node", "lead"], "left").withColumn("apart", F.when(F.col("node") == F.col("lead"), 0.0).otherwise(F.col("apart")))
    found = F.col("node").alias("u"), F.col("lead").alias("v")
    for pivot in range(1, pivots + 1):
        known = written(_unresolved(known, linked), "unresolved")
        more = _verified(_to_pivot(known, pivot, percent), texts, width).filter(near).select(*found)
        linked = components(_edges(linked).unionByName(more))
    more = _verified(written(_rest(_unresolved(known, linked), percent), "rest"), texts, width).filter(near).select(*found)
    linked = components(_edges(linked).unionByName(more))

    # rows with one id are one document
    homes = sets.join(linked, sets["node"] == linked["vertex"], "left").select("n", "set_key", F.coalesce("component", "node").alias("home"))
    placed = rows.select("doc_id", "n", "set_key").join(homes, ["n", "set_key"], "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("home", "doc_id")).alias("component_id"))


def _needed(n, m, percent: int):
    """How many n-grams of their prefixes sets of n and m n-grams share at least, if they are similar.

    The last n-gram of the prefix that ends first parts the n-grams both have: those before it are in both
    prefixes, those after it at most what the larger set has outside its prefix.
    """
    n, m = (F.col(x) if isinstance(x, str) else x for x in (n, m))
    return percent * (n + m) / (100 + percent) - percent * F.greatest(n, m) / 100 - 1e-9


def _enough(buckets: DataFrame, percent: int, small: int) -> DataFrame:
    """buckets (gram, node, n, alike) with held, without sets that cannot be similar to another of the bucket.

    held is how many prefix n-grams a set could share with another. Two sets that
    share an n-gram of a small bucket meet there, so in large buckets only the n-grams of large ones count. Sets of
    one group share the whole prefix.
    """
    of_gram = F.count("*").alias("size"), F.min("n").alias("smaller"), F.max("n").alias("larger")
    rows = with_groups(buckets, ["gram"], *of_gram, name="bucket-sizes").withColumn("large", F.col("size") > small)
    total = lambda which: F.sum(F.when(which, 1).otherwise(0))
    cross = ~F.col("alike")
    of_node = rows.groupBy("node").agg(total(cross & F.col("large")).alias("in_large"), total(cross).alias("in_all"))
    held = F.when(F.col("alike"), F.col("n")).when(F.col("large"), F.col("in_large")).otherwise(F.col("in_all"))
    least = F.least(_needed("n", F.least("n", "smaller"), percent), _needed("n", F.greatest("n", "larger"), percent))
    rows = rows.join(of_node, "node").withColumn("held", held).withColumn("least", least)
    return rows.filter("held >= least").select("gram", "node", "n", "alike", "size", "large", "held", "least")


def _needed_exactly(n: str, m: str, percent: int):
    """_needed() for two given sizes, in whole n-grams."""
    n, m = F.col(n), F.col(m)
    return F.ceil(percent * (n + m) / (100 + percent) - 1e-9) - F.ceil(percent * F.greatest(n, m) / 100 - 1e-9) + 1


def _similar_sizes(n, m, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, lead) of each set and the first of its buckets that may be similar.

    Both stand in a bucket only if its first set is the lead or a smaller one; so the set's large buckets with such
    first sets bound how many prefix n-grams the two share, unless they meet in a small bucket.
    """
    free = ~F.col("large") | F.col("alike")
    pairs = members.filter("node <> lead").groupBy("node", "lead").agg(
        F.max(free).alias("free"), F.max("held").alias("held"), F.sum(F.when(free, 0).otherwise(1)).alias("w"), F.min("n").alias("n"), F.min("lead_n").alias("m")
    )
    through = F.sum("w").over(Window.partitionBy("node").orderBy("lead"))
    able = pairs.withColumn("most", F.when(F.col("free"), F.col("held")).otherwise(through)).filter((F.col("most") >= _needed("n", "m", percent)) & _similar_sizes(F.col("n"), F.col("m"), percent))
    return able.select("node", "lead")


def _edges(linked: DataFrame) -> DataFrame:
    return linked.select(F.col("vertex").alias("u"), F.col("component").alias("v"))


def _unresolved(known: DataFrame, linked: DataFrame) -> DataFrame:
    """The buckets whose sets are in different components, with each set's component, home, and whether that is the first set's, inside."""
    homes = linked.select(F.col("vertex").alias("node"), F.col("component").alias("home"))
    placed = known.drop("home", "inside").join(homes, "node", "left").withColumn("home", F.coalesce("home", "node"))
    placed = written(placed, "placed")
    lead_home = F.max(F.when(F.col("node") == F.col("lead"), F.col("home"))).alias("lead_home")
    several = with_groups(placed, ["gram"], F.min("home").alias("lo"), F.max("home").alias("hi"), lead_home, name="homes", having="lo < hi")
    return several.withColumn("inside", F.col("home") == F.col("lead_home")).drop("lead_home", "lo", "hi")


def _to_pivot(known: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (node, lead) of the sets still outside, and near enough to link, with the bucket's k-th closest set to its first: likely a central copy."""
    closest = Window.partitionBy("gram", "inside").orderBy(F.asc_nulls_last("apart"), "node")
    pivots = known.filter("node <> lead").withColumn("k", F.row_number().over(closest)).filter(f"inside and k = {k}").select("gram", F.col("node").alias("pivot"))
    outside = known.filter(~F.col("inside") & (F.col("apart") <= 2 * (1 - percent / 100) + 1e-9))
    return outside.join(pivots, "gram").select("node", F.col("pivot").alias("lead")).distinct()


def _rest(known: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, lead) that share a prefix n-gram, are in different components and may yet be similar."""
    # a set shares `least` of the `held` n-grams it could share, so one of the first held - least + 1 in any order
    kind = Window.partitionBy("node", "large", "alike")
    most = F.col("held") - F.min("least").over(kind) + 1
    ranked = known.withColumn("few", (F.row_number().over(kind.orderBy("size", "gram")) <= most) | F.max("inside").over(Window.partitionBy("node")))
    outside = ranked.filter(~F.col("inside") & F.col("few"))
    a, b = outside.alias("a"), known.filter("node <> lead").alias("b")
    allowed = 1 - percent / 100 + 1e-9
    close = (
        (F.col("a.gram") == F.col("b.gram"))
        & (F.col("a.home") != F.col("b.home"))
        & (F.col("b.inside") | (F.col("a.node") < F.col("b.node")))
        & (F.coalesce(F.abs(F.col("a.apart") - F.col("b.apart")), F.lit(0.0)) <= allowed)
        & _similar_sizes(F.col("a.n"), F.col("b.n"), percent)
        & (F.least("a.held", "b.held") >= _needed_exactly("a.n", "b.n", percent))
    )
    return a.join(b, close).select(F.col("a.node").alias("node"), F.col("b.node").alias("lead")).distinct()
