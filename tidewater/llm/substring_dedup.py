"""Removal of word runs that occur earlier in the corpus: a compacted graph of token k-mers."""

from __future__ import annotations

import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import as_bytes, mixed, slices_of_text, window_hashes, word_hashes, written


def _anchor_words(window: int) -> int:
    """Words of the short k-mers whose local minima anchor the windows."""
    return max(1, window // 2)


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[: len(values) - step], values[step:])
        done += step
    return values


def _anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(the anchor of each window, the values at the places that anchor some window).

    The anchor is the least hash of a window's short k-mers, so equal windows have equal anchors.
    """
    grams = window_hashes(hashes, _anchor_words(window))
    width = window - _anchor_words(window) + 1
    least = _extreme(grams, width, np.minimum)
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return least, grams[_extreme(around, width, np.maximum) == grams]


def _id_mix(ids: pa.Array) -> np.ndarray:
    return mixed(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _slices(batches):
    """Batches in slices of their texts; a step's arrays are made for a slice at a time, and what it settles is settled within one."""
    for batch in batches:
        yield from slices_of_text(batch, 1)


def _asked(docs: DataFrame, window: int) -> DataFrame:
    """Anchors and the documents that hold them: (key, settled, twice, doc_id).

    A slice of a batch asks once for an anchor, key, through one of its documents. If several of
    its documents hold it, these know already that it is repeated; their rows are settled
    and their key, anchor xor a mix of the id, scatters them. So a frequent anchor is one row a slice.
    """

    def ask(batches):
        for batch in _slices(batches):
            values, owners = [], []
            for k, text in enumerate(as_bytes(batch.column(1))):
                words = text.split() if text else []
                if len(words) >= window:
                    found = _anchors(word_hashes(words), window)[1]
                    values.append(found)
                    owners.append(np.full(len(found), k, np.int64))
            if not values:
                continue
            value, owner = np.concatenate(values), np.concatenate(owners)
            order = np.lexsort((owner, value))
            value, owner = value[order], owner[order]
            first = np.append(True, value[1:] != value[:-1])
            twice = np.add.reduceat(np.ones(len(value), np.int64), np.flatnonzero(first))[np.cumsum(first) - 1] > 1
            other = first | (np.append(True, owner[1:] != owner[:-1]))
            # by document, so that neighbours in a shuffle block repeat the id and compress
            other = np.flatnonzero(other)[np.argsort(owner[other], kind="stable")]
            value, owner, first, twice = value[other], owner[other], first[other], twice[other]
            ids = batch.column(0).take(pa.array(owner))
            key = np.where(first, value, value ^ _id_mix(batch.column(0))[owner])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(~first), pa.array(twice), ids], ["key", "settled", "twice", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(ask, f"key long, settled boolean, twice boolean, doc_id {kind}")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): compressed texts, for the shuffle by id."""

    def pack(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for batch in _slices(batches):
            packed = pa.array([None if t is None else z.compress(t) for t in as_bytes(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["doc_id", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(pack, f"doc_id {kind}, packed binary")


def _known_anchors(ids: pa.Array, known: pa.Array) -> list[np.ndarray]:
    """Each document's repeated anchors: keys, of settled rows xor the id's mix."""
    flat, sizes = known.flatten(), known.value_lengths().to_numpy(zero_copy_only=False)
    key = flat.field("key").to_numpy(zero_copy_only=False).view(np.uint64)
    key = np.where(flat.field("settled").to_numpy(zero_copy_only=False), key ^ np.repeat(_id_mix(ids), sizes), key)
    return np.split(key, np.cumsum(sizes)[:-1])


#: A spot is the checksum of a text and a place in it, in one number that grows with the place.
_PLACE_BITS = 31


def _edges(found: DataFrame, window: int) -> DataFrame:
    """The windows over repeated anchors, the graph's edges: (key, settled, doc_id, spot, length).

    A slice of a batch keeps an edge's first place; it asks for an earlier one by its key. The edge's other places
    are repeated for certain: they are compacted to paths and settled here, their words compared.
    """

    def edges(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            ids = batch.column(0)
            packed, anchors = batch.column(1).to_pylist(), _known_anchors(ids, batch.column(2))
            keys, places, owners, hashes = [], [], [], []
            tags = np.zeros(len(ids), np.int64)
            for k, (p, a) in enumerate(zip(packed, anchors, strict=True)):
                text = z.decompress(p) if p is not None else b""
                tags[k] = zlib.crc32(text)
                own = word_hashes(text.split())
                hashes.append(own)
                if len(own) < window:
                    continue
                at = np.flatnonzero(np.isin(_anchors(own, window)[0], a))
                keys.append(window_hashes(own, window)[at])
                places.append(at)
                owners.append(np.full(len(at), k, np.int64))
            if not keys:
                continue
            key, place, owner = np.concatenate(keys), np.concatenate(places), np.concatenate(owners)
            rank = _ranks(ids, tags)
            order = np.lexsort((place, rank[owner], key))
            key, place, owner = key[order], place[order], owner[order]
            first = np.append(True, key[1:] != key[:-1])
            source = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            # a repeated row of the same document is not earlier
            asks = first | ((rank[owner] == rank[owner[source]]) & (place == place[source]))
            rest = ~asks
            asks = np.flatnonzero(asks)[np.lexsort((place[asks], owner[asks]))]
            spot = tags[owner] << _PLACE_BITS | place
            yield _edge_rows(ids, key[asks].view(np.int64), False, owner[asks], spot[asks], np.ones(len(asks), np.int64))
            o, s, size, fo, fs = _paths(owner[rest], place[rest], owner[source[rest]], place[source[rest]])
            equal = [np.array_equal(hashes[a][b : b + m + window - 1], hashes[c][d : d + m + window - 1]) for a, b, m, c, d in zip(o, s, size, fo, fs, strict=True)]
            equal = np.array(equal, bool)
            o, s, size = o[equal], s[equal], size[equal]
            scatter = mixed(_id_mix(ids)[o] ^ s.astype(np.uint64)).view(np.int64)
            yield _edge_rows(ids, scatter, True, o, tags[o] << _PLACE_BITS | s, size)

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(edges, f"key long, settled boolean, doc_id {kind}, spot long, length long")


def _edge_rows(ids: pa.Array, key, settled: bool, owner, spot, length) -> pa.RecordBatch:
    columns = [pa.array(key), pa.array(np.full(len(key), settled)), ids.take(pa.array(owner)), pa.array(spot), pa.array(length)]
    return pa.RecordBatch.from_arrays(columns, ["key", "settled", "doc_id", "spot", "length"])


def _ranks(ids: pa.Array, tags: np.ndarray) -> np.ndarray:
    """Numbers that order (id, tag) as Spark does, null ids first; equal for equal ones."""
    known, value = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((tags, value, known))
    columns = np.stack([known[order].astype(np.int64), value[order].astype(np.int64), tags[order]])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.append(True, (columns[:, 1:] != columns[:, :-1]).any(axis=0)))
    return rank


def _paths(owner, start, from_owner, from_start):
    """Edges that follow each other here and at their source, compacted: (owner, start, edges, from_owner, from_start)."""
    order = np.lexsort((start, owner))
    owner, start, from_owner, from_start = owner[order], start[order], from_owner[order], from_start[order]
    if not len(owner):
        return owner, start, start, from_owner, from_start
    joins = (owner[1:] == owner[:-1]) & (start[1:] == start[:-1] + 1) & (from_owner[1:] == from_owner[:-1]) & (from_start[1:] == from_start[:-1] + 1)
    head = np.flatnonzero(np.append(True, ~joins))
    size = np.diff(np.append(head, len(owner)))
    return owner[head], start[head], size, from_owner[head], from_start[head]


def _removed_edges(edges: DataFrame) -> DataFrame:
    """Edges whose first place in the corpus is another one, with that place; settled paths as they are."""
    at = F.struct("doc_id", "spot")
    first = edges.withColumn("first", F.min(at).over(Window.partitionBy("key", "settled")))
    removed = first.filter(F.col("settled") | ~at.eqNullSafe(F.col("first")))
    return removed.select("doc_id", "spot", "length", "settled", F.when(~F.col("settled"), F.col("first")["doc_id"]).alias("from_id"), F.when(~F.col("settled"), F.col("first")["spot"]).alias("from_spot"))


def _compacted(removed: DataFrame) -> DataFrame:
    """Nonbranching paths: runs of removed edges that follow each other in the document and in the source."""
    by_doc = Window.partitionBy("doc_id").orderBy("spot")
    before = lambda c: F.lag(c).over(by_doc)
    follows = (before("spot") == F.col("spot") - 1) & before("from_id").eqNullSafe(F.col("from_id")) & (before("from_spot") == F.col("from_spot") - 1)
    marked = removed.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    path = marked.withColumn("path", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.min(F.struct("spot", "from_id", "from_spot", "settled")).alias("head")
    return path.groupBy("doc_id", "path").agg(head, F.sum("length").alias("length")).select("doc_id", "head.*", "length")


def _source_digests(paths: DataFrame, packed: DataFrame, window: int) -> DataFrame:
    """(doc_id, spot, length, digest): each path with the digest of its words at the source.

    Paths with one source, thousands of copies too, ask for it once: what meets in a source's row are its distinct spans.
    """
    asking = paths.filter("not settled").select("doc_id", "spot", "length", "from_id", "from_spot")
    spans = asking.select("from_id", "from_spot", "length").distinct()
    per_source = spans.groupBy("from_id").agg(F.collect_list(F.struct("from_spot", "length")).alias("spans"))

    def digests(batches):
        import xxhash
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            owner, rows = [], []
            for k, (p, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text = z.decompress(p) if p is not None else b""
                tag, words = zlib.crc32(text), text.split()
                for x in spans:
                    if x["from_spot"] >> _PLACE_BITS == tag:
                        start = x["from_spot"] & ((1 << _PLACE_BITS) - 1)
                        owner.append(k)
                        rows.append((x["from_spot"], x["length"], xxhash.xxh3_128_digest(b" ".join(words[start : start + x["length"] + window - 1]))))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            found = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *found], ["source_id", "source_spot", "span", "digest"])

    kind = packed.schema["doc_id"].dataType.simpleString()
    joined = packed.join(per_source, packed["doc_id"].eqNullSafe(per_source["from_id"])).select("doc_id", "packed", "spans")
    # repeated rows of one document give the same digests
    known = joined.mapInArrow(digests, f"source_id {kind}, source_spot long, span long, digest binary").distinct()
    same = F.col("from_id").eqNullSafe(F.col("source_id")) & (F.col("from_spot") == F.col("source_spot")) & (F.col("length") == F.col("span"))
    return asking.join(known, same).select("doc_id", "spot", "length", "digest")


def remove_repeated(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word covered by a window of `window` words that also starts earlier
    (smaller id, or same document and earlier place): (doc_id, text, n_words,
    n_removed), text the kept words joined by single spaces, null where it was null.
    Windows are judged on the input, not on what is left. Ids are integers.

    Windows are the edges of a graph of k-mers. Two windows can be equal only if their anchors are,
    the least short k-mers in them; so first the anchors are counted, about two
    to twelve words, and only windows with a repeated anchor become
    edges. Every slice of a batch keeps an edge's first place and settles the others, so a
    hot edge or anchor is one row a slice in the shuffle. Repeated edges that follow each other
    in a document and at their source are compacted to a path, and a path's words are compared with those at
    its source coordinates before they go.

    Words are split at ASCII white space and otherwise unchanged. Null texts
    have no words. Texts with fewer than `window` words stay whole. Very long texts are held whole in their task. A null id sorts
    first. Identical repeated rows are one document and get one
    result each; different texts under one id are different documents, ordered by checksum. Extra columns are not read.
    An empty table gives an empty one; ids that are not integers, and a window under two words, are refused.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint") or window < 2:
        raise ValueError(f"ids must be integers and a window two words or more; they are {kind} and {window}")
    of_key = Window.partitionBy("key", "settled")
    asked = _asked(docs, window).withColumn("n", F.count("*").over(of_key)).withColumn("any", F.max("twice").over(of_key))
    known = asked.filter("settled or any or n > 1").select("doc_id", "key", "settled")
    anchors = written(known.groupBy("doc_id").agg(F.collect_list(F.struct("key", "settled")).alias("known")), "anchors")
    packed = _packed(docs)
    found = packed.join(anchors.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")))
    paths = written(_compacted(_removed_edges(_edges(found.select("doc_id", "packed", "known"), window))), "paths")

    settled = paths.filter("settled").select("doc_id", "spot", "length", F.lit(None).cast("binary").alias("digest"))
    spans = settled.unionByName(_source_digests(paths, packed, window))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("spot", "length", "digest")).alias("spans"))
    cut = packed.join(spans.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "packed", "spans")

    def kept(batches):
        import xxhash
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            rows = []
            for p, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if p is None:
                    rows.append((None, 0, 0))
                    continue
                text = z.decompress(p)
                tag, words = zlib.crc32(text), text.split()
                keep = np.ones(len(words), bool)
                for x in spans or ():
                    a = x["spot"] & ((1 << _PLACE_BITS) - 1)
                    b = a + x["length"] + window - 1
                    if x["spot"] >> _PLACE_BITS == tag and (x["digest"] is None or x["digest"] == xxhash.xxh3_128_digest(b" ".join(words[a:b]))):
                        keep[a:b] = False
                rows.append((b" ".join(compress(words, keep)).decode(), len(words), int((~keep).sum())))
            texts, n, gone = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    return cut.mapInArrow(kept, f"doc_id {kind}, text string, n_words long, n_removed long")
