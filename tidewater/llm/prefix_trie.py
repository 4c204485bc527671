"""The trie of conversation prefixes, from whole sequences that are collapsed first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import words_of, written
from tidewater.sources.tables import spread

#: What names a prefix: two sums of hashes of its turns, each with its place, and its depth.
NODE = ["lane1", "lane2", "depth"]
_BLOCK_CHARS = 1 << 16


def prefix_trie(turns: DataFrame) -> DataFrame:
    """trie() of turns (conv_id, turn, role, text) as they are, ordered by turn, nulls first; turns with one number go by their digest."""
    placed = placed_turns(turn_digests(turns))
    return trie(placed, turns.filter("conv_id is not null").select("conv_id").distinct())


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of turns (conv_id, turn, role, text): SHA-256 of role and text, and the number of words of the text, runs
    of anything but ASCII white space. Null roles and texts are empty; a turn with a null conv_id is of no conversation. Other columns are not read."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return spread(turns).filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.size(words_of(text)).cast("long").alias("words"))


def placed_turns(digests: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words) of turn_digests(), written: place is a turn's number in its conversation, from 1."""
    return running(digests, ["conv_id"], [F.asc_nulls_first("turn"), F.col("digest")], [], "turns").select("conv_id", "place", "digest", "words")


def trie(placed: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the conversations' prefixes, from placed (conv_id, place, digest, words), places dense from 1, and members
    (conv_id), all conversations, also those without turns: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), of which all but the last are long.

    A node is a distinct sequence of the first `depth` turns of a conversation; the root, of depth 0, has all conversations as
    members. conv_id is the smallest member, parent_conv_id that of the parent, null for the root. n_leaves are the childless nodes of the node's subtree, itself included;
    saved_tokens, over its subtree, the words of each node's last turn times its members but one; ends_sha256 the SHA-256 of
    the ascending ids of the members that end there, joined by commas.

    Identical conversations become one weighted sequence with a list of ends, so only distinct sequences have their
    prefixes made. A sequence that is a proper prefix of another is no leaf, which an anti-join tells. Prefixes are named by sums over
    (place, digest), which range-sorted tasks add up, so no task needs a whole conversation, and aggregated with the
    sequences' weights. A subtree's saved tokens are a sum over its sequences: the weight times the words from the node on, less
    the words from where the sequence's own nodes begin, those of which it has the smallest member; so no node meets its descendants.

    Sequences are told apart by 128 bits of hashes of SHA-256 digests. Repeated turns are turns. Joins on nodes or conversations that many
    rows have are with written tables, so that adaptive execution splits them. The list of ends of one node is streamed by one task in
    blocks, since its digest is of one text. No conversations give no rows.
    """
    lane = lambda seed: F.xxhash64(F.lit(seed), "place", "digest")
    turns = placed.select("conv_id", F.col("place").alias("at"), "words", lane(1).alias("lane1"), lane(2).alias("lane2"))
    through = running(turns, ["conv_id"], [F.col("at")], ["words", "lane1", "lane2"], "prefixes")
    last = through.groupBy("conv_id").agg(F.max("place").alias("n"), *[F.max_by(c, "place").alias(c) for c in ("words", "lane1", "lane2")])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    whole = written(members.select(F.col("conv_id").cast("long").alias("conv_id")).join(last, "conv_id", "left").select("conv_id", *map(zero, ("n", "words", "lane1", "lane2"))), "conversations")
    by_text = whole.groupBy("lane1", "lane2", "n").agg(F.count("*").alias("weight"), F.min("conv_id").alias("sequence"), F.min("words").alias("total"))
    sequences = written(by_text, "sequences")

    below = through.withColumnRenamed("conv_id", "sequence").join(sequences.drop("lane1", "lane2"), "sequence")
    below = below.select("sequence", "weight", "total", "n", F.col("place").alias("depth"), "lane1", "lane2", "lane1_before", "lane2_before", "words", "words_before")
    no = F.lit(0).cast("long")
    roots = sequences.select("sequence", "weight", "total", "n", *[no.alias(c) for c in below.columns[4:]])
    prefixes = written(below.unionByName(roots), "weighted-prefixes")

    up = [F.min("lane1_before").alias("up1"), F.min("lane2_before").alias("up2")]
    nodes = written(prefixes.groupBy(NODE).agg(F.sum("weight").alias("n_convs"), F.min("sequence").alias("conv_id"), *up), "nodes")

    proper = prefixes.filter("depth < n").select(NODE).distinct()
    leaves = sequences.withColumnRenamed("n", "depth").join(proper, NODE, "left_anti").select("sequence", F.lit(1).cast("long").alias("leaf"))
    other = prefixes.filter("depth > 0").join(nodes.select(*NODE, "conv_id"), NODE).filter("conv_id <> sequence")
    not_own = other.groupBy("sequence").agg(F.max("words").alias("not_own"))
    facts = written(sequences.select("sequence").join(leaves, "sequence", "left").join(not_own, "sequence", "left").select("sequence", zero("leaf"), zero("not_own")), "sequence-facts")

    saved = F.col("weight") * (F.col("total") - F.col("words_before")) - (F.col("total") - F.greatest("words_before", "not_own"))
    sums = prefixes.join(facts, "sequence").groupBy(NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    parent = [F.col("up1").alias("lane1"), F.col("up2").alias("lane2"), (F.col("depth") - 1).alias("depth")]
    children = nodes.filter("depth > 0").select(*parent).groupBy(NODE).agg(F.count("*").alias("n_children"))
    of_parent = nodes.select(F.col("lane1").alias("up1"), F.col("lane2").alias("up2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(sums, NODE).join(children, NODE, "left").join(_ends(whole), NODE, "left").join(of_parent, ["up1", "up2", "depth"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


# --- sums along rows in order ------------------------------------------------------


def _runs(keys: list[np.ndarray], before: tuple | None) -> np.ndarray:
    """Where in a batch sorted by keys another key begins; at its start too, unless it goes on from before."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[0] = before is None or any(k[0] != b for k, b in zip(keys, before, strict=True))
    return np.flatnonzero(new)


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: list[str], name: str) -> DataFrame:
    """rows with `place`, a row's number within its key, from 1, and with each of `sums` added up to it, as x, and to before it, as x_before; written.
    Keys and sums are longs; sums are modulo 2**64.

    One exchange by ranges of key and order, so a key that many rows have lies in several tasks; each streams its rows
    in order. A row for each task, with its first key, its last and that one's sums, tells the driver what the first key of a task
    has in the tasks before, which a second pass without an exchange adds.
    """
    sort = [*map(F.col, keys), *order]
    kept = [c for c in rows.columns if c not in sums]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    added = ["place", *[x for c in sums for x in (c, f"{c}_before")]]
    schema = ", ".join([f"{c} {kinds[c]}" for c in kept] + [f"{c} bigint" for c in [*added, "task"]])
    m = 1 + len(sums)

    def longs(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])

    def batch_of(batch: pa.RecordBatch, through: np.ndarray, before: np.ndarray, task: np.ndarray) -> pa.RecordBatch:
        values = [through[0], *[x for k in range(1, m) for x in (through[k], before[k])], task]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, values)], [*kept, *added, "task"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, carried, last = TaskContext.get().partitionId(), np.zeros(m, np.int64), None
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            by = list(longs(batch, keys))
            own = np.concatenate([np.ones((1, n), np.int64), longs(batch, sums)]) if sums else np.ones((1, n), np.int64)
            through, starts = np.cumsum(own, axis=1), _runs(by, last)
            offset = np.concatenate([carried[:, None], own[:, starts] - through[:, starts]], axis=1)
            through = through + offset[:, np.searchsorted(starts, np.arange(n), side="right")]
            yield batch_of(batch, through, through - own, np.full(n, task))
            carried, last = through[:, -1], tuple(k[-1] for k in by)

    at = written(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(stream, schema), name)
    ends = at.groupBy("task").agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys, "place", *sums)).alias("last"))
    late, before, carry = {}, None, np.zeros(m, np.int64)
    for task, first, end in sorted(map(tuple, ends.collect()), key=lambda r: r[0]):
        first, last, totals = tuple(first), tuple(end)[: len(keys)], np.array(tuple(end)[len(keys) :], np.int64)
        if first == before:
            late[task] = (first, carry)
        carry, before = (totals + carry if first == last == before else totals), last
    if not late:
        return at.drop("task")

    def carry_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            task, by = batch.column("task").to_numpy(), list(longs(batch, keys))
            through, before = longs(batch, ["place", *sums]), longs(batch, ["place", *[f"{c}_before" for c in sums]])
            for t in np.unique(task):
                if int(t) in late:
                    key, more = late[int(t)]
                    same = (task == t) & np.logical_and.reduce([k == x for k, x in zip(by, key, strict=True)])
                    through, before = through + more[:, None] * same, before + more[:, None] * same
            yield batch_of(batch, through, before, task)

    return at.mapInArrow(carry_on, schema).drop("task")


def _ends(whole: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end.

    Ids are first joined in blocks, in range-sorted tasks, so that the one task which a node's digest needs reads a few rows.
    """
    ids = whole.select("lane1", "lane2", F.col("n").alias("depth"), "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            by = [batch.column(c).to_numpy() for c in NODE]
            conv = batch.column("conv_id").to_pylist()
            # a batch's run may go on in the next one, as another block
            cuts = [*_runs(by, None), batch.num_rows]
            cuts = sorted({*cuts, *range(0, batch.num_rows, _BLOCK_CHARS // 20)})
            texts = [",".join(map(str, conv[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
            starts = np.array(cuts[:-1])
            yield pa.RecordBatch.from_arrays([*[pa.array(k[starts]) for k in by], pa.array([conv[a] for a in starts]), pa.array(texts)], [*NODE, "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for *key, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != node:
                    if node:
                        done.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], d, strict=True)) for d in done], schema)
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], (*node, sha.hexdigest()), strict=True))], schema)

    schema = pa.schema([(c, pa.int64()) for c in NODE] + [("ends_sha256", pa.string())])
    node = "lane1 bigint, lane2 bigint, depth bigint"
    blocks = ids.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(joined, f"{node}, first bigint, ids string")
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digested, f"{node}, ends_sha256 string")
