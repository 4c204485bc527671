"""Bounded-space online packing of token ids into sequences of fixed length."""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import written
from tidewater.llm.tokens import encoder

PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
_PARTITION_BITS = 33


class Windows:
    """A fixed number of open windows; best fit, else the fullest goes."""

    def __init__(self, size: int, width: int, slack: int, emit):
        self.size, self.width, self.slack, self.emit = size, width, slack, emit
        self.open: list[tuple[int, list]] = []

    def place(self, doc, start: int, length: int, make) -> None:
        """Puts ids start to start + length of a document into windows; make(doc, start, length) gives a piece."""
        while length:
            fits = [k for k, (fill, _) in enumerate(self.open) if fill + length <= self.size]
            if length < self.size and fits:
                best = max(fits, key=lambda k: self.open[k][0])
                fill, pieces = self.open[best]
                pieces.append(make(doc, start, length))
                self.open[best] = (fill + length, pieces)
                if fill + length == self.size:
                    self.emit(self.open.pop(best)[1])
                return
            if length >= self.size:
                self.emit([make(doc, start, self.size)])
                start, length = start + self.size, length - self.size
            elif len(self.open) < self.width:
                self.open.append((length, [make(doc, start, length)]))
                return
            else:
                fullest = max(range(len(self.open)), key=lambda k: self.open[k][0])
                fill, pieces = self.open.pop(fullest)
                if (gap := self.size - fill) > self.slack:
                    pieces.append(make(doc, start, gap))
                    start, length = start + gap, length - gap
                self.emit(pieces)


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    size: int = 1024,
    end_id: int = 0,
    open_windows: int = 32,
    slack: int = 16,
    merge_partitions: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packs every id of every text into sequences of at most `size` ids; a row a piece:
    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Each partition keeps `open_windows` windows open. What is left of a document
    after full sequences goes whole into the window that it fills best; if none
    has room, the fullest is emitted, first topped up by a cut where more than
    `slack` ids of padding would remain. The windows left open are merged in
    groups of `merge_partitions` partitions, fullest first, without reading text
    again; only their pieces travel. A sequence is padded to `size`, except when
    its length is a power of two.

    Sequence ids come from the partition's number and a counter, so a task that
    runs again gives the same rows. Null and empty texts hold the end id alone. Very long texts are encoded whole, in their task,
    and fill sequences of their own.
    Null ids and repeated rows are packed as any row; ties go by input order.
    Extra columns are not read. An empty table gives an empty one.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def online(batches):
        enc, number, base = encoder(tokenizer, "ids"), 0, TaskContext.get().partitionId() << _PARTITION_BITS
        end, out = end_id.to_bytes(4, "little"), []

        def emit(pieces, is_open=False):
            nonlocal number
            at = 0
            for p in pieces:
                out.append((*p, base + number, at, is_open))
                at += p[2]
            number += 1

        ids = b""

        def make(doc, start, length):
            return doc, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4

        windows = Windows(size, open_windows, slack, emit)

        def flushed():
            columns = list(zip(*out, strict=True)) or [[]] * 8
            types = [id_pa, *[pa.int64()] * 6, pa.bool_()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*PIECE, "sequence_id", "offset", "is_open"])
            out.clear()
            return batch

        id_pa = pa.int64()
        for batch in batches:
            id_pa = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = b"".join(enc.parts(text)) + end if text else end
                windows.place(doc, 0, len(ids) // 4, make)
            if out:
                yield flushed()
        for _, pieces in windows.open:
            emit(pieces, True)
        if out:
            yield flushed()

    kind = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    pieces = written(docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(online, f"{kind}, is_open boolean"), "pack")

    def merged(key, left: pd.DataFrame) -> pd.DataFrame:
        base, out = -1 - (int(key[0]) << _PARTITION_BITS), []
        windows = [(int(g["length"].sum()), g) for _, g in left.sort_values(["sequence_id", "offset"]).groupby("sequence_id", sort=True)]
        bins: list[list] = []
        for fill, g in sorted(windows, key=lambda w: -w[0]):
            room = [b for b in bins if b[0] + fill <= size]
            best = max(room, key=lambda b: b[0], default=None)
            if best is None:
                bins.append(best := [0, []])
            best[0] += fill
            best[1].append(g)
        for k, (_, parts) in enumerate(bins):
            g = pd.concat(parts, ignore_index=True)
            out.append(g.assign(sequence_id=base - k, offset=g["length"].cumsum() - g["length"]))
        return pd.concat(out)[[*PIECE, "sequence_id", "offset"]]

    group = F.shiftright("sequence_id", _PARTITION_BITS + merge_partitions.bit_length() - 1)
    done = pieces.filter(~F.col("is_open")).drop("is_open")
    rest = pieces.filter("is_open").drop("is_open").groupBy(group.alias("merge")).applyInPandas(merged, kind)
    all_pieces = done.unionByName(rest)
    return all_pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """Of pack()'s pieces: (sequence_id, length, padded_length) of each sequence."""
    length = F.sum("length")
    return pieces.groupBy("sequence_id").agg(length.alias("length"), F.when(F.bit_count(length) == 1, length).otherwise(F.lit(size)).cast("long").alias("padded_length"))
