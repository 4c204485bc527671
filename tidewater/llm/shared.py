"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.tables import shared_folder

#: Words are runs of anything but ASCII white space: the bytes 09 to 0D and 20.
WORD_GAP = "\t\n\x0b\x0c\r"


#: With this setting a finished query's shuffle files are removed at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts its lineage, survives lost executors.

    Nothing reads the writing query's shuffle files again, so they go when it is done.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written_at(df, name))


def written_at(df: DataFrame, name: str) -> str:
    """Writes df as written() does: the folder of its table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return path


def with_groups(df: DataFrame, keys: list[str], *facts: Column, name: str, having: str | None = None) -> DataFrame:
    """df's rows with what a grouping says of their keys, those of groups `having` passes.

    Groups pre-aggregate and are written before they are joined back: then both sides of the join come straight from a
    shuffle, and adaptive execution splits a key that many rows have, which it can't where a grouping stands between. Few groups are broadcast.
    """
    groups = df.groupBy(*keys).agg(*facts)
    return df.join(written(groups.filter(having) if having else groups, name), keys)


def removed(spark: SparkSession, folder: str) -> None:
    """Removes a folder through the file system that holds it; nothing may read it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed_rows(df: DataFrame, *, drop: list[str]) -> DataFrame:
    """df's rows as one struct column, row, so that no other column's name can clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in drop]).alias("row"))


def unpacked_rows(df: DataFrame, columns: list[str], replaced: dict[str, Column], added: dict[str, Column]) -> DataFrame:
    """The columns of row again, some replaced, and added ones."""
    return df.select(*[replaced.get(c, F.col("row").getField(c)).alias(c) for c in columns], *[v.alias(k) for k, v in added.items()])


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, natively; null has none."""
    spaced = F.coalesce(text, F.lit(""))
    for gap in WORD_GAP:
        spaced = F.replace(spaced, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Bytes of text that a task makes arrays of at a time.
SLICE_BYTES = 2 << 20


def slices_of_text(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with at most `limit` bytes of text each, or one longer text, so that what is made of a run
    doesn't grow with the batch. A binary column holds zstandard frames, whose texts count."""
    texts = batch.column(column)
    if pa.types.is_binary(texts.type):
        import zstandard

        sizes = np.fromiter((zstandard.frame_content_size(p.as_buffer()) if p.is_valid else 0 for p in texts), np.int64, len(texts))
    else:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that any bits of the result serve as a hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, kept per worker up to a bound."""

    limit = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` 64-bit values: a polynomial, built by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, done, block, size = None, 0, values, 1
    factor = _ODD
    while done < width:
        if width & size:
            part = block[done : done + n]
            total = part.copy() if total is None else total * factor + part
            done += size
        if done < width:
            block = block[: len(block) - size] * factor + block[size:]
            factor, size = np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF), 2 * size
    return mixed(total)


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of word shingles, A-Z lower-cased; all words as one where fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(width, len(words))))
