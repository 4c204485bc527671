"""Documents from a folder: listed and read by tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import SourceConfigurationError, SourceFileTooLargeError, SourceReadError
from tidewater.functions.text import path_of
from tidewater.sources.shared_files import uri_of
from tidewater.sources.tables import written

EXTENSIONS = (".md", ".txt")
MAX_FILE_BYTES = 1_000_000


def read_text(root: Path, relative: str, max_bytes: int) -> str:
    """A file's text: at most max_bytes are read; strict UTF-8, a byte order mark is dropped."""
    full = Path(root, relative)
    if root.resolve() not in full.resolve().parents:
        raise SourceReadError(f"{relative} lies outside the source")
    try:
        with full.open("rb") as file:
            return decoded(file.read(max_bytes + 1), relative, max_bytes)
    except OSError as error:
        raise SourceReadError(f"cannot read {relative}: {error}") from error


def decoded(data: bytes, relative: str, max_bytes: int) -> str:
    if len(data) > max_bytes:
        raise SourceFileTooLargeError(f"{relative} has more than {max_bytes} bytes")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError as error:
        raise SourceReadError(f"cannot read {relative}: {error}") from error


def _file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """pyarrow's file system for a URI as Spark writes it, and the path there."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), re.sub("^/+", "/", uri.removeprefix("file:"))
    return pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def entries_of(uri: str, folder: str, extensions: tuple[str, ...]) -> Iterator[tuple[str, bool, int]]:
    """(relative path, whether it is a folder, bytes) of the folders and candidate files in a folder of the source; links are left out."""
    fs, base = _file_system(uri)
    inside = f"{folder}/" if folder else ""
    wanted = lambda name: Path(name).suffix.lower() in extensions
    try:
        if isinstance(fs, pa.fs.LocalFileSystem):
            with os.scandir(Path(base, folder)) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        yield inside + e.name, True, 0
                    elif wanted(e.name) and e.is_file(follow_symlinks=False):
                        yield inside + e.name, False, e.stat(follow_symlinks=False).st_size
        else:
            for info in fs.get_file_info(pa.fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                if info.type == pa.fs.FileType.Directory:
                    yield inside + info.base_name, True, 0
                elif wanted(info.base_name) and info.type == pa.fs.FileType.File:
                    yield inside + info.base_name, False, info.size
    except OSError as error:
        raise SourceReadError(f"cannot list {uri}/{folder}: {error}") from error


def discovered(spark: SparkSession, uri: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, bytes) of the candidate files below a folder at any depth, listed by tasks: each level's folders are dealt out,
    listed and written, until a level has none. The driver sees how many folders a level has, no paths."""
    cores = spark.sparkContext.defaultParallelism

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = entries_of(uri, folder, extensions)
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.bool_(), pa.int64()), strict=True)], ["path", "is_folder", "bytes"])

    level, n, files = spark.createDataFrame([("",)], "path string"), 1, []
    while n:
        found = written(level.repartition(min(n, 4 * cores)).mapInArrow(listed, "path string, is_folder boolean, bytes long"), "listed")
        files.append(found.filter("not is_folder").select("path", "bytes"))
        level = found.filter("is_folder").select("path")
        n = level.count()
    return reduce(DataFrame.unionByName, files)


def read_file(uri: str, relative: str, max_bytes: int) -> str:
    """read_text() of a file of the source, at any URI."""
    fs, base = _file_system(uri)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return read_text(Path(base), relative, max_bytes)
    try:
        with fs.open_input_file(f"{base}/{relative}") as file:
            return decoded(file.read(max_bytes + 1), relative, max_bytes)
    except OSError as error:
        raise SourceReadError(f"cannot read {relative}: {error}") from error


def folder(spark: SparkSession, source_id: str, root: str | Path, *, extensions: tuple[str, ...] = EXTENSIONS, max_file_bytes: int = MAX_FILE_BYTES, slice_bytes: int = 16 << 20) -> DataFrame:
    """The documents of a folder that driver and executors share, a path or a URI that pyarrow knows (file, hdfs, s3, gs): (source_id, relative_path, content).

    Files are listed by tasks when this is called, and read in slices of about `slice_bytes` when the table is; a file that can't be read fails the whole read.
    """
    if not source_id.strip():
        raise SourceConfigurationError("source_id must not be blank")
    uri = uri_of(root)
    fs, base = _file_system(uri)
    if fs.get_file_info(base).type != pa.fs.FileType.Directory:
        raise SourceConfigurationError(f"not a folder: {root}")
    if max_file_bytes <= 0 or not extensions:
        raise SourceConfigurationError("max_file_bytes must be positive and extensions not empty")
    files = discovered(spark, uri, tuple(e.lower() for e in extensions))
    n, size = files.agg(F.count("*"), F.coalesce(F.sum(F.least("bytes", F.lit(max_file_bytes)) + 4096), F.lit(0))).first()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([source_id]), pa.array([path_of(path)]), pa.array([read_file(uri, path, max_file_bytes)])], ["source_id", "relative_path", "content"])

    slices = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-size // slice_bytes))))
    # files are bounded, so slices of like numbers are of like size
    return files.repartition(slices).select("path").mapInArrow(read, "source_id string, relative_path string, content string")
