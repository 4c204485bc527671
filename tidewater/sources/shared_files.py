"""Small files and folders by Hadoop's file systems, from the driver."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from tidewater.errors import StoreError


def uri_of(path: str | Path) -> str:
    """A URI as it is; a path on this machine as a file: URI."""
    text = str(path)
    return text.rstrip("/") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", text) else f"file://{Path(text).absolute()}"


class SharedFolder:
    """A folder that all of a cluster sees, by any URI that Spark reads."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.uri, self._jvm, self._gateway = uri_of(path), spark._jvm, spark.sparkContext._gateway
        root = self._path("")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = root.getFileSystem(self._conf)
        self._local = self._fs.getScheme() == "file"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def entries(self, name: str = "") -> list[tuple[str, int]]:
        """(name, time of its last change in ms) of what lies in a folder, by name; nothing if there is none."""
        if not self.exists(name):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(self._path(name)))

    def read(self, name: str) -> str:
        try:
            stream = self._fs.open(self._path(name))
            try:
                return bytes(stream.readAllBytes()).decode("utf-8")
            finally:
                stream.close()
        except Exception as error:
            raise StoreError(f"cannot read {self.uri}/{name}: {error}") from error

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def create(self, name: str, text: str) -> bool:
        """Makes a file with that text, whole or not at all; False if there is one of that name. Of several callers one succeeds.

        The text is written beside it and then moved to where nothing may be: by a hard link on a local or mounted
        disk, else by a rename that does not replace, which the file system must do in one step, as HDFS does.
        """
        new = f"{name}.{uuid.uuid4().hex}.new"
        stream = self._fs.create(self._path(new), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._local:
                local = lambda n: self._path(n).toUri().getPath()
                os.link(local(new), local(name))
            else:
                files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                files.rename(self._path(new), self._path(name), self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Exception as error:
            if "FileAlreadyExistsException" in str(error):
                return False
            raise StoreError(f"cannot create {self.uri}/{name}: {error}") from error
        finally:
            if self._fs.exists(self._path(new)):
                self._fs.delete(self._path(new), False)
