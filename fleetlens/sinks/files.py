"""Folder-level steps of table maintenance, by the file system of the path itself.

Only folders (date and batch partitions) are listed, moved and deleted here, never
single data files, and every error rises.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folders:
    """The file system that holds ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return bool(self._fs.exists(self._path(path)))

    def folders(self, path: str, prefix: str = "") -> list[str]:
        """Names of the folders in ``path`` that start with ``prefix``, sorted."""
        if not self.exists(path):
            return []
        found = self._fs.listStatus(self._path(path))
        return sorted(n for s in found if s.isDirectory() and (n := s.getPath().getName()).startswith(prefix))

    def files(self, path: str) -> list[str]:
        """Names of the files in ``path`` (markers and manifests), sorted."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isFile())

    def signature(self, path: str) -> str:
        """Bytes and number of files below ``path``: changes whenever a batch is added or replaced."""
        s = self._fs.getContentSummary(self._path(path))
        return f"{s.getLength()}-{s.getFileCount()}"

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def move(self, source: str, target: str) -> None:
        """Rename (atomic on a distributed file system); the parent of ``target`` is made first."""
        self._fs.mkdirs(self._path(target).getParent())
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"could not move {source} to {target}")

    def claim(self, path: str) -> bool:
        """Create an empty file if nobody else has: whether this call did."""
        try:
            self._fs.create(self._path(path), False).close()
        except Py4JJavaError as e:
            if self.exists(path):
                return False
            raise e
        return True

    def delete(self, path: str) -> None:
        if self.exists(path) and not self._fs.delete(self._path(path), True):
            raise OSError(f"could not delete {path}")

    def write_text(self, path: str, text: str) -> None:
        """A small file, complete or not there: written aside, then moved over the old one."""
        part = f"{path}.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(part))
        out.write(bytearray(text.encode()))
        out.close()
        self.delete(path)
        self.move(part, path)

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
