"""Files and folders of a release on any store that Hadoop reaches: local disks, HDFS, object stores."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


class Store:
    """Names below a root folder. A root without a scheme is a folder of the local file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = (root if "://" in root or root.startswith("file:") else Path(root).resolve().as_uri()).rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def place(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.place(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        """What lies in a folder, by name; nothing if it isn't there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def marks(self, name: str) -> list[tuple[str, int, int]]:
        """(name, bytes, time of change) of a file, or of each file in a folder, by name."""
        found = self._fs.listStatus(self._path(name))
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found)

    def write_new(self, name: str, content: bytes) -> None:
        """A file that must not be there yet: of several writers one succeeds, the others get a FileExistsError."""
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise FileExistsError(self.place(name)) from e
            raise
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def move(self, old: str, new: str) -> None:
        """A folder to a place that must not be there yet."""
        if self.exists(new) or not self._fs.rename(self._path(old), self._path(new)):
            raise FileExistsError(self.place(new))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
