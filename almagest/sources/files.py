"""Small files on whatever file system a path names, by the driver's Hadoop client."""

from __future__ import annotations

import contextlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, none if it is missing."""
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))] if self.exists(folder) else []

    def read(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _write(self, name: str, data: bytes, overwrite: bool) -> None:
        stream = self.fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def claim(self, name: str) -> bool:
        """Make an empty file; False if it is there already, whoever made it."""
        with contextlib.suppress(Py4JJavaError):
            self._write(name, b"", overwrite=False)
            return True
        if not self.exists(name):
            raise OSError(f"cannot write {self.at(name)}")
        return False

    def put(self, name: str, data: bytes) -> None:
        """Write a file under another name and then move it over: a torn write never shows."""
        folder, _, last = name.rpartition("/")
        part = f"{folder}/.{last}.part" if folder else f".{last}.part"
        self._write(part, data, overwrite=True)
        if self.exists(name):
            self.fs.delete(self._path(name), False)
        if not self.fs.rename(self._path(part), self._path(name)):
            raise OSError(f"cannot write {self.at(name)}")

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
