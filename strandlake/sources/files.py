"""Small files on any file system that Spark reads: manifests and locks, through Hadoop's own interface."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def make(self) -> None:
        self._fs.mkdirs(self._path(""))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))

    def claim(self, name: str) -> bool:
        """Creates a file that must not be there; false if it is."""
        try:
            self._fs.create(self._path(name), False).close()
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def write(self, name: str, content: dict) -> None:
        """Appears whole or not at all."""
        begun = self._path(f".{name}.begun")
        out = self._fs.create(begun, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not self._fs.rename(begun, self._path(name)):
            raise OSError(f"{name} could not be written")

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(name), True)
