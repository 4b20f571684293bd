"""Files and atomically numbered versions on any Hadoop file system."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    """A folder seen through Spark's file system, so that the driver needs no mount of its own."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        where = self._path(self.at(folder))
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if it is there already. The text is written aside and moved, so no reader sees half of it."""
        if self._fs.exists(self._path(self.at(name))):
            return False
        claim = self._path(self.at(name + ".claim"))
        try:
            self._fs.mkdirs(claim.getParent())
            self._fs.create(claim, False).close()  # of two writers one gets it
        except Exception:
            return False
        aside = self._path(self.at(name + ".new"))
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        return bool(self._fs.rename(aside, self._path(self.at(name))))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        for x in (name, name + ".claim", name + ".new"):
            self._fs.delete(self._path(self.at(x)), True)


class Versions:
    """Numbered JSON documents in a folder; the largest number is the current one."""

    def __init__(self, files: Files, folder: str) -> None:
        self.files, self.folder = files, folder

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(self.folder) if n.isdigit())

    def read(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/{number}"))

    def commit(self, number: int, content: dict) -> bool:
        return self.files.create(f"{self.folder}/{number}", json.dumps(content))

    def drop(self, number: int) -> None:
        self.files.delete(f"{self.folder}/{number}")
