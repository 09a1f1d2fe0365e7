"""Numbered versions of a table's state: small JSON files of which each is written once, whole or not at all."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class Folder:
    """``version-<number>.json`` files of a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> dict[str, float]:
        """What is in a folder, by name, with the time of its last change; nothing if there is no folder."""
        if not self._fs.exists(self._at(folder)):
            return {}
        found = {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._fs.listStatus(self._at(folder))}
        return dict(sorted(found.items()))

    def delete(self, path: str) -> None:
        self._fs.delete(self._at(path), True)

    def file(self, number: int) -> str:
        return f"{self.path}/version-{number:012d}.json"

    def numbers(self) -> list[int]:
        """All versions that are there, in order."""
        return sorted(int(n[8:-5]) for n in self.names(self.path) if n.startswith("version-") and n.endswith(".json"))

    def latest(self) -> tuple[int, dict | None]:
        """Number and content of the last version; ``0, None`` before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._at(self.file(number)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, number: int, content: dict) -> bool:
        """Make ``content`` version ``number``; False if another writer has taken that number.

        The file is written under a name of its own and then gets its number in one step that fails if
        the number is taken: a hard link on a local disk, a rename elsewhere.
        """
        self._fs.mkdirs(self._at(self.path))
        part = f"{self.path}/.{uuid.uuid4().hex}.part"
        stream = self._fs.create(self._at(part))
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        if self._fs.getScheme() == "file":
            try:
                os.link(urlparse(part).path, urlparse(self.file(number)).path)
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(urlparse(part).path)
        to = self._at(self.file(number))
        done = not self._fs.exists(to) and self._fs.rename(self._at(part), to)
        if not done:
            self.delete(part)
        return bool(done)
