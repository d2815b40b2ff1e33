"""State that is replaced in one step: data lies in folders that nothing changes, and a numbered pointer to them is renamed into place last."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

#: How long what a pointer no longer names stays, for readers and writers that began before.
GRACE = 24 * 3600.0


class Conflict(Exception):
    """Another writer was faster; nothing of this write is visible."""


class Versions:
    """Versions of one state under ``path``: folders ``data=<id>``, and ``_versions/<number>.json``, of which the highest counts.

    A reader resolves the pointer once and then sees one version to its end. A writer fills a new folder and commits the number after the
    one that it started from; a crash before that leaves the old version as it was, and of two writers one gets a ``Conflict``.
    All paths are Hadoop's, so the state can lie wherever Spark can write.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._store = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, name: str) -> list[tuple[str, float]]:
        """Entries of a folder with their times; none if there is no folder."""
        at = self._at(name)
        return [(i.getPath().getName(), i.getModificationTime() / 1000) for i in self._store.listStatus(at)] if self._store.exists(at) else []

    def _pointers(self) -> list[tuple[int, float]]:
        return sorted((int(n[:-5]), t) for n, t in self._names("_versions") if n.endswith(".json"))

    def _content(self, number: int) -> dict:
        stream = self._store.open(self._at(f"_versions/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self) -> tuple[int, dict]:
        """Number and content of the current version; 0 and nothing before the first one."""
        found = self._pointers()
        return (found[-1][0], self._content(found[-1][0])) if found else (0, {})

    def entries(self, folder: str) -> list[str]:
        return sorted(n for n, _ in self._names(folder))

    def remove(self, folder: str) -> None:
        self._store.delete(self._at(folder), True)

    @staticmethod
    def folder() -> str:
        """The name of a new folder for data."""
        return f"data={uuid.uuid4().hex}"

    def commit(self, after: int, content: dict) -> int:
        """Make ``content`` the version after number ``after``. Folders that it needs are listed in content["folders"]."""
        own, name = self._at(f"_versions/.{uuid.uuid4().hex}.tmp"), self._at(f"_versions/{after + 1:012d}.json")
        out = self._store.create(own)
        try:
            out.write(json.dumps(content, ensure_ascii=False).encode())
        finally:
            out.close()
        kind = getattr(self._fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self._fs.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, name, options)
        except Exception as e:
            self._store.delete(own, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {after + 1} of {self.path} was written meanwhile") from None
            raise
        return after + 1

    def sweep(self, grace: float = GRACE) -> list[str]:
        """Remove versions that were superseded over ``grace`` seconds ago, and folders that no version left names; the folders removed.

        ``grace`` must exceed the longest read and the longest write: a folder in the making isn't named yet.
        """
        limit, pointers = time.time() - grace, self._pointers()
        superseded = {n: t for (n, _), (_, t) in zip(pointers, pointers[1:], strict=False)}
        for n in [n for n, t in superseded.items() if t <= limit]:
            self._store.delete(self._at(f"_versions/{n:012d}.json"), False)
        named = {f for n, _ in self._pointers() for f in self._content(n).get("folders", [])}
        gone = sorted(n for n, t in self._names("") if n.startswith("data=") and n not in named and t <= limit)
        for n in gone:
            self._store.delete(self._at(n), True)
        return gone
