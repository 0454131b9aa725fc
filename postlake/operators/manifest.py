"""Versions of a folder of tables: the newest small file says which data files are current.

Data is written to folders of new names first; then one file with the next number names them. The file appears whole
or not at all and never replaces another, so a reader sees all tables of a commit or none, and a writer that comes
second repeats its change on the newer version.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

State = dict

#: Old versions that stay for readers that have started.
KEPT = 20


class Manifest:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        folder = self._path(f"{base.rstrip('/')}/_versions")
        self._fs = folder.getFileSystem(conf)
        self.folder = self._fs.makeQualified(folder)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), conf)

    def versions(self) -> list[int]:
        if not self._fs.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self.folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def _file(self, version: int):
        return self._path(self.folder, f"{version:020d}.json")

    def read(self) -> tuple[int, State]:
        """Number and contents of the newest version; 0 and nothing before the first."""
        found = self.versions()
        if not found:
            return 0, {}
        stream = self._fs.open(self._file(found[-1]))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return found[-1], json.loads(text)

    def commit(self, change: Callable[[State], State | None]) -> State:
        """Publish the changed state; a change that returns None publishes nothing."""
        while True:
            version, state = self.read()
            new = change(state)
            if new is None:
                return state
            if self._published(version + 1, new):
                for old in self.versions()[:-KEPT]:
                    self._fs.delete(self._file(old), False)
                return new

    def _published(self, version: int, state: State) -> bool:
        """Write aside, then rename without replacing; False if another writer has this number."""
        jvm = self.spark._jvm
        aside = self._path(self.folder, f"_{jvm.java.util.UUID.randomUUID()}")
        self._fs.mkdirs(self.folder)
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        kinds = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        try:
            self._context.rename(aside, self._file(version), options)
        except Py4JJavaError as error:
            self._fs.delete(aside, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True
