"""Tables in versions, switched in by one rename.

A root folder holds ``versions/<n>-<id>/<table>`` (Parquet) and ``manifests/<n>`` (the name of a version). Readers take
the highest manifest. A run writes its version first and then renames its manifest into place, which fails if another
run took the number; a run that is lost before that leaves a folder that no manifest names.
"""

from __future__ import annotations

import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Tables of ``schemas`` below ``root``, which all executors share."""

    schemas: ClassVar[dict[str, str]] = {}

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda *parts: hadoop.Path("/".join((root, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = hadoop.FileContext.getFileContext(self._path().toUri(), spark._jsc.hadoopConfiguration()) if "://" in root else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())

    def manifests(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def version(self) -> tuple[int, str | None]:
        """Number and folder of the version that stands; (0, None) before the first one."""
        numbers = self.manifests()
        if not numbers:
            return 0, None
        text = self.spark.read.text(f"{self.root}/manifests/{numbers[-1]:012d}").first()[0]
        return numbers[-1], text

    def read(self, table: str, version: str | None = None) -> DataFrame:
        """A table of a version, by default the one that stands; empty before the first one."""
        version = version or self.version()[1]
        if version is None:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.root}/versions/{version}/{table}")

    def write(self, version: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.to(self.spark.createDataFrame([], self.schemas[name]).schema).write.parquet(f"{self.root}/versions/{version}/{name}")

    def switch(self, number: int, version: str) -> None:
        """Name the version in manifest ``number``; FileAlreadyExistsException if another run has it."""
        draft, place = self._path("drafts", uuid.uuid4().hex), self._path("manifests", f"{number:012d}")
        self._fs.mkdirs(self._path("manifests"))
        out = self._fs.create(draft, True)
        out.write(bytearray(version.encode()))
        out.close()
        self._context.rename(draft, place, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def fresh(self, number: int) -> str:
        """The name of a folder for a version that has none yet."""
        return f"{number:012d}-{uuid.uuid4().hex[:8]}"

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions but the last ``keep`` that manifests name, and leftovers of lost runs; returns their number.

        Not while another run writes: its folder has no manifest yet.
        """
        numbers = self.manifests()
        if not numbers:
            return 0
        named = {self.spark.read.text(f"{self.root}/manifests/{n:012d}").first()[0] for n in numbers[-keep:]}
        gone = [s.getPath() for s in self._fs.listStatus(self._path("versions")) if s.getPath().getName() not in named]
        for path in gone:
            self._fs.delete(path, True)
        for n in numbers[:-keep]:
            self._fs.delete(self._path("manifests", f"{n:012d}"), False)
        return len(gone)
