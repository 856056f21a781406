"""Versioned snapshots of catalog tables in parquet; a version is visible once it is complete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class SnapshotStore:
    """Tables in ``root/data-<unique>/table``; the marker ``done=N`` names the folder of version N.

    A writer fills a folder of its own and claims the marker last, exclusively: of two
    writers of one version one fails, and neither can touch the other's files.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _markers(self) -> dict[int, str]:
        if not self._fs.exists(self._path(self.root)):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return {int(n[5:].split("=")[0]): n for n in names if n.startswith("done=")}

    def version(self) -> int:
        """The last complete version; 0 if there is none."""
        return max(self._markers(), default=0)

    def _folder(self, version: int) -> str:
        stream = self._fs.open(self._path(f"{self.root}/done={version}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._folder(version or self.version())}/{name}")

    def has(self, name: str, version: int) -> bool:
        return bool(version) and self._fs.exists(self._path(f"{self.root}/{self._folder(version)}/{name}"))

    def commit(self, tables: dict[str, DataFrame], expected: int) -> int:
        """Write all tables as the next version, unless another writer was faster."""
        if self.version() != expected:
            raise RuntimeError(f"the catalog moved on from version {expected}")
        new, folder = expected + 1, f"data-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        try:
            stream = self._fs.create(self._path(f"{self.root}/done={new}"), False)
        except Exception as e:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise RuntimeError(f"version {new} was written by another run") from e
        stream.writeUTF(folder)
        stream.close()
        return new
