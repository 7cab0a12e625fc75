"""Snapshots of a table: a new version becomes readable whole, by one rename, or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """Versions of a table in ``folder``, on any store that Spark writes to.

    A version is written to a folder of its own first. Then a file with that
    folder's name is created beside the manifests and renamed to the next
    number; a rename onto an existing number fails, so of two writers one
    publishes and the other one's data is never seen. Old versions stay readable.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, jvm = spark, folder.rstrip("/"), spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(f"{self.folder}/manifests"))

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self.fs.listStatus(self.path(f"{self.folder}/manifests"))]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version, or a given one; None if nothing was published."""
        found = self.versions()
        if not found:
            return None
        place = self.spark.read.text(f"{self.folder}/manifests/{found[-1] if version is None else version}").first()[0]
        return self.spark.read.parquet(f"{self.folder}/{place}")

    def publish(self, df: DataFrame) -> int:
        """Writes ``df`` and makes it the newest version, whose number is returned."""
        place = f"data-{self.spark._jvm.java.util.UUID.randomUUID()}"
        df.write.parquet(f"{self.folder}/{place}")
        number = (self.versions() or [0])[-1] + 1
        staged = self.path(f"{self.folder}/manifests/{place}")
        out = self.fs.create(staged)
        out.write(bytearray(f"{place}\n".encode()))
        out.close()
        target = self.path(f"{self.folder}/manifests/{number}")
        if self.fs.exists(target) or not self.fs.rename(staged, target):
            self.fs.delete(staged, False)
            raise RuntimeError(f"version {number} was published by another writer")
        return number
