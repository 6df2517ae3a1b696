"""Tables that a stream keeps by ``foreachBatch``: parts are replaced whole, under the number of their batch.

A part (a floor, or a bucket of keys) is read at its latest version below the running batch, so a batch
that runs again after a failure reads what it read before and writes the same. Versions that a
committed later batch has replaced are deleted. Each batch reads and writes only the parts that it touches.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class PartTable:
    """Rows of ``schema`` with a string column ``part``, one folder per batch and part below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = StructType.fromDDL(schema)

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _numbers(self) -> list[int]:
        """Committed batches: their list of parts is written last."""
        fs, top = self._fs(), self._path("parts")
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top)]
        return sorted(int(p.getName()) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def versions(self, before: int | None = None) -> dict[str, int]:
        """The batch that holds each part's rows; bounded by the number of parts."""
        numbers = [n for n in self._numbers() if before is None or n < before]
        if not numbers:
            return {}
        paths = [f"{self.folder}/parts/{n}" for n in numbers]
        rows = self.spark.read.schema("part string, number long").parquet(*paths)
        return {r.part: r.number for r in rows.groupBy("part").agg(F.max("number").alias("number")).collect()}

    def read(self, parts: Iterable[str] | None = None, before: int | None = None) -> DataFrame:
        """The rows of the given parts (of all), as they were before a batch."""
        known, fs = self.versions(before), self._fs()
        wanted = known if parts is None else {p: known[p] for p in parts if p in known}
        paths: list[str] = []
        for part, number in wanted.items():
            name = self._escaped(part)
            if fs.exists(self._path(f"rows/{number}/part={name}")):
                paths.append(f"{self.folder}/rows/{number}/part={name}")
        full = StructType([*self.schema.fields])
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(*paths)

    def _escaped(self, part: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(part)

    def replace(self, rows: DataFrame, part: Column, parts: list[str], number: int) -> None:
        """Make ``rows`` the content of ``parts``; a part without rows becomes empty."""
        self.tidy(number)
        names = self.schema.names
        rows.select(*names, part.cast("string").alias("part")).write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/rows/{number}")
        listed = self.spark.createDataFrame([(p, number) for p in parts], "part string, number long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/parts/{number}")

    def tidy(self, number: int) -> None:
        """Delete batches whose parts have all been replaced by batches below ``number``."""
        live = set(self.versions(number).values())
        fs = self._fs()
        for old in self._numbers():
            if old < number and old not in live:
                fs.delete(self._path(f"parts/{old}"), True)
                fs.delete(self._path(f"rows/{old}"), True)


def merge_last(table: PartTable, changes: DataFrame, part: Column, keys: list[str], order: list[str], number: int, keep: Column | None = None) -> list[str]:
    """Keep the last row per key (by ``order``) of what a table has and of ``changes``; returns the touched parts.

    The result does not depend on how often or in which order batches bring a row. ``keep`` drops
    rows that have outlived their use from the touched parts.
    """
    changes = changes.select(*table.schema.names)
    parts = [r.part for r in changes.select(part.cast("string").alias("part")).distinct().collect()]
    held = table.read(parts, before=number).unionByName(changes)
    last = held.groupBy(*keys).agg(F.max_by(F.struct(*table.schema.names), F.struct(*order)).alias("last")).select("last.*")
    table.replace(last if keep is None else last.filter(keep), part, parts, number)
    return parts
