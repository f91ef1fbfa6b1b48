"""Tables that are changed in place by key: only the buckets that a change touches are rewritten, and a change is seen whole or not at all.

A table is a folder with Parquet files in one folder per change and bucket (of a hash of the key), and numbered manifests that say
which folders hold each bucket. A change reads the touched buckets, works on them as DataFrames, writes them to new folders, and
commits by creating the next manifest, which fails if another change was faster. Until then readers see the version before; a
change that dies on its way leaves folders that no manifest names (``vacuum`` removes them). Nothing is overwritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.operators import updates


class VersionConflict(Exception):
    """Another change was committed first; nothing of this one is seen. Run it again."""


class BucketTable:
    """A table under ``folder`` by ``key``; see ``create`` for a new one. ``version`` is the last committed one when it was opened."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.refresh()

    @classmethod
    def create(cls, rows: DataFrame, folder: str, key: list[str], buckets: int) -> BucketTable:
        """A new table with ``rows``. Buckets of some hundred MB are a good size."""
        spark = rows.sparkSession
        empty = {"key": key, "buckets": buckets, "schema": rows.schema.json(), "folders": {}}
        _write_new(spark, f"{folder.rstrip('/')}/manifest-{0:012d}.json", empty)
        table = cls(spark, folder)
        table._commit(rows, range(buckets))
        return table

    def refresh(self) -> None:
        found = self._files.globStatus(self._path(f"{self.folder}/manifest-*.json"))
        if not found:
            raise FileNotFoundError(f"no table in {self.folder}")
        last = max(str(x.getPath().getName()) for x in found)
        self.version = int(last.removeprefix("manifest-").removesuffix(".json"))
        text = self.spark.read.option("wholetext", True).text(f"{self.folder}/{last}").first()[0]
        self.manifest = json.loads(text)

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.manifest["schema"]))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.manifest["key"]), F.lit(self.manifest["buckets"])).cast("int")

    def read(self, buckets=None) -> DataFrame:
        """The rows of the opened version (of some buckets)."""
        folders = self.manifest["folders"]
        paths = [folders[k] for k in sorted(folders, key=int) if buckets is None or int(k) in buckets]
        schema = self.schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, rows: DataFrame, touched) -> None:
        """Writes the new rows of the touched buckets, then the next manifest."""
        change = f"{self.folder}/change-{uuid.uuid4().hex}"
        columns = rows.columns
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").select(*columns, "_bucket").write.partitionBy("_bucket").parquet(change)
        written = {str(x.getPath().getName()).removeprefix("_bucket=") for x in self._files.globStatus(self._path(f"{change}/_bucket=*")) or []}
        kept = {k: v for k, v in self.manifest["folders"].items() if int(k) not in set(touched)}
        after = self.manifest | {"folders": kept | {k: f"{change}/_bucket={k}" for k in written}}
        _write_new(self.spark, f"{self.folder}/manifest-{self.version + 1:012d}.json", after)
        self.version, self.manifest = self.version + 1, after

    def change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replaces the rows of the buckets that ``keys`` fall into by ``make`` of them; returns the buckets."""
        touched = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())
        if touched:
            self._commit(make(self.read(set(touched))).select(self.schema.names), touched)
        return touched

    def upsert(self, rows: DataFrame, keep: list[str] | None = None) -> list[int]:
        return self.change(rows, lambda old: updates.upsert(old, rows, self.manifest["key"], keep))

    def insert_new(self, rows: DataFrame) -> list[int]:
        return self.change(rows, lambda old: updates.insert_new(old, rows, self.manifest["key"]))

    def delete(self, keys: DataFrame) -> list[int]:
        return self.change(keys, lambda old: updates.delete_keys(old, keys, self.manifest["key"]))

    def replace_groups(self, rows: DataFrame, groups: DataFrame) -> list[int]:
        """For tables whose key is the group: all rows of ``groups`` give way to ``rows``."""
        (key,) = self.manifest["key"]
        return self.change(groups, lambda old: updates.replace_groups(old, rows, groups, key))

    def vacuum(self) -> int:
        """Removes older manifests and the folders that the last version doesn't name; only while nobody reads older versions or
        changes the table. Returns the number of folders removed."""
        self.refresh()
        named, gone = set(self.manifest["folders"].values()), 0
        for x in self._files.globStatus(self._path(f"{self.folder}/change-*")) or []:
            place = f"{self.folder}/{x.getPath().getName()}"
            inside = [f"{place}/{y.getPath().getName()}" for y in self._files.listStatus(x.getPath()) if y.isDirectory()]
            for old in [p for p in inside if p not in named] if any(p in named for p in inside) else [place]:
                gone += bool(self._files.delete(self._path(old), True))
        for x in self._files.globStatus(self._path(f"{self.folder}/manifest-*.json")):
            if str(x.getPath().getName()) != f"manifest-{self.version:012d}.json":
                self._files.delete(x.getPath(), False)
        return gone


def _write_new(spark: SparkSession, place: str, content: dict) -> None:
    """A file that must not exist yet: written aside, then moved, which fails where there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files, aside = path(place).getFileSystem(spark._jsc.hadoopConfiguration()), path(f"{place}.{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if files.exists(path(place)) or not files.rename(aside, path(place)):
        files.delete(aside, False)
        raise VersionConflict(place)
