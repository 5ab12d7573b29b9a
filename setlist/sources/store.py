"""A store of rows by fingerprint that is updated in part and never seen half written.

Rows lie in buckets by a hash of their key. A merge reads and writes the buckets that its rows fall into, into a folder of its
own, and then names the folder of each bucket in a new version. A version counts once it is written whole (Spark's _SUCCESS is
the last file of a folder), so readers see the version before or the one after, and what a failed merge leaves is never read.
Two merges that begin from one version can't both end: the second one finds its version there and fails.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setlist.operators.stage import staged

BUCKETS = 64
KEY = ["cache_version", "source", "fingerprint"]
VERSION = "bucket int, folder string"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


class Store:
    """The store at `path`, in any file system that Spark knows. Rows have KEY and other columns."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _files(self, folder: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The whole versions, the last one last."""
        where, files = self._files(f"{self.path}/versions")
        if not files.exists(where):
            return []
        whole = lambda s: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()) for s in files.listStatus(where) if s.isDirectory() and whole(s))

    def folders(self, version: int | None = None) -> dict[int, str]:
        """bucket: folder, `buckets` of them at most; of the last version unless another is asked for."""
        known = self.versions()
        if not known:
            return {}
        rows = self.spark.read.schema(VERSION).parquet(f"{self.path}/versions/{known[-1] if version is None else version}").collect()
        return {r.bucket: r.folder for r in rows}

    def _rows(self, folders: dict[int, str]) -> DataFrame | None:
        """The rows of some buckets; none if there are no buckets."""
        paths = [f"{self.path}/data/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def read(self, cache_version: str, source: str) -> DataFrame | None:
        """The rows of a version of the cache and a source; None of a store that has none at all."""
        rows = self._rows(self.folders())
        return rows if rows is None else rows.where((F.col("cache_version") == cache_version) & (F.col("source") == source))

    def touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(_bucket(self.buckets).alias("bucket")).distinct().collect()]

    def split(self, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Inputs (with KEY) that are stored, and those to work on; only their buckets are looked at."""
        folders = self.folders()
        rows = self._rows({b: folders[b] for b in self.touched(inputs) if b in folders})
        if rows is None:
            return inputs.limit(0), inputs
        known = rows.select(*KEY).distinct()
        return inputs.join(known, KEY, "left_semi"), inputs.join(known, KEY, "left_anti")

    def merge(self, rows: DataFrame) -> int:
        """Puts rows in place of all those with their keys; the new version. Buckets that none of them falls into are kept as they are."""
        known, folders, rows = self.versions(), self.folders(), staged(rows)
        version = known[-1] + 1 if known else 1
        touched = self.touched(rows)
        old = self._rows({b: folders[b] for b in touched if b in folders})
        parts = [rows] if old is None else [old.join(rows.select(*KEY).distinct(), KEY, "left_anti"), rows]
        new = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).withColumn("bucket", _bucket(self.buckets))
        folder = f"{version}-{self.spark.sql('select uuid()').first()[0]}"
        # A bucket may be most of what is written: it goes to as many tasks as its rows fill.
        new.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        self._switch(version, folders | dict.fromkeys(touched, folder))
        return version

    def _switch(self, version: int, folders: dict[int, str]) -> None:
        self.spark.createDataFrame(list(folders.items()), VERSION).coalesce(1).write.parquet(f"{self.path}/versions/{version}")

    def clean(self, keep: int = 2) -> list[str]:
        """Removes all but the last versions, and the folders that none of these names, those of failed merges too; not while one runs."""
        known = self.versions()[-keep:]
        named = {f for v in known for f in self.folders(v).values()}
        gone = []
        for kind, stay in (("versions", {str(v) for v in known}), ("data", named)):
            where, files = self._files(f"{self.path}/{kind}")
            for s in files.listStatus(where) if files.exists(where) else []:
                if s.getPath().getName() not in stay:
                    files.delete(s.getPath(), True)
                    gone.append(s.getPath().getName())
        return gone
