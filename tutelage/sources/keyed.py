"""A table kept up to date by batches: rows in buckets by a hash of their key, copied on write.

A batch rewrites the buckets that its keys fall into and leaves all others alone.  Each rewrite is
a folder of its own, ``v=<batch>/bucket=<b>``; a bucket's content is its newest folder.  Nothing
that a reader may be using is overwritten, and a batch that runs again after a failure reads the
versions before its own and replaces just the folder it had begun.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"
#: Superseded versions of a bucket that stay, for readers that began before.
KEPT_VERSIONS = 1


class KeyedTable:
    """Rows under ``path``; all rows of one ``keys`` value share a bucket."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 32) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def bucket(self) -> Column:
        """A row's bucket; nulls in a key have one like other values."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def versions(self) -> dict[int, list[int]]:
        """Versions of each bucket, oldest first; names of folders only."""
        system, glob = self._files(f"{self.path}/v=*/{BUCKET}=*")
        found: dict[int, list[int]] = {}
        for status in system.globStatus(glob) or ():
            version, bucket = (part.split("=")[1] for part in status.getPath().toString().split("/")[-2:])
            found.setdefault(int(bucket), []).append(int(version))
        return {b: sorted(v) for b, v in found.items()}

    def folders(self, before: int | None = None, buckets: Sequence[int] | None = None) -> list[str]:
        """Folders with the current rows (as of the batches ``before`` one) of some or all buckets."""
        out = []
        for b, found in sorted(self.versions().items()):
            wanted = [v for v in found if before is None or v < before]
            if wanted and (buckets is None or b in buckets):
                out.append(f"{self.path}/v={wanted[-1]}/{BUCKET}={b}")
        return out

    def read(self, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        folders = self.folders(before, buckets)
        return self.spark.read.parquet(*folders) if folders else None

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of a batch's rows: at most as many numbers as there are buckets."""
        return [r[0] for r in batch.select(self.bucket()).distinct().collect()]

    def upsert(self, batch: DataFrame, number: int, identity: Sequence[str]) -> list[int]:
        """Put in a batch's rows, which replace those of the same ``identity`` (``keys`` or more columns).

        Batches are numbered in ascending order.  ``batch`` must give the same rows each time it is
        read.  Returns the buckets that were written.
        """
        buckets = self.touched(batch)
        if not buckets:
            return []
        rows, old = batch, self.read(number, buckets)
        if old is not None:
            rows = without(old, batch, identity).select(*batch.columns).unionByName(batch)
        # a large bucket is written by several tasks
        rows.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(
            BUCKET).parquet(f"{self.path}/v={number}")
        self._tidy(buckets)
        return buckets

    def _tidy(self, buckets: Sequence[int]) -> None:
        found = self.versions()
        for b in buckets:
            for v in found.get(b, [])[:-1 - KEPT_VERSIONS]:
                system, path = self._files(f"{self.path}/v={v}/{BUCKET}={b}")
                system.delete(path, True)


def without(old: DataFrame, batch: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Rows of ``old`` whose identity, nulls included, no row of ``batch`` has."""
    named = batch.select(*(F.col(c).alias(f"_n{i}") for i, c in enumerate(identity)))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_n{i}")) for i, c in enumerate(identity)))
    return old.join(named, same, "left_anti")
