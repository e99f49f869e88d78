"""Snapshots in bucketed tables: changes are appended to the buckets they meet, and nothing stored is moved to read the newest rows.

A table is bucketed by its keys, so all versions of a row lie in one bucket. Taking
rows exchanges only them and adds a file to each bucket that they fall in; the
newest row per key, and joins by the keys, need no exchange of the table. A
batch that is taken twice changes nothing, as equal rows are one. ``compact``
rewrites the table to one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; a bucket should fit a task.
BUCKETS = 32


class BucketedSnapshot:
    """The newest row per ``keys`` by ``order``, in the table ``name`` at ``path``. Rows without a key take no part."""

    def __init__(self, spark: SparkSession, name: str, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.keys, self.order, self.buckets = spark, name, path.rstrip("/"), keys, order, buckets

    def _write(self, rows: DataFrame, name: str, path: str) -> None:
        dealt = rows.repartition(self.buckets, *self.keys).sortWithinPartitions(*self.keys)
        dealt.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).format("parquet").option("path", path).mode("append").saveAsTable(name)

    def _exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def take(self, rows: DataFrame) -> None:
        """Add the newest rows of ``rows``; columns that the table has and they lack are null, others must agree."""
        for k in self.keys:
            rows = rows.filter(F.col(k).isNotNull())
        new = self._newest(rows)
        if self._exists():
            have = self.table().schema
            new = new.select(*[F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in have])
        self._write(new, self.name, self.path)

    def table(self) -> DataFrame:
        """All versions, bucketed."""
        self.spark.catalog.refreshTable(self.name)  # a stream's batches are written from sessions of their own
        return self.spark.table(self.name)

    def snapshot(self) -> DataFrame:
        """The newest row per key, without an exchange."""
        return self._newest(self.table())

    def _newest(self, rows: DataFrame) -> DataFrame:
        """Of rows that agree in ``order`` the largest by their values."""
        rest = [c for c in rows.columns if c not in self.keys]
        rank = F.struct(*self.order, *[c for c in rest if c not in self.order])
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
        return best.select(*[F.col(c) if c in self.keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])

    def compact(self, path: str) -> BucketedSnapshot:
        """A new table of one row per key at ``path``, again without an exchange of the old one; the old table stays until it is dropped."""
        new = BucketedSnapshot(self.spark, f"{self.name}_c", path, self.keys, self.order, self.buckets)
        rows = self.snapshot()
        rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).format("parquet").option("path", path).saveAsTable(new.name)
        return new

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
