"""Keyed state in files: tables dealt into buckets by file; a batch reads and writes only the buckets that it touches.

A manifest for each batch tells the version of every bucket, at most one row per table and bucket. A batch that runs twice
reads the manifest of the batch before and replaces its own version, so what it leaves is the same. Versions that neither of
the last two manifests names are removed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that one bucket of a version is written in, at most.
SPREAD = 8


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class BucketState:
    """Tables (name -> schema, each with file_id) under a folder. Batch -1 is what the state begins with."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str], buckets: int = 64):
        self.spark, self.folder, self.tables, self.buckets = spark, folder, tables, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("file_id"), F.lit(self.buckets)).cast("int")

    def manifest(self, number: int) -> dict[tuple[str, int], int]:
        """(table, bucket) -> version; empty before the first batch."""
        path = f"{self.folder}/manifest-{number}"
        if not exists(self.spark, path):
            return {}
        return {(r.name, r.bucket): r.version for r in self.spark.read.parquet(path).collect()}

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def read(self, name: str, number: int, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table after batch `number`, of all buckets or some."""
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.folder}/{name}-{v}/bucket={b}" for (n, b), v in self.manifest(number).items() if n == name and (wanted is None or b in wanted)]
        return self.spark.read.schema(self.tables[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.tables[name])

    def write(self, number: int, touched: Iterable[int], **tables: DataFrame) -> None:
        """The touched buckets of each table become those of `tables`; other buckets stay as batch number - 1 left them."""
        before, gone = self.manifest(number - 1), set(touched)
        now = {k: v for k, v in before.items() if k[1] not in gone}
        for name, df in tables.items():
            out = f"{self.folder}/{name}-{number}"
            dealt = df.withColumn("bucket", self.bucket()).repartition("bucket", F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD)))
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(out)
            now |= {(name, b): number for b in gone if exists(self.spark, f"{out}/bucket={b}")}
        rows = [(n, b, v) for (n, b), v in now.items()]
        self.spark.createDataFrame(rows, "name string, bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest-{number}")
        older = self.manifest(number - 2)
        for (name, b), v in older.items():
            if before.get((name, b)) != v and now.get((name, b)) != v:
                remove(self.spark, f"{self.folder}/{name}-{v}/bucket={b}")

    def seed(self, **tables: DataFrame) -> None:
        """What the state begins with; a state that is there already stays."""
        if not exists(self.spark, f"{self.folder}/manifest--1"):
            self.write(-1, range(self.buckets), **tables)
