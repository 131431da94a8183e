"""Reading the tables, and tables written between the steps of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.session import ensure_checkpoint_dir


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the number as text, modulo ``parts``; null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


#: Spark's setting to drop the shuffle files of a plan when it has run.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one job in the shared checkpoint folder: they cut the lineage and outlive lost executors. What a
    table was shuffled through is dropped as soon as it is written."""

    def __init__(self, spark: SparkSession, job: str):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/{job}-{uuid.uuid4().hex}"
        self._written = 0

    def write(self, df: DataFrame, *partitions: str) -> DataFrame:
        """Write a table once and read it back."""
        self._written += 1
        path = f"{self.folder}/{self._written}"
        writer = df.write.partitionBy(*partitions) if partitions else df.write
        before = self.spark.conf.get(_DROP_SHUFFLES, "false")
        self.spark.conf.set(_DROP_SHUFFLES, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.set(_DROP_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, buckets: int, column: str) -> DataFrame:
        """Write a table whose rows of one value are in one bucket: grouping by it needs no other shuffle."""
        self._written += 1
        name = f"scratch_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(buckets, column)
        writer.option("path", f"{self.folder}/{self._written}").option("compression", "zstd").format("parquet").saveAsTable(name)
        return self.spark.table(name)


def hashed_share(column: str, salt: int = 0) -> Column:
    """A number in [0, 1) that depends on the id alone: what is below p is a sample of the share p."""
    return F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(salt)), 11) / float(1 << 53)
