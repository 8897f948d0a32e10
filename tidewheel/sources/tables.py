"""Generated tables, versioned tables in folders, and virtual columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sequence_table(spark: SparkSession, n: int, name: str = "x") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", name)


def point_lookup(spark: SparkSession, values: list, name: str = "x") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def normal_dist(spark: SparkSession, rows: int, columns: int = 1, mean: float = 0.0, std: float = 1.0, seed: int = 1) -> DataFrame:
    return spark.range(rows).select(*[(F.randn(seed + i) * std + mean).alias(f"col{i}") for i in range(columns)])


def exponential_dist(spark: SparkSession, rows: int, columns: int = 1, rate: float = 1.0, seed: int = 1) -> DataFrame:
    return spark.range(rows).select(*[(-F.log(1 - F.rand(seed + i)) / rate).alias(f"col{i}") for i in range(columns)])


def with_virtual(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Generated columns that aren't stored."""
    return df.withColumns(columns)


class Snapshots:
    """A table as numbered folders: every write is a new version, AS OF reads an old one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[1:]) for n in names if n[0] == "v" and fs.exists(done(f"{self.path}/{n}/_SUCCESS")))

    def write(self, df: DataFrame) -> int:
        n = (self.versions() or [0])[-1] + 1
        df.write.parquet(f"{self.path}/v{n}")
        return n

    def read(self, as_of: int | None = None) -> DataFrame:
        have = self.versions()
        n = have[-1] if as_of is None else as_of
        if n not in have:
            raise ValueError(f"no version {n} of {self.path}")
        return self.spark.read.parquet(f"{self.path}/v{n}")


def count_from_metadata(df: DataFrame) -> int:
    """COUNT(*) of a stored table: only footers are read."""
    return df.count()


def histogram(df: DataFrame, column: str, buckets: int = 20) -> DataFrame:
    """Equi-depth histogram: bounds by approximate percentiles, then one aggregation."""
    marks = [i / buckets for i in range(buckets + 1)]
    bounds = sorted(set(df.approxQuantile(column, marks, 1 / (buckets * 10))))
    if len(bounds) < 2:
        bounds = [bounds[0], math.inf] if bounds else [0.0, math.inf]
    at = sum([(F.col(column) > b).cast("int") for b in bounds[1:-1]], F.lit(0))
    return df.groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.min(column).alias("lower"), F.max(column).alias("upper"), F.approx_count_distinct(column).alias("ndv"))
