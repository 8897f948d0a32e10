"""Session settings that the dialect's semantics need, and the table loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Division by zero and failed casts give NULL, times are zone-less in UTC, the last duplicate key of an object wins.
SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(master: str | None = None, **extra: str) -> SparkSession:
    b = SparkSession.builder.appName("tidewheel")
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | extra).items():
        b = b.config(k, v)
    return b.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the dialect's settings to a session that exists."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple = TABLES) -> SparkSession:
    """Each table as a temporary view; schemas come from the files' footers."""
    prepare(spark)
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark
