"""Delimited text in and out: LOAD DATA INFILE, SELECT ... INTO OUTFILE and DUMPFILE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load_data(spark: SparkSession, path: str, schema: StructType | str, fields: str = "\t", enclosed: str = "", escaped: str = "\\", lines: str = "\n", skip: int = 0) -> DataFrame:
    r"""LOAD DATA: ``\N`` is NULL; a declared schema, no inference; ``skip`` header lines (0 or 1)."""
    r = spark.read.schema(schema).option("sep", fields).option("lineSep", lines).option("nullValue", "\\N").option("header", bool(skip))
    r = r.option("quote", enclosed or "\u0000").option("escape", escaped).option("mode", "PERMISSIVE")
    return r.csv(path)


def into_outfile(df: DataFrame, path: str, fields: str = "\t", enclosed: str = "", escaped: str = "\\") -> None:
    """A folder of part files, written in parallel."""
    w = df.write.option("sep", fields).option("nullValue", "\\N").option("escape", escaped).option("emptyValue", "")
    (w.option("quote", enclosed or "\u0000").option("quoteAll", bool(enclosed))).csv(path)


def into_variables(df: DataFrame) -> tuple:
    """SELECT ... INTO @a, @b: one row at most."""
    rows = df.take(2)
    if len(rows) > 1:
        raise ValueError("the result has more than one row")
    return tuple(rows[0]) if rows else (None,) * len(df.columns)


def into_dumpfile(df: DataFrame, path: str) -> None:
    """SELECT ... INTO DUMPFILE: one row at most, its values as they are, in one file that isn't there yet."""
    rows = df.take(2)
    if len(rows) > 1:
        raise ValueError("the result has more than one row")
    data = b"".join(bytes(v) if isinstance(v, bytes | bytearray) else str(v).encode() for v in (rows[0] if rows else ()) if v is not None)
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
