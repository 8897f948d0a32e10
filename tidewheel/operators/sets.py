"""Set operations, distinct, and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    out = a.union(b)
    return out.distinct() if distinct else out


def intersect(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    return a.intersect(b) if distinct else a.intersectAll(b)


def except_(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    return a.distinct().subtract(b.distinct()) if distinct else a.exceptAll(b)


def concat(key: list[str], *parts: DataFrame) -> DataFrame:
    """Rows of several lookups, each key once."""
    return reduce(lambda x, y: x.unionByName(y), parts).dropDuplicates(key)


def top_n(df: DataFrame, n: int, *order: Column, offset: int = 0) -> DataFrame:
    """Sort with limit (and offset): a bounded heap a task, not a full sort."""
    out = df.orderBy(*order)
    return out.offset(offset).limit(n) if offset else out.limit(n)


def limit_found_rows(df: DataFrame, n: int) -> tuple[DataFrame, int]:
    """LIMIT with SQL_CALC_FOUND_ROWS."""
    return df.limit(n), df.count()


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key, by partial aggregation instead of a window."""
    order_struct = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order_struct).alias("_r")).select("_r.*")


class TooManyRows(ValueError):
    """A scalar subquery gave more than one row."""


def max_one_row(df: DataFrame):
    """The value of a scalar subquery, NULL without a row."""
    rows = df.take(2)
    if len(rows) > 1:
        raise TooManyRows("subquery returned more than 1 row")
    return rows[0][0] if rows else None
