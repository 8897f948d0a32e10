"""Aggregate functions with the dialect's rules; each gives a Column for ``agg`` or ``over``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL_ONES = 18446744073709551615


def sum_(x: Column, distinct: bool = False) -> Column:
    """DOUBLE, whatever the input."""
    x = x.cast("double")
    return F.sum_distinct(x) if distinct else F.sum(x)


def sum_exact(x: Column) -> Column:
    """Decimal input keeps its decimals."""
    return F.sum(x)


def avg(x: Column, distinct: bool = False) -> Column:
    return F.call_function("avg", x) if not distinct else F.sum_distinct(x.cast("double")) / F.count_distinct(x)


def count(*xs: Column, distinct: bool = False) -> Column:
    """COUNT(*), COUNT(x), COUNT(DISTINCT a, b): a row counts if no argument is NULL."""
    if not xs:
        return F.count(F.lit(1))
    return F.count_distinct(*xs) if distinct else F.count(xs[0])


def bit_and(x: Column) -> Column:
    """All ones for no rows."""
    from .numeric import unsigned

    return F.coalesce(unsigned(F.bit_and(x.cast("long"))), F.lit(str(ALL_ONES)).cast("decimal(20,0)"))


def bit_or(x: Column) -> Column:
    from .numeric import unsigned

    return F.coalesce(unsigned(F.bit_or(x.cast("long"))), F.lit(0).cast("decimal(20,0)"))


def bit_xor(x: Column) -> Column:
    from .numeric import unsigned

    return F.coalesce(unsigned(F.bit_xor(x.cast("long"))), F.lit(0).cast("decimal(20,0)"))


def first(x: Column, order: Column) -> Column:
    """The value of the first row, NULL if it is NULL there."""
    return F.min_by(x, order)


def last(x: Column, order: Column) -> Column:
    return F.max_by(x, order)


def any_value(x: Column) -> Column:
    return F.any_value(x)


def std(x: Column) -> Column:
    """Of the population, as STD, STDDEV and STDDEV_POP are."""
    return F.stddev_pop(x)


def variance(x: Column) -> Column:
    return F.var_pop(x)


def group_concat(x: Column, order: list[tuple[Column, bool]] | None = None, sep: str = ",", distinct: bool = False, max_len: int = 1024) -> Column:
    """NULLs and empty strings are skipped; ``order``: (key, ascending); the result is cut to ``max_len`` characters."""
    s = x.cast("string")
    keep = s.isNotNull() & (s != "")
    if distinct:
        items = F.array_sort(F.collect_set(F.when(keep, s)))
        if order and not order[0][1]:
            items = F.reverse(items)
        return F.left(F.when(F.size(items) > 0, F.array_join(items, sep)), F.lit(max_len))
    keys = [k.alias(f"k{i}") for i, (k, _) in enumerate(order or [])]
    rows = F.collect_list(F.when(keep, F.struct(*keys, s.alias("s"))))

    def before(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, (_, up) in reversed(list(enumerate(order or []))):
            x, y = a[f"k{i}"], b[f"k{i}"]
            less, more = (-1, 1) if up else (1, -1)
            out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), less).when(y.isNull(), more).when(x < y, less).when(x > y, more).otherwise(out)
        return out

    if order:
        rows = F.array_sort(rows, before)
    return F.left(F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: r["s"]), sep)), F.lit(max_len))


def json_arrayagg(x: Column) -> Column:
    """NULLs are kept."""
    cells = F.transform(F.collect_list(F.struct(x.alias("v"))), lambda r: F.coalesce(F.regexp_extract(F.to_json(F.struct(r["v"].alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit("")))
    return F.concat(F.lit("["), F.array_join(F.transform(cells, lambda c: F.when(c == "", "null").otherwise(c)), ", "), F.lit("]"))


def json_objectagg(k: Column, v: Column) -> Column:
    """The last of equal keys wins."""
    return F.to_json(F.map_from_entries(F.collect_list(F.struct(k.cast("string").alias("k"), v.alias("v")))))


AGGREGATES = {
    "any_value": any_value, "avg": avg, "bit_and": bit_and, "bit_or": bit_or, "bit_xor": bit_xor, "count": count, "first": first, "group_concat": group_concat,
    "json_arrayagg": json_arrayagg, "json_objectagg": json_objectagg, "last": last, "max": F.max, "min": F.min, "std": std, "stddev": std, "stddev_pop": std,
    "stddev_samp": F.stddev_samp, "sum": sum_, "var_pop": F.var_pop, "var_samp": F.var_samp, "variance": variance,
}
