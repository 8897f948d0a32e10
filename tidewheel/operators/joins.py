"""Joins: every logical kind, both anti joins' NULL rules, USING and NATURAL, and range joins by buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Physical hints by the dialect's hint names.
HINTS = {"HASH_JOIN": "shuffle_hash", "MERGE_JOIN": "merge", "LOOKUP_JOIN": "broadcast", "INNER_JOIN": None, "JOIN_ORDER": None, "NO_MERGE_JOIN": "shuffle_hash"}
#: Buckets of a range at one level, and levels, each that many times wider than the one before.
MOST_BUCKETS, LEVELS = 64, 8
KINDS = {"inner": "inner", "cross": "cross", "left": "left_outer", "right": "right_outer", "full": "full_outer", "semi": "left_semi", "anti_include_nulls": "left_anti"}


def join(left: DataFrame, right: DataFrame, on: Column | None = None, kind: str = "inner", hint: str | None = None) -> DataFrame:
    """A join of a logical kind; ``hint`` is one of the dialect's.

    A lookup hint asks for a broadcast only as far as the optimiser's size limit
    allows: the right side's estimated size is compared with it here.
    """
    h = HINTS.get(hint or "")
    if h == "broadcast":
        limit = left.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
        size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if hasattr(right, "_jdf") else 1 << 62
        h = "broadcast" if size <= _bytes(limit) else None
    if h:
        right = right.hint(h)
    if kind == "anti":
        return anti_not_in(left, right, on)
    return left.crossJoin(right) if kind == "cross" or on is None else left.join(right, on, KINDS[kind])


def _bytes(text: str) -> int:
    digits = text.lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(digits[-1:], 1)
    return int(digits.rstrip("kmg")) * unit


def anti_not_in(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """NOT IN: a comparison that is unknown rejects the row (NOT EXISTS keeps it: ``anti_include_nulls``).

    ``column = other`` goes the way of :func:`not_in`, by hash or merge; only
    another condition compares each pair of rows.
    """
    pair = _equality(on)
    if pair:
        a, b = pair if pair[0] in left.columns else pair[::-1]
        if a in left.columns and b in right.columns and a not in right.columns:
            return not_in(left, a, right, b)
    return left.join(right, F.coalesce(on, F.lit(True)), "left_anti")


def _equality(on: Column) -> tuple[str, str] | None:
    """The two columns of a condition ``a = b``, if it is one."""
    n = on._jc.node() if hasattr(on, "_jc") else None
    if n is None or n.getClass().getSimpleName() != "UnresolvedFunction" or n.functionName() not in ("=", "=="):
        return None
    sides = [n.arguments().apply(i) for i in range(2)]
    if any(x.getClass().getSimpleName() != "UnresolvedAttribute" for x in sides):
        return None
    names = [x.nameParts().apply(x.nameParts().size() - 1) for x in sides]
    return names[0], names[1]


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """``column NOT IN (SELECT other FROM right)`` without a nested loop.

    A NULL in a non-empty list, or a NULL on the left against a non-empty list,
    makes the comparison unknown.
    """
    facts = right.agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(other).isNull(), 1)).alias("_nulls"))
    kept = left.join(right.select(F.col(other).alias("_other")), F.col(column) == F.col("_other"), "left_anti")
    kept = kept.crossJoin(facts)  # one row
    return kept.where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).drop("_n", "_nulls")


def using(left: DataFrame, right: DataFrame, columns: list[str] | None = None, kind: str = "inner") -> DataFrame:
    """USING, or NATURAL without ``columns``: key columns appear once."""
    names = columns or [c for c in left.columns if c in right.columns]
    return left.join(right, names, KINDS[kind]) if names else left.crossJoin(right)


def group_by_join(left: DataFrame, right: DataFrame, on: Column, keys: list[str], *aggs: Column) -> DataFrame:
    return left.join(right, on).groupBy(*keys).agg(*aggs)


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float, kind: str = "inner") -> DataFrame:
    """``points.value BETWEEN ranges.low AND ranges.high`` as an equi-join on buckets of ``width``.

    A range is repeated for each bucket it touches, a point has one, so each
    match is found once; NULL bounds match nothing.  ``width`` near the usual
    length of a range keeps both the repeats and the buckets small.  Ranges of
    more than ``MOST_BUCKETS`` buckets go to buckets of ``MOST_BUCKETS`` times
    the width, and so on: a range has ``MOST_BUCKETS + 1`` rows at most, and a
    point one for each level.
    """
    length = (F.col(high) - F.col(low)) / width
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(length, F.lit(1.0))) / F.lit(math.log(MOST_BUCKETS))) - 1).cast("int")
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("_rl", F.least(level, F.lit(LEVELS - 1)))
    size = F.lit(float(width)) * F.pow(F.lit(float(MOST_BUCKETS)), F.col("_rl"))
    r = r.withColumn("_rb", F.explode(F.sequence(F.floor(F.col(low) / size).cast("long"), F.floor(F.col(high) / size).cast("long"))))
    # levels without a range cost the points nothing
    used = sorted(x[0] for x in r.select("_rl").distinct().limit(LEVELS).collect()) or [0]
    p = points.withColumn("_l", F.explode(F.array(*[F.lit(x) for x in used]))) if kind == "inner" or len(used) == 1 else points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_l", F.explode(F.array(*[F.lit(x) for x in used])))
    p = p.withColumn("_b", F.floor(F.col(value) / (F.lit(float(width)) * F.pow(F.lit(float(MOST_BUCKETS)), F.col("_l")))).cast("long"))
    on = (F.col("_b") == F.col("_rb")) & (F.col("_l") == F.col("_rl")) & F.col(value).between(F.col(low), F.col(high))
    out = p.join(r, on, KINDS[kind])
    if "_id" in p.columns:  # an outer row that matched on one level isn't unmatched on the others
        found = F.max(F.col("_rl").isNotNull()).over(Window.partitionBy("_id"))
        out = out.withColumn("_found", found).where(F.col("_rl").isNotNull() | (~F.col("_found") & (F.col("_l") == used[0]))).drop("_found", "_id")
    return out.drop("_b", "_rb", "_l", "_rl")
