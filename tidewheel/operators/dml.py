"""Data changes as rewrites: each takes a table's DataFrame and gives the new one.

Nothing is changed in place; the caller writes the result beside the old files
and swaps (see ``sources.tables``).  Keys, checks and foreign keys are verified
by joins and aggregations before the result is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recursive import written


class ConstraintError(ValueError):
    """A key, check or foreign key is violated."""


def fill(rows: DataFrame, columns: list[str], defaults: dict[str, Column] | None = None, generated: dict[str, Column] | None = None, auto: tuple[str, int] | None = None, ordered: bool = False) -> DataFrame:
    """Rows in the table's columns: defaults for those not given, generated ones computed, auto-increment continued; ``ordered`` keeps ``ORDER``."""
    out = rows
    for c in columns:
        if c not in out.columns and c not in (generated or {}):
            out = out.withColumn(c, (defaults or {}).get(c, F.lit(None)))
    if auto:
        out = number_rows(out, *auto)
    for c, e in (generated or {}).items():
        out = out.withColumn(c, e)
    return out.select(*columns, *[ORDER] * (ordered and ORDER in out.columns))


def number_rows(rows: DataFrame, name: str, last: int) -> DataFrame:
    """AUTO_INCREMENT: NULL and 0 take the number after the greatest so far, given ones stay and move it on.

    Row i ends at c(i) + max(last, e(j) - c(j) for j up to i), with c the rows
    without a number so far and e the given ones: a running sum and a running
    maximum in each partition, and two numbers a partition on the driver.
    """
    given = F.nullif(F.col(name).try_cast("long"), F.lit(0).cast("long"))
    out = written(rows.withColumn("_p", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).withColumn("_given", given))
    counts = {r["_p"]: r["n"] for r in out.groupBy("_p").agg(F.count(F.when(F.col("_given").isNull(), 1)).alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    at = lambda known: F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("_p")], F.lit(0)).cast("long") if known else F.lit(0)
    here = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_c", F.count(F.when(F.col("_given").isNull(), 1)).over(here) + at(before))
    tops = {r["_p"]: r["m"] for r in out.groupBy("_p").agg(F.max(F.col("_given") - F.col("_c")).alias("m")).collect()}
    floor, top = {}, last
    for p in sorted(tops):
        floor[p], top = top, max(top, tops[p] if tops[p] is not None else top)
    high = F.greatest(at(floor), F.coalesce(F.max(F.col("_given") - F.col("_c")).over(here), at(floor)))
    return out.withColumn(name, F.coalesce("_given", F.col("_c") + high)).drop("_p", "_given", "_c").withColumnRenamed("_at", ORDER)


#: The order of an INSERT's rows, where it matters; dropped from results.
ORDER = "_row_order"


def check_unique(df: DataFrame, key: list[str]) -> None:
    """NULLs in a key don't collide."""
    filled = df.where(" and ".join(f"`{k}` is not null" for k in key))
    if not filled.groupBy(*key).count().where("count > 1").isEmpty():
        raise ConstraintError(f"duplicate key {key}")


def check_rows(df: DataFrame, condition: Column, name: str) -> None:
    """A CHECK fails where it is false, not where it is unknown."""
    if not df.where(~condition).isEmpty():
        raise ConstraintError(f"check {name} is violated")


def check_foreign_key(child: DataFrame, columns: list[str], parent: DataFrame, other: list[str]) -> None:
    on = [F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in zip(columns, other, strict=True)]
    filled = child.where(" and ".join(f"`{k}` is not null" for k in columns))
    if not filled.alias("c").join(parent.alias("p"), on, "left_anti").isEmpty():
        raise ConstraintError(f"foreign key {columns} has no parent")


def _keys(key) -> list[list[str]]:
    """One key as a list of columns, or several."""
    return [] if not key else [list(key)] if isinstance(key[0], str) else [list(k) for k in key]


def _filled(prefix: str, key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{prefix}{k}").isNotNull() for k in key])


def _place(rows: DataFrame, keys: list[list[str]], last: bool = False) -> Column:
    """Whether a row is the first (or last) of its value in each key; NULLs don't collide."""
    order = F.col(ORDER).desc() if last else F.col(ORDER)
    return reduce(lambda a, b: a & b, [~_filled("", k) | (F.row_number().over(Window.partitionBy(*k).orderBy(order)) == 1) for k in keys])


def _same(keys: list[list[str]], i: int) -> list[Column]:
    return [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys[i]]


def _without(rows: DataFrame, others: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Those rows that collide with none of ``others`` in any key."""
    for i in range(len(keys)):
        rows = rows.alias("new").join(others.select(*dict.fromkeys(keys[i])).alias("old"), _same(keys, i), "left_anti")
    return rows


def insert(table: DataFrame, rows: DataFrame, key: list | None = None, mode: str = "error", update: dict[str, Column] | None = None) -> DataFrame:
    """INSERT by ``mode``: error, ignore, replace, or update (ON DUPLICATE KEY UPDATE; new values are ``new.column``).

    ``key``: the columns of a unique key, or a list of such keys.  The result is
    that of taking the rows one after another: REPLACE keeps the last of equal
    keys; for the other modes, rows that come first in all their keys are taken
    together, then those left, so there are as many rounds as a key is repeated.
    """
    keys = _keys(key)
    order = F.col(ORDER) if ORDER in rows.columns else F.monotonically_increasing_id()
    rows = rows.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns], order.alias(ORDER))
    plain = rows.select(*table.columns)
    if not keys:
        return table.unionByName(plain)
    if mode == "error":
        for i, k in enumerate(keys):  # the table's own rows are unique already: only new ones are looked at
            check_unique(plain, k)
            if not plain.alias("new").where(_filled("new.", k)).join(table.alias("old"), _same(keys, i), "left_semi").isEmpty():
                raise ConstraintError(f"duplicate key {k}")
        return table.unionByName(plain)
    rows = written(rows)
    if mode == "replace":
        kept = rows.withColumn("_last", _place(rows, keys, True)).where("_last").select(*table.columns)
        old = table
        for i in range(len(keys)):
            old = old.alias("old").join(rows.select(*keys[i]).distinct().alias("new"), _same(keys, i), "left_anti")
        return old.unionByName(kept)
    while True:
        if mode == "ignore":
            rows = written(_without(rows, table, keys))
        marked = written(rows.withColumn("_first", _place(rows, keys)))
        now, rows = marked.where("_first").drop("_first"), marked.where("not _first").drop("_first")
        table = written(table.unionByName(now.select(*table.columns)) if mode == "ignore" else _upsert(table, now, keys, update or {}))
        if rows.isEmpty():
            return table


def _upsert(table: DataFrame, rows: DataFrame, keys: list[list[str]], update: dict[str, Column]) -> DataFrame:
    """Rows with distinct keys: a row found by its first key that collides is changed, others are added."""
    for i in range(len(keys)):
        old, new = table.alias("old"), rows.alias("new")
        joined = old.join(new, _same(keys, i), "left")
        hit = F.col(f"new.{ORDER}").isNotNull()
        changed = [F.when(hit, update[c].cast(table.schema[c].dataType)).otherwise(F.col(f"old.{c}")).alias(c) if c in update else F.col(f"old.{c}").alias(c) for c in table.columns]
        left = new.join(old.select(*keys[i]).distinct().alias("old"), _same(keys, i), "left_anti")
        table, rows = joined.select(*changed), left.select("new.*")
        if i < len(keys) - 1:
            table, rows = written(table), written(rows)
    return table.unionByName(rows.select(*table.columns))


def update(table: DataFrame, changes: dict[str, Column], where: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """UPDATE; with ORDER BY and LIMIT only the first rows that match."""
    hit = F.coalesce(where if where is not None else F.lit(True), F.lit(False))
    new = lambda hit: [F.when(hit, changes[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns]
    if limit is None:
        return table.select(*new(hit))
    t, first = first_rows(table, hit, order, limit)
    marked = t.join(first, F.col("_id") == F.col("_first"), "left")
    return marked.select(*new(F.col("_first").isNotNull()))


def first_rows(table: DataFrame, hit: Column, order: list[Column] | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """The table with ``_id``, and ``_first``, the ids of its first rows that match: a top-k, no sort of the whole."""
    t = written(table).withColumn("_id", F.monotonically_increasing_id())
    found = t.where(hit)
    found = found.orderBy(*order, "_id") if order else found
    return t, found.limit(limit).select(F.col("_id").alias("_first"))


def update_join(table: DataFrame, key: list[str], other: DataFrame, on: Column, changes: dict[str, Column]) -> DataFrame:
    """UPDATE t JOIN other: aliases ``t`` and ``o``; a target row is changed once."""
    t = table.alias("t").join(other.alias("o"), on).select(*[F.col(f"t.{k}").alias(f"_{k}") for k in key], *[v.alias(f"_new_{c}") for c, v in changes.items()])
    t = t.dropDuplicates([f"_{k}" for k in key])
    j = table.join(t, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    hit = F.col(f"_{key[0]}").isNotNull()
    return j.select(*[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Rows for which the condition is true go; unknown keeps them; with LIMIT only the first that match."""
    if limit is not None:
        t, first = first_rows(table, F.coalesce(where if where is not None else F.lit(True), F.lit(False)), order, limit)
        return t.join(first, F.col("_id") == F.col("_first"), "left_anti").select(*table.columns)
    return table.limit(0) if where is None else table.where(~F.coalesce(where, F.lit(False)))


def delete_join(table: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    return table.alias("t").join(other.alias("o"), on, "left_anti")


def cascade(child: DataFrame, columns: list[str], parent: DataFrame, other: list[str], action: str) -> DataFrame:
    """What a parent's change does to its children: cascade deletes, set_null clears, restrict raises."""
    if action == "restrict":
        check_foreign_key(child, columns, parent, other)
        return child
    on = [F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in zip(columns, other, strict=True)]
    kept = child.alias("c").join(parent.select(*other).distinct().alias("p"), on, "left")
    orphan = F.col(f"p.{other[0]}").isNull() & F.col(f"c.{columns[0]}").isNotNull()
    if action == "cascade":
        return kept.where(~orphan).select("c.*")
    return kept.select(*[F.when(orphan, None).otherwise(F.col(f"c.{c}")).alias(c) if c in columns else F.col(f"c.{c}").alias(c) for c in child.columns])


def cascade_update(child: DataFrame, columns: list[str], moved: DataFrame, other: list[str], action: str) -> DataFrame:
    """What a change of a parent's key does to its children.

    ``moved``: the parent's changed rows with ``old_<column>`` and
    ``new_<column>``.  cascade gives children the new key, set_null clears it,
    restrict raises where a child has an old key.
    """
    on = [F.col(f"c.{a}") == F.col(f"m.old_{b}") for a, b in zip(columns, other, strict=True)]
    m = moved.where(reduce(lambda a, b: a | b, [~F.col(f"old_{b}").eqNullSafe(F.col(f"new_{b}")) for b in other]))
    m = m.dropDuplicates([f"old_{b}" for b in other]).alias("m")
    if action == "restrict":
        if not child.alias("c").join(m, on, "left_semi").isEmpty():
            raise ConstraintError(f"foreign key {columns}: a parent's key that is in use can't change")
        return child
    hit = reduce(lambda a, b: a & b, [F.col(f"m.old_{b}").isNotNull() for b in other])
    new = {a: F.col(f"m.new_{b}") if action == "cascade" else F.lit(None) for a, b in zip(columns, other, strict=True)}
    out = child.alias("c").join(m, on, "left")
    return out.select(*[F.when(hit, new[c].cast(child.schema[c].dataType)).otherwise(F.col(f"c.{c}")).alias(c) if c in new else F.col(f"c.{c}").alias(c) for c in child.columns])
