"""Recursive queries: UNION ALL runs in Spark SQL; UNION (DISTINCT) needs a fixpoint."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

MAX_ROUNDS = 10_001
#: Rounds' results that are kept apart before they are written as one.
MOST_PARTS = 16


class RecursionLimit(RuntimeError):
    pass


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names for checkpoints; a local one only where there is one machine and it names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not place:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            place = tempfile.mkdtemp(prefix="tidewheel-")
            atexit.register(shutil.rmtree, place, True)
        sc.setCheckpointDir(place)


def written(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint, without the constraints of its old plan (a union over them can fail to resolve)."""
    spark, key = df.sparkSession, "spark.sql.constraintPropagation.enabled"
    checkpoint_dir(spark)
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(key, before)


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = MAX_ROUNDS) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows the step makes from new rows, until there are none.

    Each round's rows are checkpointed, so the plan doesn't grow; only whether
    there are new rows reaches the driver.
    """
    new = written(base.distinct())
    parts = [new]
    for _ in range(limit):
        fresh = step(new).toDF(*base.columns).distinct()
        for p in parts:  # rows known so far stay where they were written
            fresh = fresh.subtract(p)
        new = written(fresh)
        if new.isEmpty():
            return reduce(DataFrame.union, parts)
        parts.append(new)
        if len(parts) > MOST_PARTS:  # a round's plan stays small
            parts = [written(reduce(DataFrame.union, parts))]
    raise RecursionLimit(f"more than {limit} rounds")
