"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import inspect
import shutil
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a new local one only where there is one machine, as in tests."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not conf:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            conf = tempfile.mkdtemp(prefix="tidewheel-")
            atexit.register(shutil.rmtree, conf, True)
        sc.setCheckpointDir(conf)
    return conf or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there (reliable checkpoint, never a local one).

    Shuffle files go when nothing refers to their plan any more, which Spark
    learns at a collection of the driver's heap: one is asked for here, so that
    disk is that of the steps since the last cuts, not of when memory ran short.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(True)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


#: Rows of an Arrow batch, at most: a batch of whole texts is in memory some times over, on both sides of the pipe.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_LEAN: list = []


def _lean() -> Callable[[], None]:
    """Make this worker give freed memory back: Arrow keeps no pool, only very large blocks are mapped apart; returns a trim."""
    if not _LEAN:
        import pyarrow as pa

        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 22)  # fixed thresholds: the dynamic ones grow with what is freed
            libc.mallopt(-1, 1 << 24)
        pa.set_memory_pool(pa.system_memory_pool())
        trim = getattr(libc, "malloc_trim", None)
        _LEAN.append((lambda: trim(0)) if trim else (lambda: None))
    return _LEAN[0]


#: Tables that a worker keeps from task to task, by the module that fills them.
_KEPT: dict[str, dict] = {}


def kept_tables(owner: str) -> dict:
    """A table of module ``owner`` that lasts from task to task, until the worker gets a task of another module."""
    return _KEPT.setdefault(owner, {})


def _begin(owner: str) -> Callable[[], None]:
    """What a task does first: workers are used again, so tables that other modules left in this one go; returns a trim."""
    trim = _lean()
    left = [x for name, x in _KEPT.items() if name != owner and x]
    for x in left:
        x.clear()
    if left:
        trim()
    return trim


def tidy(run: Callable) -> Callable:
    """A task's function over Arrow batches that gives freed memory back to the system when it ends, as workers are used again."""

    owner = run.__module__

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        trim = _begin(owner)
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            trim()

    return wrapped


def tidy_group(run: Callable) -> Callable:
    """The same for a function of a group: Spark counts its parameters, one or two."""

    owner = run.__module__

    def call(*tables):
        trim = _begin(owner)
        try:
            return run(*tables)
        finally:
            trim()

    def one(table):
        return call(table)

    def two(first, second):
        return call(first, second)

    return one if len(inspect.signature(run).parameters) == 1 else two


def parts(spark: SparkSession, factor: int = 1) -> int:
    """Number of buckets for hash-packed shuffles: follows the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))) * factor


#: A graph of at most so many edges (16 bytes each) is finished in one task.
FEW = 1 << 20


def _settle(e: DataFrame) -> DataFrame:
    """Components of a graph of bounded size: hooking and pointer jumping over arrays."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
        if not ends:
            return
        nodes, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*ends, strict=True)]), return_inverse=True)
        x, y = at.reshape(2, -1)
        label = np.arange(len(nodes))
        while True:
            new, low = label.copy(), np.minimum(label[x], label[y])
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        for lo in range(0, len(nodes), 1 << 16):
            cut_ = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[cut_]), pa.array(nodes[label[cut_]])], ["node", "component"])

    return e.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int | None = None) -> DataFrame:
    """Label every node of an undirected edge table with the smallest node it reaches.

    ``edges`` has long columns ``a`` and ``b``; the result has ``node`` and
    ``component``.  At most ``few`` edges (a bound, ``FEW``) are settled in one
    task, which saves a small graph the rounds; more by alternating large-star
    and small-star contractions: each round is two partial aggregations and two lookups of a node's smallest
    neighbour.  A node with more than ``max(256, ends / 50,000)`` neighbours is
    looked up without a shuffle, so no partition holds a hot node: there are at
    most 50,000 such nodes, which is the proven bound of that broadcast.  Every
    round is checkpointed; only two numbers (row count and checksum) reach the
    driver.  Null ends and self loops are ignored.  Raises RuntimeError if it
    doesn't settle in ``max_rounds``; rounds grow with the logarithm of a
    component's diameter.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    )
    e = cut(e.distinct())
    n = e.count()
    if n <= (FEW if few is None else few):
        return _settle(e)

    def lookup(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
        """``rows`` with ``m`` of ``low`` (k, m, degree) for a = k; frequent keys by a broadcast of bounded size."""
        hot = low.where(F.col("degree") > max(256, total // 50_000))
        few = F.broadcast(hot.select(F.col("k").alias("hot_k"), F.col("m").alias("hot_m")))
        marked = rows.join(few, F.col("a") == F.col("hot_k"), "left")
        cold = marked.where("hot_k is null").select("a", "b").join(low.select("k", "m"), F.col("a") == F.col("k")).select("a", "b", "m")
        return cold.union(marked.where("hot_k is not null").select("a", "b", F.col("hot_m").alias("m")))

    seen = None
    for _ in range(max_rounds):
        # large star: larger neighbours move to the smallest neighbour
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"), "degree")
        big = lookup(sym.where("b > a"), low, 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = big.where("a <> b").distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        low = big.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "k")
        small = lookup(big, low, 2 * n)
        e = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        e = cut(e.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen, n = now, now[0]
    else:
        raise RuntimeError("connected components did not settle")
    root = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    own = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return root.union(own)
