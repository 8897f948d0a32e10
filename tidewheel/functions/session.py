"""Functions of the session: literals at plan time, from the engine that runs the statement."""

from __future__ import annotations

import posixpath
import time
import uuid

from pyspark.sql import functions as F

from .registry import fn, python

#: The driver-side session whose state these functions read (see ``plans.engine.Engine``).
CURRENT: dict = {"connection_id": 1, "user": "root@localhost", "database": "default", "found_rows": 0, "row_count": -1, "last_insert_id": 0, "last_insert_uuid": "", "version": "8.0.33", "locks": {}}

for _names, _key in ((("connection_id",), "connection_id"), (("user", "current_user", "session_user", "system_user"), "user"), (("database", "schema"), "database"), (("found_rows",), "found_rows"), (("row_count",), "row_count"), (("last_insert_uuid",), "last_insert_uuid"), (("version",), "version")):
    fn(*_names, least=0)((lambda key: lambda: F.lit(CURRENT[key]))(_key))


@fn("last_insert_id", least=0, most=1)
def last_insert_id(x=None):
    return F.lit(CURRENT["last_insert_id"]) if x is None else x


def _name(c):
    return str(c._jc.toString()) if hasattr(c, "_jc") else str(c)


@fn("get_lock", least=2)
def get_lock(name, timeout):
    CURRENT["locks"][_name(name)] = CURRENT["connection_id"]
    return F.lit(1)


@fn("is_free_lock")
def is_free_lock(name):
    return F.lit(int(_name(name) not in CURRENT["locks"]))


@fn("is_used_lock")
def is_used_lock(name):
    return F.lit(CURRENT["locks"].get(_name(name))).cast("long")


@fn("release_lock")
def release_lock(name):
    return F.lit(None if CURRENT["locks"].pop(_name(name), None) is None else 1).cast("int")


@fn("release_all_locks", least=0)
def release_all_locks():
    n = len(CURRENT["locks"])
    CURRENT["locks"].clear()
    return F.lit(n)


@fn("sleep")
def sleep(x):
    """On the driver, once, when the plan is made."""
    time.sleep(float(_name(x)))
    return F.lit(0)


@fn("values")
def values(x):
    """Only inside ON DUPLICATE KEY UPDATE, where it is the new row's column."""
    return F.col(f"new.{_name(x)}")


@fn("name_const", least=2)
def name_const(name, x):
    return x.alias(_name(name))


def _intervals(text: str) -> dict[str, list[tuple[int, int]]]:
    """A set of transaction ids, ``server:1-5:7,...``, as merged ranges by server."""
    out: dict[str, list[tuple[int, int]]] = {}
    for part in text.split(","):
        server, *ranges = [x.strip() for x in part.strip().split(":")]
        if not server and not ranges:
            continue
        for r in ranges:
            lo, _, hi = r.partition("-")
            out.setdefault(str(uuid.UUID(server)), []).append((int(lo), int(hi or lo)))
    for server, found in out.items():
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted(found):
            if merged and lo <= merged[-1][1] + 1:
                merged[-1] = merged[-1][0], max(hi, merged[-1][1])
            else:
                merged.append((lo, hi))
        out[server] = merged
    return out


def _subtract(a: str, b: str) -> str:
    gone, parts = _intervals(b), []
    for server, ranges in sorted(_intervals(a).items()):
        left = ranges
        for lo, hi in gone.get(server, []):
            left = [piece for x, y in left for piece in ((x, min(y, lo - 1)), (max(x, hi + 1), y)) if piece[0] <= piece[1]]
        if left:
            parts.append(server + "".join(f":{x}" if x == y else f":{x}-{y}" for x, y in left))
    return ",".join(parts)


@fn("gtid_subtract", least=2)
def gtid_subtract(a, b):
    """Transaction ids of the first set that aren't in the second."""
    return python(_subtract, "string")(a, b)


@fn("load_file")
def load_file(path):
    """A file under the session's ``secure_file_priv`` folder; NULL without one, for other places, and beyond 64 MiB.

    The path is a literal: the file is read once, when the plan is made, by
    Spark's file systems.
    """
    from pyspark.sql import SparkSession

    name, folder = _name(path), CURRENT.get("secure_file_priv")
    spark = SparkSession.getActiveSession()
    if not folder or spark is None or not posixpath.normpath(name).startswith(posixpath.normpath(folder) + "/"):
        return F.lit(None).cast("binary")
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(name)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p) or fs.getFileStatus(p).getLen() > CURRENT.get("max_allowed_packet", 1 << 26):
        return F.lit(None).cast("binary")
    stream = fs.open(p)
    try:
        return F.lit(bytes(sc._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()
