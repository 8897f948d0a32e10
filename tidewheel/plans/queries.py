"""One query for each operator and function family, over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import datetime as D
from ..functions import numeric as N
from ..functions import json as J  # noqa: F401  (registers)
from ..functions import network, spatial, strings  # noqa: F401  (register)
from ..functions.registry import call, number
from ..operators import dml, fulltext, joins, json_table, recursive, sets, windows
from ..session import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = prepare(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._dir, name)


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def expressions(name: str, source: str, key: str, items: dict[str, tuple[Column | Callable[[], Column], str]]) -> None:
    """A query of expressions over a whole table: alias -> (Column builder, SQL)."""
    QUERIES[name] = lambda spark, sf_dir: getattr(Tables(spark, sf_dir), source).select(key, *[(c() if callable(c) else c).alias(a) for a, (c, _) in items.items()])
    SQL[name] = f"SELECT {key}, " + ", ".join(f"{s} AS {a}" for a, (_, s) in items.items()) + f" FROM {source}"


c, lit = F.col, F.lit
r6 = lambda x: F.round(x, 6)

# --- scans, projections, filters, aggregation ------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def tpch_q1(t):
    price = c("l_extendedprice") * (1 - c("l_discount"))
    return t.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(A.sum_(c("l_quantity")), 2).alias("sum_qty"), F.round(A.sum_(c("l_extendedprice")), 2).alias("sum_base_price"), F.round(A.sum_(price), 2).alias("sum_disc_price"),
        F.round(A.sum_(price * (1 + c("l_tax"))), 2).alias("sum_charge"), r6(A.avg(c("l_quantity"))).alias("avg_qty"), F.round(A.avg(c("l_extendedprice")), 4).alias("avg_price"),
        r6(A.avg(c("l_discount"))).alias("avg_disc"), A.count().alias("count_order"))


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey
  JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
  GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def tpch_q3(t):
    o = t.orders.where("o_orderdate < timestamp_ntz'1995-03-15'").join(t.customer.where("c_mktsegment = 'BUILDING'"), c("c_custkey") == c("o_custkey"))
    j = t.lineitem.where("l_shipdate > timestamp_ntz'1995-03-15'").join(o, c("l_orderkey") == c("o_orderkey"))
    g = j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"))
    return sets.top_n(g.select("l_orderkey", "revenue", "o_orderdate"), 10, c("revenue").desc(), c("l_orderkey"))


@query("""SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1""")
def tpch_q4_exists(t):
    return joins.join(t.orders, t.lineitem.where("l_quantity > 45").select("l_orderkey"), c("o_orderkey") == c("l_orderkey"), "semi").groupBy("o_orderpriority").agg(A.count().alias("order_count"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def tpch_q5(t):
    j = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("c_custkey") == c("o_custkey")).join(t.supplier, (c("l_suppkey") == c("s_suppkey")) & (c("c_nationkey") == c("s_nationkey")))
    j = j.join(t.nation, c("s_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"))


@query("""SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def tpch_q6(t):
    f = "l_shipdate >= timestamp_ntz'1994-01-01' and l_shipdate < timestamp_ntz'1995-01-01' and l_discount between 0.05D and 0.07D and l_quantity < 24"
    return t.lineitem.where(f).agg(F.round(F.sum(c("l_extendedprice") * c("l_discount")), 2).alias("revenue"))


@query("""SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY 1""")
def tpch_q13(t):
    g = joins.join(t.customer, t.orders, c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey").agg(A.count(c("o_orderkey")).alias("c_count"))
    return g.groupBy("c_count").agg(A.count().alias("custdist"))


@query("""SELECT o_orderkey, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING sum(l_quantity) > 200""")
def having(t):
    return joins.group_by_join(t.orders, t.lineitem, c("o_orderkey") == c("l_orderkey"), ["o_orderkey"], F.round(F.sum("l_quantity"), 2).alias("qty")).where("qty > 200")


@query("SELECT count(*) AS n FROM lineitem")
def table_count(t):
    return t.lineitem.agg(A.count().alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (1, 5, 9, 15) OR l_suppkey = 3 AND NOT (l_quantity BETWEEN 10 AND 40)")
def filter_or_in(t):
    return t.lineitem.where(c("l_partkey").isin(1, 5, 9, 15) | (c("l_suppkey") == 3) & ~c("l_quantity").between(10, 40)).select("l_orderkey", "l_linenumber")


@query("""SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(DISTINCT (c_nationkey, c_mktsegment)) AS pairs, round(stddev_pop(c_acctbal), 4) AS std, round(stddev_samp(c_acctbal), 4) AS std_samp,
  round(var_pop(c_acctbal), 2) AS var_p, round(var_samp(c_acctbal), 2) AS var_s, min(c_name) AS min_name, max(c_acctbal) AS max_bal, round(CAST(sum(c_nationkey) AS DOUBLE), 1) AS sum_int FROM customer GROUP BY 1""")
def aggregates(t):
    x = c("c_acctbal")
    return t.customer.groupBy("c_mktsegment").agg(
        A.count(c("c_nationkey"), distinct=True).alias("nations"), A.count(c("c_nationkey"), c("c_mktsegment"), distinct=True).alias("pairs"), F.round(A.std(x), 4).alias("std"), F.round(F.stddev_samp(x), 4).alias("std_samp"),
        F.round(A.variance(x), 2).alias("var_p"), F.round(F.var_samp(x), 2).alias("var_s"), F.min("c_name").alias("min_name"), F.max(x).alias("max_bal"), F.round(A.sum_(c("c_nationkey")), 1).alias("sum_int"))


@query("""SELECT c_mktsegment, CAST(bit_and(c_custkey) AS DECIMAL(20,0)) AS band, CAST(bit_or(c_custkey) AS DECIMAL(20,0)) AS bor, CAST(bit_xor(c_custkey) AS DECIMAL(20,0)) AS bxor,
  arg_min(c_name, c_custkey) AS first_name, arg_max(c_name, c_custkey) AS last_name FROM customer GROUP BY 1""")
def aggregates_bits(t):
    k = c("c_custkey")
    return t.customer.groupBy("c_mktsegment").agg(A.bit_and(k).alias("band"), A.bit_or(k).alias("bor"), A.bit_xor(k).alias("bxor"), A.first(c("c_name"), k).alias("first_name"), A.last(c("c_name"), k).alias("last_name"))


@query("""SELECT CAST(18446744073709551615 AS DECIMAL(20,0)) AS band, CAST(0 AS DECIMAL(20,0)) AS bor, CAST(NULL AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n""")
def aggregates_of_nothing(t):
    k = c("c_custkey")
    return t.customer.where("c_custkey < 0").agg(A.bit_and(k).alias("band"), A.bit_or(k).alias("bor"), A.sum_(k).alias("total"), A.count(k).alias("n"))


@query("""SELECT n_regionkey, left(string_agg(n_name, '|' ORDER BY n_name DESC), 1024) AS names, left(string_agg(DISTINCT left(n_name, 1), ',' ORDER BY left(n_name, 1)), 1024) AS initials FROM nation GROUP BY 1""")
def group_concat(t):
    return t.nation.groupBy("n_regionkey").agg(A.group_concat(c("n_name"), [(c("n_name"), False)], "|").alias("names"), A.group_concat(F.left(c("n_name"), lit(1)), distinct=True).alias("initials"))


@query("""SELECT r_regionkey, r_name, '[' || (SELECT string_agg(CAST(n_nationkey AS VARCHAR), ', ' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) || ']' AS keys FROM region""")
def json_aggregates(t):
    n = t.nation.orderBy("n_nationkey").coalesce(1).groupBy("n_regionkey").agg(A.json_arrayagg(c("n_nationkey")).alias("keys"))
    return t.region.join(n, c("r_regionkey") == c("n_regionkey")).select("r_regionkey", "r_name", "keys")


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct(t):
    return t.customer.select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT DISTINCT ON (c_mktsegment) c_mktsegment, c_custkey, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def distinct_on(t):
    return sets.distinct_on(t.customer.select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], -c("c_acctbal"), c("c_custkey"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
def top_n_offset(t):
    return sets.top_n(t.customer.select("c_custkey", "c_acctbal"), 20, c("c_acctbal").desc(), c("c_custkey"), offset=5)


# --- joins ------------------------------------------------------------------------------------

_J = {
    "inner": ("inner", "JOIN"), "left": ("left", "LEFT JOIN"), "right": ("right", "RIGHT JOIN"), "full": ("full", "FULL JOIN"),
}
for _k, (_how, _sql) in _J.items():

    def _f(t, how=_how):
        a, b = t.customer.where("c_acctbal > 5000"), t.orders.where("o_totalprice > 200000")
        return joins.join(a, b, c("c_custkey") == c("o_custkey"), how).select("c_custkey", "o_orderkey")

    _f.__name__ = f"join_{_k}"
    query(f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) {_sql} (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")(_f)
for _h in ("HASH_JOIN", "MERGE_JOIN", "LOOKUP_JOIN"):

    def _f(t, h=_h):
        return joins.join(t.orders, t.customer, c("c_custkey") == c("o_custkey"), "inner", h).groupBy("c_mktsegment").agg(A.count().alias("n"))

    _f.__name__ = f"join_hint_{_h.lower()}"
    query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")(_f)


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return joins.join(t.region, t.nation, None, "cross").select("r_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti_not_exists(t):
    return joins.join(t.customer, t.orders, c("c_custkey") == c("o_custkey"), "anti_include_nulls").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def join_anti_not_in(t):
    return joins.not_in(t.customer, "c_custkey", t.orders.where("o_totalprice > 100000"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_totalprice > 100000 THEN o_custkey END FROM orders)")
def join_anti_not_in_nulls(t):
    return joins.not_in(t.customer, "c_custkey", t.orders.select(F.when(c("o_totalprice") > 100000, c("o_custkey")).alias("k")), "k").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def join_semi_in(t):
    return joins.join(t.orders, t.customer.where("c_mktsegment = 'MACHINERY'"), c("o_custkey") == c("c_custkey"), "semi").select("o_orderkey")


@query("SELECT k, c_name, o_orderkey FROM (SELECT c_custkey AS k, c_name FROM customer) JOIN (SELECT o_custkey AS k, o_orderkey FROM orders) USING (k)")
def join_using(t):
    return joins.using(t.customer.select(c("c_custkey").alias("k"), "c_name"), t.orders.select(c("o_custkey").alias("k"), "o_orderkey"), ["k"])


@query("SELECT k, c_name, o_orderkey FROM (SELECT c_custkey AS k, c_name FROM customer) NATURAL LEFT JOIN (SELECT o_custkey AS k, o_orderkey FROM orders)")
def join_natural_left(t):
    return joins.using(t.customer.select(c("c_custkey").alias("k"), "c_name"), t.orders.select(c("o_custkey").alias("k"), "o_orderkey"), None, "left")


@query("""SELECT r_name, x.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) x""")
def join_lateral(t):
    t.region.createOrReplaceTempView("_tw_region")
    t.nation.createOrReplaceTempView("_tw_nation")
    return t._spark.sql("SELECT r_name, x.n_name FROM _tw_region, LATERAL (SELECT n_name FROM _tw_nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) x")


@query("""SELECT r_name, n FROM region LEFT JOIN LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey AND n_name < 'C') x ON true""")
def join_lateral_left(t):
    n = t.nation.where("n_name < 'C'").groupBy("n_regionkey").agg(A.count().alias("n"))
    return t.region.join(n, c("r_regionkey") == c("n_regionkey"), "left").select("r_name", F.coalesce("n", lit(0)).alias("n"))


@query("""SELECT event_id, s_suppkey FROM events JOIN (SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS lo, s_suppkey + 0.75 AS hi FROM supplier) ON value BETWEEN lo AND hi""")
def join_range(t):
    s = t.supplier.select("s_suppkey", c("s_suppkey").cast("double").alias("lo"), (c("s_suppkey") + 0.75).alias("hi"))
    return joins.range_join(t.events, s, "value", "lo", "hi", 1.0).select("event_id", "s_suppkey")


@query("""SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) < (100, 'F')""")
def tuple_comparison(t):
    return t.orders.where(N.row_compare([c("o_custkey"), c("o_orderstatus")], "<", [lit(100), lit("F")])).select("o_orderkey")


@query("SELECT o_orderkey, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS name, (SELECT max(o_totalprice) FROM orders) AS top FROM orders")
def scalar_subquery(t):
    top = t.orders.agg(F.max("o_totalprice").alias("top"))
    return t.orders.join(t.customer, c("c_custkey") == c("o_custkey"), "left").crossJoin(top).select("o_orderkey", c("c_name").alias("name"), "top")


# --- set operations, recursion, values ---------------------------------------------------------

for _n, _op, _distinct in (("union", "UNION", True), ("union_all", "UNION ALL", False), ("intersect", "INTERSECT", True), ("intersect_all", "INTERSECT ALL", False), ("except", "EXCEPT", True), ("except_all", "EXCEPT ALL", False)):

    def _f(t, n=_n, distinct=_distinct):
        op = {"union": sets.union, "intersect": sets.intersect, "except": sets.except_}[n.split("_")[0]]
        return op(t.customer.select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k")), distinct)

    _f.__name__ = f"set_{_n}"
    query(f"SELECT c_nationkey AS k FROM customer {_op} SELECT s_nationkey FROM supplier")(_f)


@query("WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n, n * n AS sq FROM s")
def recursive_union_all(t):
    return t._spark.sql("WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n, n * n AS sq FROM s")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), r(x) AS (SELECT 0 UNION SELECT b FROM e JOIN r ON a = x) SELECT x FROM r")
def recursive_union_distinct(t):
    e = t.nation.select(c("n_nationkey").alias("a"), ((c("n_nationkey") * 7 + 3) % 25).alias("b"))
    return recursive.fixpoint(t._spark.sql("SELECT 0 AS x"), lambda new: e.join(new, c("a") == c("x")).select("b"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL), (2, NULL)) v(x, y)")
def values_rows(t):
    return t._spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")


# --- windows -------------------------------------------------------------------------------------

def _W():
    return Window.partitionBy("o_custkey").orderBy("o_orderkey")


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 6) AS pr, ntile(3) OVER w AS nt, lag(o_totalprice, 2, 0.0) OVER w AS lg,
  lead(o_totalprice) OVER w AS ld, first_value(o_orderkey) OVER w AS fv, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def window_functions(t):
    v = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.orders.select(
        "o_orderkey", F.row_number().over(_W()).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), r6(windows.percent_rank(v)).alias("pr"), F.ntile(3).over(_W()).alias("nt"), F.lag("o_totalprice", 2, 0.0).over(_W()).alias("lg"),
        F.lead("o_totalprice").over(_W()).alias("ld"), F.first("o_orderkey").over(_W()).alias("fv"), F.last("o_orderkey").over(windows.spec(_W(), "rows", None, None)).alias("lv"))


def _bound(b: int | None, n: int, start: bool) -> str:
    return f"UNBOUNDED {'PRECEDING' if start else 'FOLLOWING'}" if b is None else "CURRENT ROW" if b == 0 else f"{n} {'PRECEDING' if b < 0 else 'FOLLOWING'}"


def _frames(kind: str) -> None:
    n = 2 if kind == "rows" else 40
    use = {k: v for k, v in windows.frames(n).items() if v[0] == kind}

    def f(t):
        return t.orders.select("o_orderkey", *[windows.over(F.count(lit(1)), _W(), *v, empty=0).cast("long").alias(f"n_{k.lower()}") for k, v in use.items()], *[windows.over(F.max("o_orderkey"), _W(), *v).cast("long").alias(f"m_{k.lower()}") for k, v in use.items()])

    f.__name__ = f"window_frames_{kind}"
    cells = []
    for k, (_, a, b) in use.items():
        over = f"OVER (PARTITION BY o_custkey ORDER BY o_orderkey {kind} BETWEEN {_bound(a, n, True)} AND {_bound(b, n, False)})"
        bad = windows.inverted(a, b)
        cells += [f"{'CAST(0 AS BIGINT)' if bad else f'count(*) {over}'} AS n_{k.lower()}", f"{'CAST(NULL AS BIGINT)' if bad else f'max(o_orderkey) {over}'} AS m_{k.lower()}"]
    query(f"SELECT o_orderkey, {', '.join(cells)} FROM orders")(f)


_frames("rows")
_frames("range")


@query("""SELECT l_orderkey, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, (SELECT count(DISTINCT y.l_suppkey) FROM lineitem y WHERE y.l_orderkey = x.l_orderkey) AS n FROM lineitem x)""")
def window_count_distinct(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", windows.count_distinct_over(c("l_suppkey"), Window.partitionBy("l_orderkey")).cast("long").alias("n"))


@query("""SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) > 100 AS busy FROM events""")
def window_range_interval(t):
    e = t.events.withColumn("s", F.unix_micros(c("ts").cast("timestamp_ltz")))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", (F.sum("value").over(w) > 100).alias("busy"))


# --- expressions -----------------------------------------------------------------------------------

q, p = lambda: c("l_quantity"), lambda: c("l_extendedprice")
expressions("math_functions", "part", "p_partkey", {
    "f_abs": (lambda: call("abs", c("p_size") - 25), "abs(p_size - 25)"), "f_ceil": (lambda: call("ceil", c("p_retailprice")), "CAST(ceil(p_retailprice) AS BIGINT)"), "f_floor": (lambda: call("floor", c("p_retailprice")), "CAST(floor(p_retailprice) AS BIGINT)"),
    "f_sqrt": (lambda: r6(call("sqrt", c("p_size") - 10)), "CASE WHEN p_size >= 10 THEN round(sqrt(p_size - 10), 6) END"), "f_ln": (lambda: r6(call("ln", c("p_size") - 10)), "CASE WHEN p_size > 10 THEN round(ln(p_size - 10), 6) END"),
    "f_log10": (lambda: r6(call("log10", c("p_size"))), "CASE WHEN p_size > 0 THEN round(log10(p_size), 6) END"), "f_log2": (lambda: r6(call("log2", c("p_size"))), "CASE WHEN p_size > 0 THEN round(log2(p_size), 6) END"),
    "f_log": (lambda: r6(call("log", 3.0, c("p_size"))), "CASE WHEN p_size > 0 THEN round(ln(p_size) / ln(3), 6) END"), "f_pow": (lambda: call("pow", c("p_size"), 2), "power(p_size, 2)"), "f_mod": (lambda: call("mod", c("p_size"), c("p_size") % 3), "CASE WHEN p_size % 3 <> 0 THEN p_size % (p_size % 3) END"),
    "f_sign": (lambda: call("sign", c("p_size") - 20).cast("int"), "CAST(sign(p_size - 20) AS INT)"), "f_trunc": (lambda: r6(call("truncate", -c("p_retailprice"), 1)), "round(trunc(-p_retailprice * 10) / 10, 6)"), "f_round": (lambda: call("round", c("p_retailprice")), "round(p_retailprice)"),
    "f_sin": (lambda: r6(call("sin", c("p_size"))), "round(sin(p_size), 6)"), "f_cos": (lambda: r6(call("cos", c("p_size"))), "round(cos(p_size), 6)"), "f_tan": (lambda: r6(call("tan", c("p_size"))), "round(tan(p_size), 6)"), "f_atan2": (lambda: r6(call("atan2", c("p_size"), 3.0)), "round(atan2(p_size, 3), 6)"),
    "f_atan": (lambda: r6(call("atan", c("p_size"))), "round(atan(p_size), 6)"), "f_asin": (lambda: r6(call("asin", c("p_size") / 100)), "round(asin(p_size / 100.0), 6)"), "f_acos": (lambda: r6(call("acos", c("p_size") / 100)), "round(acos(p_size / 100.0), 6)"), "f_deg": (lambda: r6(call("degrees", c("p_size"))), "round(degrees(p_size), 6)"),
    "f_rad": (lambda: r6(call("radians", c("p_size"))), "round(radians(p_size), 6)"), "f_exp": (lambda: r6(call("exp", c("p_size") / 10)), "round(exp(p_size / 10.0), 6)"), "f_pi": (lambda: r6(call("pi")), "round(pi(), 6)"), "f_bits": (lambda: call("bit_count", c("p_partkey")), "CAST(bit_count(p_partkey) AS INT)"),
    "f_bin": (lambda: call("bin", c("p_partkey")), "bin(p_partkey)"), "f_hex": (lambda: call("hex", c("p_partkey")), "hex(p_partkey)"), "f_greatest": (lambda: call("greatest", c("p_size"), F.nullif(c("p_size") % 5, lit(0))), "CASE WHEN p_size % 5 <> 0 THEN greatest(p_size, p_size % 5) END"),
    "f_least": (lambda: call("least", c("p_size"), lit(20), c("p_size") * 2), "least(p_size, 20, p_size * 2)"), "f_cot": (lambda: r6(call("cot", c("p_size"))), "round(cot(p_size), 6)"),
})
expressions("arithmetic", "lineitem", "l_orderkey", {
    "a_div": (lambda: r6(N.divide(p(), q() - 10)), "CASE WHEN l_quantity <> 10 THEN round(l_extendedprice / (l_quantity - 10), 6) END"), "a_idiv": (lambda: N.int_divide(p(), q() - 10), "CASE WHEN l_quantity <> 10 THEN CAST(trunc(l_extendedprice / (l_quantity - 10)) AS BIGINT) END"),
    "a_and": (lambda: N.bit_and(c("l_partkey"), lit(6)), "CAST(l_partkey & 6 AS DECIMAL(20,0))"), "a_or": (lambda: N.bit_or(c("l_partkey"), lit(6)), "CAST(l_partkey | 6 AS DECIMAL(20,0))"), "a_xor": (lambda: N.bit_xor(c("l_partkey"), lit(6)), "CAST(xor(l_partkey, 6) AS DECIMAL(20,0))"),
    "a_not": (lambda: N.bit_not(c("l_partkey")), "CAST(18446744073709551615 - l_partkey::HUGEINT AS DECIMAL(20,0))"), "a_shl": (lambda: N.shift(c("l_partkey"), lit(3), True), "CAST(l_partkey * 8 AS DECIMAL(20,0))"), "a_lxor": (lambda: N.logical_xor(q() > 20, p() > 30000), "(l_quantity > 20) <> (l_extendedprice > 30000)"),
    "a_nse": (lambda: N.null_safe_equal(F.nullif(c("l_linenumber"), lit(1)), F.nullif(c("l_linenumber"), lit(2))), "nullif(l_linenumber, 1) IS NOT DISTINCT FROM nullif(l_linenumber, 2)"), "a_case": (lambda: F.when(q() > 30, "big").when(q() > 10, "mid"), "CASE WHEN l_quantity > 30 THEN 'big' WHEN l_quantity > 10 THEN 'mid' END"),
    "a_text": (lambda: number(F.concat(c("l_linenumber").cast("string"), lit("abc"))) + 1, "CAST(l_linenumber + 1 AS DOUBLE)"), "a_istrue": (lambda: F.coalesce(q() > 25, lit(False)), "(l_quantity > 25) IS TRUE"), "a_cast": (lambda: p().cast("decimal(12,1)"), "CAST(l_extendedprice AS DECIMAL(12,1))"),
})
n_, s_ = lambda: c("c_name"), lambda: c("c_mktsegment")
expressions("string_functions", "customer", "c_custkey", {
    "s_len": (lambda: call("length", n_()), "CAST(strlen(c_name) AS INT)"), "s_chars": (lambda: call("char_length", n_()), "CAST(length(c_name) AS INT)"), "s_upper": (lambda: call("upper", n_()), "upper(c_name)"), "s_lower": (lambda: call("lower", s_()), "lower(c_mktsegment)"), "s_concat": (lambda: call("concat", n_(), "-", s_()), "c_name || '-' || c_mktsegment"),
    "s_ws": (lambda: call("concat_ws", "/", n_(), F.nullif(s_(), lit("BUILDING")), s_()), "concat_ws('/', c_name, nullif(c_mktsegment, 'BUILDING'), c_mktsegment)"), "s_left": (lambda: call("left", n_(), 4), "left(c_name, 4)"), "s_right": (lambda: call("right", n_(), 4), "right(c_name, 4)"), "s_sub": (lambda: call("substring", n_(), 3, 5), "substring(c_name, 3, 5)"), "s_sub0": (lambda: call("mid", n_(), 0, 5), "''"),
    "s_subneg": (lambda: call("substr", n_(), -3), "right(c_name, 3)"), "s_instr": (lambda: call("instr", n_(), "0"), "CAST(instr(c_name, '0') AS INT)"), "s_locate": (lambda: call("locate", "0", n_(), 12), "CAST(CASE WHEN instr(substring(c_name, 12), '0') > 0 THEN instr(substring(c_name, 12), '0') + 11 ELSE 0 END AS INT)"), "s_lpad": (lambda: call("lpad", n_(), 25, "*"), "lpad(c_name, 25, '*')"), "s_rpad": (lambda: call("rpad", n_(), 25, "ab"), "rpad(c_name, 25, 'ab')"),
    "s_rep": (lambda: call("repeat", s_(), 2), "repeat(c_mktsegment, 2)"), "s_replace": (lambda: call("replace", n_(), "Customer", "C"), "replace(c_name, 'Customer', 'C')"), "s_rev": (lambda: call("reverse", n_()), "reverse(c_name)"), "s_trim": (lambda: call("trim", F.concat(lit("  "), n_(), lit(" "))), "c_name"), "s_md5": (lambda: call("md5", n_()), "md5(c_name)"), "s_sha": (lambda: call("sha1", n_()), "sha1(c_name)"), "s_sha2": (lambda: call("sha2", n_(), 256), "sha256(c_name)"),
    "s_ascii": (lambda: call("ascii", n_()), "ascii(c_name)"), "s_ord": (lambda: call("ord", n_()), "CAST(ascii(c_name) AS BIGINT)"), "s_hex": (lambda: call("hex", s_()), "hex(c_mktsegment)"), "s_b64": (lambda: call("to_base64", s_()), "base64(encode(c_mktsegment))"), "s_idx": (lambda: call("substring_index", n_(), "#", 1), "split_part(c_name, '#', 1)"), "s_insert": (lambda: call("insert", n_(), 1, 4, "XX"), "'XX' || substring(c_name, 5)"),
    "s_field": (lambda: call("field", s_(), "BUILDING", "MACHINERY"), "CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END"), "s_elt": (lambda: call("elt", 2, "a", s_()), "c_mktsegment"), "s_set": (lambda: call("find_in_set", s_(), "AUTOMOBILE,BUILDING"), "CAST(coalesce(list_position(['AUTOMOBILE', 'BUILDING'], c_mktsegment), 0) AS INT)"), "s_cmp": (lambda: call("strcmp", s_(), "FURNITURE"), "CASE WHEN c_mktsegment < 'FURNITURE' THEN -1 WHEN c_mktsegment > 'FURNITURE' THEN 1 ELSE 0 END"),
    "s_mask": (lambda: call("make_set", 5, s_(), n_(), lit("z")), "c_mktsegment || ',z'"), "s_exp": (lambda: call("export_set", c("c_custkey"), "1", "0", "", 4), "reverse(right(lpad(bin(c_custkey), 64, '0'), 4))"), "s_quote": (lambda: call("quote", F.concat(s_(), lit("'s"))), "'''' || c_mktsegment || '\\''s'''"), "s_like": (lambda: strings.like(n_(), "%1_"), "c_name LIKE '%1_'"),
    "s_re": (lambda: call("regexp_like", n_(), "0[1-3]$"), "regexp_matches(c_name, '0[1-3]$')"), "s_resub": (lambda: call("regexp_substr", n_(), "[1-9]+"), "nullif(regexp_extract(c_name, '[1-9]+'), '')"), "s_rerep": (lambda: call("regexp_replace", n_(), "0+", "_"), "regexp_replace(c_name, '0+', '_', 'g')"), "s_bits": (lambda: call("bit_length", s_()), "CAST(bit_length(c_mktsegment) AS INT)"), "s_crc": (lambda: call("crc32", lit("abc")), "CAST(891568578 AS BIGINT)"),
    "s_space": (lambda: F.concat(call("space", 2), s_()), "'  ' || c_mktsegment"), "s_unhex": (lambda: call("unhex", call("hex", s_())).cast("string"), "c_mktsegment"), "s_fmt": (lambda: call("format", c("c_acctbal"), 2), "format('{:,.2f}', c_acctbal)"), "s_if": (lambda: call("if", c("c_acctbal") > 0, "pos", "neg"), "CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END"), "s_nullif": (lambda: call("ifnull", call("nullif", s_(), "BUILDING"), "none"), "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')"),
})
d_ = lambda: c("o_orderdate")
expressions("date_functions", "orders", "o_orderkey", {
    "d_year": (lambda: call("year", d_()), "CAST(year(o_orderdate) AS INT)"), "d_quarter": (lambda: call("quarter", d_()), "CAST(quarter(o_orderdate) AS INT)"), "d_month": (lambda: call("month", d_()), "CAST(month(o_orderdate) AS INT)"), "d_day": (lambda: call("dayofmonth", d_()), "CAST(day(o_orderdate) AS INT)"), "d_dow": (lambda: call("dayofweek", d_()), "CAST(dayofweek(o_orderdate) + 1 AS INT)"), "d_wd": (lambda: call("weekday", d_()), "CAST(isodow(o_orderdate) - 1 AS INT)"),
    "d_doy": (lambda: call("dayofyear", d_()), "CAST(dayofyear(o_orderdate) AS INT)"), "d_iso": (lambda: call("weekofyear", d_()), "CAST(weekofyear(o_orderdate) AS INT)"), "d_week3": (lambda: D.week_parts(d_(), 3)[1], "CAST(weekofyear(o_orderdate) AS INT)"), "d_week0": (lambda: D.week_parts(d_(), 0)[1], "CAST(strftime(o_orderdate, '%U') AS INT)"), "d_week5": (lambda: D.week_parts(d_(), 5)[1], "CAST(strftime(o_orderdate, '%W') AS INT)"), "d_yw": (lambda: D.call_yearweek(d_(), 3), "CAST(yearweek(o_orderdate) AS INT)"),
    "d_name": (lambda: call("dayname", d_()), "dayname(o_orderdate)"), "d_mname": (lambda: call("monthname", d_()), "monthname(o_orderdate)"), "d_last": (lambda: call("last_day", d_()), "last_day(o_orderdate)"), "d_diff": (lambda: call("datediff", d_(), lit("1995-01-01").cast("date")), "CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT)"), "d_add": (lambda: D.add(d_(), lit(1), "MONTH"), "o_orderdate + INTERVAL 1 MONTH"), "d_sub": (lambda: D.add(d_(), lit(90), "MINUTE", -1), "o_orderdate - INTERVAL 90 MINUTE"),
    "d_comp": (lambda: D.add(d_(), lit("1 2:30:00"), "DAY_SECOND"), "o_orderdate + INTERVAL 1 DAY + INTERVAL 150 MINUTE"), "d_fmt": (lambda: D.format_date(d_(), "%Y/%m/%d %H:%i:%s %W %j"), "strftime(o_orderdate, '%Y/%m/%d %H:%M:%S %A %j')"), "d_days": (lambda: call("to_days", d_()), "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528 AS INT)"), "d_from": (lambda: call("from_days", call("to_days", d_())), "CAST(o_orderdate AS DATE)"), "d_unix": (lambda: call("unix_timestamp", d_()), "CAST(epoch(o_orderdate) AS BIGINT)"),
    "d_tsd": (lambda: D.months_apart(d_()), "CAST(datesub('month', TIMESTAMP '1992-01-15', o_orderdate) AS BIGINT)"), "d_date": (lambda: call("date", d_()), "CAST(o_orderdate AS DATE)"), "d_hm": (lambda: D.call_extract("HOUR_MINUTE", d_()), "CAST(hour(o_orderdate) * 100 + minute(o_orderdate) AS BIGINT)"), "d_sec": (lambda: call("time_to_sec", lit("-01:00:05")), "CAST(-3605 AS BIGINT)"), "d_tdiff": (lambda: call("timediff", lit("10:00:00"), lit("100:00:01")), "'-90:00:01'"),
    "d_str": (lambda: D.parse(F.date_format(d_(), "yyyy-MM-dd"), "%Y-%m-%d"), "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)"), "d_time": (lambda: call("sec_to_time", F.lit(3661)), "'01:01:01'"),
})
doc_ = lambda: F.to_json(F.struct(c("n_nationkey").alias("k"), F.struct(c("n_name").alias("n"), F.array(c("n_regionkey"), lit(7)).alias("r")).alias("v")))
_sqldoc = "to_json({'k': n_nationkey, 'v': {'n': n_name, 'r': [n_regionkey, 7]}})"
expressions("json_functions", "nation", "n_nationkey", {
    "j_ext": (lambda: call("json_extract", doc_(), "$.v.r[0]"), "CAST(n_regionkey AS VARCHAR)"), "j_unq": (lambda: call("json_unquote", call("json_extract", doc_(), "$.v.n")), "n_name"), "j_wild": (lambda: call("json_extract", doc_(), "$.v.r[*]"), "'[' || n_regionkey || ', 7]'"), "j_len": (lambda: call("json_length", doc_()), "CAST(2 AS INT)"), "j_keys": (lambda: call("json_keys", doc_(), "$.v"), "'[\"n\", \"r\"]'"), "j_depth": (lambda: call("json_depth", doc_()), "CAST(4 AS INT)"),
    "j_type": (lambda: call("json_type", doc_()), "'OBJECT'"), "j_valid": (lambda: call("json_valid", doc_()), "true"), "j_bad": (lambda: call("json_valid", lit("{")), "false"), "j_has": (lambda: call("json_contains", doc_(), "7", "$.v.r"), "true"), "j_path": (lambda: call("json_contains_path", doc_(), "all", "$.k", "$.x"), "false"), "j_set": (lambda: call("json_set", lit('{"a": 1}'), "$.b", c("n_nationkey")), "'{\"a\": 1, \"b\": ' || n_nationkey || '}'"), "j_rem": (lambda: call("json_remove", lit('{"a": 1, "b": [1, 2]}'), "$.b[0]"), "'{\"a\": 1, \"b\": [2]}'"),
    "j_merge": (lambda: call("json_merge_patch", lit('{"a": 1, "b": 2}'), lit('{"b": null, "c": 3}')), "'{\"a\": 1, \"c\": 3}'"), "j_pres": (lambda: call("json_merge_preserve", lit("[1]"), lit("2")), "'[1, 2]'"), "j_search": (lambda: call("json_search", doc_(), "one", n_name := c("n_name")), "'\"$.v.n\"'"), "j_app": (lambda: call("json_array_append", lit("[1]"), "$", 2), "'[1, 2]'"), "j_ins": (lambda: call("json_array_insert", lit("[1, 3]"), "$[1]", 2), "'[1, 2, 3]'"), "j_over": (lambda: call("json_overlaps", lit("[1, 2]"), lit("[2, 5]")), "true"), "j_val": (lambda: call("json_value", doc_(), "$.v.n"), "n_name"),
    "j_arr": (lambda: call("json_array", c("n_nationkey"), c("n_name"), lit(None)), "'[' || n_nationkey || ', \"' || n_name || '\", null]'"), "j_obj": (lambda: call("json_object", "k", c("n_nationkey")), "'{\"k\": ' || n_nationkey || '}'"), "j_quote": (lambda: call("json_quote", c("n_name")), "'\"' || n_name || '\"'"),
})
expressions("network_functions", "supplier", "s_suppkey", {
    "i_ntoa": (lambda: call("inet_ntoa", c("s_suppkey") + 167772160), "concat_ws('.', '10', '0', CAST(s_suppkey // 256 AS VARCHAR), CAST(s_suppkey % 256 AS VARCHAR))"), "i_aton": (lambda: call("inet_aton", call("inet_ntoa", c("s_suppkey"))), "CAST(s_suppkey AS BIGINT)"), "i_4": (lambda: call("is_ipv4", lit("256.1.1.1")), "false"), "i_6": (lambda: call("is_ipv6", lit("::1")), "true"),
    "i_6a": (lambda: call("inet6_ntoa", call("inet6_aton", lit("fe80::1"))), "'fe80::1'"), "i_map": (lambda: call("is_ipv4_mapped", call("inet6_aton", lit("::ffff:1.2.3.4"))), "true"), "i_uuid": (lambda: call("is_uuid", call("bin_to_uuid", call("uuid_to_bin", lit("6ccd780c-baba-1026-9564-5b8c656024db"), 1), 1)), "true"), "i_rt": (lambda: call("bin_to_uuid", call("uuid_to_bin", lit("6ccd780c-baba-1026-9564-5b8c656024db"))), "'6ccd780c-baba-1026-9564-5b8c656024db'"),
})
expressions("vector_functions", "embeddings", "vec_id", {
    "v_l2": (lambda: r6(call("vec_distance_l2_squared", c("embedding"), F.reverse("embedding"))), "round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: power(embedding[i]::DOUBLE - embedding[len(embedding) + 1 - i]::DOUBLE, 2))), 6)"),
    "v_cos": (lambda: r6(call("vec_distance_cosine", c("embedding"), c("embedding"))) + 0.0, "0.0::DOUBLE"), "v_eu": (lambda: r6(call("vec_distance_euclidean", c("embedding"), c("embedding"))), "0.0::DOUBLE"),
})
_pt = lambda: call("point", c("n_nationkey"), c("n_regionkey"))
expressions("spatial_functions", "nation", "n_nationkey", {
    "g_text": (lambda: call("st_astext", _pt()), "'POINT(' || n_nationkey || ' ' || n_regionkey || ')'"), "g_x": (lambda: call("st_x", _pt()), "CAST(n_nationkey AS DOUBLE)"), "g_dist": (lambda: r6(call("st_distance", _pt(), call("point", 0, 0))), "round(sqrt(n_nationkey * n_nationkey + n_regionkey * n_regionkey), 6)"), "g_area": (lambda: call("st_area", call("st_geomfromtext", lit("POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))"))), "15.0::DOUBLE"),
    "g_in": (lambda: call("st_within", _pt(), call("st_geomfromtext", lit("POLYGON((-1 -1,10 -1,10 10,-1 10,-1 -1))"))), "n_nationkey < 10"), "g_len": (lambda: call("st_length", call("linestring", call("point", 0, 0), call("point", 3, 4))), "5.0::DOUBLE"), "g_type": (lambda: call("st_geometrytype", _pt()), "'POINT'"), "g_rt": (lambda: call("st_astext", call("st_geomfromwkb", call("st_aswkb", _pt()))), "'POINT(' || n_nationkey || ' ' || n_regionkey || ')'"), "g_srid": (lambda: call("st_srid", call("st_srid", _pt(), 4326)), "CAST(4326 AS BIGINT)"),
    "g_int": (lambda: call("st_intersects", call("st_geomfromtext", lit("LINESTRING(0 0,10 10)")), _pt()), "n_nationkey = n_regionkey AND n_nationkey <= 10"), "g_hull": (lambda: call("st_area", call("st_convexhull", call("st_geomfromtext", lit("MULTIPOINT(0 0,2 0,2 2,0 2,1 1)")))), "4.0::DOUBLE"), "g_n": (lambda: call("st_numpoints", call("st_geomfromtext", lit("LINESTRING(0 0,1 1,2 2)"))), "CAST(3 AS INT)"), "g_json": (lambda: call("st_astext", call("st_geomfromgeojson", call("st_asgeojson", _pt()))), "'POINT(' || n_nationkey || ' ' || n_regionkey || ')'"),
})


@query("""SELECT n_nationkey, i, CAST(v AS BIGINT) AS v FROM (SELECT n_nationkey, unnest([1, 2]) AS i, unnest([n_regionkey, 7]) AS v FROM nation)""")
def json_table_rows(t):
    return json_table.json_table(t.nation.withColumn("doc", doc_()), "doc", "$.v.r[*]", [json_table.Col("i", kind="ordinality"), json_table.Col("v", "long", "$")], ["n_nationkey"])


@query("""SELECT e.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: power(e.embedding[i]::DOUBLE - z.embedding[i]::DOUBLE, 2))), 6) AS d FROM embeddings e, embeddings z WHERE z.vec_id = 0 ORDER BY d, e.vec_id LIMIT 10""")
def vector_order_by_distance(t):
    zero = t.embeddings.where("vec_id = 0").select(c("embedding").alias("q"))
    return sets.top_n(t.embeddings.crossJoin(zero).select("vec_id", r6(call("vec_distance_l2_squared", c("embedding"), c("q"))).alias("d")), 10, c("d"), c("vec_id"))


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_'']+'), lambda x: x <> '')) AS word FROM documents), i AS (SELECT word, doc_id, count(*) AS tf FROM w WHERE word IN ('the', 'of', 'idiot') GROUP BY 1, 2),
  d AS (SELECT word, count(*) AS df FROM i GROUP BY 1) SELECT doc_id, round(sum(tf * power(log10((SELECT count(*) FROM documents) / df::DOUBLE), 2)), 6) AS score FROM i JOIN d USING (word) GROUP BY 1""")
def fulltext_match(t):
    return fulltext.match(t.documents, "doc_id", ["text"], "the of idiot").select("doc_id", r6(c("score")).alias("score"))


# --- data changes -----------------------------------------------------------------------------------


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def update_where(t):
    return dml.update(t.nation, {"n_name": F.concat(F.upper("n_name"), lit("!"))}, c("n_regionkey") == 2).select("n_nationkey", "n_name")


@query("SELECT n_nationkey FROM nation WHERE NOT coalesce(nullif(n_regionkey, 1) > 2, false)")
def delete_where(t):
    return dml.delete(t.nation, F.nullif(c("n_regionkey"), lit(1)) > 2).select("n_nationkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN n_name || '+' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'NEW', 0")
def insert_on_duplicate_key(t):
    new = t.nation.where("n_nationkey < 3").unionByName(t._spark.sql("SELECT 100 AS n_nationkey, 'NEW' AS n_name, 0 AS n_regionkey"))
    return dml.insert(t.nation, new, ["n_nationkey"], "update", {"n_name": F.concat(c("old.n_name"), lit("+"))})


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'R' ELSE n_name END AS n_name FROM nation")
def replace_into(t):
    return dml.insert(t.nation, t.nation.where("n_nationkey < 3").withColumn("n_name", lit("R")), ["n_nationkey"], "replace").select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation")
def insert_ignore(t):
    return dml.insert(t.nation, t.nation.withColumn("n_name", lit("dup")), ["n_nationkey"], "ignore").select("n_nationkey", "n_name")


@query("SELECT n_nationkey, CASE WHEN r_name = 'ASIA' THEN 'in ' || r_name ELSE n_name END AS n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def update_join(t):
    return dml.update_join(t.nation, ["n_nationkey"], t.region.where("r_name = 'ASIA'"), c("t.n_regionkey") == c("o.r_regionkey"), {"n_name": F.concat(lit("in "), c("o.r_name"))}).select("n_nationkey", "n_name")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE')")
def delete_join(t):
    return dml.delete_join(t.nation, t.region.where("r_name = 'EUROPE'"), c("t.n_regionkey") == c("o.r_regionkey")).select("n_nationkey")


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 0")
def foreign_key_cascade(t):
    return dml.cascade(t.nation, ["n_regionkey"], t.region.where("r_regionkey > 0"), ["r_regionkey"], "cascade").select("n_nationkey", "n_regionkey")


@query("SELECT n_nationkey, nullif(n_regionkey, 0) AS n_regionkey FROM nation")
def foreign_key_set_null(t):
    return dml.cascade(t.nation, ["n_regionkey"], t.region.where("r_regionkey > 0"), ["r_regionkey"], "set_null").select("n_nationkey", "n_regionkey")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY c_mktsegment")
def sql_front_door(t):
    from .engine import Engine

    e = Engine(t._spark)
    e.register("customer", t.customer)
    e.sql("SET @least = 100")
    e.sql("PREPARE s FROM 'SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > ? GROUP BY c_mktsegment'")
    return e.sql("EXECUTE s USING @least")
