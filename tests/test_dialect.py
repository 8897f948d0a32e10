"""What the front door makes of statements."""

import pytest

from tidewheel.functions import json as J
from tidewheel.plans.engine import Engine
from tidewheel.plans.sql_queries import QUERIES


@pytest.fixture
def pairs(spark):
    e = Engine(spark)
    e.register("big", spark.range(2_000).selectExpr("id % 4 AS k", "id % 3 AS g"))
    e.register("small", spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "x"), (9, "x")], "k long, s string"))
    return e


def joined_rows(df):
    """The rows that the plan's joins gave, as its metrics count them."""
    df.collect()
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
        if name.endswith("JoinExec"):
            out += p.metrics().apply("numOutputRows").value()
    return out


def test_pairs_of_equal_keys_are_counted_without_being_made(pairs):
    df = pairs.sql("SELECT a.k, COUNT(*) AS n FROM big a JOIN big b ON a.k = b.k GROUP BY a.k")
    assert joined_rows(df) == 4
    assert sorted(map(tuple, df.collect())) == [(k, 500**2) for k in range(4)]
    assert df.schema.simpleString() == "struct<k:bigint,n:bigint>"


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT b.s, COUNT(*) AS n, a.g FROM big a JOIN small b ON a.k = b.k GROUP BY 1, a.g", [("x", 333, 0), ("x", 333, 1), ("x", 334, 2), ("y", 166, 0), ("y", 167, 1), ("y", 167, 2)]),
        ("SELECT COUNT(*) AS n, a.s FROM small a JOIN small b ON a.k <=> b.k AND a.s = b.s GROUP BY a.s", [(4, "x"), (1, "y")]),
        ("SELECT a.s, COUNT(*) AS n FROM small a JOIN small b ON a.k = b.k AND a.s < b.s GROUP BY a.s", [("x", 1)]),
        ("SELECT a.s, COUNT(*) AS n FROM small a JOIN small b ON a.k = b.k OR a.s = b.s GROUP BY a.s", [("x", 17), ("y", 2)]),
        ("SELECT a.s, COUNT(*) AS n FROM small a JOIN small b ON NOT (a.k = b.k) GROUP BY a.s", [("x", 8), ("y", 2)]),
        ("SELECT a.s, COUNT(*) AS n FROM small a LEFT JOIN small b ON a.k = b.k GROUP BY a.s", [("x", 5), ("y", 2)]),
        ("SELECT a.s, COUNT(b.k) AS n FROM small a JOIN small b ON a.s = b.s GROUP BY a.s", [("x", 12), ("y", 1)]),
        ("SELECT a.s, COUNT(*) AS n FROM small a JOIN small b ON a.s = b.s WHERE b.k > 1 GROUP BY a.s", [("x", 8)]),
        ("SELECT a.s, COUNT(*) AS n FROM small a JOIN small b ON a.s = b.s GROUP BY a.s HAVING COUNT(*) > 1", [("x", 16)]),
        ("SELECT a.s, COUNT(*) AS n FROM small a JOIN small b ON a.s = b.s JOIN small c ON b.s = c.s GROUP BY a.s ORDER BY COUNT(*)", [("x", 64), ("y", 1)]),
        ("SELECT a.s, COUNT(*) AS n FROM small a JOIN (SELECT * FROM small WHERE k = 1) AS b ON a.k = b.k GROUP BY a.s", [("x", 2), ("y", 2)]),
    ],
)
def test_counts_of_joins(pairs, query, want):
    assert sorted(map(tuple, pairs.sql(query).collect())) == sorted(want)


@pytest.fixture
def customers(spark, tmp_path):
    """A table of one file with one group of rows, as most writers leave it."""
    e = Engine(spark)
    spark.range(0, 50_000, 1, 1).selectExpr("id AS k", "CAST(id % 25 AS INT) AS n", "uuid() AS name").write.parquet(str(tmp_path / "customers"))
    e.register("customers", spark.read.parquet(str(tmp_path / "customers")))
    return e


def arrow_nodes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_rows_of_one_file_are_dealt_to_all_cores(customers, spark):
    assert spark.table("customers").rdd.getNumPartitions() == 1
    df = customers.sql("SELECT k, ST_X(POINT(k, n)) AS x FROM customers WHERE k >= 0")
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 8 and max(sizes) < 50_000 / 4 and sum(sizes) == 50_000
    assert df.selectExpr("count(DISTINCT k)", "max(abs(x - k))").first() == (50_000, 0.0)
    qualified = customers.sql("SELECT customers.k, c2.n FROM customers JOIN customers c2 ON customers.k = c2.k WHERE ST_Y(POINT(customers.k, c2.n)) = 3")
    assert qualified.count() == 2_000
    named = customers.sql("WITH t AS (SELECT k, n FROM customers WHERE k < 10) SELECT t.k, ST_ASTEXT(POINT(t.n, 0)) AS p, (SELECT MAX(ST_X(POINT(c.n, 1))) FROM customers c) AS m FROM t WHERE t.k = 7")
    assert [tuple(r) for r in named.collect()] == [(7, "POINT(7 0)", 24.0)]
    assert customers.sql("SELECT ST_X(POINT(customers.k, 1)) AS x FROM customers ORDER BY customers.k DESC LIMIT 2").collect() == [(49_999.0,), (49_998.0,)]


def test_functions_within_functions_go_to_python_once(customers):
    df = customers.sql("SELECT k, ST_ASTEXT(ST_SWAPXY(ST_X(POINT(k, n), 1))) AS p, JSON_EXTRACT(JSON_OBJECT('k', k, 'v', JSON_ARRAY(n, 2)), '$.v[0]') AS v, ST_ASTEXT(LINESTRING(POINT(0, 0), POINT(k, n))) AS l FROM customers WHERE k < 3")
    assert arrow_nodes(df) == 1
    assert sorted(map(tuple, df.collect())) == [(k, f"POINT({k} 1)", str(k), f"LINESTRING(0 0,{k} {k})") for k in range(3)]


def test_functions_of_literals_run_once(customers):
    df = customers.sql("SELECT ST_AREA(ST_GEOMFROMTEXT('POLYGON((0 0,4 0,4 4,0 4,0 0))')) AS a, ST_ASTEXT(ST_POINTN(LINESTRING(POINT(0, -1.5), POINT(3, 4)), 1)) AS p, JSON_LENGTH('[1, 2]') AS n, JSON_EXTRACT('not json', '$') AS bad, ST_ISEMPTY(NULL) AS nothing, JSON_PRETTY('[\"it''s\\\\n\"]') AS t FROM customers LIMIT 1")
    assert arrow_nodes(df) == 0
    assert df.collect() == [(16.0, "POINT(0 -1.5)", 2, None, None, '[\n  "it\'s\\n"\n]')]
    assert df.schema.simpleString() == "struct<a:double,p:string,n:int,bad:string,nothing:boolean,t:string>"
    assert customers.sql("SELECT COUNT(DISTINCT HEX(RANDOM_BYTES(8))) AS n FROM customers").first()[0] == 50_000


def test_what_may_not_be_settled_before_the_run(customers):
    with pytest.raises(Exception, match="SRID 0"):
        customers.sql("SELECT ST_LENGTH(LINESTRING(POINT(0, 0), POINT(3, 4)), 'metre')").collect()
    calls = []
    customers.register_function("counted", lambda x: calls.append(x) or f"{x}!")
    assert customers.sql("SELECT COUNTED('a') AS v FROM customers LIMIT 2").collect() == [("a!",), ("a!",)]
    assert calls == []


def test_steps_keep_types_and_nulls(customers):
    df = customers.sql("SELECT k, JSON_SET('{}', '$.n', JSON_LENGTH(IF(k = 1, NULL, '[1, 2]'))) AS v, ST_X(ST_POINTN(LINESTRING(POINT(0, 0), POINT(k, 1)), JSON_LENGTH(IF(k = 2, '[1, 2, 3]', '[1, 2]')))) AS x FROM customers WHERE k < 3")
    assert sorted(map(tuple, df.collect())) == [(0, '{"n": 2}', 0.0), (1, None, 1.0), (2, '{"n": 2}', None)]


def test_prepared_values_stay_in_order(customers):
    customers.sql("PREPARE s FROM 'SELECT ST_ASTEXT(LINESTRING(POINT(?, 0), POINT(?, 0))) AS l FROM customers WHERE k = ?'")
    customers.sql("SET @a = 1, @b = 2")
    assert customers.sql("EXECUTE s USING @a, @b, @a").collect() == [("LINESTRING(1 0,2 0)",)]


@pytest.mark.parametrize("name", ["sql_spatial_measures", "sql_spatial_parts", "sql_json"])
def test_a_row_of_a_statement_goes_to_python_once(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.1")
    assert arrow_nodes(df) == 1
    assert df.rdd.getNumPartitions() >= 8


def test_a_path_is_parsed_once():
    assert J.parse_path("$.a[1]") is J.parse_path("$.a[1]")
    assert J.parse_path("$.a[1]") == [("key", "a"), ("at", 1)]
