"""NULLs, empty inputs, duplicates and ties of joins, sets, windows and data changes; sources and the front door."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.operators import dml, joins, json_table, recursive, sets, windows
from tidewheel.plans.engine import Engine, UnsupportedStatement, translate
from tidewheel.sources import delimited, tables


@pytest.fixture
def ab(spark):
    return spark.createDataFrame([(1, 1), (2, None), (None, 3), (2, 2)], "x int, y int"), spark.createDataFrame([(1,), (None,), (5,)], "k int")


def test_anti_joins_and_nulls(ab, spark):
    a, b = ab
    assert joins.not_in(a, "x", b, "k").count() == 0
    assert joins.not_in(a, "x", b.where("k is not null"), "k").count() == 2
    assert joins.not_in(a, "x", b.limit(0), "k").count() == 4
    assert joins.anti_not_in(a, b, F.col("x") == F.col("k")).count() == 0
    assert joins.join(a, b, F.col("x") == F.col("k"), "anti_include_nulls").count() == 3


def test_range_join_matches_nested_loop(spark):
    p = spark.range(200).select((F.col("id") * 0.37).alias("v"))
    r = spark.range(50).select(F.col("id").alias("r"), (F.col("id") * 1.5).alias("lo"), (F.col("id") * 1.5 + F.col("id") % 7).alias("hi"))
    want = p.join(r, F.col("v").between(F.col("lo"), F.col("hi"))).count()
    assert joins.range_join(p, r, "v", "lo", "hi", 2.0).count() == want
    assert joins.range_join(p.limit(0), r, "v", "lo", "hi", 2.0).count() == 0


def test_sets(ab, spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (None,)], "k int")
    assert sorted(r[0] or 0 for r in sets.except_(a, b, False).collect()) == [1, 2]
    assert [r[0] for r in sets.except_(a, b).collect()] == [2]
    assert sets.intersect(a, b).count() == 2
    with pytest.raises(sets.TooManyRows):
        sets.max_one_row(a)
    assert sets.max_one_row(a.limit(0)) is None


def test_recursion(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "a int, b int")
    got = recursive.fixpoint(spark.sql("select 0 as x"), lambda n: e.join(n, F.col("a") == F.col("x")).select("b"))
    assert sorted(r[0] for r in got.collect()) == [0, 1, 2]
    with pytest.raises(recursive.RecursionLimit):
        recursive.fixpoint(spark.sql("select 0 as x"), lambda n: n.select(F.col("x") + 1), 3)


def test_frames():
    assert len(windows.frames()) == 32
    assert windows.inverted(1, -1)
    assert not windows.inverted(None, 0)


def test_inverted_frame_is_empty(spark):
    w = Window.orderBy("id")
    r = spark.range(3).select(windows.over(F.count(F.lit(1)), w, "rows", 2, 1, empty=0).alias("n")).collect()
    assert [x[0] for x in r] == [0, 0, 0]


def test_json_table_nested_siblings(spark):
    doc = '{"a": [{"x": 1, "b": [1, 2], "c": ["p"]}, {"b": []}]}'
    cols = [json_table.Col("n", kind="ordinality"), json_table.Col("x", "int", "$.x", empty=0), json_table.Col("has", path="$.c", kind="exists"), json_table.Nested("$.b[*]", [json_table.Col("b", "int", "$")]), json_table.Nested("$.c[*]", [json_table.Col("c", "string", "$")])]
    df = spark.createDataFrame([(1, doc), (2, None), (3, "{")], "id int, doc string")
    got = [tuple(r) for r in json_table.json_table(df, "doc", "$.a[*]", cols, ["id"]).collect()]
    assert got == [(1, 1, 1, 1, 1, None), (1, 1, 1, 1, 2, None), (1, 1, 1, 1, None, "p"), (1, 2, 0, 0, None, None)]


def test_data_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    with pytest.raises(dml.ConstraintError):
        dml.insert(t, new, ["k"])
    assert sorted(map(tuple, dml.insert(t, new, ["k"], "ignore").collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(map(tuple, dml.insert(t, new, ["k"], "replace").collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(map(tuple, dml.insert(t, new, ["k"], "update", {"v": F.concat("old.v", "new.v")}).collect())) == [(1, "a"), (2, "bx"), (3, "y")]
    assert dml.update(t, {"v": F.lit("z")}, limit=1, order=[F.col("k").desc()]).where("v = 'z'").first()[0] == 2
    with pytest.raises(dml.ConstraintError):
        dml.check_foreign_key(new, ["k"], t, ["k"])
    with pytest.raises(dml.ConstraintError):
        dml.check_rows(t, F.col("k") > 1, "k_above_1")
    filled = dml.fill(spark.createDataFrame([("q",)], "v string"), ["k", "v", "n"], generated={"n": F.length("v")}, auto=("k", 7))
    assert tuple(filled.first()) == (8, "q", 1)


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, v string")
    delimited.into_outfile(df, str(tmp_path / "out"), ",", '"')
    back = delimited.load_data(spark, str(tmp_path / "out"), "k int, v string", ",", '"')
    assert sorted(map(tuple, back.collect())) == [(1, "a,b"), (2, None)]


def test_snapshots(spark, tmp_path):
    s = tables.Snapshots(spark, str(tmp_path / "t"))
    s.write(spark.range(2))
    s.write(spark.range(5))
    assert (s.read().count(), s.read(1).count()) == (5, 2)
    with pytest.raises(ValueError):
        s.read(9)


def test_front_door(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"))
    e.sql("SET @x = 2, @y := 'b'")
    assert e.sql("SELECT v FROM t WHERE k = @x AND v = @y").first()[0] == "b"
    assert e.sql("SELECT k FROM t ORDER BY k LIMIT 1, 2").count() == 2
    e.sql("SELECT max(k) INTO @m FROM t")
    assert e.variables["m"] == 3
    e.sql("CREATE VIEW w AS SELECT k FROM t WHERE k > 1")
    assert e.sql("SELECT count(*) FROM w").first()[0] == 2
    e.procedures["twice"] = lambda eng, n: eng.sql(f"SELECT {n} * 2 AS r")
    assert e.sql("CALL twice(4)").first()[0] == 8
    e.sql("SELECT SQL_CALC_FOUND_ROWS k FROM t LIMIT 1")
    assert e.sql("SELECT FOUND_ROWS() AS n").first()[0] == 3
    assert e.sql("SHOW COLUMNS FROM t").count() == 2
    assert e.information_schema("columns").where("table_name = 't'").count() == 2
    assert translate("SELECT 'LIMIT 1, 2', LENGTH(v) FROM t LIMIT 3, 4") == "SELECT 'LIMIT 1, 2', octet_length(v) FROM t LIMIT 4 OFFSET 3"
    with pytest.raises(UnsupportedStatement):
        e.sql("START REPLICA")


def test_range_join_of_long_ranges(spark):
    """Ranges of any length and outer rows, against a nested loop."""
    points = [(i, v) for i, v in enumerate([0.5, 3.0, 40.0, 999.0, 5000.0, None])]
    ranges = [("a", 0.0, 1.0), ("b", 2.0, 4000.0), ("c", 39.5, 40.5), ("d", 900.0, 1000.0), ("e", None, 1.0), ("f", 5.0, 4.0)]
    p, r = spark.createDataFrame(points, "i int, v double"), spark.createDataFrame(ranges, "name string, lo double, hi double")
    want = sorted((i, n) for i, v in points for n, lo, hi in ranges if None not in (v, lo, hi) and lo <= v <= hi)
    assert sorted(map(tuple, joins.range_join(p, r, "v", "lo", "hi", 1.0).select("i", "name").collect())) == want
    left = sorted((x[0], x[1] or "") for x in joins.range_join(p, r, "v", "lo", "hi", 1.0, "left").select("i", "name").collect())
    missing = [(i, "") for i, _ in points if i not in {a for a, _ in want}]
    assert left == sorted(want + missing)


def test_anti_join_by_kind_avoids_pairs_of_rows(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "x int"), spark.createDataFrame([(2,), (3,)], "y int")
    got = joins.join(a, b, F.col("x") == F.col("y"), "anti")
    assert [r.x for r in got.collect()] == [1]
    assert "BroadcastNestedLoopJoin BuildRight, LeftAnti" not in got._jdf.queryExecution().executedPlan().toString()
    with_null = b.union(spark.createDataFrame([(None,)], "y int"))
    assert joins.join(a, with_null, F.col("x") == F.col("y"), "anti").count() == 0


def test_units_of_length(spark):
    from tidewheel.functions import call

    line = lambda srid: call("st_geomfromtext", F.lit("LINESTRING(0 0,3 4)"), F.lit(srid))
    assert spark.range(1).select(call("st_length", line(3857), "kilometre")).first()[0] == pytest.approx(0.005)
    for bad in (call("st_length", line(0), "metre"), call("st_length", line(3857), "parsec")):
        with pytest.raises(Exception, match="unit"):
            spark.range(1).select(bad).collect()
