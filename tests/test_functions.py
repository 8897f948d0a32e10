"""Values of functions that SQL oracles can't check, NULL rules, and arity."""

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import FUNCTIONS, ArityError, Unsupported, call
from tidewheel.functions import datetime as D
from tidewheel.functions import numeric as N
from tidewheel.functions import spatial as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_registry_is_wide():
    assert len(FUNCTIONS) > 300


@pytest.mark.parametrize(
    ("name", "args", "want"),
    [
        ("soundex", ("Hello",), "H400"), ("make_set", (5, "a", "b", "c"), "a,c"), ("export_set", (5, "Y", "N", ",", 4), "Y,N,Y,N"), ("elt", (2, "a", "b"), "b"), ("field", ("b", "a", "b"), 2), ("insert", ("Quadratic", 3, 4, "What"), "QuWhattic"),
        ("insert", ("Quadratic", -1, 4, "What"), "Quadratic"), ("substring_index", ("www.a.b", ".", 2), "www.a"), ("greatest", (1, None), None), ("inet_aton", ("10.0.5.9",), 167773449), ("inet_aton", ("127.1",), 2130706433), ("ord", ("é",), 50089), ("length", ("é",), 2),
        ("json_type", ("[1]",), "ARRAY"), ("json_depth", ("[[]]",), 2), ("json_set", ('{"a": 1}', "$.a", 2, "$.b", "x"), '{"a": 2, "b": "x"}'), ("json_merge_preserve", ('{"a": 1}', '{"a": 2}'), '{"a": [1, 2]}'), ("json_search", ('["abc", {"x": "abd"}]', "all", "ab%"), '["$[0]", "$[1].x"]'),
        ("json_extract", ("not json", "$.a"), None), ("regexp_instr", ("dog cat dog", "dog", 2), 9), ("regexp_replace", ("abc def", "[a-z]+", "X", 1, 2), "abc X"), ("truncate", (-1.999, 1), -1.9), ("conv", ("ff", 16, 10), "255"), ("uncompressed_length", (None,), None),
        ("st_astext", (None,), None), ("st_geohash", (10.40744, 57.64911, 11), "u4pruydqqvj"), ("time_to_sec", ("100:00:00",), 360000), ("timediff", ("2000-01-01 00:00:00", "2000-01-02 00:00:00"), "-24:00:00"), ("get_format", ("DATE", "USA"), "%m.%d.%Y"), ("validate_password_strength", ("aB1!aB1!",), 100),
    ],
)
def test_values(spark, name, args, want):
    got = value(spark, call(name, *args))
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_round_trips(spark):
    assert value(spark, call("uncompress", call("compress", F.lit("abc" * 50)))) == b"abc" * 50
    wkt = "GEOMETRYCOLLECTION(POINT(1 2),POLYGON((0 0,1 0,1 1,0 0)),MULTIPOLYGON(((0 0,2 0,2 2,0 0))))"
    assert S.to_wkt(S.from_wkb(S.to_wkb(S.from_wkt(wkt)))[0]) == wkt
    assert S.from_geojson(S.to_geojson(S.from_wkt(wkt)))[0] == "GEOMETRYCOLLECTION"


def test_month_ends_and_weeks(spark):
    assert str(value(spark, D.add(F.lit("2020-01-31"), F.lit(1), "MONTH"))) == "2020-02-29 00:00:00"
    weeks = [value(spark, D.week_parts(F.lit("2008-02-20"), m)[1]) for m in range(8)]
    assert weeks == [7, 8, 7, 8, 8, 7, 8, 7]
    assert value(spark, D.call_yearweek(F.lit("1987-01-01"), 0)) == 198652


def test_zero_divisors_and_unsigned(spark):
    assert value(spark, N.divide(F.lit(1), F.lit(0))) is None
    assert value(spark, N.int_divide(F.lit(-7), F.lit(2))) == -3
    assert value(spark, N.bit_not(F.lit(0))) == 18446744073709551615
    assert value(spark, N.shift(F.lit(1), F.lit(64), True)) == 0
    assert value(spark, N.row_compare([F.lit(1), F.lit(None).cast("int")], "<", [F.lit(2), F.lit(1)])) is True


def test_errors():
    with pytest.raises(ArityError):
        call("pow", 1)
    with pytest.raises(Unsupported):
        call("json_schema_valid", "{}", "{}")
    with pytest.raises(KeyError):
        call("no_such_function")
