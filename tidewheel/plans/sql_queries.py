"""Queries whose path is the SQL front door: statements of the dialect, and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import TABLES, prepare, table
from .engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, *statements: str) -> Engine:
    """A session that has the tables which the statements name."""
    e = Engine(prepare(spark))
    named = set(re.findall(r"\w+", " ".join(statements).lower()))
    for n in TABLES:
        if n in named:
            e.register(n, table(spark, sf_dir, n))
    return e


def script(name: str, expected: str, *statements: str, setup: Callable[[Engine], None] | None = None) -> None:
    """Statements run one after another in a session; the last one's rows are the query's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, *statements)
        if setup:
            setup(e)
        out = None
        for s in statements:
            out = e.sql(s)
        return out

    QUERIES[name], SQL[name] = run, expected


def calls(name: str, source: str, key: str, items: dict[str, tuple[str, str]]) -> None:
    """Expressions over a whole table: alias -> (the dialect's, DuckDB's)."""
    script(name, f"SELECT {key}, " + ", ".join(f"{b} AS {a}" for a, (_, b) in items.items()) + f" FROM {source}", f"SELECT {key}, " + ", ".join(f"{x} AS {a}" for a, (x, _) in items.items()) + f" FROM {source}")


# --- operators and casts --------------------------------------------------------------------------

calls("sql_operators", "lineitem", "l_orderkey, l_linenumber", {
    "o_greatest": ("GREATEST(l_linenumber, NULL)", "CAST(NULL AS INT)"), "o_least": ("LEAST(l_linenumber, 3)", "least(l_linenumber, 3)"), "o_not": ("~l_partkey", "CAST(18446744073709551615 - l_partkey::HUGEINT AS DECIMAL(20,0))"),
    "o_and": ("l_partkey & 6", "CAST(l_partkey & 6 AS DECIMAL(20,0))"), "o_or": ("l_partkey | 6", "CAST(l_partkey | 6 AS DECIMAL(20,0))"), "o_xor": ("l_partkey ^ 6", "CAST(xor(l_partkey, 6) AS DECIMAL(20,0))"),
    "o_shl": ("l_partkey << 3", "CAST(l_partkey * 8 AS DECIMAL(20,0))"), "o_shr": ("l_partkey >> 2", "CAST(l_partkey // 4 AS DECIMAL(20,0))"), "o_idiv": ("l_partkey DIV 7", "CAST(l_partkey // 7 AS BIGINT)"), "o_mod": ("l_partkey % 7", "l_partkey % 7"),
    "o_mod0": ("l_partkey MOD 0", "CAST(NULL AS BIGINT)"), "o_lxor": ("(l_quantity > 20) XOR (l_linenumber = 1)", "(l_quantity > 20) <> (l_linenumber = 1)"), "o_or2": ("l_quantity > 40 || l_linenumber = 2", "l_quantity > 40 OR l_linenumber = 2"),
    "o_and2": ("l_quantity > 40 && NOT l_linenumber = 2", "l_quantity > 40 AND NOT l_linenumber = 2"), "o_nse": ("NULLIF(l_linenumber, 1) <=> NULL", "nullif(l_linenumber, 1) IS NOT DISTINCT FROM NULL"), "o_tuple": ("(l_linenumber, l_suppkey) > (2, 5)", "(l_linenumber, l_suppkey) > (2, 5)"),
    "o_in": ("(l_linenumber, l_returnflag) IN ((1, 'A'), (2, 'R'))", "(l_linenumber, l_returnflag) IN ((1, 'A'), (2, 'R'))"), "o_text": ("'2abc' + l_linenumber", "CAST(2 + l_linenumber AS DOUBLE)"), "o_neg": ("-l_linenumber", "-l_linenumber"),
    "o_between": ("l_quantity NOT BETWEEN 10 AND 40", "l_quantity NOT BETWEEN 10 AND 40"), "o_like": ("l_returnflag LIKE 'a%'", "l_returnflag LIKE 'a%'"), "o_esc": ("CONCAT(l_returnflag, '%') LIKE 'A|%' ESCAPE '|'", "l_returnflag = 'A'"),
    "o_re": ("l_shipdate REGEXP '-0[1-3]-'", "regexp_matches(CAST(l_shipdate AS VARCHAR), '-0[1-3]-')"), "o_ci": ("l_returnflag = 'a' COLLATE utf8mb4_0900_ai_ci", "lower(l_returnflag) = 'a'"), "o_cs": ("l_returnflag = 'a'", "l_returnflag = 'a'"),
    "o_if": ("IF(l_linenumber, 'some', 'none')", "'some'"), "o_case": ("CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END", "CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END"), "o_isu": ("(l_quantity > NULL) IS UNKNOWN", "true"),
    "o_ist": ("(l_quantity > 25) IS NOT TRUE", "NOT l_quantity > 25"), "o_coal": ("COALESCE(NULL, NULLIF(l_linenumber, 2), 0)", "coalesce(nullif(l_linenumber, 2), 0)"), "o_isnull": ("ISNULL(NULLIF(l_linenumber, 2))", "l_linenumber = 2"), "o_ifnull": ("IFNULL(NULLIF(l_linenumber, 2), 9)", "coalesce(nullif(l_linenumber, 2), 9)"),
})
calls("sql_casts", "part", "p_partkey", {
    "c_signed": ("CAST(CONCAT(p_partkey, 'abc') AS SIGNED)", "p_partkey"), "c_unsigned": ("CAST(-p_partkey AS UNSIGNED)", "CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE 18446744073709551616::HUGEINT - p_partkey END AS DECIMAL(20,0))"), "c_char": ("CAST(p_partkey AS CHAR)", "CAST(p_partkey AS VARCHAR)"), "c_char2": ("CAST(p_name AS CHAR(3))", "left(p_name, 3)"),
    "c_dec": ("CAST(p_retailprice AS DECIMAL(10,1))", "CAST(p_retailprice AS DECIMAL(10,1))"), "c_double": ("CAST(CONCAT('1.5e', p_partkey % 3) AS DOUBLE)", "CAST('1.5e' || (p_partkey % 3) AS DOUBLE)"), "c_date": ("CAST('2020-02-29' AS DATE)", "DATE '2020-02-29'"), "c_bad": ("CAST('2021-02-29' AS DATE)", "CAST(NULL AS DATE)"),
    "c_dt": ("CAST('2020-02-29 10:11:12' AS DATETIME)", "TIMESTAMP '2020-02-29 10:11:12'"), "c_time": ("CAST('10:11:12' AS TIME)", "'10:11:12'"), "c_year": ("CAST('2020-05-06' AS YEAR)", "CAST(2020 AS INT)"), "c_json": ("CAST('{\"b\": 1,  \"a\": [2]}' AS JSON)", "'{\"a\": [2], \"b\": 1}'"),
    "c_bin": ("HEX(CAST(p_partkey AS BINARY))", "hex(CAST(p_partkey AS VARCHAR))"), "c_bin2": ("HEX(BINARY 'ab')", "'6162'"), "c_using": ("CONVERT(CONCAT('é', p_partkey) USING ascii)", "'?' || p_partkey"), "c_utf": ("CONVERT(p_name USING utf8mb4)", "p_name"), "c_conv": ("CONVERT('17', SIGNED)", "CAST(17 AS BIGINT)"),
    "c_real": ("CAST('2.5' AS REAL)", "CAST(2.5 AS DOUBLE)"), "c_hex": ("CONVERT(CONCAT(X'4142', 0x43) USING utf8mb4)", "'ABC'"), "c_bits": ("b'101' + 0", "CAST(5 AS INT)"), "c_nc": ("NAME_CONST('n', p_size)", "p_size"),
})

# --- functions by family -------------------------------------------------------------------------------

calls("sql_math", "part", "p_partkey", {
    "m_ceiling": ("CEILING(p_retailprice)", "CAST(ceil(p_retailprice) AS BIGINT)"), "m_conv": ("CONV(p_partkey, 10, 2)", "bin(p_partkey)"), "m_oct": ("OCT(p_partkey)", "format('{:o}', p_partkey)"), "m_power": ("POWER(p_size, 2)", "CAST(p_size * p_size AS DOUBLE)"), "m_pow": ("POW(2, p_size % 8)", "CAST(power(2, p_size % 8) AS DOUBLE)"),
    "m_rand": ("RAND() BETWEEN 0 AND 1", "true"), "m_rands": ("RAND(7) < 1", "true"), "m_trunc": ("ROUND(TRUNCATE(p_retailprice, 1), 6)", "round(trunc(p_retailprice * 10) / 10, 6)"), "m_log": ("ROUND(LOG(2, p_size), 6)", "round(ln(p_size) / ln(2), 6)"), "m_log0": ("LOG(-1)", "CAST(NULL AS DOUBLE)"),
    "m_crc": ("CRC32('MySQL')", "CAST(3259397556 AS BIGINT)"), "m_format": ("FORMAT(p_retailprice, 2)", "format('{:,.2f}', p_retailprice)"), "m_mod": ("MOD(p_size, 7)", "p_size % 7"), "m_sqrt": ("ROUND(SQRT(p_size), 6)", "round(sqrt(p_size), 6)"), "m_bitc": ("CAST(BIT_COUNT(p_partkey) AS SIGNED)", "CAST(bit_count(p_partkey) AS BIGINT)"),
    "m_atan": ("ROUND(ATAN(p_size, 2), 6)", "round(atan2(p_size, 2), 6)"), "m_sign": ("CAST(SIGN(p_size - 20) AS SIGNED)", "CAST(sign(p_size - 20) AS BIGINT)"),
})
calls("sql_strings", "customer", "c_custkey", {
    "t_char": ("CHAR(77, 121, 83)", "'MyS'"), "t_character_length": ("CHARACTER_LENGTH(c_name)", "CAST(length(c_name) AS INT)"), "t_charset": ("CHARSET(c_name)", "'utf8mb4'"), "t_collation": ("COLLATION(c_name)", "'utf8mb4_0900_bin'"), "t_coer": ("COERCIBILITY(c_name) >= 0", "true"),
    "t_compress": ("CONVERT(UNCOMPRESS(COMPRESS(c_name)) USING utf8mb4)", "c_name"), "t_ulen": ("CAST(UNCOMPRESSED_LENGTH(COMPRESS(c_name)) AS SIGNED)", "CAST(length(c_name) AS BIGINT)"), "t_b64": ("CONVERT(FROM_BASE64(TO_BASE64(c_name)) USING utf8mb4)", "c_name"), "t_isbin": ("IS_BINARY(c_name)", "false"),
    "t_lcase": ("LCASE(c_mktsegment)", "lower(c_mktsegment)"), "t_ucase": ("UCASE(c_name)", "upper(c_name)"), "t_ltrim": ("LTRIM(CONCAT('  ', c_name))", "c_name"), "t_rtrim": ("RTRIM(CONCAT(c_name, '  '))", "c_name"), "t_octet": ("OCTET_LENGTH(CONCAT('é', c_name))", "CAST(strlen('é' || c_name) AS INT)"),
    "t_rnd": ("LENGTH(HEX(RANDOM_BYTES(8)))", "CAST(16 AS INT)"), "t_instr": ("CAST(REGEXP_INSTR(c_name, '[1-9]') AS SIGNED)", "CAST(CASE WHEN regexp_matches(c_name, '[1-9]') THEN strlen(regexp_extract(c_name, '^[^1-9]*')) + 1 ELSE 0 END AS BIGINT)"),
    "t_sha": ("SHA(c_name)", "sha1(c_name)"), "t_sha1": ("SHA1(c_name)", "sha1(c_name)"), "t_sha2": ("SHA2(c_name, 256)", "sha256(c_name)"), "t_md5": ("MD5(c_name)", "md5(c_name)"), "t_soundex": ("SOUNDEX('Robert')", "'R163'"), "t_strong": ("VALIDATE_PASSWORD_STRENGTH('abc') < 50", "true"),
    "t_trim": ("TRIM(LEADING 'C' FROM c_name)", "ltrim(c_name, 'C')"), "t_trim2": ("TRIM(BOTH '00' FROM '00x0000')", "'x'"), "t_pos": ("POSITION('#' IN c_name)", "CAST(instr(c_name, '#') AS INT)"), "t_sub": ("SUBSTRING(c_name FROM 2 FOR 3)", "substring(c_name, 2, 3)"), "t_mid": ("MID(c_name, -3, 2)", "substring(right(c_name, 3), 1, 2)"),
    "t_ins": ("INSERT(c_name, 1, 8, 'C')", "'C' || substring(c_name, 9)"), "t_elt": ("ELT(2, 'a', c_name)", "c_name"), "t_field": ("FIELD(c_mktsegment, 'BUILDING')", "CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS INT)"), "t_export": ("EXPORT_SET(5, 'Y', 'N', ',', 4)", "'Y,N,Y,N'"), "t_make": ("MAKE_SET(5, 'a', 'b', 'c')", "'a,c'"),
    "t_lpad": ("LPAD(c_custkey, 8, '*')", "lpad(CAST(c_custkey AS VARCHAR), 8, '*')"), "t_rpad": ("RPAD(c_custkey, 8, '*')", "rpad(CAST(c_custkey AS VARCHAR), 8, '*')"), "t_rep": ("REPEAT('ab', 2)", "'abab'"), "t_space": ("CONCAT('[', SPACE(2), ']')", "'[  ]'"), "t_rev": ("REVERSE(c_name)", "reverse(c_name)"),
    "t_idx": ("SUBSTRING_INDEX(c_name, '#', -1)", "split_part(c_name, '#', 2)"), "t_strcmp": ("CAST(STRCMP(c_mktsegment, 'BUILDING') AS SIGNED)", "CAST(CASE WHEN c_mktsegment < 'BUILDING' THEN -1 WHEN c_mktsegment > 'BUILDING' THEN 1 ELSE 0 END AS BIGINT)"), "t_ord": ("CAST(ORD(c_name) AS SIGNED)", "CAST(67 AS BIGINT)"), "t_ascii": ("CAST(ASCII(c_name) AS SIGNED)", "CAST(67 AS BIGINT)"),
    "t_bin": ("BIN(c_custkey)", "bin(c_custkey)"), "t_hex": ("HEX(c_custkey)", "hex(c_custkey)"), "t_unhex": ("CONVERT(UNHEX('4142') USING utf8mb4)", "'AB'"), "t_set": ("CAST(FIND_IN_SET('b', 'a,b') AS SIGNED)", "CAST(2 AS BIGINT)"), "t_quote": ("QUOTE(c_mktsegment)", "'''' || c_mktsegment || ''''"),
    "t_bits": ("BIT_LENGTH(c_mktsegment)", "CAST(strlen(c_mktsegment) * 8 AS INT)"), "t_relike": ("REGEXP_LIKE(c_name, 'CUSTOMER', 'i')", "true"), "t_resub": ("REGEXP_SUBSTR(c_name, '[a-z]+')", "'ustomer'"), "t_rerep": ("REGEXP_REPLACE(c_name, '0+', '-')", "regexp_replace(c_name, '0+', '-', 'g')"),
})
calls("sql_dates", "orders", "o_orderkey", {
    "d_add": ("DATE_ADD(o_orderdate, INTERVAL 1 MONTH)", "o_orderdate + INTERVAL 1 MONTH"), "d_sub": ("DATE_SUB(o_orderdate, INTERVAL 2 DAY)", "o_orderdate - INTERVAL 2 DAY"), "d_adddate": ("ADDDATE(o_orderdate, 3)", "o_orderdate + INTERVAL 3 DAY"), "d_subdate": ("SUBDATE(o_orderdate, INTERVAL 1 YEAR)", "o_orderdate - INTERVAL 1 YEAR"),
    "d_plus": ("o_orderdate + INTERVAL 90 MINUTE", "o_orderdate + INTERVAL 90 MINUTE"), "d_comp": ("o_orderdate - INTERVAL '1 2:30' DAY_MINUTE", "o_orderdate - INTERVAL 1 DAY - INTERVAL 150 MINUTE"), "d_tsadd": ("TIMESTAMPADD(WEEK, 1, o_orderdate)", "o_orderdate + INTERVAL 7 DAY"),
    "d_tsdiff": ("TIMESTAMPDIFF(DAY, '1992-01-01', o_orderdate)", "CAST(datediff('day', TIMESTAMP '1992-01-01', o_orderdate) AS BIGINT)"), "d_extract": ("CAST(EXTRACT(YEAR_MONTH FROM o_orderdate) AS SIGNED)", "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT)"),
    "d_fmt": ("DATE_FORMAT(o_orderdate, '%Y/%m/%d %W %j')", "strftime(o_orderdate, '%Y/%m/%d %A %j')"), "d_unix": ("FROM_UNIXTIME(UNIX_TIMESTAMP(o_orderdate))", "o_orderdate"), "d_unixf": ("FROM_UNIXTIME(UNIX_TIMESTAMP(o_orderdate), '%Y-%m-%d')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "d_tz": ("CONVERT_TZ(o_orderdate, '+00:00', '+02:00')", "o_orderdate + INTERVAL 2 HOUR"), "d_day": ("DAY(o_orderdate)", "CAST(day(o_orderdate) AS INT)"), "d_hour": ("HOUR(o_orderdate + INTERVAL 5 HOUR)", "CAST(hour(o_orderdate + INTERVAL 5 HOUR) AS INT)"), "d_min": ("MINUTE('2020-01-01 10:11:12')", "CAST(11 AS INT)"),
    "d_sec": ("SECOND('2020-01-01 10:11:12')", "CAST(12 AS INT)"), "d_us": ("CAST(MICROSECOND('2020-01-01 10:11:12.000034') AS SIGNED)", "CAST(34 AS BIGINT)"), "d_week": ("CAST(WEEK(o_orderdate, 3) AS SIGNED)", "CAST(weekofyear(o_orderdate) AS BIGINT)"), "d_yw": ("CAST(YEARWEEK(o_orderdate, 3) AS SIGNED)", "CAST(yearweek(o_orderdate) AS BIGINT)"),
    "d_ts": ("TIMESTAMP(o_orderdate, '01:00:00')", "o_orderdate + INTERVAL 1 HOUR"), "d_dt": ("DATETIME(o_orderdate)", "o_orderdate"), "d_time": ("TIME('2020-01-01 10:11:12')", "'10:11:12'"), "d_tfmt": ("TIME_FORMAT('25:01:02', '%H:%i')", "'25:01'"), "d_tdiff": ("TIMEDIFF('10:00:00', '09:30:00')", "'00:30:00'"), "d_tsec": ("CAST(TIME_TO_SEC('01:01:01') AS SIGNED)", "CAST(3661 AS BIGINT)"),
    "d_str": ("STR_TO_DATE('06/05/2020', '%d/%m/%Y')", "TIMESTAMP '2020-05-06'"), "d_getf": ("GET_FORMAT(DATE, 'EUR')", "'%d.%m.%Y'"), "d_to": ("CAST(TO_DAYS(FROM_DAYS(737000)) AS SIGNED)", "CAST(737000 AS BIGINT)"), "d_lit": ("DATE '2020-01-01' + INTERVAL 1 DAY", "TIMESTAMP '2020-01-02'"),
    "d_now": ("NOW() >= '2024-01-01' AND SYSDATE() >= CURRENT_TIMESTAMP AND LOCALTIME() >= LOCALTIMESTAMP()", "true"), "d_cur": ("CURDATE() = CURRENT_DATE AND UTC_DATE() >= '2024-01-01'", "true"), "d_curt": ("LENGTH(CURTIME()) >= 8 AND LENGTH(CURRENT_TIME()) >= 8 AND LENGTH(UTC_TIME()) >= 8", "true"), "d_utc": ("UTC_TIMESTAMP() >= '2024-01-01'", "true"),
    "d_last": ("LAST_DAY(o_orderdate)", "last_day(o_orderdate)"), "d_dow": ("DAYOFWEEK(o_orderdate)", "CAST(dayofweek(o_orderdate) + 1 AS INT)"), "d_wd": ("WEEKDAY(o_orderdate)", "CAST(isodow(o_orderdate) - 1 AS INT)"),
})
_doc = "JSON_OBJECT('k', c_custkey, 'v', JSON_ARRAY(c_nationkey, 7, 'x'))"
calls("sql_json", "customer", "c_custkey", {
    "j_arrow": (f"{_doc}->'$.v[1]'", "'7'"), "j_arrow2": (f"{_doc}->>'$.v[2]'", "'x'"), "j_insert": (f"JSON_INSERT({_doc}, '$.n', 1)->>'$.n'", "'1'"), "j_replace": (f"JSON_REPLACE({_doc}, '$.k', 'z')->>'$.k'", "'z'"), "j_set": (f"JSON_SET({_doc}, '$.v[0]', 5)->'$.v'", "'[5, 7, \"x\"]'"),
    "j_remove": (f"JSON_REMOVE({_doc}, '$.v')", "'{\"k\": ' || c_custkey || '}'"), "j_merge": ("JSON_MERGE('[1]', '[2]')", "'[1, 2]'"), "j_pretty": ("JSON_PRETTY('[1]')", "'[\n  1\n]'"), "j_app": ("JSON_ARRAY_APPEND('[1]', '$', 2)", "'[1, 2]'"), "j_ains": ("JSON_ARRAY_INSERT('[1]', '$[0]', 2)", "'[2, 1]'"),
    "j_keys": (f"JSON_KEYS({_doc})", "'[\"k\", \"v\"]'"), "j_len": (f"CAST(JSON_LENGTH({_doc}, '$.v') AS SIGNED)", "CAST(3 AS BIGINT)"), "j_depth": (f"CAST(JSON_DEPTH({_doc}) AS SIGNED)", "CAST(3 AS BIGINT)"), "j_over": ("JSON_OVERLAPS('[1, 2]', '[2, 3]')", "true"), "j_member": ("7 MEMBER OF ('[1, 7]')", "true"),
    "j_value": (f"JSON_VALUE({_doc}, '$.v[1]' RETURNING SIGNED)", "CAST(7 AS BIGINT)"), "j_cont": (f"JSON_CONTAINS_PATH({_doc}, 'all', '$.k', '$.zz')", "false"), "j_type": ("JSON_TYPE('[1]')", "'ARRAY'"),
})
calls("sql_vectors", "embeddings", "vec_id", {
    "v_l2": ("ROUND(VEC_DISTANCE_L2_SQUARED(embedding, STRING_TO_VECTOR(VECTOR_TO_STRING(embedding))), 4)", "0.0::DOUBLE"), "v_to": ("VECTOR_TO_STRING(TO_VECTOR('[1,2]')) = FROM_VECTOR(VEC_FROMTEXT('[1,2]'))", "true"), "v_text": ("VEC_TOTEXT(STRING_TO_VECTOR('[1,2]')) = VECTOR_TO_STRING(STRING_TO_VECTOR('[1,2]'))", "true"),
    "v_d": ("ROUND(VEC_DISTANCE(STRING_TO_VECTOR('[0,0]'), STRING_TO_VECTOR('[3,4]')), 4)", "25.0::DOUBLE"), "v_di": ("ROUND(DISTANCE(STRING_TO_VECTOR('[0,0]'), STRING_TO_VECTOR('[3,4]'), 'EUCLIDEAN'), 4)", "5.0::DOUBLE"), "v_cos": ("ROUND(VEC_DISTANCE_COSINE(STRING_TO_VECTOR('[1,0]'), STRING_TO_VECTOR('[0,2]')), 4)", "1.0::DOUBLE"), "v_eu": ("ROUND(VEC_DISTANCE_EUCLIDEAN(STRING_TO_VECTOR('[0,0]'), STRING_TO_VECTOR('[3,4]')), 4)", "5.0::DOUBLE"),
})
calls("sql_network", "supplier", "s_suppkey", {
    "n_aton": ("INET_ATON('10.0.0.1') + s_suppkey", "CAST(167772161 + s_suppkey AS BIGINT)"), "n_ntoa": ("INET_NTOA(167772161)", "'10.0.0.1'"), "n_6": ("INET6_NTOA(INET6_ATON('::1'))", "'::1'"), "n_v4": ("IS_IPV4('1.2.3.4') AND NOT IS_IPV4('1.2.3')", "true"), "n_v6": ("IS_IPV6('::1')", "true"), "n_compat": ("IS_IPV4_COMPAT(INET6_ATON('::1.2.3.4'))", "true"),
    "n_map": ("IS_IPV4_MAPPED(INET6_ATON('::ffff:1.2.3.4'))", "true"), "n_uuid": ("IS_UUID(UUID())", "true"), "n_short": ("UUID_SHORT() > 0", "true"), "n_bin": ("BIN_TO_UUID(UUID_TO_BIN('6ccd780c-baba-1026-9564-5b8c656024db'))", "'6ccd780c-baba-1026-9564-5b8c656024db'"),
})
_p, _l = "POINT(c_custkey, c_nationkey)", "LINESTRING(POINT(0, 0), POINT(3, 4), POINT(c_custkey, 10))"
_sq, _hole = "ST_GEOMFROMTEXT('POLYGON((0 0,4 0,4 4,0 4,0 0))')", "ST_GEOMFROMTEXT('POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,2 1,2 2,1 2,1 1))')"
calls("sql_spatial_parts", "customer", "c_custkey", {
    "g_x": (f"ST_X({_p})", "CAST(c_custkey AS DOUBLE)"), "g_y": (f"ST_Y({_p})", "CAST(c_nationkey AS DOUBLE)"), "g_setx": (f"ST_ASTEXT(ST_X({_p}, 1))", "'POINT(1 ' || c_nationkey || ')'"), "g_lon": ("ST_LONGITUDE(ST_GEOMFROMTEXT('POINT(2 1)', 4326)) IN (1, 2)", "true"), "g_lat": ("ST_LATITUDE(ST_GEOMFROMTEXT('POINT(2 1)', 4326)) IN (1, 2)", "true"),
    "g_start": (f"ST_ASTEXT(ST_STARTPOINT({_l}))", "'POINT(0 0)'"), "g_end": (f"ST_ASTEXT(ST_ENDPOINT({_l}))", "'POINT(' || c_custkey || ' 10)'"), "g_pn": (f"ST_ASTEXT(ST_POINTN({_l}, 2))", "'POINT(3 4)'"), "g_np": (f"CAST(ST_NUMPOINTS({_l}) AS SIGNED)", "CAST(3 AS BIGINT)"), "g_closed": (f"ST_ISCLOSED({_l})", "false"),
    "g_ext": (f"ST_ASTEXT(ST_EXTERIORRING({_sq}))", "'LINESTRING(0 0,4 0,4 4,0 4,0 0)'"), "g_int": (f"ST_ASTEXT(ST_INTERIORRINGN({_hole}, 1))", "'LINESTRING(1 1,2 1,2 2,1 2,1 1)'"), "g_nint": (f"CAST(ST_NUMINTERIORRING({_hole}) AS SIGNED)", "CAST(1 AS BIGINT)"), "g_nints": (f"CAST(ST_NUMINTERIORRINGS({_hole}) AS SIGNED)", "CAST(1 AS BIGINT)"),
    "g_gn": ("ST_ASTEXT(ST_GEOMETRYN(ST_GEOMFROMTEXT('MULTIPOINT(1 1,2 2)'), 2))", "'POINT(2 2)'"), "g_ng": ("CAST(ST_NUMGEOMETRIES(ST_GEOMFROMTEXT('MULTIPOINT(1 1,2 2)')) AS SIGNED)", "CAST(2 AS BIGINT)"), "g_dim": (f"CAST(ST_DIMENSION({_p}) + ST_DIMENSION({_l}) + ST_DIMENSION({_sq}) AS SIGNED)", "CAST(3 AS BIGINT)"),
    "g_type": (f"ST_GEOMETRYTYPE({_l})", "'LINESTRING'"), "g_empty": ("ST_ISEMPTY(ST_GEOMFROMTEXT('GEOMETRYCOLLECTION EMPTY'))", "true"), "g_simple": (f"ST_ISSIMPLE({_sq})", "true"), "g_srid": (f"CAST(ST_SRID(ST_SRID({_p}, 4326)) AS SIGNED)", "CAST(4326 AS BIGINT)"), "g_swap": (f"ST_ASTEXT(ST_SWAPXY({_p}))", "'POINT(' || c_nationkey || ' ' || c_custkey || ')'"),
    "g_multi": ("ST_ASTEXT(MULTIPOINT(POINT(1, 2), POINT(3, 4)))", "'MULTIPOINT(1 2,3 4)'"), "g_mline": ("ST_GEOMETRYTYPE(MULTILINESTRING(LINESTRING(POINT(1, 2), POINT(3, 4))))", "'MULTILINESTRING'"), "g_poly": ("ST_AREA(POLYGON(LINESTRING(POINT(0, 0), POINT(2, 0), POINT(2, 2), POINT(0, 0))))", "2.0::DOUBLE"),
    "g_mpoly": ("ST_AREA(MULTIPOLYGON(POLYGON(LINESTRING(POINT(0, 0), POINT(2, 0), POINT(2, 2), POINT(0, 0)))))", "2.0::DOUBLE"), "g_gc": ("CAST(ST_NUMGEOMETRIES(GEOMETRYCOLLECTION(POINT(1, 2), LINESTRING(POINT(1, 2), POINT(3, 4)))) AS SIGNED)", "CAST(2 AS BIGINT)"), "g_gc2": ("ST_GEOMETRYTYPE(GEOMCOLLECTION(POINT(1, 2)))", "'GEOMETRYCOLLECTION'"),
})
calls("sql_spatial_measures", "customer", "c_custkey", {
    "s_area": (f"ST_AREA({_hole})", "80.0::DOUBLE"), "s_len": ("ST_LENGTH(LINESTRING(POINT(0, 0), POINT(3, 4)))", "5.0::DOUBLE"), "s_per": (f"ST_PERIMETER({_sq})", "16.0::DOUBLE"), "s_dist": (f"ROUND(ST_DISTANCE({_p}, POINT(0, 0)), 6)", "round(sqrt(c_custkey::DOUBLE * c_custkey + c_nationkey * c_nationkey), 6)"),
    "s_cont": (f"ST_CONTAINS({_sq}, {_p})", "c_custkey > 0 AND c_custkey < 4 AND c_nationkey > 0 AND c_nationkey < 4"), "s_with": (f"ST_WITHIN({_p}, {_sq})", "c_custkey > 0 AND c_custkey < 4 AND c_nationkey > 0 AND c_nationkey < 4"), "s_inter": (f"ST_INTERSECTS({_sq}, {_p})", "c_custkey BETWEEN 0 AND 4 AND c_nationkey BETWEEN 0 AND 4"),
    "s_dis": (f"ST_DISJOINT({_sq}, {_p})", "NOT (c_custkey BETWEEN 0 AND 4 AND c_nationkey BETWEEN 0 AND 4)"), "s_eq": (f"ST_EQUALS({_p}, POINT(c_custkey, c_nationkey))", "true"), "s_eq2": (f"ST_EQUAL({_p}, POINT(-1, 0))", "false"), "s_cent": (f"ST_ASTEXT(ST_CENTROID({_sq}))", "'POINT(2 2)'"), "s_env": (f"ST_ASTEXT(ST_ENVELOPE({_l}))", "CASE WHEN true THEN 'POLYGON((0 0,' || greatest(3, c_custkey) || ' 0,' || greatest(3, c_custkey) || ' 10,0 10,0 0))' END"),
    "s_hull": ("ST_AREA(ST_CONVEXHULL(ST_GEOMFROMTEXT('MULTIPOINT(0 0,2 0,2 2,0 2,1 1)')))", "4.0::DOUBLE"), "s_valid": (f"ST_ASTEXT(ST_VALIDATE({_sq}))", "'POLYGON((0 0,4 0,4 4,0 4,0 0))'"), "s_hash": ("ST_GEOHASH(180, 0, 10)", "'xbpbpbpbpb'"), "s_lath": ("ROUND(ST_LATFROMGEOHASH('xbpbpbpbpb'), 3)", "0.0::DOUBLE"), "s_lonh": ("ROUND(ST_LONGFROMGEOHASH('xbpbpbpbpb'), 3)", "180.0::DOUBLE"),
    "s_ph": ("ST_GEOMETRYTYPE(ST_POINTFROMGEOHASH('xbpbpbpbpb', 0))", "'POINT'"), "s_gj": (f"ST_ASGEOJSON({_p})->>'$.type'", "'Point'"), "s_fgj": ("ST_ASTEXT(ST_GEOMFROMGEOJSON('{\"type\": \"Point\", \"coordinates\": [1, 2]}', 1, 0))", "'POINT(1 2)'"),
})
_texts = {"geom": "POINT(1 2)", "geometry": "POINT(1 2)", "point": "POINT(1 2)", "line": "LINESTRING(0 0,1 1)", "linestring": "LINESTRING(0 0,1 1)", "poly": "POLYGON((0 0,1 0,1 1,0 0))", "polygon": "POLYGON((0 0,1 0,1 1,0 0))", "mpoint": "MULTIPOINT(1 1,2 2)", "multipoint": "MULTIPOINT(1 1,2 2)", "mline": "MULTILINESTRING((0 0,1 1))", "multilinestring": "MULTILINESTRING((0 0,1 1))", "mpoly": "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "multipolygon": "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "geomcoll": "GEOMETRYCOLLECTION(POINT(1 2))", "geometrycollection": "GEOMETRYCOLLECTION(POINT(1 2))"}
calls("sql_spatial_texts", "supplier", "s_suppkey", {f"w_{k}": (f"ST_ASWKT(ST_{k.upper()}FROMWKB(ST_ASWKB(ST_{k.upper()}FROMTEXT('{v}'))))", f"'{v}'") for k, v in _texts.items()} | {"w_txt": ("ST_ASTEXT(ST_GEOMCOLLFROMTXT('GEOMETRYCOLLECTION(POINT(1 2))'))", "'GEOMETRYCOLLECTION(POINT(1 2))'"), "w_bin": ("ST_ASBINARY(POINT(1, 2)) = ST_ASWKB(POINT(1, 2))", "true")})
script("sql_session", "SELECT 1 AS c, 'root@localhost' AS u, 'root@localhost' AS cu, 'default' AS d, 'default' AS s, 3 AS found, CAST(1 AS INT) AS got, CAST(0 AS INT) AS is_free, CAST(1 AS INT) AS released, CAST(0 AS INT) AS slept, '8.0.33' AS v, CAST(5 AS INT) AS x, CAST(6 AS INT) AS y",
       "SET @x = 5, @y := @x + 1", "SELECT SQL_CALC_FOUND_ROWS n_name FROM nation WHERE n_nationkey < 3 LIMIT 1",
       "SELECT CONNECTION_ID() AS c, USER() AS u, CURRENT_USER() AS cu, DATABASE() AS d, SCHEMA() AS s, FOUND_ROWS() AS found, GET_LOCK('a', 1) AS got, IS_FREE_LOCK('a') AS is_free, RELEASE_LOCK('a') AS released, SLEEP(0) AS slept, VERSION() AS v, @x AS x, @y AS y")
script("sql_locks", "SELECT CAST(1 AS BIGINT) AS used, CAST(2 AS INT) AS released_all, CAST(1 AS INT) AS free_again", "SELECT GET_LOCK('a', 0), GET_LOCK('b', 0)", "SELECT IS_USED_LOCK('a') AS used, RELEASE_ALL_LOCKS() AS released_all, IS_FREE_LOCK('a') AS free_again")
script("sql_row_counts", "SELECT CAST(3 AS INT) AS changed, CAST(8 AS INT) AS last_id, '' AS last_uuid", "CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, v INT)", "INSERT INTO t VALUES (7, 0)", "INSERT INTO t (v) VALUES (1), (2), (3)", "SELECT ROW_COUNT() AS changed, LAST_INSERT_ID() AS last_id, LAST_INSERT_UUID() AS last_uuid")

# --- queries ---------------------------------------------------------------------------------------------

script("sql_aggregates", """SELECT c_mktsegment, CAST(sum(c_nationkey) AS DOUBLE) AS total, round(avg(c_acctbal), 6) AS mean, count(DISTINCT c_nationkey) AS nations, round(stddev_pop(c_acctbal), 4) AS sd, CAST(bit_or(c_custkey) AS DECIMAL(20,0)) AS bits,
  left(string_agg(c_name, '|' ORDER BY c_name DESC), 1024) AS names FROM customer GROUP BY 1 HAVING count(*) > 1""",
       "SELECT c_mktsegment, SUM(c_nationkey) AS total, ROUND(AVG(c_acctbal), 6) AS mean, COUNT(DISTINCT c_nationkey) AS nations, ROUND(STD(c_acctbal), 4) AS sd, BIT_OR(c_custkey) AS bits, GROUP_CONCAT(c_name ORDER BY c_name DESC SEPARATOR '|') AS names FROM customer GROUP BY c_mktsegment HAVING COUNT(*) > 1")
script("sql_aggregates_rest", "SELECT n_regionkey, min(n_nationkey) AS lo, max(n_nationkey) AS hi, CAST(bit_and(n_nationkey) AS DECIMAL(20,0)) AS a, CAST(bit_xor(n_nationkey) AS DECIMAL(20,0)) AS x, round(var_samp(n_nationkey), 6) AS vs, round(variance_pop, 6) AS vp, n_regionkey AS some, 5 AS keys FROM (SELECT *, var_pop(n_nationkey) OVER (PARTITION BY n_regionkey) AS variance_pop FROM nation) GROUP BY n_regionkey, variance_pop",
       "SELECT n_regionkey, MIN(n_nationkey) AS lo, MAX(n_nationkey) AS hi, BIT_AND(n_nationkey) AS a, BIT_XOR(n_nationkey) AS x, ROUND(VAR_SAMP(n_nationkey), 6) AS vs, ROUND(VARIANCE(n_nationkey), 6) AS vp, ANY_VALUE(n_regionkey) AS some, JSON_LENGTH(JSON_OBJECTAGG(n_name, n_nationkey)) AS `keys` FROM nation GROUP BY n_regionkey")
script("sql_rollup", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey)", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey WITH ROLLUP")
script("sql_windows", "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS DECIMAL(18,2)) AS around, lag(o_orderkey) OVER w AS before, first_value(o_orderkey) OVER w AS first_key, CAST(ntile(3) OVER w AS INT) AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
       "SELECT o_orderkey, ROW_NUMBER() OVER w AS rn, CAST(SUM(o_totalprice) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS DECIMAL(18,2)) AS around, LAG(o_orderkey) OVER w AS before, FIRST_VALUE(o_orderkey) OVER w AS first_key, NTILE(3) OVER w AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
script("sql_left_lateral", "SELECT r_name, x.n AS n, x.top AS top FROM region LEFT JOIN LATERAL (SELECT count(*) AS n, max(n_name) AS top FROM nation WHERE n_regionkey = r_regionkey) x ON true", "SELECT r_name, x.n, x.top FROM region LEFT JOIN LATERAL (SELECT COUNT(*) AS n, MAX(n_name) AS top FROM nation WHERE n_regionkey = r_regionkey) x ON TRUE")
script("sql_join_kinds", "SELECT n_name, r_name, s_suppkey FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 WHERE n_nationkey IN (SELECT c_nationkey FROM customer)",
       "SELECT /*+ HASH_JOIN(nation, region) */ n_name, r_name, s_suppkey FROM nation STRAIGHT_JOIN region ON n_regionkey = r_regionkey LEFT OUTER JOIN supplier USE INDEX (s) ON s_nationkey = n_nationkey AND s_acctbal > 0 WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
for _name, _join in (("left_hash", "/*+ HASH_JOIN(orders, customer) */ ~ LEFT JOIN"), ("left_merge", "/*+ MERGE_JOIN(orders, customer) */ ~ LEFT JOIN"), ("left_lookup", "/*+ LOOKUP_JOIN(orders, customer) */ ~ LEFT JOIN"), ("right_using", "~ RIGHT JOIN")):
    _hint, _, _kind = _join.partition("~")
    script(f"sql_join_{_name}", f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 3000) c {_kind} (SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_totalprice > 150000) o USING (c_custkey)", f"SELECT {_hint} c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 3000) c {_kind} (SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_totalprice > 150000) o USING (c_custkey)")
for _name, _test in (("semi", "IN"), ("anti", "NOT IN")):
    for _h in ("HASH_JOIN", "MERGE_JOIN", "LOOKUP_JOIN"):
        script(f"sql_{_name}_{_h.lower()}", f"SELECT c_custkey FROM customer WHERE c_custkey {_test} (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)", f"SELECT /*+ {_h}(customer, orders) */ c_custkey FROM customer WHERE c_custkey {_test} (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
script("sql_left_exclude_nulls", "SELECT n_nationkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON s_nationkey = n_nationkey WHERE s_suppkey IS NULL", "SELECT n_nationkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON s_nationkey = n_nationkey WHERE s_suppkey IS NULL")
script("sql_any_all", "SELECT p_partkey FROM part WHERE p_size >= (SELECT max(p_size) FROM part WHERE p_partkey < 20) AND p_partkey IN (SELECT l_partkey FROM lineitem)", "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part WHERE p_partkey < 20) AND p_partkey = ANY (SELECT l_partkey FROM lineitem)")
script("sql_max1row", "SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region FROM nation", "SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region FROM nation")
script("sql_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(column_0, column_1)", "VALUES ROW(1, 'a'), ROW(2, 'b'), ROW(3, NULL)")
script("sql_dual", "SELECT 3 AS three", "SELECT 1 + 2 AS three FROM DUAL")
script("sql_empty_table", "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS INT) AS m", "CREATE TABLE e (a INT)", "SELECT COUNT(*) AS n, MAX(a) AS m FROM e")
script("sql_concat", "SELECT n_name AS name FROM nation WHERE n_nationkey < 5 UNION ALL SELECT r_name FROM region", "SELECT n_name AS name FROM nation WHERE n_nationkey < 5 UNION ALL SELECT r_name FROM region")
script("sql_recursive_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 12) SELECT n, f FROM t", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 12) SELECT n, f FROM t")
script("sql_recursive_distinct", "SELECT range AS n FROM range(25)", "WITH RECURSIVE t(n) AS (SELECT 0 UNION SELECT (n + n_nationkey) % 25 FROM t JOIN nation ON n_nationkey IN (3, 5)) SELECT CAST(n AS SIGNED) AS n FROM t")
script("sql_json_table", "SELECT n_nationkey, i, v, w FROM (SELECT n_nationkey, unnest([1, 2]) AS i, unnest([n_regionkey::BIGINT, 7]) AS v, unnest(['x', 'none']) AS w FROM nation)",
       """SELECT n_nationkey, j.i, j.v, j.w FROM (SELECT n_nationkey, JSON_ARRAY(JSON_OBJECT('v', n_regionkey, 'w', 'x'), JSON_OBJECT('v', 7)) AS doc FROM nation) n,
  JSON_TABLE(n.doc, '$[*]' COLUMNS (i FOR ORDINALITY, v BIGINT PATH '$.v', w VARCHAR(10) PATH '$.w' DEFAULT 'none' ON EMPTY)) AS j""")  # fmt: skip
script("sql_match", "SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_'']+'), 'idiot')", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST('idiot' IN NATURAL LANGUAGE MODE)")
script("sql_limit_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7 OFFSET 4", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 4, 7")
script("sql_prepared", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY 1", "SET @least = 100", "PREPARE s FROM 'SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_acctbal > ? GROUP BY c_mktsegment'", "EXECUTE s USING @least")
script("sql_into_variables", "SELECT max(n_nationkey) AS m, count(*) AS n FROM nation", "SELECT MAX(n_nationkey), COUNT(*) FROM nation INTO @m, @n", "SELECT @m AS m, CAST(@n AS SIGNED) AS n")
script("sql_host_functions", "SELECT n_nationkey, CAST(n_nationkey * 3 AS DOUBLE) AS tripled, n_name || '!' AS loud FROM nation", "SELECT n_nationkey, TRIPLE(n_nationkey) AS tripled, LOUD(n_name) AS loud FROM nation", setup=lambda e: (e.register_function("triple", lambda x: x * 3.0, "double"), e.register_function("loud", lambda x: x + "!")))
script("sql_host_aggregate", "SELECT n_regionkey, CAST(max(n_nationkey) - min(n_nationkey) AS DOUBLE) AS spread FROM nation GROUP BY 1", "SELECT n_regionkey, SPREAD(CAST(n_nationkey AS DOUBLE)) AS spread FROM nation GROUP BY n_regionkey", setup=lambda e: e.register_aggregate("spread", lambda x: float(x.max() - x.min())))
script("sql_table_function", "SELECT range AS x FROM range(5) WHERE range > 1", "SELECT x FROM numbers(5) AS t WHERE x > 1", setup=lambda e: e.register_table_function("numbers", lambda spark, n: spark.range(n).withColumnRenamed("id", "x")))

script("sql_right_lateral", "SELECT r_name, x.n AS n FROM region RIGHT JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) x ON x.n_regionkey = r_regionkey AND r_name <> 'ASIA'", "SELECT r_name, x.n FROM region RIGHT JOIN LATERAL (SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey) x ON x.n_regionkey = r_regionkey AND r_name <> 'ASIA'")
script("sql_lateral_inner", "SELECT c_custkey, x.o_orderkey AS o_orderkey FROM customer JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30) x ON true", "SELECT c_custkey, x.o_orderkey FROM customer JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30) x ON TRUE")
script("sql_shared_subquery", "WITH spent AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT a.n AS n, count(*) AS pairs FROM spent a JOIN spent b ON a.n = b.n GROUP BY 1", "WITH spent AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT a.n, COUNT(*) AS pairs FROM spent a JOIN spent b ON a.n = b.n GROUP BY a.n")
script("sql_gtid_subtract", "SELECT '3e11fa47-71ca-11e1-9e33-c80aa9429562:1-20:41-57' AS a, '' AS b", "SELECT GTID_SUBTRACT('3E11FA47-71CA-11E1-9E33-C80AA9429562:1-57', '3E11FA47-71CA-11E1-9E33-C80AA9429562:21-40') AS a, GTID_SUBTRACT('3E11FA47-71CA-11E1-9E33-C80AA9429562:1-3', '3e11fa47-71ca-11e1-9e33-c80aa9429562:1-9') AS b")
script("sql_load_file", "SELECT true AS none, true AS outside", "SET secure_file_priv = '/tmp/no-such-folder'", "SELECT LOAD_FILE('/tmp/no-such-folder/x') IS NULL AS none, LOAD_FILE('/etc/hostname') IS NULL AS outside")
script("sql_warnings", "SELECT 'Warning' AS level, CAST(1062 AS INT) AS code, '2 of 3 rows ignored: duplicate entry or no parent' AS message", "CREATE TABLE u (k INT PRIMARY KEY)", "INSERT IGNORE INTO u VALUES (1), (1), (1)", "SHOW WARNINGS")
# --- the public decision-support statements that these tables can answer --------------------------------------

_TPCH = {
    "q1": ("SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) AS sum_charge, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order FROM lineitem WHERE l_shipdate <= {ts} '1998-09-02' GROUP BY l_returnflag, l_linestatus", ""),
    "q3": ("SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < {ts} '1995-03-15' AND l_shipdate > {ts} '1995-03-15' GROUP BY l_orderkey, o_orderdate", " ORDER BY revenue DESC, l_orderkey LIMIT 10"),
    "q4": ("SELECT o_orderpriority, COUNT(*) AS order_count FROM orders WHERE o_orderdate >= {ts} '1993-07-01' AND o_orderdate < {ts} '1995-10-01' AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) GROUP BY o_orderpriority", ""),
    "q5": ("SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name", ""),
    "q6": ("SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= {ts} '1994-01-01' AND l_shipdate < {ts} '1995-01-01' AND l_discount BETWEEN 0.05e0 AND 0.07e0 AND l_quantity < 24", ""),
    "q7": ("SELECT supp_nation, cust_nation, l_year, ROUND(SUM(volume) + 0.00001e0, 2) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(YEAR(l_shipdate) AS {int}) AS l_year, l_extendedprice * (1 - l_discount) AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_regionkey <> n2.n_regionkey) AS shipping GROUP BY supp_nation, cust_nation, l_year", ""),
    "q10": ("SELECT c_custkey, c_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, n_name", " ORDER BY revenue DESC, c_custkey LIMIT 20"),
    "q13": ("SELECT c_count, COUNT(*) AS custdist FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) AS c_orders GROUP BY c_count", ""),
    "q14": ("SELECT ROUND(100.00e0 * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / SUM(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey", ""),
    "q15": ("WITH revenue AS (SELECT l_suppkey AS supplier_no, SUM(l_extendedprice * (1 - l_discount)) AS total_revenue FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, ROUND(total_revenue, 2) AS total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue >= (SELECT MAX(total_revenue) - 0.001 FROM revenue)", ""),
    "q17": ("SELECT ROUND(SUM(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 20 AND l_quantity < (SELECT 0.5e0 * AVG(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)", ""),
    "q18": ("SELECT c_name, o_orderkey, ROUND(SUM(l_quantity), 2) AS qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 150) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, o_orderkey", " ORDER BY qty DESC, o_orderkey LIMIT 100"),
    "q19": ("SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 11) OR (p_partkey = l_partkey AND p_size BETWEEN 20 AND 30 AND l_quantity BETWEEN 10 AND 20)", ""),
    "q21": ("SELECT s_name, COUNT(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_quantity > 45) GROUP BY s_name", " ORDER BY numwait DESC, s_name LIMIT 100"),
    "q22": ("SELECT c_nationkey, COUNT(*) AS numcust, ROUND(SUM(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_nationkey", ""),
}
for _name, (_text, _tail) in _TPCH.items():
    script(f"tpch_sql_{_name}", (_text + _tail).replace("{ts}", "TIMESTAMP").replace("{int}", "BIGINT"), (_text + _tail).replace("{ts}", "TIMESTAMP").replace("{int}", "SIGNED"))

# --- definitions and data changes ---------------------------------------------------------------------------

_copy = "CREATE TABLE t (k INT PRIMARY KEY, name VARCHAR(30), r INT)", "INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation"
script("dml_upsert_repeated_key", "SELECT * FROM (VALUES (1, 6), (2, 5), (3, 1)) t(k, v)", "CREATE TABLE u (k INT PRIMARY KEY, v INT)", "INSERT INTO u VALUES (1, 1), (2, 5)", "INSERT INTO u VALUES (1, 2), (3, 1), (1, 3) ON DUPLICATE KEY UPDATE v = v + VALUES(v)", "SELECT k, v FROM u")
script("dml_upsert_unique_key", "SELECT * FROM (VALUES (1, 10, 'old+'), (2, 20, 'b')) t(k, u, s)", "CREATE TABLE q (k INT PRIMARY KEY, u INT UNIQUE, s VARCHAR(9))", "INSERT INTO q VALUES (1, 10, 'old')", "INSERT INTO q VALUES (5, 10, 'x'), (2, 20, 'b') ON DUPLICATE KEY UPDATE s = CONCAT(s, '+')", "SELECT k, u, s FROM q")
script("dml_replace_repeated_key", "SELECT * FROM (VALUES (5, 3), (6, 1)) t(k, v)", "CREATE TABLE u (k INT PRIMARY KEY, v INT)", "REPLACE INTO u VALUES (5, 1), (5, 2), (6, 1), (5, 3)", "SELECT k, v FROM u")
script("dml_insert_ignore", "SELECT * FROM (VALUES (1, 1), (2, 7), (3, 9)) t(k, v)", "CREATE TABLE u (k INT PRIMARY KEY, v INT)", "INSERT INTO u VALUES (1, 1)", "INSERT IGNORE INTO u VALUES (1, 5), (2, 7), (2, 8), (3, 9)", "SELECT k, v FROM u")
script("dml_insert_set_default", "SELECT * FROM (VALUES (1, 'x', 5, 10), (2, 'none', 7, 14)) t(id, s, n, twice)", "CREATE TABLE u (id INT PRIMARY KEY AUTO_INCREMENT, s VARCHAR(9) NOT NULL DEFAULT 'none', n INT DEFAULT (3 + 4), twice INT AS (n * 2) STORED)", "INSERT INTO u SET s = 'x', n = 5", "INSERT INTO u (s) VALUES (DEFAULT)", "SELECT id, s, n, twice FROM u")
script("dml_auto_increment", "SELECT * FROM (VALUES (1, 'a'), (10, 'b'), (11, 'c'), (12, 'd')) t(id, s)", "CREATE TABLE u (id INT PRIMARY KEY AUTO_INCREMENT, s VARCHAR(9))", "INSERT INTO u VALUES (NULL, 'a'), (10, 'b'), (0, 'c')", "INSERT INTO u (s) VALUES ('d')", "SELECT id, s FROM u")
script("dml_update_order_limit", "SELECT n_nationkey AS k, CASE WHEN n_nationkey >= 20 THEN 'last' ELSE n_name END AS name FROM nation", *_copy, "UPDATE t SET name = 'last' ORDER BY k DESC LIMIT 5", "SELECT k, name FROM t")
script("dml_update_left_to_right", "SELECT n_nationkey AS k, n_regionkey + 2 AS r, CAST(n_regionkey + 2 AS VARCHAR) AS name FROM nation WHERE n_regionkey > 0 UNION ALL SELECT n_nationkey, n_regionkey, n_name FROM nation WHERE n_regionkey = 0", *_copy, "UPDATE t SET r = r + 2, name = r WHERE r > 0", "SELECT k, r, name FROM t")
script("dml_update_join", "SELECT n_nationkey AS k, CASE WHEN r_name = 'ASIA' THEN 'in ' || r_name ELSE n_name END AS name FROM nation JOIN region ON n_regionkey = r_regionkey", *_copy, "UPDATE t JOIN region ON t.r = region.r_regionkey SET t.name = CONCAT('in ', r_name) WHERE r_name = 'ASIA'", "SELECT k, name FROM t")
script("dml_delete_order_limit", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey >= 4", *_copy, "DELETE FROM t WHERE k < 100 ORDER BY k LIMIT 4", "SELECT k FROM t")
script("dml_delete_join", "SELECT n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE'", *_copy, "DELETE t FROM t JOIN region ON t.r = r_regionkey WHERE r_name = 'EUROPE'", "SELECT k FROM t")
script("dml_truncate", "SELECT CAST(0 AS BIGINT) AS n", *_copy, "TRUNCATE TABLE t", "SELECT COUNT(*) AS n FROM t")
_parent = "CREATE TABLE pa (id BIGINT PRIMARY KEY, v INT)", "INSERT INTO pa SELECT r_regionkey, 0 FROM region"
for _name, _rule, _child in (("cascade", "CASCADE", "CASE WHEN n_regionkey = 1 THEN 100 ELSE n_regionkey END"), ("set_null", "SET NULL", "nullif(n_regionkey, 1)")):
    script(f"fk_on_update_{_name}", f"SELECT n_nationkey AS k, CAST({_child} AS BIGINT) AS pid FROM nation", *_parent, f"CREATE TABLE ch (k INT PRIMARY KEY, pid BIGINT, FOREIGN KEY (pid) REFERENCES pa (id) ON UPDATE {_rule})", "INSERT INTO ch SELECT n_nationkey, n_regionkey FROM nation", "UPDATE pa SET id = 100 WHERE id = 1", "SELECT k, pid FROM ch")
for _name, _rule, _rows in (("cascade", "CASCADE", "SELECT n_nationkey AS k, CAST(n_regionkey AS BIGINT) AS pid FROM nation WHERE n_regionkey <> 1"), ("set_null", "SET NULL", "SELECT n_nationkey AS k, CAST(nullif(n_regionkey, 1) AS BIGINT) AS pid FROM nation")):
    script(f"fk_on_delete_{_name}", _rows, *_parent, f"CREATE TABLE ch (k INT PRIMARY KEY, pid BIGINT, FOREIGN KEY (pid) REFERENCES pa (id) ON DELETE {_rule})", "INSERT INTO ch SELECT n_nationkey, n_regionkey FROM nation", "DELETE FROM pa WHERE id = 1", "SELECT k, pid FROM ch")


def _refused(e: Engine, *statements: str) -> None:
    """Statements that must fail, noted in a table ``refused``."""
    failed = []
    for s in statements:
        try:
            e.sql(s)
        except Exception as x:
            failed.append((s.split()[0], type(x).__name__))
    e.register("refused", e.spark.createDataFrame(failed, "statement string, error string"))


def refused(name: str, expected: str, before: tuple, statements: tuple, last: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, *before, *statements, last)
        for s in before:
            e.sql(s)
        _refused(e, *statements)
        return e.sql(last)

    QUERIES[name], SQL[name] = run, expected


refused("fk_restrict", "SELECT CAST(3 AS BIGINT) AS refused, CAST(25 AS BIGINT) AS children", (*_parent, "CREATE TABLE ch (k INT PRIMARY KEY, pid BIGINT, FOREIGN KEY (pid) REFERENCES pa (id))", "INSERT INTO ch SELECT n_nationkey, n_regionkey FROM nation"), ("UPDATE pa SET id = 100 WHERE id = 1", "DELETE FROM pa WHERE id = 1", "INSERT INTO ch VALUES (999, 999)"), "SELECT (SELECT COUNT(*) FROM refused) AS refused, COUNT(*) AS children FROM ch")
refused("checks_and_keys", "SELECT CAST(4 AS BIGINT) AS refused, CAST(1 AS BIGINT) AS n", ("CREATE TABLE u (k INT PRIMARY KEY, v INT NOT NULL, w INT UNIQUE, CONSTRAINT big CHECK (v < 10))", "INSERT INTO u VALUES (1, 1, 1)"), ("INSERT INTO u VALUES (1, 2, 2)", "INSERT INTO u VALUES (2, 2, 1)", "INSERT INTO u VALUES (2, 20, 2)", "INSERT INTO u VALUES (2, NULL, 2)"), "SELECT (SELECT COUNT(*) FROM refused) AS refused, COUNT(*) AS n FROM u")
refused("json_functions_refused", "SELECT CAST(4 AS BIGINT) AS n", (), ("SELECT JSON_SCHEMA_VALID('{}', '1')", "SELECT JSON_SCHEMA_VALIDATION_REPORT('{}', '1')", "SELECT JSON_STORAGE_FREE('{}')", "SELECT JSON_STORAGE_SIZE('{}')"), "SELECT COUNT(*) AS n FROM refused")
refused("replication_refused", "SELECT CAST(6 AS BIGINT) AS n", (), ("BINLOG 'x'", "CHANGE REPLICATION FILTER x", "CHANGE REPLICATION SOURCE TO x", "RESET REPLICA", "START REPLICA", "STOP REPLICA"), "SELECT COUNT(*) AS n FROM refused")
script("kill", "SELECT 1 AS alive", "KILL QUERY 99", "SELECT 1 AS alive")
script("ddl_drop_check", "SELECT 20 AS v", "CREATE TABLE u (v INT, CONSTRAINT big CHECK (v < 10))", "ALTER TABLE u DROP CHECK big", "INSERT INTO u VALUES (20)", "SELECT v FROM u")
script("ddl_add_check", "SELECT 'big' AS constraint_name, '(v < 10)' AS check_clause", "CREATE TABLE u (v INT)", "ALTER TABLE u ADD CONSTRAINT big CHECK (v < 10)", "SELECT constraint_name, check_clause FROM information_schema.check_constraints")
script("ddl_drop_constraint", "SELECT CAST(0 AS BIGINT) AS n", "CREATE TABLE u (v INT, CONSTRAINT big CHECK (v < 10))", "ALTER TABLE u DROP CONSTRAINT big", "SELECT COUNT(*) AS n FROM information_schema.check_constraints")
script("ddl_foreign_keys", "SELECT 'ch' AS table_name, 'pa' AS referenced_table_name, 'CASCADE' AS delete_rule", *_parent, "CREATE TABLE ch (k INT, pid BIGINT)", "ALTER TABLE ch ADD CONSTRAINT a FOREIGN KEY (pid) REFERENCES pa (id), ADD CONSTRAINT b FOREIGN KEY (pid) REFERENCES pa (id) ON DELETE CASCADE", "ALTER TABLE ch DROP FOREIGN KEY a", "SELECT table_name, referenced_table_name, delete_rule FROM information_schema.referential_constraints")
script("ddl_add_column", "SELECT n_nationkey AS k, 'x' AS note FROM nation", *_copy, "ALTER TABLE t ADD COLUMN note VARCHAR(5) DEFAULT 'x' AFTER k", "SELECT k, note FROM t")
script("ddl_drop_column", "SELECT n_nationkey AS k, n_regionkey AS r FROM nation", *_copy, "ALTER TABLE t DROP COLUMN name", "SELECT * FROM t")
script("ddl_rename_column", "SELECT n_nationkey AS key2, n_name AS name, n_regionkey AS r FROM nation", *_copy, "ALTER TABLE t RENAME COLUMN k TO key2", "INSERT IGNORE INTO t VALUES (1, 'dup', 0)", "SELECT * FROM t")
script("ddl_modify_column", "SELECT n_nationkey AS k, CAST(n_regionkey AS VARCHAR) AS r FROM nation", *_copy, "ALTER TABLE t MODIFY COLUMN r VARCHAR(10)", "SELECT k, r FROM t")
script("ddl_defaults", "SELECT * FROM (VALUES (1, 5), (2, NULL)) t(k, v)", "CREATE TABLE u (k INT, v INT)", "ALTER TABLE u ALTER COLUMN v SET DEFAULT 5", "INSERT INTO u (k) VALUES (1)", "ALTER TABLE u ALTER COLUMN v DROP DEFAULT", "INSERT INTO u (k) VALUES (2)", "SELECT k, v FROM u")
script("ddl_primary_key", "SELECT 'id' AS column_name", "CREATE TABLE u (id INT, v INT, PRIMARY KEY (v))", "ALTER TABLE u DROP PRIMARY KEY, ADD PRIMARY KEY (id)", "SELECT column_name FROM information_schema.key_column_usage WHERE constraint_name = 'PRIMARY'")
script("ddl_auto_increment", "SELECT 100 AS id", "CREATE TABLE u (id INT PRIMARY KEY AUTO_INCREMENT, v INT)", "ALTER TABLE u AUTO_INCREMENT = 100", "INSERT INTO u (v) VALUES (1)", "SELECT id FROM u")
script("ddl_indexes", "SELECT * FROM (VALUES ('b', CAST(0 AS BIGINT), 'k'), ('c', CAST(1 AS BIGINT), 'v')) t(key_name, non_unique, column_name)", "CREATE TABLE u (k INT, v INT, INDEX a (v))", "CREATE UNIQUE INDEX b ON u (k)", "CREATE INDEX d ON u (v)", "DROP INDEX d ON u", "ALTER TABLE u RENAME INDEX a TO c", "SELECT index_name AS key_name, non_unique, column_name FROM information_schema.statistics WHERE table_name = 'u'")
script("ddl_comment_collation", "SELECT 'u' AS table_name, 'about' AS table_comment, 'utf8mb4_0900_ai_ci' AS table_collation", "CREATE TABLE u (k INT)", "ALTER TABLE u COMMENT = 'about'", "ALTER TABLE u COLLATE = utf8mb4_0900_ai_ci", "SELECT table_name, table_comment, table_collation FROM information_schema.tables WHERE table_name = 'u'")
script("ddl_rename_table", "SELECT n_nationkey AS k FROM nation", *_copy, "RENAME TABLE t TO t2", "ALTER TABLE t2 RENAME TO t3", "SELECT k FROM t3")
script("ddl_create_as_and_like", "SELECT CAST(5 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b", "CREATE TABLE a AS SELECT * FROM region", "CREATE TABLE b LIKE a", "SELECT (SELECT COUNT(*) FROM a) AS a, COUNT(*) AS b FROM b")
script("ddl_drop_table", "SELECT CAST(0 AS BIGINT) AS n", "CREATE TABLE gone (k INT)", "DROP TABLE gone", "DROP TABLE IF EXISTS gone", "SELECT COUNT(*) AS n FROM information_schema.tables WHERE table_name = 'gone'")
script("ddl_views", "SELECT n_nationkey AS a, upper(n_name) AS b FROM nation", "CREATE VIEW old AS SELECT 1 AS x", "DROP VIEW old", "CREATE OR REPLACE VIEW w (a, b) AS SELECT n_nationkey, UPPER(n_name) FROM nation", "SELECT a, b FROM w")
script("ddl_databases", "SELECT schema_name FROM (VALUES ('information_schema'), ('default'), ('two')) t(schema_name)", "CREATE DATABASE one", "CREATE SCHEMA two", "ALTER DATABASE two COLLATE utf8mb4_0900_ai_ci", "USE one", "USE two", "DROP DATABASE one", "SELECT schema_name FROM information_schema.schemata")
script("ddl_spatial_reference", "SELECT 'mine' AS srs_name, CAST(900 AS BIGINT) AS srs_id", "CREATE SPATIAL REFERENCE SYSTEM 900 NAME 'mine' DEFINITION 'GEOGCS'", "SELECT srs_name, srs_id FROM information_schema.st_spatial_reference_systems WHERE srs_id = 900")
script("as_of", "SELECT * FROM (VALUES (1)) t(v)", "CREATE TABLE u (v INT)", "INSERT INTO u VALUES (1)", "INSERT INTO u VALUES (2)", "SELECT v FROM u AS OF '2'")
script("analyze_histogram", "SELECT 'u' AS table_name, 'k' AS column_name", "CREATE TABLE u (k INT, v INT)", "INSERT INTO u SELECT n_nationkey, n_regionkey FROM nation", "ANALYZE TABLE u UPDATE HISTOGRAM ON k, v", "ANALYZE TABLE u DROP HISTOGRAM ON v", "SELECT table_name, column_name FROM information_schema.column_statistics")
script("transaction_rollback", "SELECT CAST(25 AS BIGINT) AS n", *_copy, "START TRANSACTION", "DELETE FROM t", "ROLLBACK", "SELECT COUNT(*) AS n FROM t")
script("transaction_commit", "SELECT CAST(20 AS BIGINT) AS n", *_copy, "BEGIN", "DELETE FROM t WHERE r = 1", "COMMIT", "ROLLBACK", "SELECT COUNT(*) AS n FROM t")
script("transaction_savepoint", "SELECT CAST(20 AS BIGINT) AS n", *_copy, "START TRANSACTION", "DELETE FROM t WHERE r = 1", "SAVEPOINT a", "SAVEPOINT b", "RELEASE SAVEPOINT b", "DELETE FROM t", "ROLLBACK TO SAVEPOINT a", "COMMIT", "SELECT COUNT(*) AS n FROM t")
script("lock_tables", "SELECT CAST(25 AS BIGINT) AS n", "LOCK TABLES nation READ", "UNLOCK TABLES", "SELECT COUNT(*) AS n FROM nation")

# --- procedures and triggers -----------------------------------------------------------------------------------

script("procedure_while", "SELECT 55 AS f", "CREATE PROCEDURE fib(IN n INT, OUT r INT) BEGIN DECLARE a, b, i INT DEFAULT 0; SET b = 1; WHILE i < n DO SET r = a + b; SET a = b, b = r; SET i = i + 1; END WHILE; SET r = a; END", "CALL fib(10, @f)", "SELECT @f AS f")
script("procedure_cursor", "SELECT CAST(sum(r_regionkey) AS BIGINT) AS total FROM region WHERE r_regionkey <> 2",
       "CREATE PROCEDURE sums() BEGIN DECLARE done INT DEFAULT 0; DECLARE x, total BIGINT DEFAULT 0; DECLARE cur CURSOR FOR SELECT r_regionkey FROM region; DECLARE CONTINUE HANDLER FOR NOT FOUND SET done = 1; OPEN cur; l: LOOP FETCH cur INTO x; IF done THEN LEAVE l; END IF; IF x = 2 THEN ITERATE l; END IF; SET total = total + x; END LOOP; CLOSE cur; SELECT CAST(total AS SIGNED) AS total; END", "CALL sums()")
script("procedure_signal", "SELECT 'caught' AS m", "CREATE PROCEDURE sig(x INT) BEGIN DECLARE bad CONDITION FOR SQLSTATE '45000'; DECLARE EXIT HANDLER FOR bad SELECT 'caught' AS m; IF x > 1 THEN SIGNAL bad SET MESSAGE_TEXT = 'no'; ELSEIF x = 1 THEN SELECT 'one' AS m; ELSE SELECT 'zero' AS m; END IF; END", "CALL sig(2)")
script("procedure_case", "SELECT 'two' AS m", "CREATE PROCEDURE c(x INT) BEGIN CASE x WHEN 1 THEN SELECT 'one' AS m; WHEN 2 THEN SELECT 'two' AS m; ELSE SELECT 'many' AS m; END CASE; END", "CALL c(2)")
refused("procedure_case_without_else", "SELECT CAST(1 AS BIGINT) AS n, min(error) AS error FROM (VALUES ('Signal')) t(error)", ("CREATE PROCEDURE c(x INT) BEGIN CASE x WHEN 1 THEN SELECT 'one' AS m; END CASE; END",), ("CALL c(2)",), "SELECT COUNT(*) AS n, MIN(error) AS error FROM refused")
script("procedure_repeat", "SELECT * FROM (VALUES (1), (2), (3)) t(v)", "CREATE TABLE u (v INT)", "CREATE PROCEDURE rep(n INT) BEGIN DECLARE i INT DEFAULT 0; REPEAT SET i = i + 1; INSERT INTO u VALUES (i); UNTIL i >= n END REPEAT; END", "CALL rep(3)", "SELECT v FROM u")
script("procedure_external", "SELECT 8 AS r", "CALL twice(4)", setup=lambda e: e.procedures.__setitem__("twice", lambda eng, n: eng.sql(f"SELECT {n} * 2 AS r")))
script("procedure_metadata", "SELECT * FROM (VALUES ('a', 'IN', 'int'), ('b', 'OUT', 'bigint')) t(parameter_name, parameter_mode, data_type)", "CREATE PROCEDURE pr(a INT, OUT b BIGINT) SET b = a", "CREATE PROCEDURE gone() SELECT 1", "DROP PROCEDURE gone", "SELECT parameter_name, parameter_mode, data_type FROM information_schema.parameters")
script("trigger_before_insert", "SELECT n_nationkey AS k, least(n_regionkey, 2) AS v FROM nation", "CREATE TABLE u (k INT, v INT)", "CREATE TRIGGER cap BEFORE INSERT ON u FOR EACH ROW BEGIN IF NEW.v > 2 THEN SET NEW.v = 2; END IF; END", "INSERT INTO u SELECT n_nationkey, n_regionkey FROM nation", "SELECT k, v FROM u")
script("trigger_after_insert", "SELECT n_nationkey AS k, 'new ' || n_regionkey AS what FROM nation", "CREATE TABLE u (k INT, v INT)", "CREATE TABLE log (k INT, what VARCHAR(20))", "CREATE TRIGGER noted AFTER INSERT ON u FOR EACH ROW INSERT INTO log VALUES (NEW.k, CONCAT('new ', NEW.v))", "INSERT INTO u SELECT n_nationkey, n_regionkey FROM nation", "SELECT k, what FROM log")
script("trigger_update_delete", "SELECT * FROM (VALUES (1, 'gone'), (2, 'was 20')) t(k, what)", "CREATE TABLE u (k INT, v INT)", "CREATE TABLE log (k INT, what VARCHAR(20))", "CREATE TRIGGER a AFTER UPDATE ON u FOR EACH ROW INSERT INTO log VALUES (OLD.k, CONCAT('was ', OLD.v))", "CREATE TRIGGER b AFTER DELETE ON u FOR EACH ROW BEGIN INSERT INTO log VALUES (OLD.k, 'gone'); END",
       "CREATE TRIGGER c BEFORE UPDATE ON u FOR EACH ROW SET NEW.v = NEW.v + 1", "INSERT INTO u VALUES (1, 10), (2, 20)", "DELETE FROM u WHERE k = 1", "UPDATE u SET v = 0", "DROP TRIGGER c", "SELECT k, what FROM log")
refused("trigger_signal", "SELECT CAST(1 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS n", ("CREATE TABLE u (v INT)", "CREATE TRIGGER no BEFORE INSERT ON u FOR EACH ROW BEGIN IF NEW.v < 0 THEN SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'negative'; END IF; END"), ("INSERT INTO u VALUES (-1)",), "SELECT (SELECT COUNT(*) FROM refused) AS refused, COUNT(*) AS n FROM u")

# --- accounts, SHOW and information_schema -------------------------------------------------------------------------

script("accounts", "SELECT * FROM (VALUES ('GRANT USAGE ON *.* TO `bob`@`localhost`'), ('GRANT SELECT ON `default`.`nation` TO `bob`@`localhost`'), ('GRANT `reader`@`%` TO `bob`@`localhost`')) t(grants)",
       "CREATE USER 'old'@'localhost', 'gone'@'localhost'", "ALTER USER 'old'@'localhost' IDENTIFIED BY 'x'", "RENAME USER 'old'@'localhost' TO 'bob'@'localhost'", "DROP USER 'gone'@'localhost'", "CREATE ROLE reader, writer", "GRANT SELECT, INSERT ON default.nation TO 'bob'@'localhost'", "GRANT reader, writer TO 'bob'@'localhost'", "REVOKE writer FROM 'bob'@'localhost'", "DROP ROLE writer",
       "GRANT PROXY ON 'root'@'localhost' TO 'bob'@'localhost'", "REVOKE PROXY ON 'root'@'localhost' FROM 'bob'@'localhost'", "REVOKE INSERT ON default.nation FROM 'bob'@'localhost'", "FLUSH PRIVILEGES", "SHOW GRANTS FOR 'bob'@'localhost'")
script("show_tables", "SELECT * FROM (VALUES ('nation', 'BASE TABLE'), ('nations', 'VIEW')) t(table_name, table_type)", "CREATE VIEW nations AS SELECT * FROM nation", "SHOW FULL TABLES LIKE 'nation%'")
script("show_columns", "SELECT * FROM (VALUES ('k', 'int', 'NO', 'PRI', NULL, 'auto_increment'), ('v', 'varchar(5)', 'YES', 'UNI', 'x', '')) t(field, type, \"null\", key, \"default\", extra)", "CREATE TABLE u (k INT PRIMARY KEY AUTO_INCREMENT, v VARCHAR(5) DEFAULT 'x' UNIQUE)", "SHOW COLUMNS FROM u")
script("show_create_table", "SELECT 'u' AS \"table\", 'CREATE TABLE `u` (\n  `k` int NOT NULL,\n  `v` int DEFAULT 3,\n  PRIMARY KEY (`k`),\n  KEY `i` (`v`),\n  CONSTRAINT `c` CHECK (v < 9)\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4 COLLATE=utf8mb4_0900_bin' AS create_table", "CREATE TABLE u (k INT PRIMARY KEY, v INT DEFAULT 3, INDEX i (v), CONSTRAINT c CHECK (v < 9))", "SHOW CREATE TABLE u")
script("show_create_others", "SELECT 'w' AS view, 'CREATE VIEW `w` AS SELECT 1 AS x' AS create_view", "CREATE VIEW w AS SELECT 1 AS x", "SHOW CREATE DATABASE `default`", "CREATE PROCEDURE pr() SELECT 1", "SHOW CREATE PROCEDURE pr", "SHOW CREATE VIEW w")
script("show_create_trigger", "SELECT 'a' AS \"trigger\", 'CREATE TRIGGER a BEFORE INSERT ON u FOR EACH ROW SET NEW.v = 1' AS sql_original_statement", "CREATE TABLE u (v INT)", "CREATE TRIGGER a BEFORE INSERT ON u FOR EACH ROW SET NEW.v = 1", "SHOW CREATE TRIGGER a", "SELECT trigger_name AS `trigger`, CONCAT('CREATE TRIGGER ', trigger_name, ' ', action_timing, ' ', event_manipulation, ' ON ', event_object_table, ' FOR EACH ROW ', action_statement) AS sql_original_statement FROM information_schema.triggers")
script("show_indexes", "SELECT 'u' AS \"table\", CAST(0 AS BIGINT) AS non_unique, 'PRIMARY' AS key_name, CAST(1 AS BIGINT) AS seq_in_index, 'k' AS column_name, 'A' AS collation, '' AS nullable, 'BTREE' AS index_type, 'YES' AS is_visible", "CREATE TABLE u (k INT PRIMARY KEY)", "SHOW INDEXES FROM u")
script("show_databases", "SELECT * FROM (VALUES ('information_schema'), ('default')) t(database)", "SHOW DATABASES")
script("show_variables", "SELECT 'autocommit' AS variable_name, '0' AS value", "SET autocommit = 0", "SHOW VARIABLES LIKE 'autocommit'")
script("show_status", "SELECT 'Threads_connected' AS variable_name, '1' AS value", "SHOW STATUS LIKE 'Threads_connected'")
script("show_charset", "SELECT 'utf8mb4' AS charset, 'UTF-8 Unicode' AS description, 'utf8mb4_0900_ai_ci' AS default_collation, CAST(4 AS INT) AS maxlen", "SHOW CHARACTER SET LIKE 'utf8mb4'")
script("show_triggers", "SELECT 'a' AS \"trigger\", 'INSERT' AS event, 'u' AS \"table\", 'SET NEW.v = 1' AS statement, 'BEFORE' AS timing", "CREATE TABLE u (v INT)", "CREATE TRIGGER a BEFORE INSERT ON u FOR EACH ROW SET NEW.v = 1", "SHOW TRIGGERS")
script("show_table_status", "SELECT 'u' AS name, 'InnoDB' AS engine, '10' AS version, 'Dynamic' AS row_format, CAST(NULL AS BIGINT) AS rows, CAST(1 AS BIGINT) AS auto_increment, 'utf8mb4_0900_bin' AS collation, 'x' AS comment", "CREATE TABLE u (k INT PRIMARY KEY AUTO_INCREMENT) COMMENT = 'x'", "SHOW TABLE STATUS LIKE 'u'")
script("show_processlist", "SELECT CAST(1 AS BIGINT) AS id, 'root' AS \"user\", 'localhost' AS host, 'default' AS db, 'Query' AS command, CAST(0 AS BIGINT) AS time, 'running' AS state, 'SHOW PROCESSLIST' AS info", "SHOW PROCESSLIST")
script("show_privileges", "SELECT 'Select' AS privilege, 'Tables' AS context, '' AS comment", "SHOW PRIVILEGES", "SELECT 'Select' AS privilege, 'Tables' AS context, '' AS comment")
script("show_warnings", "SELECT CAST(0 AS BIGINT) AS n", "SHOW WARNINGS", "SHOW REPLICA STATUS", "SHOW BINARY LOGS", "SHOW BINARY LOG STATUS", "SELECT COUNT(*) AS n FROM information_schema.plugins")
script("describe", "SELECT 'k' AS field, 'int' AS type, 'NO' AS \"null\", 'PRI' AS key, CAST(NULL AS VARCHAR) AS \"default\", '' AS extra", "CREATE TABLE u (k INT PRIMARY KEY)", "DESCRIBE u")
_schema = "CREATE TABLE pa (id INT PRIMARY KEY, g POINT, CONSTRAINT big CHECK (id < 100))", "CREATE TABLE ch (k INT PRIMARY KEY, pid INT, UNIQUE KEY u (pid), CONSTRAINT f FOREIGN KEY (pid) REFERENCES pa (id) ON DELETE CASCADE)", "CREATE VIEW w AS SELECT k FROM ch", "CREATE USER 'bob'@'localhost'", "GRANT SELECT ON default.ch TO 'bob'@'localhost'", "CREATE PROCEDURE pr(a INT) SELECT a", "CREATE TRIGGER tr BEFORE INSERT ON pa FOR EACH ROW SET NEW.id = NEW.id"
_is = {
    "tables": ("table_name, table_type", "WHERE table_name IN ('pa', 'ch', 'w')", "('pa', 'BASE TABLE'), ('ch', 'BASE TABLE'), ('w', 'VIEW')"), "columns": ("table_name, column_name, data_type, column_key", "WHERE table_name IN ('pa', 'ch')", "('pa', 'id', 'int', 'PRI'), ('pa', 'g', 'point', ''), ('ch', 'k', 'int', 'PRI'), ('ch', 'pid', 'int', 'UNI')"),
    "views": ("table_name, view_definition", "", "('w', 'SELECT k FROM ch')"), "view_table_usage": ("view_name, table_name", "", "('w', 'ch')"), "schemata": ("schema_name", "", "('information_schema'), ('default')"), "character_sets": ("character_set_name, maxlen", "WHERE character_set_name = 'utf8mb4'", "('utf8mb4', CAST(4 AS BIGINT))"),
    "collations": ("collation_name, id", "WHERE collation_name = 'utf8mb4_0900_bin'", "('utf8mb4_0900_bin', CAST(309 AS BIGINT))"), "collation_character_set_applicability": ("character_set_name", "WHERE collation_name = 'binary'", "('binary')"), "check_constraints": ("constraint_name, check_clause", "", "('big', '(id < 100)')"),
    "table_constraints": ("table_name, constraint_name, constraint_type", "", "('pa', 'PRIMARY', 'PRIMARY KEY'), ('pa', 'big', 'CHECK'), ('ch', 'PRIMARY', 'PRIMARY KEY'), ('ch', 'u', 'UNIQUE'), ('ch', 'f', 'FOREIGN KEY')"), "table_constraints_extensions": ("table_name, constraint_name", "WHERE table_name = 'pa'", "('pa', 'PRIMARY'), ('pa', 'big')"),
    "key_column_usage": ("constraint_name, column_name, referenced_table_name", "WHERE table_name = 'ch'", "('PRIMARY', 'k', NULL), ('u', 'pid', NULL), ('f', 'pid', 'pa')"), "referential_constraints": ("constraint_name, delete_rule, update_rule", "", "('f', 'CASCADE', 'NO ACTION')"), "statistics": ("index_name, column_name, non_unique", "WHERE table_name = 'ch'", "('PRIMARY', 'k', CAST(0 AS BIGINT)), ('u', 'pid', CAST(0 AS BIGINT))"),
    "triggers": ("trigger_name, event_object_table", "", "('tr', 'pa')"), "routines": ("routine_name, routine_type", "", "('pr', 'PROCEDURE')"), "parameters": ("specific_name, parameter_name", "", "('pr', 'a')"), "engines": ("engine, support", "", "('InnoDB', 'DEFAULT')"), "processlist": ("id, command", "", "(CAST(1 AS BIGINT), 'Query')"), "keywords": ("word, reserved", "WHERE word = 'SELECT'", "('SELECT', CAST(1 AS BIGINT))"),
    "st_geometry_columns": ("table_name, column_name, geometry_type_name", "", "('pa', 'g', 'point')"), "st_spatial_reference_systems": ("srs_id", "", "(CAST(0 AS BIGINT)), (CAST(4326 AS BIGINT))"), "st_units_of_measure": ("unit_name, conversion_factor", "WHERE unit_name = 'foot'", "('foot', '0.3048')"), "user_attributes": ("user, host", "", "('root', 'localhost'), ('bob', 'localhost')"),
    "user_privileges": ("grantee, privilege_type", "", "('''root''@''localhost''', 'ALL PRIVILEGES')"), "table_privileges": ("grantee, table_name, privilege_type", "", "('''bob''@''localhost''', 'ch', 'SELECT')"), "schemata_extensions": ("schema_name", "", "('information_schema'), ('default')"), "tables_extensions": ("table_name", "WHERE table_name = 'ch'", "('ch')"), "columns_extensions": ("column_name", "WHERE table_name = 'ch'", "('k'), ('pid')"),
}
for _name, (_cols, _where, _rows) in _is.items():
    script(f"is_{_name}", f"SELECT * FROM (VALUES {_rows}) t({', '.join(chr(34) + x.strip() + chr(34) for x in _cols.split(','))})", *_schema, f"SELECT {_cols} FROM information_schema.{_name} {_where}")
_none = "administrable_role_authorizations applicable_roles column_privileges column_statistics enabled_roles events files optimizer_trace partitions plugins profiling resource_groups role_column_grants role_routine_grants role_table_grants schema_privileges tablespaces tablespaces_extensions view_routine_usage".split()
script("is_empty_tables", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST(0 AS BIGINT))" for n in _none) + ") t(name, n)", " UNION ALL ".join(f"SELECT '{n}' AS name, COUNT(*) AS n FROM information_schema.{n}" for n in _none))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SELECT ... INTO OUTFILE and back by LOAD DATA, in the folder the executors share."""
    import uuid

    from ..operators.recursive import checkpoint_dir

    e = engine(spark, sf_dir, "nation")
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4()}"
    e.sql(f"SELECT n_nationkey, n_name, NULLIF(n_regionkey, 1) FROM nation INTO OUTFILE '{path}/a' FIELDS TERMINATED BY ',' ENCLOSED BY '\"'")
    e.sql("CREATE TABLE back (k INT PRIMARY KEY, name VARCHAR(30), r INT, up VARCHAR(30))")
    e.sql(f"LOAD DATA INFILE '{path}/a' INTO TABLE back FIELDS TERMINATED BY ',' ENCLOSED BY '\"' (k, name, r) SET up = UPPER(name)")
    e.sql(f"SELECT n_name FROM nation WHERE n_nationkey = 3 INTO DUMPFILE '{path}/b'")
    return e.sql("SELECT k, name, r, up FROM back")


QUERIES["load_data_round_trip"], SQL["load_data_round_trip"] = _files, "SELECT n_nationkey AS k, n_name AS name, nullif(n_regionkey, 1) AS r, upper(n_name) AS up FROM nation"
