"""Mathematical functions, operators with the dialect's rules, conditionals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import alias_native, fn, number

alias_native(
    {n: (n, 1, 1) for n in ("abs", "acos", "asin", "bit_count", "ceil", "ceiling", "cos", "cot", "degrees", "exp", "floor", "radians", "sign", "sin", "tan")}
    | {"atan2": ("atan2", 2, 2), "pi": ("pi", 0, 0), "pow": ("power", 2, 2), "power": ("power", 2, 2), "rand": ("rand", 0, 1), "conv": ("conv", 3, 3), "coalesce": ("coalesce", 1, None)}
    | {"if": ("if", 3, 3), "ifnull": ("ifnull", 2, 2), "nullif": ("nullif", 2, 2), "isnull": ("isnull", 1, 1)}
)


@fn("crc32")
def crc32(x):
    return F.crc32(x.cast("string").cast("binary"))


@fn("atan", least=1, most=2)
def atan(y, x=None):
    return F.atan(y) if x is None else F.atan2(y, x)


def _positive(x: Column, value: Column) -> Column:
    return F.when(x > 0, value)


@fn("ln")
def ln(x):
    return _positive(x, F.log(x))


@fn("log10")
def log10(x):
    return _positive(x, F.log10(x))


@fn("log2")
def log2(x):
    return _positive(x, F.log2(x))


@fn("log", least=1, most=2)
def log(a, b=None):
    if b is None:
        return ln(a)
    return F.when((a > 0) & (b > 0) & (a != 1), F.log(b) / F.log(a))


@fn("sqrt")
def sqrt(x):
    return F.when(x >= 0, F.sqrt(x))


@fn("mod", least=2)
def mod(a, b):
    return F.try_mod(a, b)


@fn("oct")
def oct_(x):
    return F.conv(x.cast("string"), 10, 8)


@fn("round", least=1, most=2)
def round_(x, d=None):
    return F.call_function("round", x, F.lit(0) if d is None else d.cast("int"))


@fn("truncate", least=2)
def truncate(x, d):
    scale = F.pow(F.lit(10.0), d)
    cut = F.when(x >= 0, F.floor(F.abs(x) * scale)).otherwise(-F.floor(F.abs(x) * scale))
    return cut / scale


def divide(a: Column, b: Column) -> Column:
    """``/``: NULL for a zero divisor; exact operands give four more decimals."""
    return F.try_divide(a, b)


def int_divide(a: Column, b: Column) -> Column:
    """DIV: the quotient towards zero; NULL for a zero divisor."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)).cast("long")


def unsigned(x: Column) -> Column:
    """A 64-bit pattern as an unsigned number."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def bit_and(a, b):
    return unsigned(a.cast("long").bitwiseAND(b.cast("long")))


def bit_or(a, b):
    return unsigned(a.cast("long").bitwiseOR(b.cast("long")))


def bit_xor(a, b):
    return unsigned(a.cast("long").bitwiseXOR(b.cast("long")))


def bit_not(a):
    return unsigned(F.bitwise_not(a.cast("long")))


def shift(a, n, left: bool):
    """<< and >>: unsigned; 64 places or more give 0."""
    moved = F.call_function("shiftleft" if left else "shiftrightunsigned", a.cast("long"), n.cast("int"))
    return F.when((n < 0) | (n >= 64), F.lit(0).cast("decimal(20,0)")).otherwise(unsigned(moved))


def logical_xor(a: Column, b: Column) -> Column:
    return a.cast("boolean") != b.cast("boolean")


def null_safe_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def row_compare(left: list[Column], op: str, right: list[Column]) -> Column:
    """Comparison of tuples as a chain of comparisons of their members, with SQL's unknown."""
    pairs = list(zip(left, right, strict=True))
    equal = reduce(lambda x, y: x & y, [a == b for a, b in pairs])
    if op == "=":
        return equal
    if op == "<>":
        return ~equal
    strict, last = op[0], len(pairs) - 1
    out = None
    for i in range(last, -1, -1):
        a, b = pairs[i]
        less = a < b if strict == "<" else a > b
        here = (a <= b if strict == "<" else a >= b) if i == last and op.endswith("=") else less
        out = here if out is None else less | ((a == b) & out)
    return out


@fn("greatest", least=1, most=None)
def greatest(*xs):
    return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in xs]), F.greatest(*xs) if len(xs) > 1 else xs[0])


@fn("least", least=1, most=None)
def least(*xs):
    return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in xs]), F.least(*xs) if len(xs) > 1 else xs[0])


def convert(x: Column, kind: str) -> Column:
    """CAST to one of the dialect's targets; text that isn't a number starts with 0, dates that aren't are NULL."""
    name, _, rest = kind.upper().partition("(")
    size = rest.rstrip(")")
    if name in ("SIGNED", "BIGINT", "INT", "INTEGER"):
        return F.coalesce(x.try_cast("long"), F.round(number(x)).cast("long"))
    if name == "UNSIGNED":
        whole = F.coalesce(x.try_cast("decimal(20,0)"), F.round(number(x)).cast("decimal(20,0)"))
        return F.when(whole < 0, whole + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(whole).cast("decimal(20,0)")
    if name in ("CHAR", "NCHAR", "VARCHAR", "TEXT"):
        s = x.cast("string")
        return F.left(s, F.lit(int(size))) if size else s
    if name in ("BINARY", "VARBINARY"):
        b = x.cast("string").cast("binary")
        return F.substring(b, 1, int(size)) if size else b
    if name in ("DECIMAL", "DEC", "NUMERIC"):
        p, _, s = size.partition(",")
        return F.coalesce(x.try_cast(f"decimal({int(p or 10)},{int(s or 0)})"), number(x).cast(f"decimal({int(p or 10)},{int(s or 0)})"))
    if name in ("DOUBLE", "REAL", "FLOAT"):
        return number(x).cast("float" if name == "FLOAT" else "double")
    if name == "DATE":
        return x.try_cast("date")
    if name in ("DATETIME", "TIMESTAMP"):
        return x.try_cast("timestamp_ntz")
    if name == "TIME":
        from .datetime import time

        return time(x)
    if name == "YEAR":
        return F.coalesce(F.year(x.try_cast("date")), number(x).cast("int"))
    if name == "JSON":
        from .json import as_json

        return as_json(x)
    if name in ("BOOLEAN", "BOOL"):
        return number(x) != 0
    if name == "VECTOR":
        return F.from_json(x.cast("string"), "array<float>")
    raise ValueError(f"no cast to {kind}")


def convert_using(x: Column, charset: str) -> Column:
    """CONVERT(x USING charset): bytes for binary; characters a small set lacks become ``?``."""
    if charset == "binary":
        return x.cast("string").cast("binary")
    s = x.cast("string")
    if charset in ("ascii", "us-ascii"):
        return F.regexp_replace(s, r"[^\x00-\x7f]", "?")
    if charset in ("latin1", "cp1252"):
        return F.regexp_replace(s, r"[^\x00-\xff]", "?")
    return s


def trim_text(s: Column, what: Column, side: str) -> Column:
    """TRIM of repeats of a longer text."""
    quoted = F.concat(F.lit(r"\Q"), what, F.lit(r"\E"))
    if side in ("BOTH", "LEADING"):
        s = F.regexp_replace(s, F.concat(F.lit("^(?:"), quoted, F.lit(")+")), F.lit(""))
    if side in ("BOTH", "TRAILING"):
        s = F.regexp_replace(s, F.concat(F.lit("(?:"), quoted, F.lit(")+$")), F.lit(""))
    return s
