"""String and binary functions."""

from __future__ import annotations

import re
import secrets
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import alias_native, fn, python, text

alias_native(
    {n: (n, 1, 1) for n in ("bit_length", "char_length", "character_length", "lcase", "lower", "ltrim", "md5", "octet_length", "reverse", "rtrim", "sha", "sha1", "ucase", "unhex", "upper", "space")}
    | {"bin": ("bin", 1, 1), "concat": ("concat", 1, None), "concat_ws": ("concat_ws", 2, None), "elt": ("elt", 2, None), "find_in_set": ("find_in_set", 2, 2), "instr": ("instr", 2, 2)}
    | {"left": ("left", 2, 2), "right": ("right", 2, 2), "locate": ("locate", 2, 3), "position": ("locate", 2, 2), "lpad": ("lpad", 3, 3), "rpad": ("rpad", 3, 3), "repeat": ("repeat", 2, 2)}
    | {"replace": ("replace", 3, 3), "sha2": ("sha2", 2, 2), "substring_index": ("substring_index", 3, 3), "hex": ("hex", 1, 1)}
)


@fn("trim")
def trim(x):
    return F.trim(x)


@fn("length")
def length(x):
    """Bytes, not characters."""
    return F.octet_length(text(x))


@fn("ascii")
def ascii_(x):
    """The first byte."""
    return F.coalesce(F.conv(F.substring(F.hex(F.encode(text(x), "UTF-8")), 1, 2), 16, 10).cast("int"), F.when(x.isNotNull(), F.lit(0)))


@fn("ord")
def ord_(x):
    """The first character's bytes as one number."""
    return F.coalesce(F.conv(F.hex(F.encode(F.left(text(x), F.lit(1)), "UTF-8")), 16, 10).cast("long"), F.when(x.isNotNull(), F.lit(0)))


@fn("char", least=1, most=None)
def char(*xs):
    return F.concat_ws("", *[F.char(x.cast("int")) for x in xs])


def _slice(s, pos, n=None):
    size = F.char_length(text(s))
    n = size if n is None else n
    return F.when((pos == 0) | (n <= 0) | (-pos > size), F.when(s.isNotNull() & pos.isNotNull() & n.isNotNull(), F.lit(""))).otherwise(F.substring(text(s), pos.cast("int"), n.cast("int")))


@fn("substring", "substr", "mid", least=2, most=3)
def substring(s, pos, n=None):
    return _slice(s, pos, n)


@fn("insert", least=4)
def insert(s, pos, n, new):
    size = F.char_length(s)
    n = F.when((n < 0) | (pos + n > size + 1), size - pos + 1).otherwise(n)
    return F.when((pos < 1) | (pos > size), s).otherwise(F.overlay(s, new, pos.cast("int"), n.cast("int")))


@fn("field", least=2, most=None)
def field(x, *xs):
    return F.coalesce(F.array_position(F.array(*xs), x), F.lit(0)).cast("int")


@fn("export_set", least=3, most=5)
def export_set(bits, on, off, sep=None, n=None):
    n = F.lit(64) if n is None else F.greatest(F.lit(0), F.least(F.lit(64), n))
    each = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.getbit(bits.cast("long"), i.cast("int")) == 1, on).otherwise(off))
    sep = F.lit(",") if sep is None else sep
    return F.aggregate(F.slice(each, 1, n.cast("int")), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, sep, x)))


@fn("make_set", least=2, most=None)
def make_set(bits, *xs):
    return F.array_join(F.filter(F.array(*[F.when(F.getbit(bits.cast("long"), F.lit(i)) == 1, x) for i, x in enumerate(xs)]), lambda x: x.isNotNull()), ",")


@fn("format", least=2, most=3)
def format_(x, d, locale=None):
    return F.call_function("format_number", x, d.cast("int"))


@fn("from_base64")
def from_base64(x):
    return F.unbase64(x)


@fn("to_base64")
def to_base64(x):
    """Lines of 76 characters."""
    return F.regexp_replace(F.base64(F.encode(text(x), "UTF-8")).cast("string"), r"\r\n", "\n")


@fn("quote")
def quote(x):
    s = x
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\x00", "\\0"), ("\x1a", "\\Z")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit("'"), s, F.lit("'")), F.lit("NULL"))


@fn("strcmp", least=2)
def strcmp(a, b):
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def _flags(pattern: Column, flags: Column | None) -> Column:
    if flags is None:
        return pattern
    on = F.concat(F.when(flags.contains("i"), "i").otherwise(""), F.when(flags.contains("m"), "m").otherwise(""), F.when(flags.contains("n"), "s").otherwise(""))
    return F.when(on == "", pattern).otherwise(F.concat(F.lit("(?"), on, F.lit(")"), pattern))


@fn("regexp_like", least=2, most=3)
def regexp_like(s, p, flags=None):
    return F.regexp_like(s, _flags(p, flags))


@fn("regexp_substr", least=2, most=5)
def regexp_substr(s, p, pos=None, occ=None, flags=None):
    found = F.regexp_extract_all(s if pos is None else F.substr(s, pos.cast("int")), _flags(p, flags), F.lit(0))
    return F.try_element_at(found, F.lit(1) if occ is None else F.greatest(occ, F.lit(1)).cast("int"))


@fn("regexp_instr", least=2, most=6)
def regexp_instr(s, p, pos=None, occ=None, ret=None, flags=None):
    if occ is None and ret is None:
        start = F.lit(1) if pos is None else pos.cast("int")
        at = F.regexp_instr(F.substr(s, start), _flags(p, flags))
        return F.when(at > 0, at + start - 1).otherwise(at)

    def find(s, p, pos, occ, ret):
        for i, m in enumerate(re.finditer(p, s[int(pos) - 1 :]), 1):
            if i == int(occ):
                return (m.end() if int(ret) else m.start()) + int(pos)
        return 0

    one = F.lit(1)
    return python(find, "int")(s, _flags(p, flags), one if pos is None else pos, one if occ is None else occ, F.lit(0) if ret is None else ret)


@fn("regexp_replace", least=3, most=6)
def regexp_replace(s, p, r, pos=None, occ=None, flags=None):
    if occ is None:
        return F.call_function("regexp_replace", s, _flags(p, flags), r, *([] if pos is None else [pos.cast("int")]))

    def sub(s, p, r, pos, occ):
        head, tail, n = s[: int(pos) - 1], s[int(pos) - 1 :], 0
        r = re.sub(r"\$(\d)", r"\\\1", r)

        def one(m):
            nonlocal n
            n += 1
            return m.expand(r) if int(occ) in (0, n) else m[0]

        return head + re.sub(p, one, tail)

    return python(sub, "string")(s, _flags(p, flags), r, F.lit(1) if pos is None else pos, occ)


def like(x: Column, pattern: str, escape: str = "\\", ignore_case: bool = False) -> Column:
    """LIKE with an escape character; a case-insensitive collation compares in lower case."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return x.rlike(("(?si)" if ignore_case else "(?s)") + "^" + out + "$")


@fn("soundex")
def soundex(x):
    """Not cut to four characters."""

    def code(s):
        values = {c: str(i) for i, cs in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), 1) for c in cs}
        out, last = "", ""
        for c in s.upper():
            if not c.isalpha():
                continue
            v = values.get(c, "")
            if not out:
                out, last = c, v
            elif c in "HW":
                continue
            else:
                if v and v != last:
                    out += v
                last = v
        return out.ljust(4, "0") if out else ""

    return python(code, "string")(x)


@fn("compress")
def compress(x):
    return python(lambda s: (lambda b: len(b).to_bytes(4, "little") + zlib.compress(b) if b else b"")(s if isinstance(s, bytes) else s.encode()), "binary")(x)


@fn("uncompress")
def uncompress(x):
    return python(lambda b: zlib.decompress(b[4:]) if b else b"", "binary")(x)


@fn("uncompressed_length")
def uncompressed_length(x):
    return python(lambda b: int.from_bytes(b[:4], "little") if b else 0, "long")(x)


@fn("is_binary")
def is_binary(x):
    return F.instr(F.substring(text(x), 1, 8000), "\x00") > 0


@fn("random_bytes")
def random_bytes(n):
    return python(lambda n: secrets.token_bytes(int(n)) if 1 <= n <= 1024 else None, "binary", pure=False)(n)


@fn("validate_password_strength")
def validate_password_strength(x):
    n = F.char_length(x)
    mixed = x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[0-9]") & x.rlike("[^a-zA-Z0-9]")
    return F.when(n < 4, 0).when(n < 8, 25).when(mixed, 100).when(n >= 8, 50)


@fn("collation")
def collation(x):
    return F.when(F.collation(x) == "SYSTEM.BUILTIN.UTF8_BINARY", "utf8mb4_0900_bin").otherwise("utf8mb4_0900_ai_ci")


@fn("charset")
def charset(x):
    return F.when(F.typeof(x) == "binary", "binary").otherwise("utf8mb4")


@fn("coercibility")
def coercibility(x):
    return F.when(F.typeof(x) == "void", 6).when(F.typeof(x) == "string", 2).otherwise(5)
