"""Network addresses, UUIDs and vectors."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import alias_native, fn, python

alias_native({"uuid": ("uuid", 0, 0)})
_V4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
_HEX = "[0-9a-fA-F]"


@fn("inet_aton")
def inet_aton(x):
    """Short forms: the last part fills the bytes that are left."""
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    n = F.size(parts)
    head = F.aggregate(F.slice(parts, 1, n - 1), F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    return F.when(x.rlike(r"^\d+(\.\d+){0,3}$"), head * F.pow(F.lit(256), 5 - n).cast("long") + F.element_at(parts, -1))


@fn("inet_ntoa")
def inet_ntoa(n):
    n = n.cast("long")
    return F.when(n.between(0, 4294967295), F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))


@fn("is_ipv4")
def is_ipv4(x):
    return x.rlike(_V4)


@fn("is_ipv6")
def is_ipv6(x):
    def ok(s):
        try:
            return ipaddress.ip_address(s).version == 6
        except ValueError:
            return False

    return python(ok, "boolean")(x)


@fn("inet6_aton")
def inet6_aton(x):
    return python(lambda s: ipaddress.ip_address(s).packed, "binary")(x)


@fn("inet6_ntoa")
def inet6_ntoa(b):
    return python(lambda b: str(ipaddress.ip_address(bytes(b))) if len(b) in (4, 16) else None, "string")(b)


@fn("is_ipv4_compat")
def is_ipv4_compat(b):
    h = F.hex(b)
    return (F.length(h) == 32) & h.startswith("0" * 24) & ~h.endswith("0" * 8)


@fn("is_ipv4_mapped")
def is_ipv4_mapped(b):
    h = F.hex(b)
    return (F.length(h) == 32) & h.startswith("0" * 20 + "FFFF")


@fn("is_uuid")
def is_uuid(x):
    dashed = f"{_HEX}{{8}}(-{_HEX}{{4}}){{3}}-{_HEX}{{12}}"
    return x.rlike(f"^({dashed}|urn:uuid:{dashed}|\\{{{dashed}\\}}|{_HEX}{{32}})$")


@fn("uuid_to_bin", least=1, most=2)
def uuid_to_bin(x, swap=None):
    h = F.regexp_replace(F.regexp_replace(x, r"^urn:uuid:", ""), "[-{}]", "")
    swapped = F.concat(F.substring(h, 13, 4), F.substring(h, 9, 4), F.substring(h, 1, 8), F.substring(h, 17, 16))
    return F.unhex(h if swap is None else F.when(swap.cast("int") == 1, swapped).otherwise(h))


@fn("bin_to_uuid", least=1, most=2)
def bin_to_uuid(b, swap=None):
    h = F.lower(F.hex(b))
    back = F.concat(F.substring(h, 9, 8), F.substring(h, 5, 4), F.substring(h, 1, 4), F.substring(h, 17, 16))
    h = h if swap is None else F.when(swap.cast("int") == 1, back).otherwise(h)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


@fn("uuid_short", least=0)
def uuid_short():
    return F.monotonically_increasing_id() + F.lit(1 << 56)


def _vector(x: Column) -> Column:
    return x.cast("array<double>")


@fn("string_to_vector", "to_vector", "vec_fromtext")
def to_vector(x):
    return F.from_json(x, "array<float>")


@fn("vector_to_string", "from_vector", "vec_totext")
def from_vector(v):
    return F.to_json(v)


def _same_length(a, b, out):
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths"))).otherwise(out)


@fn("vec_distance_l2_squared", "vec_distance", least=2)
def l2_squared(a, b):
    a, b = _vector(a), _vector(b)
    return _same_length(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


@fn("vec_distance_euclidean", least=2)
def euclidean(a, b):
    return F.sqrt(l2_squared(a, b))


@fn("vec_distance_cosine", least=2)
def cosine(a, b):
    a, b = _vector(a), _vector(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return _same_length(a, b, 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


@fn("distance", least=3)
def distance(a, b, metric):
    m = F.upper(metric)
    return F.when(m == "COSINE", cosine(a, b)).when(m.isin("EUCLIDEAN", "L2"), euclidean(a, b)).when(m.isin("L2_SQUARED", "EUCLIDEAN_SQUARED"), l2_squared(a, b))
