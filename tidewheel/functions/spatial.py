"""Geometries: binary columns of a 4-byte SRID and well-known binary; codecs, accessors, measures and predicates.

In Python a geometry is (kind, coordinates): POINT (x, y), LINESTRING [(x, y)],
POLYGON [ring], MULTI* lists of those, GEOMETRYCOLLECTION a list of geometries.
"""

from __future__ import annotations

import json
import math
import re
import struct

from pyspark.sql import functions as F

from .registry import fn, python

KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")
_PART = {"MULTIPOINT": "POINT", "MULTILINESTRING": "LINESTRING", "MULTIPOLYGON": "POLYGON"}


def to_wkb(g) -> bytes:
    kind, c = g
    head = struct.pack("<BI", 1, KINDS.index(kind) + 1)
    pts = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p) for p in ps)
    if kind == "POINT":
        return head + struct.pack("<dd", *c)
    if kind == "LINESTRING":
        return head + pts(c)
    if kind == "POLYGON":
        return head + struct.pack("<I", len(c)) + b"".join(map(pts, c))
    inner = c if kind == "GEOMETRYCOLLECTION" else [(_PART[kind], x) for x in c]
    return head + struct.pack("<I", len(c)) + b"".join(map(to_wkb, inner))


def from_wkb(b: bytes, at: int = 0):
    """(geometry, place after it)."""
    order = "<" if b[at] == 1 else ">"
    (t,) = struct.unpack_from(order + "I", b, at + 1)
    kind, at = KINDS[t - 1], at + 5

    def pts(at):
        (n,) = struct.unpack_from(order + "I", b, at)
        return [struct.unpack_from(order + "dd", b, at + 4 + 16 * i) for i in range(n)], at + 4 + 16 * n

    if kind == "POINT":
        return (kind, struct.unpack_from(order + "dd", b, at)), at + 16
    if kind == "LINESTRING":
        c, at = pts(at)
        return (kind, c), at
    (n,) = struct.unpack_from(order + "I", b, at)
    at, out = at + 4, []
    for _ in range(n):
        if kind == "POLYGON":
            x, at = pts(at)
        else:
            x, at = from_wkb(b, at)
            x = x if kind == "GEOMETRYCOLLECTION" else x[1]
        out.append(x)
    return (kind, out), at


def _num(x: float) -> str:
    return repr(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def to_wkt(g) -> str:
    kind, c = g
    pt = lambda p: f"{_num(p[0])} {_num(p[1])}"
    seq = lambda ps: "(" + ",".join(map(pt, ps)) + ")"
    poly = lambda rs: "(" + ",".join(map(seq, rs)) + ")"
    if kind == "GEOMETRYCOLLECTION":
        return kind + ("(" + ",".join(map(to_wkt, c)) + ")" if c else " EMPTY")
    body = {"POINT": lambda: f"({pt(c)})", "LINESTRING": lambda: seq(c), "POLYGON": lambda: poly(c), "MULTIPOINT": lambda: seq(c), "MULTILINESTRING": lambda: poly(c), "MULTIPOLYGON": lambda: "(" + ",".join(map(poly, c)) + ")"}
    return kind + body[kind]()


_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def from_wkt(s: str):
    tokens, at = [], 0
    while at < len(s.rstrip()):
        m = _TOKEN.match(s, at)
        if not m:
            raise ValueError(f"bad geometry text: {s}")
        tokens.append(m[1])
        at = m.end()
    tokens.reverse()

    def take(x):
        if not tokens or tokens.pop() != x:
            raise ValueError(f"bad geometry text: {s}")

    def listed(item):
        take("(")
        out = [item()]
        while tokens and tokens[-1] == ",":
            tokens.pop()
            out.append(item())
        take(")")
        return out

    pt = lambda: (float(tokens.pop()), float(tokens.pop()))

    def wrapped():
        if tokens[-1] == "(":
            take("(")
            p = pt()
            take(")")
            return p
        return pt()

    def geom():
        kind = tokens.pop().upper()
        if kind == "GEOMCOLLECTION":
            kind = "GEOMETRYCOLLECTION"
        if kind not in KINDS:
            raise ValueError(f"bad geometry text: {s}")
        if tokens and tokens[-1].upper() == "EMPTY":
            tokens.pop()
            return kind, []
        if kind == "POINT":
            return kind, listed(pt)[0]
        if kind == "LINESTRING":
            return kind, listed(pt)
        if kind == "MULTIPOINT":
            return kind, listed(wrapped)
        if kind in ("POLYGON", "MULTILINESTRING"):
            return kind, listed(lambda: listed(pt))
        if kind == "MULTIPOLYGON":
            return kind, listed(lambda: listed(lambda: listed(pt)))
        return kind, listed(geom)

    g = geom()
    if tokens:
        raise ValueError(f"bad geometry text: {s}")
    return g


def pack(g, srid: int = 0) -> bytes:
    return struct.pack("<I", int(srid)) + to_wkb(g)


def unpack(b: bytes):
    return from_wkb(bytes(b), 4)[0]


def srid_of(b: bytes) -> int:
    return struct.unpack_from("<I", bytes(b))[0]


def points(g) -> list[tuple[float, float]]:
    kind, c = g
    if kind == "POINT":
        return [c] if c else []
    if kind in ("LINESTRING", "MULTIPOINT"):
        return list(c)
    if kind in ("POLYGON", "MULTILINESTRING"):
        return [p for r in c for p in r]
    if kind == "MULTIPOLYGON":
        return [p for x in c for r in x for p in r]
    return [p for x in c for p in points(x)]


def segments(g):
    kind, c = g
    lines = {"LINESTRING": lambda: [c], "POLYGON": lambda: c, "MULTILINESTRING": lambda: c, "MULTIPOLYGON": lambda: [r for p in c for r in p]}.get(kind, lambda: [])()
    for line in lines:
        yield from zip(line, line[1:], strict=False)
    if kind == "GEOMETRYCOLLECTION":
        for x in c:
            yield from segments(x)


def polygons(g):
    kind, c = g
    return [c] if kind == "POLYGON" else c if kind == "MULTIPOLYGON" else [p for x in c for p in polygons(x)] if kind == "GEOMETRYCOLLECTION" else []


def ring_area(r) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2


def area(g) -> float:
    return sum(abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:]) for p in polygons(g))


def _side(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def on_segment(p, a, b) -> bool:
    return _side(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def cross(s, t) -> bool:
    (a, b), (c, d) = s, t
    sign = lambda v: (v > 0) - (v < 0)
    if sign(_side(a, b, c)) * sign(_side(a, b, d)) < 0 and sign(_side(c, d, a)) * sign(_side(c, d, b)) < 0:
        return True
    return on_segment(c, a, b) or on_segment(d, a, b) or on_segment(a, c, d) or on_segment(b, c, d)


def place(p, poly) -> int:
    """1 inside a polygon, 0 on its boundary, -1 outside."""
    if any(on_segment(p, a, b) for r in poly for a, b in zip(r, r[1:], strict=False)):
        return 0
    inside = False
    for r in poly:
        for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                inside = not inside
    return 1 if inside else -1


def intersects(g, h) -> bool:
    sg, sh = [*segments(g)], [*segments(h)]
    if any(cross(s, t) for s in sg for t in sh):
        return True
    pg, ph = points(g), points(h)
    if any(place(p, poly) >= 0 for p in pg for poly in polygons(h)) or any(place(p, poly) >= 0 for p in ph for poly in polygons(g)):
        return True
    return any(p in ph or any(on_segment(p, *s) for s in sh) for p in pg) or any(any(on_segment(p, *s) for s in sg) for p in ph)


def covers(g, p) -> bool:
    return any(place(p, x) >= 0 for x in polygons(g)) or any(on_segment(p, *s) for s in segments(g)) or (g[0] in ("POINT", "MULTIPOINT") and p in points(g))


def contains(g, h) -> bool:
    """No point of ``h`` outside ``g`` and some point of it inside (for polygons and simple lines, by vertices and midpoints)."""
    ps = points(h)
    middle = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in segments(h)]
    if not ps or not all(covers(g, p) for p in ps + middle):
        return False
    polys = polygons(g)
    return not polys or any(place(p, x) > 0 for x in polys for p in ps + middle) or bool(polygons(h))


def distance(g, h) -> float:
    if intersects(g, h):
        return 0.0

    def near(p, s):
        (ax, ay), (bx, by) = s
        d = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if d == 0 else max(0, min(1, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / d))
        return math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay))

    sg, sh, pg, ph = [*segments(g)], [*segments(h)], points(g), points(h)
    return min([math.dist(p, q) for p in pg for q in ph] + [near(p, s) for p in pg for s in sh] + [near(p, s) for p in ph for s in sg])


def hull(g):
    ps = sorted(set(points(g)))
    if len(ps) < 3:
        return ("POINT", ps[0]) if len(ps) == 1 else ("LINESTRING", ps)

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and _side(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(ps) + half(ps[::-1])
    return ("POLYGON", [[*ring, ring[0]]])


def envelope(g):
    xs, ys = zip(*points(g), strict=True)
    a, b, c, d = min(xs), min(ys), max(xs), max(ys)
    if (a, b) == (c, d):
        return "POINT", (a, b)
    if a == c or b == d:
        return "LINESTRING", [(a, b), (c, d)]
    return "POLYGON", [[(a, b), (c, b), (c, d), (a, d), (a, b)]]


def centroid(g):
    polys = polygons(g)
    if polys:
        sx = sy = total = 0.0
        for p in polys:
            for i, r in enumerate(p):
                w = ring_area(r)
                k = 1 if (w > 0) == (i == 0) else -1
                for a, b in zip(r, r[1:], strict=False):
                    c = (a[0] * b[1] - b[0] * a[1]) * k
                    sx, sy = sx + (a[0] + b[0]) * c / 6, sy + (a[1] + b[1]) * c / 6
                total += abs(w) * (1 if i == 0 else -1)
        return "POINT", (sx / total, sy / total)
    segs = [*segments(g)]
    if segs:
        w = [math.dist(a, b) for a, b in segs]
        return "POINT", tuple(sum(k * (a[i] + b[i]) / 2 for k, (a, b) in zip(w, segs, strict=True)) / sum(w) for i in (0, 1))
    ps = points(g)
    return "POINT", tuple(sum(p[i] for p in ps) / len(ps) for i in (0, 1))


def simple(g) -> bool:
    s = [*segments(g)]
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            touch = {*s[i]} & {*s[j]}
            if (j == i + 1 or (i == 0 and j == len(s) - 1 and s[0][0] == s[-1][1])) and len(touch) == 1:
                continue
            if cross(s[i], s[j]):
                return False
    return len(set(points(g))) == len(points(g)) if g[0] == "MULTIPOINT" else True


_B32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lon: float, lat: float, n: int) -> str:
    box, out, bits, even, v = [[-180.0, 180.0], [-90.0, 90.0]], "", 0, True, 0
    while len(out) < n:
        b, x = (box[0], lon) if even else (box[1], lat)
        m = (b[0] + b[1]) / 2
        v, even = v * 2 + (x >= m), not even
        b[0 if x >= m else 1] = m
        bits += 1
        if bits == 5:
            out, bits, v = out + _B32[v], 0, 0
    return out


def from_geohash(s: str) -> tuple[float, float]:
    box, even = [[-180.0, 180.0], [-90.0, 90.0]], True
    for c in s.lower():
        for i in (16, 8, 4, 2, 1):
            b = box[0 if even else 1]
            b[0 if _B32.index(c) & i else 1] = sum(b) / 2
            even = not even
    return sum(box[0]) / 2, sum(box[1]) / 2


def to_geojson(g, digits: int = 15):
    name = {k: "".join(w.capitalize() for w in re.findall("MULTI|GEOMETRY|POINT|LINE|STRING|POLYGON|COLLECTION", k)) for k in KINDS}
    name |= {"LINESTRING": "LineString", "MULTILINESTRING": "MultiLineString"}
    r = lambda c: [r(x) for x in c] if isinstance(c, list) else [round(v, digits) for v in c]
    return {"type": name[g[0]], "geometries": [to_geojson(x, digits) for x in g[1]]} if g[0] == "GEOMETRYCOLLECTION" else {"type": name[g[0]], "coordinates": r(g[1])}


def from_geojson(d):
    d = d.get("geometry", d)
    kind = d["type"].upper()
    if kind == "GEOMETRYCOLLECTION":
        return kind, [from_geojson(x) for x in d["geometries"]]
    t = lambda c: tuple(map(float, c[:2])) if isinstance(c[0], int | float) else [t(x) for x in c]
    return kind, t(d["coordinates"])


# --- Column functions ---------------------------------------------------------


def _g(f, returns="double"):
    """A function of geometries (and plain values after them); binary arguments are unpacked."""

    def run(*a):
        return f(*[unpack(x) if isinstance(x, bytes | bytearray | memoryview) else x for x in a])

    return python(run, returns)


def _geo(f):
    """The same, giving a geometry in the SRID of the first argument."""

    def run(first, *a):
        out = f(unpack(first), *a)
        return None if out is None else pack(out, srid_of(first))

    return python(run, "binary")


@fn("point", least=2)
def point(x, y):
    return python(lambda x, y: pack(("POINT", (float(x), float(y)))), "binary")(x.cast("double"), y.cast("double"))


def _gather(kind, part):
    def run(*gs):
        inner = [unpack(g) for g in gs]
        if part and any(x[0] != part for x in inner):
            raise ValueError(f"{kind} is made of {part}s")
        return pack((kind, [x[1] for x in inner] if part else inner), srid_of(gs[0]))

    return lambda *cols: python(run, "binary")(*cols)


for _names, _kind, _part in ((("linestring",), "LINESTRING", "POINT"), (("polygon",), "POLYGON", "LINESTRING"), (("multipoint",), "MULTIPOINT", "POINT"), (("multilinestring",), "MULTILINESTRING", "LINESTRING"), (("multipolygon",), "MULTIPOLYGON", "POLYGON"), (("geomcollection", "geometrycollection"), "GEOMETRYCOLLECTION", None)):
    fn(*_names, least=1, most=None)(_gather(_kind, _part))


def _reader(kinds, parse):
    def build(x, srid=None, opts=None):
        def run(s, srid):
            g = parse(s)
            return pack(g, srid) if not kinds or g[0] in kinds else None

        return python(run, "binary")(x, F.lit(0) if srid is None else srid)

    return build


_wkb = lambda b: from_wkb(bytes(b))[0]
for _stems, _kinds in (
    (("geom", "geometry"), ()), (("geomcoll", "geometrycollection"), ("GEOMETRYCOLLECTION",)), (("line", "linestring"), ("LINESTRING",)), (("mline", "multilinestring"), ("MULTILINESTRING",)),
    (("mpoint", "multipoint"), ("MULTIPOINT",)), (("mpoly", "multipolygon"), ("MULTIPOLYGON",)), (("point",), ("POINT",)), (("poly", "polygon"), ("POLYGON",)),
):
    for _s in _stems:
        fn(f"st_{_s}fromtext", *(["st_geomcollfromtxt"] if _s == "geomcoll" else []), least=1, most=3)(_reader(_kinds, from_wkt))
        fn(f"st_{_s}fromwkb", least=1, most=3)(_reader(_kinds, _wkb))
fn("st_geomfromgeojson", least=1, most=3)(lambda d, opts=None, srid=None: python(lambda d, s: pack(from_geojson(json.loads(d)), s), "binary")(d, F.lit(4326) if srid is None else srid))
fn("st_astext", "st_aswkt", least=1, most=2)(lambda g, o=None: _g(to_wkt, "string")(g))
fn("st_asbinary", "st_aswkb", least=1, most=2)(lambda g, o=None: python(lambda b: bytes(b)[4:], "binary")(g))
fn("st_asgeojson", least=1, most=3)(lambda g, n=None, o=None: _g(lambda g, n: json.dumps(to_geojson(g, int(n))), "string")(g, F.lit(15) if n is None else n))
_measures = {
    "st_area": (lambda g: area(g) if polygons(g) else None, "double"),
    "st_dimension": (lambda g: 2 if polygons(g) else 1 if [*segments(g)] else 0, "int"),
    "st_geometrytype": (lambda g: g[0], "string"), "st_isempty": (lambda g: not points(g), "boolean"), "st_issimple": (simple, "boolean"),
    "st_isclosed": (lambda g: all(x[0] == x[-1] for x in ([g[1]] if g[0] == "LINESTRING" else g[1])) if "LINE" in g[0] else None, "boolean"),
    "st_numgeometries": (lambda g: len(g[1]) if g[0].startswith(("MULTI", "GEOM")) else None, "int"), "st_numpoints": (lambda g: len(g[1]) if g[0] == "LINESTRING" else None, "int"),
    "st_numinteriorring": (lambda g: len(g[1]) - 1 if g[0] == "POLYGON" else None, "int"), "st_numinteriorrings": (lambda g: len(g[1]) - 1 if g[0] == "POLYGON" else None, "int"),
}
for _n, (_f, _t) in _measures.items():
    fn(_n)(_g(_f, _t))
# Units of length, in metres.
UNITS = {"metre": 1.0, "centimetre": 0.01, "kilometre": 1000.0, "foot": 0.3048, "yard": 0.9144, "statute mile": 1609.344, "nautical mile": 1852.0}


def _measured(f, geometries: int):
    """A length, or in a unit that is named: only a geometry with a reference system has units."""

    def with_unit(*args):
        *gs, unit = args
        if srid_of(gs[0]) == 0:
            raise RuntimeError("the geometry passed has SRID 0, which doesn't specify a length unit")
        if unit.lower() not in UNITS:
            raise RuntimeError(f"there's no unit of measure named '{unit}'")
        got = f(*[unpack(g) for g in gs])
        return None if got is None else got / UNITS[unit.lower()]

    return lambda *cols: _g(f)(*cols) if len(cols) == geometries else python(with_unit, "double")(*cols)


_along = lambda g: sum(math.dist(a, b) for a, b in segments(g))
fn("st_length", least=1, most=2)(_measured(lambda g: _along(g) if "LINE" in g[0] else None, 1))
fn("st_perimeter", least=1, most=2)(_measured(lambda g: _along(g) if polygons(g) else None, 1))
fn("st_distance", least=2, most=3)(_measured(distance, 2))
fn("st_contains", least=2)(_g(contains, "boolean"))
fn("st_within", least=2)(lambda a, b: _g(contains, "boolean")(b, a))
fn("st_intersects", least=2)(_g(intersects, "boolean"))
fn("st_disjoint", least=2)(_g(lambda a, b: not intersects(a, b), "boolean"))
fn("st_equals", "st_equal", least=2)(_g(lambda a, b: a == b or (contains(a, b) and contains(b, a)), "boolean"))
for _n, _f in {
    "st_centroid": centroid, "st_convexhull": hull, "st_envelope": envelope,
    "st_startpoint": lambda g: ("POINT", g[1][0]) if g[0] == "LINESTRING" else None, "st_endpoint": lambda g: ("POINT", g[1][-1]) if g[0] == "LINESTRING" else None,
    "st_exteriorring": lambda g: ("LINESTRING", g[1][0]) if g[0] == "POLYGON" else None, "st_validate": lambda g: g if simple(g) or not polygons(g) else None,
    "st_swapxy": lambda g: from_wkt(to_wkt(_swap(g))),
}.items():
    fn(_n)(_geo(_f))


def _swap(g):
    s = lambda c: (c[1], c[0]) if isinstance(c, tuple) and not isinstance(c[0], str) else [s(x) for x in c] if isinstance(c, list) else (c[0], s(c[1]))
    return g[0], s(g[1])


fn("st_geometryn", least=2)(_geo(lambda g, n: (g[1][int(n) - 1] if g[0] == "GEOMETRYCOLLECTION" else (_PART[g[0]], g[1][int(n) - 1])) if 1 <= n <= len(g[1]) else None))
fn("st_interiorringn", least=2)(_geo(lambda g, n: ("LINESTRING", g[1][int(n)]) if g[0] == "POLYGON" and 1 <= n < len(g[1]) else None))
fn("st_pointn", least=2)(_geo(lambda g, n: ("POINT", g[1][int(n) - 1]) if g[0] == "LINESTRING" and 1 <= n <= len(g[1]) else None))


def _coordinate(i):
    def build(g, v=None):
        if v is None:
            return _g(lambda g: g[1][i] if g[0] == "POINT" else None)(g)
        return _geo(lambda g, v: ("POINT", (v, g[1][1]) if i == 0 else (g[1][0], v)) if g[0] == "POINT" else None)(g, v)

    return build


fn("st_x", "st_longitude", least=1, most=2)(_coordinate(0))
fn("st_y", "st_latitude", least=1, most=2)(_coordinate(1))


@fn("st_srid", least=1, most=2)
def st_srid(g, srid=None):
    return python(srid_of, "long")(g) if srid is None else python(lambda b, s: struct.pack("<I", int(s)) + bytes(b)[4:], "binary")(g, srid)


@fn("st_geohash", least=2, most=3)
def st_geohash(a, b, n=None):
    if n is None:
        return _g(lambda g, n: geohash(*g[1], int(n)), "string")(a, b)
    return python(lambda x, y, n: geohash(x, y, int(n)), "string")(a, b, n)


fn("st_latfromgeohash")(python(lambda s: round(from_geohash(s)[1], max(0, len(s) - 2)), "double"))
fn("st_longfromgeohash")(python(lambda s: round(from_geohash(s)[0], max(0, len(s) - 2)), "double"))
fn("st_pointfromgeohash", least=2)(python(lambda s, i: pack(("POINT", from_geohash(s)), i), "binary"))
