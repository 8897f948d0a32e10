"""JSON functions: built-ins where they agree, one path walker in Arrow batches for the rest."""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import functions as F

from .registry import Unsupported, alias_native, fn, python

_LEG = re.compile(r"""\.\s*(?:"((?:[^"\\]|\\.)*)"|([A-Za-z_$][\w$]*)|(\*))|\[\s*(?:(\d+)|last(?:\s*-\s*(\d+))?|(\*))\s*\]|(\*\*)""")


@functools.lru_cache(4096)
def parse_path(path: str) -> list[tuple[str, object]]:
    """Legs of a path: ('key', name), ('at', index), ('last', back), ('keys', None), ('all', None), ('deep', None)."""
    path = path.strip()
    if not path.startswith("$"):
        raise ValueError(f"a path begins with $: {path}")
    at, legs = 1, []
    while at < len(path):
        m = _LEG.match(path, at)
        if not m:
            if path[at:].strip() == "":
                break
            raise ValueError(f"bad path: {path}")
        quoted, name, keys, index, back, every, deep = m.groups()
        if quoted is not None or name is not None:
            legs.append(("key", json.loads(f'"{quoted}"') if quoted is not None else name))
        elif keys:
            legs.append(("keys", None))
        elif index is not None:
            legs.append(("at", int(index)))
        elif every:
            legs.append(("all", None))
        elif deep:
            legs.append(("deep", None))
        else:
            legs.append(("last", int(back or 0)))
        at = m.end()
    return legs


def has_wildcard(legs) -> bool:
    return any(k in ("keys", "all", "deep") for k, _ in legs)


def _index(doc, kind, v):
    n = len(doc) if isinstance(doc, list) else 1
    return v if kind == "at" else n - 1 - v


def walk(doc, legs, where="$"):
    """(path, value) of everything a path reaches."""
    if not legs:
        yield where, doc
        return
    (kind, v), rest = legs[0], legs[1:]
    if kind == "key":
        if isinstance(doc, dict) and v in doc:
            yield from walk(doc[v], rest, where + key_leg(v))
    elif kind == "keys":
        if isinstance(doc, dict):
            for k in doc:
                yield from walk(doc[k], rest, where + key_leg(k))
    elif kind == "all":
        if isinstance(doc, list):
            for i, x in enumerate(doc):
                yield from walk(x, rest, f"{where}[{i}]")
    elif kind == "deep":
        yield from walk(doc, rest, where)
        inner = doc.items() if isinstance(doc, dict) else enumerate(doc) if isinstance(doc, list) else ()
        for k, x in inner:
            yield from walk(x, legs, where + (key_leg(k) if isinstance(doc, dict) else f"[{k}]"))
    else:
        i = _index(doc, kind, v)
        if isinstance(doc, list):
            if 0 <= i < len(doc):
                yield from walk(doc[i], rest, f"{where}[{i}]")
        elif i == 0:
            yield from walk(doc, rest, where)


def key_leg(k: str) -> str:
    return f".{k}" if re.fullmatch(r"[A-Za-z_$][\w$]*", k) else "." + json.dumps(k, ensure_ascii=False)


def order_keys(v):
    """Object keys in document order: by length, then bytes."""
    if isinstance(v, dict):
        return {k: order_keys(v[k]) for k in sorted(v, key=lambda k: (len(k.encode()), k.encode()))}
    return [order_keys(x) for x in v] if isinstance(v, list) else v


def dump(v) -> str:
    return json.dumps(order_keys(v), ensure_ascii=False, separators=(", ", ": "))


def value(v):
    """A path function's value argument: numbers and booleans as they are, text as a JSON string."""
    if v is None or isinstance(v, bool | int | float | str):
        return v
    return v.item() if hasattr(v, "item") else str(v)


def change(doc, legs, how, v):
    """One mutation; returns the new document.  how: set, insert, replace, remove, append, array_insert."""
    if not legs:
        if how in ("set", "replace"):
            return v
        if how == "append":
            return [*doc, v] if isinstance(doc, list) else [doc, v]
        return doc
    (kind, k), rest = legs[0], legs[1:]
    if kind in ("keys", "all", "deep"):
        raise ValueError("a wildcard can't be changed")
    if kind == "key":
        if not isinstance(doc, dict):
            return doc
        if rest or how == "append":
            return doc | {k: change(doc[k], rest, how, v)} if k in doc else doc
        if how == "remove":
            return {x: y for x, y in doc.items() if x != k}
        if how == "set" or (how == "insert" and k not in doc) or (how == "replace" and k in doc):
            return doc | {k: v}
        return doc
    i = _index(doc, kind, k)
    if not isinstance(doc, list):
        if i == 0 and (rest or how in ("set", "replace", "append")):
            return change(doc, rest, how, v)
        if i > 0 and not rest and how in ("set", "insert"):
            return [doc, v]
        return doc
    if rest or how == "append":
        return [*doc[:i], change(doc[i], rest, how, v), *doc[i + 1 :]] if 0 <= i < len(doc) else doc
    if how == "array_insert":
        return [*doc[: max(i, 0)], v, *doc[max(i, 0) :]]
    if how == "remove":
        return [x for j, x in enumerate(doc) if j != i]
    if 0 <= i < len(doc):
        return [*doc[:i], v, *doc[i + 1 :]] if how in ("set", "replace") else doc
    return [*doc, v] if how in ("set", "insert") else doc


@functools.cache
def _mutation(how, raw=frozenset()):
    def run(doc, *args):
        d = json.loads(doc)
        if how == "remove":
            for p in args:
                if not parse_path(p):
                    raise ValueError("$ can't be removed")
                d = change(d, parse_path(p), how, None)
        else:
            for i, (p, v) in enumerate(zip(args[::2], args[1::2], strict=True)):
                d = change(d, parse_path(p), how, json.loads(v) if 2 * i + 2 in raw else value(v))
        return dump(d)

    return run


def _mutator(how, raw=frozenset()):
    return lambda *cols: python(_mutation(how, raw), "string")(*cols)


MUTATORS = {"json_set": "set", "json_insert": "insert", "json_replace": "replace", "json_array_append": "append", "json_array_insert": "array_insert"}
for _name, _how in MUTATORS.items():
    fn(_name, least=3, most=None)(_mutator(_how))
fn("json_remove", least=2, most=None)(_mutator("remove"))


def contains(doc, x) -> bool:
    if isinstance(doc, list):
        return all(any(contains(d, y) for d in doc) for y in x) if isinstance(x, list) else any(contains(d, x) for d in doc)
    if isinstance(doc, dict):
        return isinstance(x, dict) and all(k in doc and contains(doc[k], v) for k, v in x.items())
    return same(doc, x)


def same(a, b) -> bool:
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    return a == b


@fn("json_contains", least=2, most=3)
def json_contains(doc, x, path=None):
    def run(d, x, p="$"):
        found = next(walk(json.loads(d), parse_path(p)), None)
        return None if found is None else contains(found[1], json.loads(x))

    return python(run, "boolean")(*[c for c in (doc, x, path) if c is not None])


@fn("json_contains_path", least=3, most=None)
def json_contains_path(doc, mode, *paths):
    def run(d, mode, *paths):
        d = json.loads(d)
        return (any if mode.lower() == "one" else all)(next(walk(d, parse_path(p)), None) is not None for p in paths)

    return python(run, "boolean")(doc, mode, *paths)


@fn("json_depth")
def json_depth(doc):
    depth = lambda v: 1 + max(map(depth, v.values() if isinstance(v, dict) else v), default=0) if isinstance(v, dict | list) else 1
    return python(lambda d: depth(json.loads(d)), "int")(doc)


@fn("json_extract", least=2, most=None)
def json_extract(doc, *paths):
    def run(d, *paths):
        d = json.loads(d)
        legs = [parse_path(p) for p in paths]
        found = [v for x in legs for _, v in walk(d, x)]
        if not found:
            return None
        return dump(found if len(legs) > 1 or has_wildcard(legs[0]) else found[0])

    return python(run, "string")(doc, *paths)


@fn("json_keys", least=1, most=2)
def json_keys(doc, path=None):
    def run(d, p="$"):
        found = next(walk(json.loads(d), parse_path(p)), (None, None))[1]
        return dump([*order_keys(found)]) if isinstance(found, dict) else None

    return python(run, "string")(*([doc] if path is None else [doc, path]))


@fn("json_length", least=1, most=2)
def json_length(doc, path=None):
    def run(d, p="$"):
        found = next(walk(json.loads(d), parse_path(p)), None)
        return None if found is None else len(found[1]) if isinstance(found[1], list | dict) else 1

    return python(run, "int")(*([doc] if path is None else [doc, path]))


def merge_patch(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def merge_preserve(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: merge_preserve(a[k], v) if k in a else v for k, v in b.items()}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def _merger(f):
    def run(first, *rest):
        out = json.loads(first)
        for x in rest:
            out = f(out, json.loads(x))
        return dump(out)

    return lambda *cols: python(run, "string")(*cols)


fn("json_merge_patch", least=2, most=None)(_merger(merge_patch))
fn("json_merge_preserve", "json_merge", least=2, most=None)(_merger(merge_preserve))


@fn("json_overlaps", least=2)
def json_overlaps(a, b):
    def run(a, b):
        a, b = json.loads(a), json.loads(b)
        if isinstance(a, dict) and isinstance(b, dict):
            return any(k in b and same(b[k], v) for k, v in a.items())
        a, b = a if isinstance(a, list) else [a], b if isinstance(b, list) else [b]
        return any(same(x, y) for x in a for y in b)

    return python(run, "boolean")(a, b)


@fn("json_pretty")
def json_pretty(doc):
    return python(lambda d: json.dumps(order_keys(json.loads(d)), indent=2, ensure_ascii=False), "string")(doc)


@fn("json_quote")
def json_quote(s):
    return python(lambda s: json.dumps(s, ensure_ascii=False), "string")(s)


@fn("json_unquote")
def json_unquote(s):
    return python(lambda s: json.loads(s) if s[:1] == s[-1:] == '"' and len(s) > 1 else s, "string")(s)


@fn("json_search", least=3, most=None)
def json_search(doc, mode, pattern, escape=None, *paths):
    def run(d, mode, pattern, escape, *paths):
        d, out, i = json.loads(d), "", 0
        esc = escape or "\\"
        while i < len(pattern):
            c = pattern[i]
            if c == esc and i + 1 < len(pattern):
                i += 1
                out += re.escape(pattern[i])
            else:
                out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
            i += 1
        ok = re.compile(out, re.DOTALL).fullmatch
        found = []
        for p in paths or ("$",):
            for where, v in walk(d, [*parse_path(p), ("deep", None)]):
                if isinstance(v, str) and ok(v) and where not in found:
                    found.append(where)
        if not found:
            return None
        return dump(found[0] if mode.lower() == "one" or len(found) == 1 else found)

    return python(run, "string")(doc, mode, pattern, F.lit("") if escape is None else F.coalesce(escape, F.lit("")), *paths)


@fn("json_type")
def json_type(doc):
    def run(d):
        v = json.loads(d)
        return "NULL" if v is None else {bool: "BOOLEAN", int: "INTEGER", float: "DOUBLE", str: "STRING", list: "ARRAY", dict: "OBJECT"}[type(v)]

    return python(run, "string")(doc)


@fn("json_valid")
def json_valid(doc):
    return F.when(doc.isNotNull(), F.try_parse_json(doc).isNotNull())


@fn("json_value", least=1, most=3)
def json_value(doc, path=None, kind=None):
    def run(d, p="$"):
        found = next(walk(json.loads(d), parse_path(p)), (None, None))[1]
        return found if isinstance(found, str) or found is None else dump(found)

    out = python(run, "string")(*([doc] if path is None else [doc, path]))
    return out if kind is None else out.try_cast(str(kind._jc.toString()))


def _json(x):
    return F.when(x.isNull(), F.lit("null")).otherwise(F.regexp_replace(F.regexp_replace(F.to_json(F.array(x)), r"^\[", ""), r"\]$", ""))


def as_json(x):
    """CAST(x AS JSON): text is parsed, other values become their JSON form; invalid text is NULL."""
    return python(lambda s: dump(json.loads(s)), "string")(x.cast("string"))


def _cell(x, is_json):
    return F.coalesce(x, F.lit("null")) if is_json else _json(x)


def _normal(text):
    return dump(json.loads(text))


@fn("json_array", least=0, most=None)
def json_array(*xs, raw=frozenset()):
    return F.concat(F.lit("["), F.concat_ws(", ", *[_cell(x, i in raw) for i, x in enumerate(xs)]), F.lit("]"))


@fn("json_object", least=0, most=None)
def json_object(*xs, raw=frozenset()):
    if len(xs) % 2:
        raise TypeError("json_object takes keys and values in pairs")
    flat = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(_json(k.cast("string")), F.lit(": "), _cell(v, 2 * i + 1 in raw)) for i, (k, v) in enumerate(zip(xs[::2], xs[1::2], strict=True))]), F.lit("}"))
    return python(_normal, "string")(flat)


#: Functions whose result is JSON, so that it is nested and not quoted in another document.
GIVES_JSON = frozenset(("json_array", "json_object", "json_extract", "json_remove", "json_merge", "json_merge_patch", "json_merge_preserve", "json_keys", "json_arrayagg", "json_objectagg", *MUTATORS))


def nested(name: str, raw: frozenset[int]):
    """The builder of ``name`` whose arguments at ``raw`` are JSON themselves."""
    if name in MUTATORS:
        return _mutator(MUTATORS[name], raw)
    made = {"json_array": json_array, "json_object": json_object}[name]
    return lambda *xs: made(*xs, raw=raw)


def _unsupported(name):
    def f(*_):
        raise Unsupported(f"{name} is not supported")

    return f


for _name in ("json_schema_valid", "json_schema_validation_report", "json_storage_free", "json_storage_size", "json_table"):
    fn(_name, least=0, most=None)(_unsupported(_name))
alias_native({})
