"""Named function builders: dialect name -> Column expression, with arity checks."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict[str, tuple[Callable[..., Column], int, int | None]] = {}
#: Set while an expression becomes text (see ``plans.render``): gives Python functions names in the session.
NAMED = None


class ArityError(TypeError):
    """A function got a number of arguments that it doesn't take."""


class Unsupported(NotImplementedError):
    """The dialect knows the function's name but doesn't evaluate it."""


def fn(*names: str, least: int = 1, most: int | None = -1):
    """Register a builder; ``most`` None: any number, -1: as many as ``least``."""

    def add(f):
        for n in names:
            FUNCTIONS[n] = f, least, least if most == -1 else most
        return f

    return add


def call(name: str, *args) -> Column:
    """Build function ``name``; plain values become literals."""
    if name.lower() not in FUNCTIONS:
        raise KeyError(f"no function {name}")
    f, least, most = FUNCTIONS[name.lower()]
    if len(args) < least or most is not None and len(args) > most:
        raise ArityError(f"{name} takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments, not {len(args)}")
    return f(*[a if isinstance(a, Column) else F.lit(a) for a in args])


def alias_native(names: dict[str, tuple[str, int, int | None]]) -> None:
    """Functions whose Spark namesake agrees: dialect name -> (Spark name, least, most arguments)."""
    for name, (native, least, most) in names.items():
        FUNCTIONS[name] = (lambda native: lambda *a: F.call_function(native, *a))(native), least, most


def text(x: Column) -> Column:
    return x.cast("string")


def number(x: Column) -> Column:
    """The number that a text starts with (0 without one), as arithmetic on text takes it."""
    return F.coalesce(F.regexp_extract(text(x), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double"), F.when(x.isNotNull(), F.lit(0.0)))


#: Types whose values reach another Python function as they were returned.
_CARRIED = {"string": (str, str), "binary": (bytes, bytes), "double": ((float, int), float), "int": (int, int), "long": (int, int), "boolean": (bool, bool)}


@dataclasses.dataclass(frozen=True)
class Step:
    """A Python function in an expression; ``args``: steps within it, or places among the arguments of the whole."""

    f: Callable
    returns: str
    args: tuple

    def key(self):
        return identity(self.f), self.returns, tuple(a.key() if isinstance(a, Step) else a for a in self.args)


def identity(f, within: tuple = ()):
    """Equal for functions that a builder makes anew of the same code and values."""
    if f in within:  # it calls itself
        return within.index(f)
    held = lambda v: identity(v, (*within, f)) if callable(v) else (type(v), v)
    try:
        made = f.__module__, f.__code__, f.__defaults__, tuple(held(c.cell_contents) for c in f.__closure__ or ())
        hash(made)
    except (AttributeError, TypeError, ValueError):
        return f
    return made


def carries(returns: str) -> bool:
    return returns in _CARRIED


def fits(v, returns: str) -> bool:
    """Whether a value is of the type that its function declares, and can stand in a statement's text."""
    if v is None or not carries(returns):
        return v is None
    if not isinstance(v, _CARRIED[returns][0]) or isinstance(v, bool) != (returns == "boolean"):
        return False
    if isinstance(v, str):
        return not re.search(r"[^\S\n\t ]|[\x00-\x08\x0e-\x1f\ud800-\udfff]", v) and "${" not in v
    return returns not in ("int", "long") or abs(v) < 2 ** (31 if returns == "int" else 63)


def evaluator(step: Step, inner: bool = False) -> Callable:
    """A function of the row of arguments; NULL for any error or if any argument is NULL, at every step."""
    f, args = step.f, [evaluator(a, True) if isinstance(a, Step) else a for a in step.args]
    to = _CARRIED[step.returns][1] if inner else None
    plain = not inner and args == [*range(len(args))]
    nat = pd.NaT

    def one(row):
        values = row if plain else [row[a] if a.__class__ is int else a(row) for a in args]
        for v in values:
            if v is None or v is nat or (isinstance(v, float) and v != v):
                return None
        try:
            out = f(*values)
            return out if to is None or out is None else to(out)
        except (ValueError, TypeError, KeyError, IndexError, ArithmeticError):
            return None

    return one


def batches(step: Step, n: int):
    """A pandas UDF of ``n`` arguments over Arrow batches."""
    from pyspark.sql.pandas.functions import PandasUDFType, pandas_udf

    one = evaluator(step)

    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([one(row) for row in zip(*cols, strict=True)], dtype=object)

    run.__annotations__ = {}
    # one positional parameter an argument, as Spark counts them
    names = ", ".join(f"a{i}" for i in range(n))
    scope = {"run": run}
    exec(f"def call({names}):\n    return run({names})", scope)  # noqa: S102
    return pandas_udf(scope["call"], step.returns, PandasUDFType.SCALAR)


def python(f: Callable, returns: str, pure: bool = True) -> Callable[..., Column]:
    """A scalar Python function as a pandas UDF over Arrow batches; NULL for any error or if any argument is NULL.

    ``pure``: the same arguments always give the same value, so that it may run once for literals.
    """

    def build(*args: Column) -> Column:
        step = Step(f, returns, tuple(range(len(args))))
        if NAMED is not None:
            return F.call_function(NAMED.call(step, pure), *args)
        return batches(step, len(args))(*args)

    return build
