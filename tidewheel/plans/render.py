"""Column expressions as Spark SQL text, so that every function builder can be called from a statement.

A builder is run on placeholder columns ``__a0``, ``__a1``, ...; the tree it
makes is printed with the arguments' own text in their places.  Python
functions become named functions of the session; one of literals only is
printed as its value, and one within another becomes a single function, so
that a row goes to Python once.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..functions.registry import Step, batches, carries, evaluator, fits

#: What the names of Python functions in a session begin with.
PYTHON = "tw_py_"
#: Names whose node is an operator, by how SQL writes it.
INFIX = {"+": "+", "-": "-", "*": "*", "/": "/", "%": "%", "and": "AND", "or": "OR", "==": "=", "=": "=", "<=>": "<=>", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "!=": "<>", "&": "&", "|": "|", "^": "^"}
PREFIX = {"not": "NOT ", "!": "NOT ", "negative": "-", "-": "-", "~": "~"}
AGGREGATED = {"sum", "avg", "count", "min", "max", "collect_list", "collect_set", "bit_and", "bit_or", "bit_xor", "min_by", "max_by", "stddev_pop", "stddev_samp", "var_pop", "var_samp", "any_value", "first", "last"}


def text_literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int | float) and v < 0:
        return f"({value(-v)})".replace("(", "(-", 1) if v != -(2**63) else "(-9223372036854775807L - 1L)"
    if isinstance(v, int):
        return str(v) if -(2**31) <= v < 2**31 else f"{v}L" if -(2**63) <= v < 2**63 else f"CAST('{v}' AS DECIMAL({len(str(abs(v)))},0))"
    if isinstance(v, float):
        return f"CAST('{v}' AS DOUBLE)" if v != v or abs(v) == float("inf") else f"{v!r}D"
    if isinstance(v, decimal.Decimal):
        return f"{v}BD"
    if isinstance(v, bytes | bytearray):
        return f"X'{bytes(v).hex()}'"
    return text_literal(str(v))


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def type_text(t) -> str:
    """A type's name; the session's TIMESTAMP is the one without a zone."""
    return "TIMESTAMP_LTZ" if t.sql() == "TIMESTAMP" else t.sql()


class Renderer:
    """Prints the nodes of one expression; ``args``: the placeholders' text, ``over``: a window for its aggregate."""

    def __init__(self, args: list[str], over: str = "", distinct: bool = False, held: _Session | None = None):
        self.args, self.over, self.distinct, self.held = args, over, distinct, held

    def node(self, n) -> str:
        return getattr(self, "_" + n.getClass().getSimpleName().rstrip("$").lower())(n)

    def _unresolvedattribute(self, n) -> str:
        parts = _seq(n.nameParts())
        if len(parts) == 1 and parts[0].startswith("__a") and parts[0][3:].isdigit():
            return self.args[int(parts[0][3:])]
        return ".".join(f"`{p}`" for p in parts)

    def _literal(self, n) -> str:
        t = n.dataType()
        v = value(n.value())
        return f"CAST({v} AS {type_text(t.get())})" if t.isDefined() and t.get().sql() not in ("STRING", "INT") else v

    def _unresolvedfunction(self, n) -> str:
        name, args = n.functionName(), [self.node(a) for a in _seq(n.arguments())]
        if self.held and name in self.held.steps:
            return self.held.fused(name, args, [self._known(a) for a in _seq(n.arguments())])
        if name in INFIX and len(args) == 2:
            return f"({args[0]} {INFIX[name]} {args[1]})"
        if name in PREFIX and len(args) == 1:
            return f"({PREFIX[name]}{args[0]})"
        if name == "in":
            return f"({args[0]} IN ({', '.join(args[1:])}))"
        if name == "when":
            last = f" ELSE {args[-1]}" if len(args) % 2 else ""
            return "CASE" + "".join(f" WHEN {a} THEN {b}" for a, b in zip(args[::2], args[1::2], strict=False)) + last + " END"
        out = f"{name}({'DISTINCT ' if n.isDistinct() or self.distinct and name.lower() in AGGREGATED else ''}{', '.join(args)})"
        return out + self.over if self.over and name.lower() in AGGREGATED else out

    def _known(self, n) -> tuple | None:
        """(value,) of a literal as Python functions get it, also of a number that is cast to double."""
        kind = n.getClass().getSimpleName()
        if kind == "Literal":
            v = n.value()
            return (bytes(v) if isinstance(v, bytes | bytearray) else v,) if v is None or isinstance(v, str | int | float | bytes | bytearray) else None
        if kind == "Cast" and n.dataType().sql() == "DOUBLE" and (got := self._known(n.child())):
            return (float(got[0]),) if isinstance(got[0], int | float) and not isinstance(got[0], bool) else None
        return None

    def _casewhenotherwise(self, n) -> str:
        branches = [(self.node(b._1()), self.node(b._2())) for b in _seq(n.branches())]
        last = f" ELSE {self.node(n.otherwise().get())}" if n.otherwise().isDefined() else ""
        return "(CASE" + "".join(f" WHEN {a} THEN {b}" for a, b in branches) + last + " END)"

    def _cast(self, n) -> str:
        mode = n.evalMode()
        word = "TRY_CAST" if mode.isDefined() and "Try" in mode.get().toString() else "CAST"
        return f"{word}({self.node(n.child())} AS {type_text(n.dataType())})"

    def _alias(self, n) -> str:
        return f"{self.node(n.child())} AS `{_seq(n.name())[0]}`"

    def _lambdafunction(self, n) -> str:
        names = [a.name() for a in _seq(n.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {self.node(n.function())}"

    def _unresolvednamedlambdavariable(self, n) -> str:
        return n.name()

    def _unresolvedextractvalue(self, n) -> str:
        child, at = self.node(n.child()), self.node(n.extraction())
        return f"{child}[{at}]"

    def _sqlexpression(self, n) -> str:
        return f"({n.expression()})"

    def _unresolvedstar(self, n) -> str:
        return "*"


class _Session:
    """Names for Python functions while an expression is rendered; a function keeps its name in a session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, {}
        #: Python functions by the name that stands for them in a tree; calls and values by their text.
        self.steps: dict[str, tuple[Step, bool]] = {}
        self.calls: dict[str, tuple[Step, list[str]]] = {}
        self.values: dict[str, tuple] = {}

    def name(self, key, make: Callable) -> str:
        if key not in self.names:
            self.names[key] = f"{PYTHON}{len(self.names)}"
            self.spark.udf.register(self.names[key], make())
        return self.names[key]

    def call(self, step: Step, pure: bool) -> str:
        """A name that stands for a function until its call is printed."""
        name = f"tw_step_{len(self.steps)}"
        self.steps[name] = step, pure
        return name

    def forget(self) -> None:
        """Drop what was kept of calls; a statement needs its own only."""
        for held in (self.steps, self.calls, self.values):
            held.clear()

    def fused(self, name: str, args: list[str], known: list[tuple | None]) -> str:
        """The text of a call whose arguments are ``args``; ``known``: those that are literals."""
        step, pure = self.steps[name]
        if pure:
            known = [self.values.get(a) if k is None else k for a, k in zip(args, known, strict=True)]
            if (text := self._folded(step, known)) is not None:
                return text
        leaves: list[str] = []
        at = lambda text: leaves.append(text) or len(leaves) - 1
        moved = lambda s, own: Step(s.f, s.returns, tuple(moved(a, own) if isinstance(a, Step) else at(own[a]) for a in s.args))
        inner = [self.calls.get(a) if pure else None for a in args]
        whole = Step(step.f, step.returns, tuple(moved(*found) if found else at(a) for a, found in zip(args, inner, strict=True)))
        text = f"{self.name(whole.key() if pure else whole, lambda: batches(whole, len(leaves)))}({', '.join(leaves)})"
        if pure and carries(step.returns):
            self.calls[text] = whole, leaves
        return text

    def _folded(self, step: Step, known: list[tuple | None]) -> str | None:
        """The text of a function's value if all its arguments are literals; an error is left to the run."""
        if any(k is None for k in known) or not carries(step.returns):
            return None
        try:
            got = evaluator(step)([k[0] for k in known])
        except Exception:  # noqa: BLE001
            return None
        if not fits(got, step.returns):
            return None
        got = float(got) if step.returns == "double" and got is not None else got
        text = value(got)
        if got is None or step.returns in ("int", "long"):
            text = f"CAST({text} AS {'BIGINT' if step.returns == 'long' else step.returns.upper()})"
        self.values[text] = (got,)
        return text


def session(spark: SparkSession) -> _Session:
    held = getattr(spark, "_tidewheel_names", None)
    if held is None:
        held = spark._tidewheel_names = _Session(spark)
    return held


def expression(spark: SparkSession, build: Callable[..., Column], args: list[tuple[str, bool, object]], over: str = "", distinct: bool = False) -> str:
    """The text of ``build`` of arguments (text, is a literal, its value); literals reach the builder as such."""
    columns = [F.lit(v) if known else F.col(f"`__a{i}`") for i, (_, known, v) in enumerate(args)]
    before, registry.NAMED = registry.NAMED, session(spark)
    try:
        made = build(*columns)
    finally:
        registry.NAMED = before
    return Renderer([t for t, _, _ in args], over, distinct, session(spark)).node(made._jc.node())
