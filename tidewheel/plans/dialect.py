"""A parser for the dialect's queries that gives Spark SQL text.

Expressions are parsed by precedence; each function call is lowered through the
registry's builders (``plans.render``), so a call means the same from SQL and
from Python.  Queries keep their shape and go to Catalyst whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import FUNCTIONS
from ..functions import aggregates as A
from ..functions import datetime as D
from ..functions import json as J
from ..functions import numeric as N
from ..functions.registry import ArityError, number
from . import eager, render

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[ \t][^\n]*|\#[^\n]*|/\*(?![+!]).*?\*/)
  | (?P<hint>/\*\+.*?\*/)
  | (?P<hex>[xX]'[0-9a-fA-F]*'|0x[0-9a-fA-F]+)
  | (?P<bits>[bB]'[01]*'|0b[01]+)
  | (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
  | (?P<quoted>`(?:[^`]|``)*`)
  | (?P<system>@@(?:\w+\.)?\w+)
  | (?P<user>@(?:\w[\w.$]*|`[^`]*`|'[^']*'))
  | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?(?![\w]))
  | (?P<word>[^\W][\w$]*)
  | (?P<op><=>|->>|->|:=|<<|>>|<=|>=|<>|!=|\|\||&&|[-+*/%=<>!~^&|(),.;?:{}\[\]])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "0": "\0", "Z": "\x1a"}

# Words that end a clause or can't be an alias without AS.
RESERVED = frozenset(
    """SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT MINUS ON USING JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL STRAIGHT_JOIN WINDOW FOR LOCK INTO AS SET VALUES WITH
    AND OR XOR NOT IN IS LIKE REGEXP RLIKE BETWEEN DIV MOD THEN ELSE END WHEN CASE ASC DESC USE FORCE IGNORE LATERAL PARTITION EXISTS COLLATE INTERVAL DISTINCT ALL BINARY ROWS RANGE""".split()
)
# Units of INTERVAL.
UNITS = frozenset(D.UNITS) | frozenset(D.COMPOSITE)
#: Functions of Spark's windows, which need OVER.
WINDOWED = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lead", "lag", "first_value", "last_value", "nth_value"}
#: Functions with the same meaning whose text Spark takes as it is, without a builder.
PLAIN = {"if", "ifnull", "nullif", "coalesce"}


class ParseError(ValueError):
    pass


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def up(self) -> str:
        return self.text.upper()


@dataclass
class Node:
    """Spark SQL text; ``known``: a literal with its ``value``; ``truth``: a boolean; ``items``: of a tuple; ``column``: a bare reference; ``json``: a document."""

    text: str
    known: bool = False
    value: object = None
    truth: bool = False
    items: list | None = None
    column: bool = False
    json: bool = False

    def boolean(self) -> str:
        return self.text if self.truth else f"CAST({self.text} AS BOOLEAN)"


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected {sql[at : at + 20]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return [*out, Token("end", "", len(sql), len(sql))]


def unquote(text: str) -> str:
    """The value of a string literal."""
    q, body = text[0], text[1:-1]
    body = body.replace(q + q, q)
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_" else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def name_of(t: Token) -> str:
    return t.text[1:-1].replace("``", "`") if t.kind == "quoted" else t.text


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Session:
    """What a parser asks of the statement's session; the engine's own has variables and virtual tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def user(self, name: str):
        return None

    def system(self, name: str):
        return None

    def assign(self, name: str, node: Node) -> Node:
        raise ParseError("no assignment here")

    def function(self, name: str) -> Callable[..., Column] | None:
        return None

    def relation(self, parts: list[str], as_of: str | None) -> str:
        return ".".join(quoted(p) for p in parts)

    #: Bytes of a table that a task of Python functions takes, and those that a scan splits by itself.
    SPREAD, SPLIT = 32 << 10, 128 << 20

    def spread(self, relation: str) -> str:
        """A relation whose rows are dealt to all cores, where a scan of it would be a few tasks: a file's rows are split by bytes and groups, and Python functions take time by the row."""
        try:
            size = int(str(self.spark.table(relation)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        except AnalysisException:
            return relation
        most = max(16, 2 * self.spark.sparkContext.defaultParallelism)
        if not 2 * self.SPREAD <= size < most * self.SPLIT:
            return relation
        return f"(SELECT /*+ REPARTITION({min(most, size // self.SPREAD)}) */ * FROM {relation})"

    def table_function(self, name: str, args: list[Node]) -> str | None:
        return None

    def json_table(self, doc: str, path: str, columns: list) -> tuple[str, list[str]]:
        raise ParseError("no JSON_TABLE here")

    def recursive(self, name: str, columns: list[str], base: str, step: str) -> str:
        raise ParseError("no UNION DISTINCT recursion here")


class Parser:
    def __init__(self, sql: str, session: Session, columns: dict[str, str] | None = None):
        self.sql, self.session, self.toks, self.i = sql, session, tokens(sql), 0
        #: Names that stand for other text: parameters and variables of procedures, OLD and NEW of triggers.
        self.columns = columns or {}
        #: (alias, table) of each table that FROM names.
        self.seen: list[tuple[str, str]] = []

    # --- tokens -------------------------------------------------------------------------------

    @property
    def t(self) -> Token:
        return self.toks[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def at(self, *words: str) -> bool:
        """Whether the next tokens are these words or signs."""
        return all(self.ahead(k).kind in ("word", "op") and self.ahead(k).up == w for k, w in enumerate(words))

    def accept(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise ParseError(f"{' '.join(words)} is missing at {self.sql[self.t.start : self.t.start + 30]!r}")

    def take(self) -> Token:
        self.i += 1
        return self.toks[self.i - 1]

    def ident(self) -> str:
        if self.t.kind not in ("word", "quoted", "string"):
            raise ParseError(f"a name is missing at {self.sql[self.t.start : self.t.start + 30]!r}")
        t = self.take()
        return unquote(t.text) if t.kind == "string" else name_of(t)

    def names(self) -> list[str]:
        """(a, b, ...)"""
        self.expect("(")
        out = [] if self.at(")") else [self.ident()]
        while self.accept(","):
            out.append(self.ident())
        self.expect(")")
        return out

    def qualified(self) -> list[str]:
        out = [self.ident()]
        while self.accept("."):
            out.append(self.ident())
        return out

    def done(self) -> None:
        self.accept(";")
        if self.t.kind != "end":
            raise ParseError(f"unexpected {self.sql[self.t.start : self.t.start + 30]!r}")

    # --- expressions ----------------------------------------------------------------------------

    def build(self, f: Callable[..., Column], args: list[Node], over: str = "", distinct: bool = False) -> str:
        return render.expression(self.session.spark, f, [(a.text, a.known, a.value) for a in args], over, distinct)

    def expr(self) -> Node:
        out = self._xor()
        while self.at("OR") or self.at("||"):
            self.take()
            out = Node(f"({out.boolean()} OR {self._xor().boolean()})", truth=True)
        return out

    def _xor(self) -> Node:
        out = self._and()
        while self.accept("XOR"):
            out = Node(f"({out.boolean()} <> {self._and().boolean()})", truth=True)
        return out

    def _and(self) -> Node:
        out = self._not()
        while self.at("AND") or self.at("&&"):
            self.take()
            out = Node(f"({out.boolean()} AND {self._not().boolean()})", truth=True)
        return out

    def _not(self) -> Node:
        if self.accept("NOT"):
            return Node(f"(NOT {self._not().boolean()})", truth=True)
        return self._comparison()

    def _comparison(self) -> Node:
        out = self._bits(0)
        while True:
            negated = False
            if self.at("NOT") and self.ahead().up in ("IN", "LIKE", "BETWEEN", "REGEXP", "RLIKE"):
                self.take()
                negated = True
            if self.t.kind == "op" and self.t.text in ("=", "<=>", "<", "<=", ">", ">=", "<>", "!="):
                op = self.take().text.replace("!=", "<>")
                out = self._compare(out, op)
            elif self.accept("IS"):
                negated = self.accept("NOT")
                word = self.take().up
                if word == "UNKNOWN":
                    word = "NULL"
                text = f"{out.text} IS {'NOT ' * negated}NULL" if word == "NULL" else f"{out.boolean()} IS {'NOT ' * negated}{word}"
                out = Node(f"({text})", truth=True)
                continue
            elif self.accept("BETWEEN"):
                low = self._bits(0)
                self.expect("AND")
                out = Node(f"({out.text} BETWEEN {low.text} AND {self._bits(0).text})", truth=True)
            elif self.accept("IN"):
                out = Node(f"({self._tuple(out)} IN ({self._in_list()}))", truth=True)
            elif self.accept("LIKE"):
                pattern = self._bits(0)
                escape = unquote(self.take().text) if self.accept("ESCAPE") else None
                out = Node(f"({self._plain_text(out)} LIKE {pattern.text}{f' ESCAPE {render.text_literal(escape)}' if escape else ''})", truth=True)
            elif self.at("REGEXP") or self.at("RLIKE"):
                self.take()
                out = Node(self.build(FUNCTIONS["regexp_like"][0], [out, self._bits(0)]), truth=True)
            elif self.accept("MEMBER", "OF"):
                self.expect("(")
                doc = self.expr()
                self.expect(")")
                out = Node(self.build(FUNCTIONS["json_contains"][0], [doc, Node(self.build(FUNCTIONS["json_quote"][0], [out])) if out.known and isinstance(out.value, str) else Node(f"CAST({out.text} AS STRING)")]), truth=True)
            else:
                return out
            if negated:
                out = Node(f"(NOT {out.text})", truth=True)

    def _plain_text(self, n: Node) -> str:
        return n.text if n.known and isinstance(n.value, str) else f"CAST({n.text} AS STRING)"

    def _tuple(self, n: Node) -> str:
        return f"({', '.join(x.text for x in n.items)})" if n.items else n.text

    def _in_list(self) -> str:
        self.expect("(")
        if self.at("SELECT") or self.at("WITH") or self.at("VALUES") or self.at("TABLE"):
            text = self.query()
        else:
            text = ", ".join(self._tuple(x) for x in self.list())
        self.expect(")")
        return text

    def _compare(self, left: Node, op: str) -> Node:
        if self.t.up in ("ANY", "SOME", "ALL") and self.ahead().text == "(":
            word = self.take().up
            self.expect("(")
            q = self.query()
            self.expect(")")
            if op == "=" and word != "ALL":
                return Node(f"({self._tuple(left)} IN ({q}))", truth=True)
            if op == "<>" and word == "ALL":
                return Node(f"({self._tuple(left)} NOT IN ({q}))", truth=True)
            return Node(self._quantified(left.text, op, word == "ALL", q), truth=True)
        right = self._bits(0)
        if left.items and right.items:
            if op == "<=>":
                return Node("(" + " AND ".join(f"({a.text} <=> {b.text})" for a, b in zip(left.items, right.items, strict=True)) + ")", truth=True)
            n = len(left.items)
            return Node(self.build(lambda *x: N.row_compare(list(x[:n]), op, list(x[n:])), [*left.items, *right.items]), truth=True)
        return Node(f"({self._tuple(left)} {op} {self._tuple(right)})", truth=True)

    def _quantified(self, x: str, op: str, every: bool, q: str) -> str:
        """A comparison with all or any rows of a query, by its least and greatest value; a NULL there can make it unknown."""
        of = lambda what: f"(SELECT {what} FROM ({q}) AS _q(v))"
        if op in ("=", "<>"):
            test = f"({x} {op} {of('min(v)')} {'AND' if op == '=' else 'OR'} {x} {op} {of('max(v)')})"
        else:
            test = f"({x} {op} {of('max(v)' if (op[0] == '>') == every else 'min(v)')})"
        settled = f"NOT {test} THEN FALSE" if every else f"{test} THEN TRUE"
        return f"(CASE WHEN {of('count(*)')} = 0 THEN {'TRUE' if every else 'FALSE'} WHEN {settled} WHEN {of('count(*) - count(v)')} > 0 THEN NULL ELSE {test} END)"

    _LEVELS = [("|",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "DIV", "%", "MOD"), ("^",)]

    def _bits(self, level: int) -> Node:
        if level == len(self._LEVELS):
            return self._unary()
        out = self._bits(level + 1)
        while self.t.kind in ("op", "word") and self.t.up in self._LEVELS[level]:
            op = self.take().up
            if op in "+-" and self.at("INTERVAL"):
                n, unit = self._interval()
                out = Node(self.build(lambda d, k, unit=unit, op=op: D.add(d, k, unit, 1 if op == "+" else -1), [out, n]))
                continue
            right = self._bits(level + 1)
            out = self._binary(op, out, right)
        return out

    def _number(self, n: Node) -> Node:
        """Text in arithmetic is the number it starts with."""
        return Node(self.build(number, [n])) if n.known and isinstance(n.value, str) else Node(f"CAST({n.text} AS INT)") if n.truth else n

    def _binary(self, op: str, a: Node, b: Node) -> Node:
        if op in ("|", "&", "^"):
            return Node(self.build({"|": N.bit_or, "&": N.bit_and, "^": N.bit_xor}[op], [a, b]))
        if op in ("<<", ">>"):
            return Node(self.build(lambda x, n: N.shift(x, n, op == "<<"), [a, b]))
        a, b = self._number(a), self._number(b)
        if op == "DIV":
            return Node(self.build(N.int_divide, [a, b]))
        if op in ("%", "MOD"):
            return Node(self.build(FUNCTIONS["mod"][0], [a, b]))
        if op == "/":
            return Node(self.build(N.divide, [a, b]))
        return Node(f"({a.text} {op} {b.text})")

    def _unary(self) -> Node:
        if self.accept("-"):
            x = self._number(self._unary())
            if x.known and isinstance(x.value, int | float) and not isinstance(x.value, bool):
                return Node(f"(-{x.text})" if not x.text.startswith("(-") else x.text[2:-1], True, -x.value)
            return Node(f"(-{x.text})")
        if self.accept("+"):
            return self._unary()
        if self.accept("~"):
            return Node(self.build(N.bit_not, [self._unary()]))
        if self.accept("!"):
            return Node(f"(NOT {self._unary().boolean()})", truth=True)
        if self.at("BINARY") and self.ahead().text not in (",", ")"):
            self.take()
            return Node(f"CAST({self._unary().text} AS BINARY)")
        if self.at("PRIOR"):
            raise ParseError("PRIOR")
        out = self._primary()
        while True:
            if self.at("->") or self.at("->>"):
                op = self.take().text
                path = self._primary()
                got = Node(self.build(FUNCTIONS["json_extract"][0], [out, path]))
                out = Node(self.build(FUNCTIONS["json_unquote"][0], [got])) if op == "->>" else Node(got.text, json=True)
            elif self.accept("COLLATE"):
                out = Node(collated(out.text, self.ident()))
            else:
                return out

    def _interval(self) -> tuple[Node, str]:
        self.expect("INTERVAL")
        n = self.expr()
        unit = self.take().up
        if unit not in UNITS:
            raise ParseError(f"no unit {unit}")
        return n, unit

    def list(self) -> list[Node]:
        out = [self.expr()]
        while self.accept(","):
            out.append(self.expr())
        return out

    def _primary(self) -> Node:
        t = self.t
        if t.kind == "string":
            self.take()
            v = unquote(t.text)
            while self.t.kind == "string":
                v += unquote(self.take().text)
            return Node(render.text_literal(v), True, v)
        if t.kind == "number":
            self.take()
            if re.fullmatch(r"\d+", t.text):
                return Node(render.value(int(t.text)), True, int(t.text))
            if "e" in t.text.lower():
                return Node(f"{float(t.text)!r}D", True, float(t.text))
            digits = t.text + "0" if t.text.endswith(".") else t.text
            return Node(digits if digits[0] != "." else "0" + digits, True, float(digits))
        if t.kind == "hex":
            self.take()
            h = t.text[2:].rstrip("'")
            h = "0" * (len(h) % 2) + h
            return Node(f"X'{h}'", True, bytes.fromhex(h))
        if t.kind == "bits":
            self.take()
            n = int(t.text[2:].rstrip("'") or "0", 2)
            return Node(render.value(n), True, n)
        if t.kind == "system":
            self.take()
            v = self.session.system(t.text[2:].split(".")[-1].lower())
            return Node(render.value(v), True, v)
        if t.kind == "user":
            self.take()
            name = t.text[1:].strip("`'").lower()
            if self.accept(":="):
                return self.session.assign(name, self.expr())
            v = self.session.user(name)
            return Node(render.value(v), True, v)
        if self.accept("?"):
            return Node("?")
        if self.accept("{"):  # {d '...'}
            kind = self.ident().lower()
            out = self._typed({"d": "DATE", "t": "TIME", "ts": "TIMESTAMP"}[kind], unquote(self.take().text))
            self.expect("}")
            return out
        if self.accept("("):
            if self.at("SELECT") or self.at("WITH") or self.at("VALUES") or self.at("TABLE"):
                q = self.query()
                self.expect(")")
                return Node(f"({q})")
            items = self.list()
            self.expect(")")
            if len(items) > 1:
                return Node("(" + ", ".join(x.text for x in items) + ")", items=items)
            x = items[0]
            return x if x.known else Node(f"({x.text})", truth=x.truth, json=x.json)
        if self.accept("*"):
            return Node("*")
        if t.kind == "quoted":
            return self._reference()
        if t.kind != "word":
            raise ParseError(f"unexpected {self.sql[t.start : t.start + 30]!r}")
        word = t.up
        if word in ("NULL", "TRUE", "FALSE") and self.ahead().text != "(":
            self.take()
            return Node(word, True, {"NULL": None, "TRUE": True, "FALSE": False}[word], truth=word != "NULL")
        if word == "CASE":
            return self._case()
        if word == "EXISTS" and self.ahead().text == "(":
            self.take(), self.take()
            q = self.query()
            self.expect(")")
            return Node(f"(EXISTS ({q}))", truth=True)
        if word in ("DATE", "TIME", "TIMESTAMP") and self.ahead().kind == "string":
            self.take()
            return self._typed(word, unquote(self.take().text))
        if word == "INTERVAL" and self.ahead().text != "(":
            n, unit = self._interval()
            self.expect("+")
            return Node(self.build(lambda d, k: D.add(d, k, unit), [self._bits(3), n]))
        if word == "N" and self.ahead().kind == "string" and self.ahead().start == t.end:
            self.take()
            return self._primary()
        if word.startswith("_") and self.ahead().kind in ("string", "hex") and word[1:] in ("UTF8MB4", "UTF8MB3", "UTF8", "LATIN1", "BINARY", "ASCII", "UTF16", "UTF32"):
            self.take()
            return self._primary()
        if word in ("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "LOCALTIME", "LOCALTIMESTAMP", "CURRENT_USER", "UTC_DATE", "UTC_TIME", "UTC_TIMESTAMP") and self.ahead().text != "(" and self.ahead().text != ".":
            self.take()
            return Node(self.build(FUNCTIONS[word.lower()][0], []))
        if self.ahead().text == "(" and word not in RESERVED | {"ROW"} or word in ("LEFT", "RIGHT", "VALUES", "MOD", "IF", "INSERT", "REPLACE", "REPEAT", "CHAR", "DATE", "SET", "DISTANCE") and self.ahead().text == "(":
            return self._call()
        if word == "ROW" and self.ahead().text == "(":
            self.take(), self.take()
            items = self.list()
            self.expect(")")
            return Node("(" + ", ".join(x.text for x in items) + ")", items=items)
        if word in ("SELECT", "FROM", "WHERE"):
            raise ParseError(f"unexpected {word}")
        return self._reference()

    def _typed(self, kind: str, v: str) -> Node:
        if kind == "TIME":
            return Node(render.text_literal(v), True, v)
        return Node(f"{'DATE' if kind == 'DATE' else 'TIMESTAMP_NTZ'} {render.text_literal(v)}")

    def _reference(self) -> Node:
        parts = [name_of(self.take())]
        while self.at("."):
            self.take()
            if self.accept("*"):
                return Node(".".join(quoted(p) for p in parts) + ".*", column=True)
            parts.append(name_of(self.take()))
        found = self.columns.get(".".join(parts).lower())
        if found is not None:
            return Node(found, truth=False)
        return Node(".".join(quoted(p) for p in parts[-2:]), column=True)

    def _case(self) -> Node:
        self.expect("CASE")
        on = None if self.at("WHEN") else self.expr()
        out = "CASE" + (f" {on.text}" if on else "")
        truth = True
        while self.accept("WHEN"):
            c = self.expr()
            self.expect("THEN")
            v = self.expr()
            truth &= v.truth
            out += f" WHEN {c.text if on else c.boolean()} THEN {v.text}"
        if self.accept("ELSE"):
            v = self.expr()
            truth &= v.truth
            out += f" ELSE {v.text}"
        self.expect("END")
        return Node(f"({out} END)", truth=truth)

    # --- calls ----------------------------------------------------------------------------------------

    def _call(self) -> Node:
        name = self.ident().lower()
        self.expect("(")
        special = getattr(self, f"_call_{name}", None)
        if special:
            return special()
        distinct = self.accept("DISTINCT")
        args = [] if self.at(")") else self.list()
        self.expect(")")
        return self.call(name, args, distinct)

    def call(self, name: str, args: list[Node], distinct: bool = False) -> Node:
        args = [Node(f"({x.text})", items=x.items) if x.items else x for x in args]
        if own := self.session.function(name):
            return Node(own(*[a.text for a in args]))
        if name in WINDOWED:
            respect = "IGNORE NULLS" if self.accept("IGNORE", "NULLS") else ""
            self.accept("RESPECT", "NULLS")
            return Node(f"{name}({', '.join(a.text for a in args)}) {respect}{self.over()}")
        if name in A.AGGREGATES:
            return self._aggregate(name, args, distinct)
        if name in PLAIN:
            if name == "if":
                return Node(f"if({args[0].boolean()}, {args[1].text}, {args[2].text})", truth=args[1].truth and args[2].truth)
            return Node(f"{name}({', '.join(a.text for a in args)})")
        if name == "isnull":
            return Node(f"({args[0].text} IS NULL)", truth=True)
        if name == "not":
            return Node(f"(NOT {args[0].boolean()})", truth=True)
        if name not in FUNCTIONS:
            return Node(f"{name}({'DISTINCT ' if distinct else ''}{', '.join(a.text for a in args)})")
        f, least, most = FUNCTIONS[name]
        if len(args) < least or most is not None and len(args) > most:
            raise ArityError(f"{name} takes {least}{'' if most == least else f' to {most}' if most else ' or more'} arguments, not {len(args)}")
        raw = frozenset(i for i, a in enumerate(args) if a.json)
        if raw and (name in J.MUTATORS or name in ("json_array", "json_object")):
            f = J.nested(name, raw)
        return Node(self.build(f, args), json=name in J.GIVES_JSON)

    def over(self) -> str:
        """The OVER clause that follows, if one does."""
        if not self.accept("OVER"):
            return ""
        if not self.at("("):
            return f" OVER {quoted(self.ident())}"
        return f" OVER ({self._window()})"

    def _window(self) -> str:
        self.expect("(")
        out = []
        if self.t.kind in ("word", "quoted") and self.t.up not in ("PARTITION", "ORDER", "ROWS", "RANGE"):
            out.append(self._named[self.ident().lower()])
        if self.accept("PARTITION", "BY"):
            out.append("PARTITION BY " + ", ".join(x.text for x in self.list()))
        if self.at("ORDER", "BY"):
            out.append(self._order())
        if self.t.up in ("ROWS", "RANGE"):
            out.append(self.take().up)
            if self.accept("BETWEEN"):
                low = self._bound()
                self.expect("AND")
                out.append(f"BETWEEN {low} AND {self._bound()}")
            else:
                out.append(f"BETWEEN {self._bound()} AND CURRENT ROW")
        self.expect(")")
        return " ".join(out)

    def _bound(self) -> str:
        if self.accept("CURRENT", "ROW"):
            return "CURRENT ROW"
        if self.accept("UNBOUNDED"):
            return f"UNBOUNDED {self.take().up}"
        if self.at("INTERVAL"):
            n, unit = self._interval()
            return f"INTERVAL {n.value!r} {unit} {self.take().up}" if not isinstance(n.value, str) else f"INTERVAL '{n.value}' {unit} {self.take().up}"
        n = self._bits(0)
        return f"{n.text} {self.take().up}"

    def _aggregate(self, name: str, args: list[Node], distinct: bool) -> Node:
        over = self.over()
        if name == "count":
            if not args or args[0].text == "*":
                return Node(f"count(1){over}")
            items = args[0].items if args[0].items and len(args) == 1 else args
            return Node(f"count({'DISTINCT ' if distinct else ''}{', '.join(x.text for x in items)}){over}")
        if name in ("first", "last"):
            return Node(f"{name}({args[0].text}){over}")
        if name == "json_objectagg":
            return Node(self.build(A.json_objectagg, args, over))
        if name == "sum":
            args = [self._number(args[0])]
        return Node(self.build(A.AGGREGATES[name], [Node(a.text) for a in args], over, distinct))

    def _call_group_concat(self) -> Node:
        distinct = self.accept("DISTINCT")
        args, order, sep = self.list(), [], ","
        if self.accept("ORDER", "BY"):
            while True:
                k = self.expr()
                order.append((k, not self.accept("DESC")))
                self.accept("ASC")
                if not self.accept(","):
                    break
        if self.accept("SEPARATOR"):
            sep = unquote(self.take().text)
        self.expect(")")
        text = args[0] if len(args) == 1 else self.call("concat", args)
        limit = self.session.system("group_concat_max_len") or 1024

        def build(x, *keys):
            return A.group_concat(x, [(k, up) for k, (_, up) in zip(keys, order, strict=True)], sep, distinct, int(limit))

        return Node(self.build(build, [Node(text.text), *[Node(k.text) for k, _ in order]], self.over()))

    def _type(self) -> str:
        """A type of CAST, as written."""
        out = self.take().up
        if out == "DOUBLE":
            self.accept("PRECISION")
        if self.accept("("):
            while not self.accept(")"):
                out += ("" if out[-1] == "(" or "(" in out else "(") + self.take().text
            out += ")"
        if self.accept("CHARACTER", "SET") or self.accept("CHARSET"):
            self.take()
        self.accept("UNSIGNED") if out == "UNSIGNED" else None
        self.accept("INTEGER") or self.accept("INT")
        return out

    def _call_cast(self) -> Node:
        x = self.expr()
        if self.accept("AS"):
            kind = self._type()
        else:
            self.expect(",")
            kind = self._type()
        self.expect(")")
        return Node(self.build(lambda v: N.convert(v, kind), [x]), json=kind == "JSON")

    def _call_convert(self) -> Node:
        x = self.expr()
        if self.accept("USING"):
            charset = self.ident().lower()
            self.expect(")")
            return Node(self.build(lambda v: N.convert_using(v, charset), [x]))
        self.expect(",")
        kind = self._type()
        self.expect(")")
        return Node(self.build(lambda v: N.convert(v, kind), [x]))

    def _call_extract(self) -> Node:
        unit = self.take().up
        self.expect("FROM")
        x = self.expr()
        self.expect(")")
        return Node(self.build(lambda d: D.call_extract(unit, d), [x]))

    def _call_trim(self) -> Node:
        side = self.take().up if self.t.up in ("BOTH", "LEADING", "TRAILING") else "BOTH"
        what = None
        if self.at("FROM"):
            self.take()
            x = self.expr()
        else:
            x = self.expr()
            if self.accept("FROM"):
                what, x = x, self.expr()
        self.expect(")")
        return Node(f"TRIM({side} {what.text if what else repr(' ')} FROM {x.text})") if not what or len(str(what.value)) <= 1 else Node(self.build(lambda s, w: N.trim_text(s, w, side), [x, what]))

    def _call_substring(self) -> Node:
        args = [self.expr()]
        if self.accept("FROM"):
            args.append(self.expr())
            if self.accept("FOR"):
                args.append(self.expr())
        else:
            while self.accept(","):
                args.append(self.expr())
        self.expect(")")
        return self.call("substring", args)

    _call_substr = _call_mid = _call_substring

    def _call_position(self) -> Node:
        a = self._bits(0)
        self.expect("IN")
        b = self.expr()
        self.expect(")")
        return self.call("locate", [a, b])

    def _call_char(self) -> Node:
        args = self.list()
        if self.accept("USING"):
            self.ident()
        self.expect(")")
        return self.call("char", args)

    def _date_arithmetic(self, sign: int) -> Node:
        d = self.expr()
        self.expect(",")
        if self.at("INTERVAL"):
            n, unit = self._interval()
        else:
            n, unit = self.expr(), "DAY"
        self.expect(")")
        return Node(self.build(lambda x, k: D.add(x, k, unit, sign), [Node(d.text), n]))

    def _call_date_add(self) -> Node:
        return self._date_arithmetic(1)

    def _call_date_sub(self) -> Node:
        return self._date_arithmetic(-1)

    _call_adddate, _call_subdate = _call_date_add, _call_date_sub

    def _unit_first(self, f) -> Node:
        unit = self.take().up.removeprefix("SQL_TSI_")
        self.expect(",")
        args = self.list()
        self.expect(")")
        return Node(self.build(lambda *x: f(F.lit(unit), *x), args))

    def _call_timestampadd(self) -> Node:
        return self._unit_first(D.timestampadd)

    def _call_timestampdiff(self) -> Node:
        return self._unit_first(D.timestampdiff)

    def _call_get_format(self) -> Node:
        kind = self.take().up
        self.expect(",")
        where = self.expr()
        self.expect(")")
        return Node(self.build(lambda w: D.get_format(F.lit(kind), w), [where]))

    def _call_values(self) -> Node:
        name = self.qualified()[-1]
        self.expect(")")
        return Node(f"new.{quoted(name)}")

    def _call_default(self) -> Node:
        name = self.qualified()[-1]
        self.expect(")")
        return Node(self.columns.get(f"default({name.lower()})", "NULL"))

    def _call_name_const(self) -> Node:
        self.expr()
        self.expect(",")
        v = self.expr()
        self.expect(")")
        return v

    def _call_json_value(self) -> Node:
        args = self.list()
        kind = self._type() if self.accept("RETURNING") else None
        self.expect(")")
        got = Node(self.build(FUNCTIONS["json_value"][0], args))
        return Node(self.build(lambda v: N.convert(v, kind), [got])) if kind else got

    def _call_match(self) -> Node:
        from ..operators import fulltext

        cols = self.list()
        self.expect(")")
        self.expect("AGAINST")
        self.expect("(")
        q = self._bits(0)
        while not self.at(")"):
            self.take()
        self.expect(")")
        return Node(self.build(lambda *x: fulltext.term_hits(F.concat_ws(" ", *x), str(q.value)), [Node(c.text) for c in cols]), truth=False)

    # --- queries ----------------------------------------------------------------------------------------

    _named: dict[str, str] = {}

    def query(self) -> str:
        """[WITH ...] a UNION b ... [ORDER BY] [LIMIT]"""
        head = self._with() if self.at("WITH") else ""
        out = [self._term()]
        while self.t.up in ("UNION", "INTERSECT", "EXCEPT", "MINUS") and self.t.kind == "word":
            op = self.take().up.replace("MINUS", "EXCEPT")
            if self.accept("ALL"):
                op += " ALL"
            else:
                self.accept("DISTINCT")
            out += [op, self._term()]
        body = " ".join(out)
        tail = self._tail()
        self._locks()
        return f"{head}{body}{tail}"

    def _tail(self) -> str:
        out = ""
        if self.at("ORDER", "BY"):
            out += " " + self._order()
        if self.accept("LIMIT"):
            a = self._bits(0).text
            if self.accept(","):
                out += f" LIMIT {self._bits(0).text} OFFSET {a}"
            elif self.accept("OFFSET"):
                out += f" LIMIT {a} OFFSET {self._bits(0).text}"
            else:
                out += f" LIMIT {a}"
        elif self.accept("OFFSET"):
            out += f" OFFSET {self._bits(0).text}"
        return out

    def _locks(self) -> None:
        while self.at("FOR", "UPDATE") or self.at("FOR", "SHARE") or self.at("LOCK", "IN"):
            if self.accept("LOCK"):
                self.expect("IN", "SHARE", "MODE")
                continue
            self.take(), self.take()
            if self.accept("OF"):
                self.qualified()
            self.accept("SKIP", "LOCKED") or self.accept("NOWAIT")

    def _order(self) -> str:
        self.expect("ORDER", "BY")
        out = []
        while True:
            k = self.expr()
            out.append(k.text + (" DESC" if self.accept("DESC") else ""))
            self.accept("ASC")
            if not self.accept(","):
                return "ORDER BY " + ", ".join(out)

    def _with(self) -> str:
        self.expect("WITH")
        recursive = self.accept("RECURSIVE")
        parts, loops = [], False
        while True:
            name = self.ident()
            self.common |= {name.lower()}
            cols = self.names() if self.at("(") else []
            self.expect("AS")
            self.expect("(")
            start = self.i
            if recursive and (found := self._recursion(name)):
                base, union, step = found
                if union == "UNION":
                    text = self.session.recursive(name, cols, base, step)
                else:
                    text, loops = f"{base} UNION ALL {step}", True
            else:
                self.i = start
                text = self.query()
            self.expect(")")
            parts.append(f"{quoted(name)}{'(' + ', '.join(map(quoted, cols)) + ')' if cols else ''} AS ({text})")
            if not self.accept(","):
                return f"WITH {'RECURSIVE ' if loops else ''}{', '.join(parts)} "

    def _recursion(self, name: str) -> tuple[str, str, str] | None:
        """(base, UNION or UNION ALL, step) if the query names itself after its first union."""
        base = self._term()
        if not self.at("UNION"):
            return None
        self.take()
        op = "UNION ALL" if self.accept("ALL") else "UNION"
        self.accept("DISTINCT")
        start = self.i
        step = self._term()
        used = any(t.kind in ("word", "quoted") and name_of(t).lower() == name.lower() for t in self.toks[start : self.i])
        step += self._tail()
        return (base, op, step) if used and self.at(")") else None

    def _term(self) -> str:
        if self.accept("("):
            q = self.query()
            self.expect(")")
            return f"({q})"
        if self.at("VALUES"):
            return self._values()
        if self.accept("TABLE"):
            return f"SELECT * FROM {self.session.relation(self.qualified(), None)}"
        return self._select()

    def _values(self) -> str:
        self.expect("VALUES")
        rows = []
        while True:
            self.accept("ROW")
            self.expect("(")
            rows.append("(" + ", ".join(x.text for x in self.list()) + ")")
            self.expect(")")
            if not self.accept(","):
                break
        n = len(split_top(rows[0][1:-1]))
        return f"SELECT * FROM VALUES {', '.join(rows)} AS _v({', '.join(f'column_{i}' for i in range(n))})"

    def _select(self) -> str:
        self.expect("SELECT")
        hint, distinct = "", ""
        while True:
            if self.t.kind == "hint":
                hint = hints(self.take().text)
            elif self.t.up in ("DISTINCT", "DISTINCTROW"):
                self.take()
                distinct = "DISTINCT "
                if self.at("ON") and self.ahead().text == "(":
                    raise ParseError("DISTINCT ON is an operator, see operators.sets")
            elif self.t.up in ("SQL_CALC_FOUND_ROWS", "HIGH_PRIORITY", "STRAIGHT_JOIN", "SQL_NO_CACHE", "SQL_CACHE", "SQL_BIG_RESULT", "SQL_SMALL_RESULT", "SQL_BUFFER_RESULT", "ALL") and self.t.kind == "word":
                self.take()
            else:
                break
        # named windows come later in the text than their uses
        outer, self._named = self._named, {}
        back = self.i
        depth = 0
        for k in range(self.i, len(self.toks)):
            t = self.toks[k]
            depth += (t.text == "(") - (t.text == ")")
            if depth < 0:
                break
            if depth == 0 and t.kind == "word" and t.up == "WINDOW" and self.toks[k + 1].kind in ("word", "quoted") and self.toks[k + 2].up == "AS":
                self.i = k + 1
                while True:
                    name = self.ident().lower()
                    self.expect("AS")
                    self._named[name] = self._window()
                    if not self.accept(","):
                        break
                break
        windows = dict(self._named)
        self.i = back
        items = [self._item()]
        while self.accept(","):
            items.append(self._item())
        self._into()
        source = ""
        self.pair = self.scan = None
        if self.accept("FROM") and not self.accept("DUAL"):
            source = self.sources()
        pair, scan, rest = self.pair, self.scan, ""
        if self.accept("WHERE"):
            rest, pair = " WHERE " + self.expr().boolean(), None
        if self.accept("GROUP", "BY"):
            groups = [x.text for x in self.list()]
            rest += " GROUP BY " + ", ".join(groups)
            if self.accept("WITH", "ROLLUP"):
                rest += " WITH ROLLUP"
            elif pair and not distinct and self.t.up not in ("HAVING", "WINDOW", "ORDER") and (made := eager.counted(items, *pair, groups)):
                items, source = made
        if scan and source == scan[0] + scan[1] and not self.at("LIMIT") and render.PYTHON in "".join(items) + rest:
            spread = self.session.spread(scan[0])
            source = spread + (scan[1] or (f" AS {scan[2]}" if spread != scan[0] else ""))
        out = f"SELECT {hint}{distinct}{', '.join(items)}{f' FROM {source}' if source else ''}{rest}"
        if self.accept("HAVING"):
            out += " HAVING " + self.expr().boolean()
        if self.accept("WINDOW"):
            while True:
                self.ident()
                self.expect("AS")
                self._window()
                if not self.accept(","):
                    break
            out += " WINDOW " + ", ".join(f"{quoted(n)} AS ({w})" for n, w in windows.items())
        self._named = outer
        return out

    into: list[str] | None = None

    def _into(self) -> None:
        """INTO of a top query: user variables, or a file with its options."""
        if not self.accept("INTO"):
            return
        self.into = []
        if self.t.up in ("OUTFILE", "DUMPFILE"):
            self.into = [self.take().up, unquote(self.take().text), self.file_options()]
            return
        while True:
            self.into.append(self.take().text.lstrip("@").lower())
            if not self.accept(","):
                return

    def file_options(self) -> dict[str, str]:
        """FIELDS TERMINATED BY ... ENCLOSED BY ... ESCAPED BY ... LINES STARTING BY ... TERMINATED BY ..."""
        out, group = {}, ""
        while self.t.up in ("FIELDS", "COLUMNS", "LINES", "TERMINATED", "ENCLOSED", "OPTIONALLY", "ESCAPED", "STARTING"):
            w = self.take().up
            if w in ("FIELDS", "COLUMNS", "LINES"):
                group = "lines" if w == "LINES" else "fields"
            elif w != "OPTIONALLY":
                self.expect("BY")
                out[f"{group}_{w.lower()}"] = unquote(self.take().text)
        return out

    def _item(self) -> str:
        start = self.t.start
        if self.accept("*"):
            return "*"
        x = self.expr()
        end = self.toks[self.i - 1].end
        if self.accept("AS") or self.t.kind in ("quoted", "string") or self.t.kind == "word" and self.t.up not in RESERVED:
            return f"{x.text} AS {quoted(self.ident())}"
        if x.column:
            return x.text
        title = self.sql[start:end]
        if re.fullmatch(r"'(?:[^'\\]|'')*'", title, re.S):
            title = unquote(title)
        return f"{x.text} AS {quoted(title)}"

    #: (left, right, condition) of the last FROM, if it is one inner join of two.
    pair: tuple[str, str, str] | None = None
    #: (relation, alias as written, name) of the last table in FROM.
    scan: tuple[str, str, str] | None = None
    #: Names that WITH gave to queries.
    common: frozenset[str] = frozenset()

    def sources(self) -> str:
        out = self._joined()
        while self.accept(","):
            out += f", {self._joined()}"
            self.pair = None
        return out

    def _joined(self) -> str:
        out = self._factor()
        pair, joins = None, 0
        while True:
            natural = self.accept("NATURAL")
            kind = ""
            if self.accept("STRAIGHT_JOIN"):
                kind = "JOIN"
            elif self.t.up in ("LEFT", "RIGHT", "FULL") and self.t.kind == "word":
                kind = self.take().up
                self.accept("OUTER")
                self.expect("JOIN")
                kind = f"{kind} JOIN"
            elif self.accept("INNER", "JOIN") or self.accept("JOIN"):
                kind = "JOIN"
            elif self.accept("CROSS", "JOIN"):
                kind = "CROSS JOIN"
            else:
                self.pair = pair if joins == 1 else None
                return out
            right = self._factor()
            if kind == "RIGHT JOIN":  # its right side can't see the left one, so it's a plain join
                right = right.removeprefix("LATERAL ")
            if self.accept("ON"):
                on = f" ON {self.expr().boolean()}"
                kind = kind.replace("CROSS ", "")
            elif self.accept("USING"):
                on = f" USING ({', '.join(map(quoted, self.names()))})"
            else:
                on = ""
                if kind == "JOIN" and not natural:
                    kind = "CROSS JOIN"
            joins += 1
            pair = (out, right, on.removeprefix(" ON ")) if kind == "JOIN" and on.startswith(" ON ") and not natural else None
            out += f" {'NATURAL ' * natural}{kind} {right}{on}"

    def _alias(self) -> str:
        if not (self.accept("AS") or self.t.kind == "quoted" or self.t.kind == "word" and self.t.up not in RESERVED and not (self.t.up == "SET")):
            return ""
        out = f" AS {quoted(self.ident())}"
        if self.at("("):
            out += f"({', '.join(map(quoted, self.names()))})"
        return out

    def _factor(self) -> str:
        lateral = "LATERAL " * self.accept("LATERAL")
        if self.at("("):
            k = 1
            while self.ahead(k).text == "(":
                k += 1
            if self.ahead(k).up in ("SELECT", "WITH", "VALUES", "TABLE"):
                self.take()
                if self.at("VALUES"):
                    q = self._values()
                    q += self._tail()
                else:
                    q = self.query()
                self.expect(")")
                return f"{lateral}({q}){self._alias()}"
            self.take()
            inner = self.sources()
            self.expect(")")
            return f"({inner})"
        if self.at("VALUES"):
            q = self._values()
            return f"({q}){self._alias()}"
        if self.at("JSON_TABLE") and self.ahead().text == "(":
            return self._json_table()
        parts = self.qualified()
        if self.accept("("):
            args = [] if self.at(")") else self.list()
            self.expect(")")
            made = self.session.table_function(parts[-1].lower(), args)
            return f"({made}){self._alias() or f' AS {quoted(parts[-1])}'}" if made else f"{parts[-1]}({', '.join(a.text for a in args)}){self._alias()}"
        as_of = None
        if self.accept("PARTITION"):
            self.names()
        if self.accept("AS", "OF") or self.accept("FOR", "SYSTEM_TIME", "AS", "OF"):
            self.accept("TIMESTAMP") if self.ahead().kind != "string" else None
            as_of = self.expr()
            as_of = str(as_of.value) if as_of.known else as_of.text
        relation = self.session.relation(parts, as_of)
        before = self.i
        alias = self._alias()
        self.seen.append((name_of(self.toks[self.i - 1]) if self.i > before and not alias.endswith(")") else parts[-1], parts[-1]))
        alias = alias or (f" AS {quoted(parts[-1])}" if relation.startswith("(") else "")
        while self.t.up in ("USE", "FORCE", "IGNORE") and self.ahead().up in ("INDEX", "KEY"):
            self.take(), self.take()
            if self.accept("FOR"):
                self.accept("JOIN") or self.accept("ORDER", "BY") or self.accept("GROUP", "BY")
            self.names()
        if not relation.startswith("(") and parts[-1].lower() not in self.common:
            self.scan = relation, alias, quoted(parts[-1])
        return relation + alias

    def _json_table(self) -> str:
        self.take()
        self.expect("(")
        doc = self.expr()
        self.expect(",")
        path = unquote(self.take().text)
        columns = self._json_columns()
        self.expect(")")
        self.accept("AS")
        name = self.ident()
        call, cols = self.session.json_table(doc.text, path, columns)
        return f"LATERAL {call} AS {quoted(name)}({', '.join(map(quoted, cols))})"

    def _json_columns(self) -> list:
        from ..operators.json_table import Col, Nested

        self.expect("COLUMNS")
        self.expect("(")
        out = []
        while True:
            if self.accept("NESTED"):
                self.accept("PATH")
                path = unquote(self.take().text)
                out.append(Nested(path, self._json_columns()))
            else:
                name = self.ident()
                if self.accept("FOR", "ORDINALITY"):
                    out.append(Col(name, kind="ordinality"))
                else:
                    kind = self._type()
                    exists = self.accept("EXISTS")
                    self.expect("PATH")
                    c = Col(name, "bigint" if re.match(r"(BIG|SMALL|TINY|MEDIUM)?INT|INTEGER|SIGNED", kind) else "double" if re.match(r"FLOAT|DOUBLE|REAL|DEC", kind) else "json" if kind == "JSON" else "string", unquote(self.take().text), "exists" if exists else "path")
                    while self.t.up in ("NULL", "ERROR", "DEFAULT") and self.t.kind == "word":
                        word = self.take().up
                        v = None if word == "NULL" else "ERROR" if word == "ERROR" else unquote(self.take().text) if self.t.kind == "string" else self.take().text
                        if word == "DEFAULT" and c.type in ("bigint", "double"):
                            v = (int if c.type == "bigint" else float)(v)
                        self.expect("ON")
                        setattr(c, "empty" if self.take().up == "EMPTY" else "error", v)
                    out.append(c)
            if not self.accept(","):
                break
        self.expect(")")
        return out


def collated(text: str, collation: str) -> str:
    """A comparison under a collation: those that end in _ci fold case (and accents if _ai)."""
    c = collation.lower()
    if c.endswith("_ci"):
        return f"collate({text}, '{'UNICODE_CI_AI' if '_ai_' in c else 'UTF8_LCASE'}')"
    return text


def split_top(text: str) -> list[str]:
    """Parts between commas outside quotes and brackets."""
    out, depth, at = [], 0, 0
    for t in tokens(text):
        depth += (t.text in "([{" and t.kind == "op") - (t.text in ")]}" and t.kind == "op" and t.text != "")
        if t.kind == "op" and t.text == "," and depth == 0:
            out.append(text[at : t.start].strip())
            at = t.end
    rest = text[at:].strip()
    return [*out, rest] if rest or out else out


def hints(text: str) -> str:
    """Join hints by their Spark names; others are dropped."""
    known = {"HASH_JOIN": "SHUFFLE_HASH", "MERGE_JOIN": "MERGE", "LOOKUP_JOIN": "BROADCAST"}
    found = [f"{known[n.upper()]}({a})" for n, a in re.findall(r"(\w+)\(([^)]*)\)", text) if n.upper() in known]
    return f"/*+ {', '.join(found)} */ " if found else ""


def query(sql: str, session: Session, columns: dict[str, str] | None = None) -> str:
    p = Parser(sql, session, columns)
    out = p.query()
    p.done()
    return out


def expression(sql: str, session: Session, columns: dict[str, str] | None = None) -> Node:
    p = Parser(sql, session, columns)
    out = p.expr()
    p.done()
    return out
