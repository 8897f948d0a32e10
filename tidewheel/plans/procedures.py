"""Stored procedures and triggers: blocks of statements, run on the driver; each statement in them is a Spark job.

A block is parsed once into a list of steps; variables are driver values that
later statements see as literals.  Cursors stream their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.recursive import written
from . import dialect, render
from .dialect import ParseError, Parser, quoted


class Signal(RuntimeError):
    """SIGNAL: an error with its SQLSTATE."""

    def __init__(self, state: str, message: str, code: int = 1644):
        super().__init__(message)
        self.state, self.message, self.code = state, message, code


class _Leave(Exception):
    def __init__(self, label):
        self.label = label


class _Iterate(_Leave):
    pass


class _Return(Exception):
    pass


class _Exit(Exception):
    """An EXIT handler ends its block."""

    def __init__(self, block):
        self.block = block


@dataclass
class Cursor:
    query: str
    rows: Iterator | None = None


@dataclass
class Frame:
    """Variables, cursors, conditions and handlers of a block; names are looked up outwards."""

    outer: Frame | None = None
    variables: dict[str, object] = field(default_factory=dict)
    cursors: dict[str, Cursor] = field(default_factory=dict)
    conditions: dict[str, str] = field(default_factory=dict)
    handlers: list[tuple[str, list[str], list]] = field(default_factory=list)

    def find(self, kind: str, name: str):
        f = self
        while f is not None:
            if name in getattr(f, kind):
                return getattr(f, kind)
            f = f.outer
        return None

    def literals(self) -> dict[str, str]:
        out = self.outer.literals() if self.outer else {}
        return out | {n: render.value(v) for n, v in self.variables.items()}


# --- parsing ------------------------------------------------------------------------------------------------

_ENDS = ("END", "ELSEIF", "ELSE", "WHEN", "UNTIL")


def parse_block(p: Parser) -> list:
    """Statements up to one of ``_ENDS``; each step is a tuple that starts with its kind."""
    out = []
    while p.t.kind != "end" and not (p.t.kind == "word" and p.t.up in _ENDS):
        out.append(parse_step(p))
        while p.accept(";"):
            pass
    return out


def _condition_values(p: Parser) -> list[str]:
    out = []
    while True:
        if p.accept("NOT", "FOUND"):
            out.append("NOT FOUND")
        elif p.accept("SQLSTATE"):
            p.accept("VALUE")
            out.append("STATE " + dialect.unquote(p.take().text))
        elif p.t.kind == "number":
            out.append("CODE " + p.take().text)
        else:
            out.append(p.ident().upper())
        if not p.accept(","):
            return out


def _until(p: Parser, *words: str) -> str:
    """The text up to one of these words outside brackets and CASE."""
    start, depth = p.t.start, 0
    while p.t.kind != "end":
        t = p.t
        if depth == 0 and (t.kind == "word" and t.up in words or t.kind == "op" and t.text in words):
            break
        depth += (t.text == "(") - (t.text == ")") + (t.kind == "word" and t.up == "CASE") - (t.kind == "word" and t.up == "END" and depth > 0)
        p.take()
    return p.sql[start : p.toks[p.i - 1].end]


def parse_step(p: Parser) -> tuple:
    label = None
    if p.t.kind in ("word", "quoted") and p.ahead().text == ":" and p.ahead(2).up in ("BEGIN", "LOOP", "WHILE", "REPEAT"):
        label = p.ident().lower()
        p.expect(":")
    if p.accept("BEGIN"):
        body = parse_block(p)
        p.expect("END")
        _label(p, label)
        return "block", label, body
    if p.accept("LOOP"):
        body = parse_block(p)
        p.expect("END", "LOOP")
        _label(p, label)
        return "loop", label, body
    if p.accept("WHILE"):
        test = _until(p, "DO")
        p.expect("DO")
        body = parse_block(p)
        p.expect("END", "WHILE")
        _label(p, label)
        return "while", label, test, body
    if p.at("REPEAT") and p.ahead().text != "(":
        p.take()
        body = parse_block(p)
        p.expect("UNTIL")
        test = _until(p, "END")
        p.expect("END", "REPEAT")
        _label(p, label)
        return "repeat", label, test, body
    if p.at("IF") and p.ahead().text != "EXISTS":
        p.take()
        branches, last = [], []
        while True:
            test = _until(p, "THEN")
            p.expect("THEN")
            branches.append((test, parse_block(p)))
            if not p.accept("ELSEIF"):
                break
        if p.accept("ELSE"):
            last = parse_block(p)
        p.expect("END", "IF")
        return "if", branches, last
    if p.accept("CASE"):
        on = None if p.at("WHEN") else _until(p, "WHEN")
        branches, last = [], None
        while p.accept("WHEN"):
            test = _until(p, "THEN")
            p.expect("THEN")
            branches.append((f"({on}) = ({test})" if on else test, parse_block(p)))
        if p.accept("ELSE"):
            last = parse_block(p)
        p.expect("END", "CASE")
        return "case", branches, last
    if p.accept("DECLARE"):
        return _declare(p)
    if p.accept("OPEN"):
        return "open", p.ident().lower()
    if p.accept("CLOSE"):
        return "close", p.ident().lower()
    if p.accept("FETCH"):
        p.accept("NEXT")
        p.accept("FROM")
        name = p.ident().lower()
        p.expect("INTO")
        into = [p.ident().lower()]
        while p.accept(","):
            into.append(p.ident().lower())
        return "fetch", name, into
    if p.accept("LEAVE"):
        return "leave", p.ident().lower()
    if p.accept("ITERATE"):
        return "iterate", p.ident().lower()
    if p.accept("RETURN"):
        return ("return",)
    if p.at("SIGNAL") or p.at("RESIGNAL"):
        return _signal(p)
    text = _until(p, ";")
    return "sql", text


def _label(p: Parser, label: str | None) -> None:
    if label and p.t.kind in ("word", "quoted") and dialect.name_of(p.t).lower() == label:
        p.take()


def _declare(p: Parser) -> tuple:
    if p.t.up in ("CONTINUE", "EXIT", "UNDO") and p.ahead().up == "HANDLER":
        kind = p.take().up
        p.expect("HANDLER", "FOR")
        return "handler", kind, _condition_values(p), [parse_step(p)]
    names = [p.ident().lower()]
    if p.accept("CONDITION"):
        p.expect("FOR")
        return "condition", names[0], _condition_values(p)[0]
    if p.accept("CURSOR"):
        p.expect("FOR")
        return "cursor", names[0], _until(p, ";")
    while p.accept(","):
        names.append(p.ident().lower())
    kind = p._type()
    default = None
    if p.accept("DEFAULT"):
        default = _until(p, ";")
    return "declare", names, kind, default


def _signal(p: Parser) -> tuple:
    again = p.take().up == "RESIGNAL"
    state = None
    if p.accept("SQLSTATE"):
        p.accept("VALUE")
        state = dialect.unquote(p.take().text)
    elif p.t.kind == "word" and not p.at("SET"):
        state = "@" + p.ident().upper()
    items = {}
    if p.accept("SET"):
        while True:
            name = p.ident().lower()
            p.expect("=")
            items[name] = _until(p, ",", ";")
            if not p.accept(","):
                break
    return "signal", again, state, items


@dataclass
class Procedure:
    name: str
    parameters: list[tuple[str, str, str]]
    body: list
    text: str
    comment: str = ""


def parse_procedure(p: Parser, name: str) -> Procedure:
    p.expect("(")
    parameters = []
    while not p.at(")"):
        way = p.take().up if p.t.up in ("IN", "OUT", "INOUT") and p.t.kind == "word" else "IN"
        n = p.ident().lower()
        parameters.append((way, n, p._type()))
        p.accept(",")
    p.expect(")")
    comment = ""
    while p.t.up in ("COMMENT", "LANGUAGE", "DETERMINISTIC", "NOT", "CONTAINS", "NO", "READS", "MODIFIES", "SQL") and p.t.kind == "word":
        if p.accept("COMMENT"):
            comment = dialect.unquote(p.take().text)
        else:
            p.take()
    body = [parse_step(p)]
    return Procedure(name, parameters, body, p.sql, comment)


# --- running ----------------------------------------------------------------------------------------------------


class Interpreter:
    """Runs steps; ``result`` is the frame of the last SELECT."""

    def __init__(self, engine):
        self.engine, self.result = engine, None
        self.current: Signal | None = None

    def value(self, text: str, frame: Frame):
        node = dialect.expression(text, self.engine, frame.literals())
        if node.known:
            return node.value
        return self.engine.spark.sql(f"SELECT {node.text}").first()[0]

    def test(self, text: str, frame: Frame) -> bool:
        return bool(self.value(text, frame))

    def run(self, steps: list, frame: Frame) -> None:
        for step in steps:
            try:
                getattr(self, "_" + step[0])(frame, *step[1:])
            except (_Leave, _Return, _Exit):
                raise
            except Exception as e:
                if not self._handled(e, frame):
                    raise

    def _handled(self, e: Exception, frame: Frame) -> bool:
        state = e.state if isinstance(e, Signal) else "HY000"
        wanted = {"SQLEXCEPTION"} if state[:2] not in ("02", "01") else set()
        wanted |= {"STATE " + state, f"CODE {getattr(e, 'code', 1105)}"} | ({"NOT FOUND"} if state[:2] == "02" else set()) | ({"SQLWARNING"} if state[:2] == "01" else set())
        f = frame
        while f is not None:
            for kind, values, body in f.handlers:
                known = {f.find("conditions", v.lower())[v.lower()] if f.find("conditions", v.lower()) else v for v in values}
                if known & wanted:
                    before, self.current = self.current, e if isinstance(e, Signal) else Signal(state, str(e), 1105)
                    self.run(body, Frame(f))
                    self.current = before
                    if kind == "EXIT":
                        raise _Exit(f)
                    return True
            f = f.outer
        return False

    def _block(self, frame, label, body):
        inner = Frame(frame)
        try:
            self.run(body, inner)
        except _Exit as e:
            if e.block is not inner:
                raise
        except _Iterate:
            raise
        except _Leave as e:
            if label is None or e.label != label:
                raise

    def _repeat_while(self, frame, label, again, body, first):
        while first or again():
            first = False
            try:
                self.run(body, frame)
            except _Iterate as e:
                if e.label != label:
                    raise
            except _Leave as e:
                if e.label != label:
                    raise
                return

    def _loop(self, frame, label, body):
        self._repeat_while(frame, label, lambda: True, body, False)

    def _while(self, frame, label, test, body):
        self._repeat_while(frame, label, lambda: self.test(test, frame), body, False)

    def _repeat(self, frame, label, test, body):
        self._repeat_while(frame, label, lambda: not self.test(test, frame), body, True)

    def _if(self, frame, branches, last):
        for test, body in branches:
            if self.test(test, frame):
                return self.run(body, frame)
        return self.run(last, frame)

    def _case(self, frame, branches, last):
        for test, body in branches:
            if self.test(test, frame):
                return self.run(body, frame)
        if last is None:
            raise Signal("20000", "Case not found for CASE statement", 1339)
        return self.run(last, frame)

    def _declare(self, frame, names, kind, default):
        v = None if default is None else self.value(f"CAST(({default}) AS {cast_type(kind)})", frame)
        frame.variables |= dict.fromkeys(names, v)

    def _condition(self, frame, name, value):
        frame.conditions[name] = value

    def _handler(self, frame, kind, values, body):
        frame.handlers.append((kind, values, body))

    def _cursor(self, frame, name, query):
        frame.cursors[name] = Cursor(query)

    def _cursor_of(self, frame, name) -> Cursor:
        held = frame.find("cursors", name)
        if held is None:
            raise Signal("42000", f"Undefined CURSOR: {name}", 1324)
        return held[name]

    def _open(self, frame, name):
        c = self._cursor_of(frame, name)
        if c.rows is not None:
            raise Signal("24000", "Cursor is already open", 1325)
        c.rows = self.engine.spark.sql(dialect.query(c.query, self.engine, frame.literals())).toLocalIterator()

    def _close(self, frame, name):
        self._cursor_of(frame, name).rows = None

    def _fetch(self, frame, name, into):
        c = self._cursor_of(frame, name)
        if c.rows is None:
            raise Signal("24000", "Cursor is not open", 1326)
        row = next(c.rows, None)
        if row is None:
            raise Signal("02000", "No data - zero rows fetched, selected, or processed", 1329)
        for n, v in zip(into, row, strict=True):
            self.assign(frame, n, v)

    def assign(self, frame, name, v):
        held = frame.find("variables", name)
        if held is None:
            raise Signal("HY000", f"no variable {name}", 1193)
        held[name] = v

    def _leave(self, frame, label):
        raise _Leave(label)

    def _iterate(self, frame, label):
        raise _Iterate(label)

    def _return(self, frame):
        raise _Return

    def _signal(self, frame, again, state, items):
        values = {k: self.value(v, frame) for k, v in items.items()}
        if again and state is None and self.current:
            raise Signal(self.current.state, str(values.get("message_text", self.current.message)), int(values.get("mysql_errno", self.current.code)))
        if state and state[0] == "@":
            held = frame.find("conditions", state[1:].lower())
            if held is None:
                raise Signal("42000", f"Undefined CONDITION: {state[1:]}", 1319)
            state = held[state[1:].lower()].removeprefix("STATE ")
        raise Signal(state, str(values.get("message_text", "Unhandled user-defined exception condition")), int(values.get("mysql_errno", 1644)))

    def _sql(self, frame, text):
        word = text.split(None, 1)[0].upper() if text.strip() else ""
        if word == "SET":
            p = Parser(text, self.engine, frame.literals())
            p.take()
            if p.t.kind == "word" and frame.find("variables", dialect.name_of(p.t).lower()) is not None:
                while True:
                    name = p.ident().lower()
                    p.accept(":=") or p.expect("=")
                    node = p.expr()
                    self.assign(frame, name, node.value if node.known else self.engine.spark.sql(f"SELECT {node.text}").first()[0])
                    p.columns = frame.literals()
                    if not p.accept(","):
                        return
        out = self.engine.statement(text, frame.literals(), lambda n, v: self.assign(frame, n, v) if frame.find("variables", n) is not None else self.engine.variables.__setitem__(n, v))
        if word in ("SELECT", "WITH", "SHOW", "(", "TABLE", "VALUES") and out is not None and out.columns != ["ok"]:
            self.result = out


def cast_type(kind: str) -> str:
    """A variable's type as a target of CAST."""
    name = kind.upper().partition("(")[0].split()[0]
    if "INT" in name or name in ("BOOL", "BOOLEAN", "SIGNED"):
        return "SIGNED"
    if name in ("DECIMAL", "NUMERIC", "DOUBLE", "FLOAT", "DATE", "DATETIME", "TIME", "JSON", "YEAR", "BINARY"):
        return kind
    return "DATETIME" if name == "TIMESTAMP" else "CHAR"


def call(engine, procedure: Procedure, args: list[Parser | str], outer: Frame | None = None) -> DataFrame | None:
    """CALL: OUT and INOUT arguments are user variables; the frame of the last SELECT is the result."""
    if len(args) != len(procedure.parameters):
        raise ValueError(f"{procedure.name} takes {len(procedure.parameters)} arguments, not {len(args)}")
    run, frame = Interpreter(engine), Frame()
    for (way, name, kind), text in zip(procedure.parameters, args, strict=True):
        v = None if way == "OUT" else run.value(text, outer or Frame())
        frame.variables[name] = v if v is None else run.value(f"CAST({dialect_literal(v)} AS {cast_type(kind)})", frame)
    try:
        run.run(procedure.body, frame)
    except _Return:
        pass
    for (way, name, _), text in zip(procedure.parameters, args, strict=True):
        if way != "IN":
            n = text.strip().lower()
            if n.startswith("@"):
                engine.variables[n[1:]] = frame.variables[name]
            elif outer is not None:
                run.assign(outer, n, frame.variables[name])
    return run.result


def dialect_literal(v) -> str:
    return "NULL" if v is None else str(int(v)) if isinstance(v, bool) else repr(v) if isinstance(v, int | float) else render.text_literal(str(v))


# --- triggers -----------------------------------------------------------------------------------------------------


def fire(engine, trigger, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Run a trigger for all changed rows and return them, as SET NEW.x may change them.

    SET, IF, SIGNAL and INSERT are done for all rows at once; other statements
    one row after another, from an iterator.
    """
    p = Parser(trigger.body, engine)
    steps = [parse_step(p)]
    new, old = ("new_", "old_") if trigger.event == "UPDATE" else ("", "old_")
    names = {f"new.{c}".lower(): quoted(f"{new}{c}") for c in columns if trigger.event != "DELETE"} | {f"old.{c}".lower(): quoted(f"{old}{c}") for c in columns if trigger.event != "INSERT"}
    return _apply(engine, steps, rows, names)


def _apply(engine, steps: list, rows: DataFrame, names: dict[str, str]) -> DataFrame:
    for step in steps:
        kind, word = step[0], step[1].split(None, 1)[0].upper() if step[0] == "sql" else ""
        if kind == "block":
            rows = _apply(engine, step[2], rows, names)
        elif kind in ("if", "case"):
            tests = [dialect.expression(c, engine, names).boolean() for c, _ in step[1]]
            number = "CASE " + " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(tests)) + f" ELSE {len(tests)} END"
            marked = written(rows.withColumn("_branch", F.expr(number)))
            bodies = [*[b for _, b in step[1]], step[2] or []]
            rows = written(reduce(DataFrame.union, [_apply(engine, b, marked.where(f"_branch = {i}").drop("_branch"), names) for i, b in enumerate(bodies)]))
        elif kind == "signal":
            if not rows.isEmpty():
                Interpreter(engine)._signal(Frame(), *step[1:])
        elif word == "SET":
            p = Parser(step[1], engine, names)
            p.take()
            while True:
                target = p.qualified() if p.t.kind in ("word", "quoted") else [p.take().text]
                p.accept(":=") or p.expect("=")
                node = p.expr()
                if target[0].startswith("@"):
                    last = [[node.value]] if node.known else rows.select(F.expr(node.text).alias("v")).tail(1)
                    if last:
                        engine.variables[target[0][1:].lower()] = last[0][0]
                else:
                    c = names[".".join(target).lower()].strip("`")
                    rows = rows.withColumn(c, F.expr(node.text).cast(rows.schema[c].dataType))
                if not p.accept(","):
                    break
        elif word in ("INSERT", "REPLACE"):
            _insert_all(engine, step[1], rows, names)
        elif kind == "sql":
            for r in rows.toLocalIterator():
                engine.statement(step[1], {n: render.value(r[c.strip("`")]) for n, c in names.items()})
        else:
            raise ParseError(f"{kind} in a trigger")
    return rows


def _insert_all(engine, text: str, rows: DataFrame, names: dict[str, str]) -> None:
    """INSERT ... VALUES of a trigger, for all rows at once."""
    p = Parser(text, engine, names)
    replace = p.take().up == "REPLACE"
    ignore = p.accept("IGNORE")
    p.accept("INTO")
    target = p.qualified()[-1]
    t = engine.catalog.get(target)
    columns = p.names() if p.at("(") else [c for c in t.df.columns if c not in t.generated]
    if not (p.accept("VALUES") or p.accept("VALUE")):
        for r in rows.toLocalIterator():
            engine.statement(text, {n: render.value(r[c.strip("`")]) for n, c in names.items()})
        return
    p.expect("(")
    values = [x.text for x in p.list()]
    p.expect(")")
    made = rows.select(*[F.expr(v).alias(c) for v, c in zip(values, columns, strict=True)])
    if not made.isEmpty():
        engine.catalog.insert_rows(target, written(made), "replace" if replace else "ignore" if ignore else "error")
