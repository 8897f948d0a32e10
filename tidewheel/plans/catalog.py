"""Tables that statements define and change: CREATE, ALTER, INSERT, UPDATE, DELETE and their constraints.

A table is a DataFrame and its metadata on the driver.  Every change is a
rewrite (``operators.dml``) that is checkpointed, verified, and then swapped in;
a statement that fails leaves all tables as they were.
"""

from __future__ import annotations

import copy
import re
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dml
from ..operators.recursive import checkpoint_dir, written
from . import dialect
from .dialect import ParseError, Parser, quoted

# The dialect's types and Spark's.
TYPES = {
    "BOOLEAN": "boolean", "BOOL": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "MEDIUMINT": "int", "INT": "int", "INTEGER": "int", "BIGINT": "bigint", "FLOAT": "float", "DOUBLE": "double", "REAL": "double",
    "DECIMAL": "decimal(10,0)", "NUMERIC": "decimal(10,0)", "CHAR": "string", "VARCHAR": "string", "TEXT": "string", "TINYTEXT": "string", "MEDIUMTEXT": "string", "LONGTEXT": "string", "JSON": "string", "ENUM": "string", "SET": "string", "TIME": "string",
    "BINARY": "binary", "VARBINARY": "binary", "BLOB": "binary", "TINYBLOB": "binary", "MEDIUMBLOB": "binary", "LONGBLOB": "binary", "DATE": "date", "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz", "YEAR": "smallint", "BIT": "bigint", "VECTOR": "array<float>",
    "GEOMETRY": "binary", "POINT": "binary", "LINESTRING": "binary", "POLYGON": "binary", "MULTIPOINT": "binary", "MULTILINESTRING": "binary", "MULTIPOLYGON": "binary", "GEOMETRYCOLLECTION": "binary",
}
#: Unsigned integers take the next wider type.
WIDER = {"tinyint": "smallint", "smallint": "int", "int": "bigint", "bigint": "decimal(20,0)"}
ACTIONS = {"CASCADE": "cascade", "SET NULL": "set_null", "RESTRICT": "restrict", "NO ACTION": "restrict", "SET DEFAULT": "restrict"}


@dataclass
class Foreign:
    columns: list[str]
    parent: str
    other: list[str]
    on_delete: str = "restrict"
    on_update: str = "restrict"


@dataclass
class Trigger:
    name: str
    when: str
    event: str
    table: str
    body: str


@dataclass
class Table:
    df: DataFrame | None
    key: list[str] = field(default_factory=list)
    #: index name -> (columns, unique, kind)
    indexes: dict[str, tuple[list[str], bool, str]] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    foreign: dict[str, Foreign] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    generated: dict[str, str] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)
    declared: dict[str, str] = field(default_factory=dict)
    comments: dict[str, str] = field(default_factory=dict)
    auto: str | None = None
    last_auto: int = 0
    comment: str = ""
    collation: str = "utf8mb4_0900_bin"
    triggers: list[Trigger] = field(default_factory=list)
    #: (time, contents) of every change, for AS OF
    versions: list[tuple[float, DataFrame]] = field(default_factory=list)
    histograms: dict[str, list] = field(default_factory=dict)

    @property
    def unique(self) -> list[list[str]]:
        return [c for c, u, _ in self.indexes.values() if u]

    @property
    def keys(self) -> list[list[str]]:
        return [self.key] * bool(self.key) + self.unique


def spark_type(text: str) -> str:
    m = re.match(r"(\w+)\s*(?:\(([^)]*)\))?\s*(UNSIGNED)?", text.strip(), re.I)
    name, args = m[1].upper(), m[2]
    if name not in TYPES:
        raise ValueError(f"no type {name}")
    if name in ("DECIMAL", "NUMERIC") and args:
        p, _, s = args.partition(",")
        return f"decimal({int(p)},{int(s or 0)})"
    if name == "TINYINT" and args == "1":
        return "boolean"
    return WIDER.get(TYPES[name], TYPES[name]) if m[3] else TYPES[name]


def split_list(text: str) -> list[str]:
    """Parts between commas outside quotes and brackets."""
    return dialect.split_top(text)


class Catalog:
    """Tables by name; ``session`` is the engine, which knows variables, functions and how to run a trigger's body."""

    def __init__(self, session):
        self.session, self.spark, self.tables = session, session.spark, {}
        checkpoint_dir(self.spark)

    # --- contents ---------------------------------------------------------------------------------

    def snapshot(self) -> dict[str, Table]:
        """The tables as they are; contents are immutable, so only metadata is copied."""
        keep = {n: t.df for n, t in self.tables.items()}
        out = {}
        for n, t in self.tables.items():
            frames, versions = t.df, t.versions
            t.df, t.versions = None, []
            out[n] = copy.deepcopy(t)
            t.df, t.versions = frames, versions
            out[n].df, out[n].versions = keep[n], list(versions)
        return out

    def restore(self, tables: dict[str, Table]) -> None:
        for n in self.tables.keys() - tables.keys():
            self.spark.catalog.dropTempView(n)
        self.tables = tables
        for n, t in tables.items():
            t.df.createOrReplaceTempView(n)

    def get(self, name: str) -> Table:
        """A table by name; a view that was registered becomes a table when it is first changed."""
        for n, t in self.tables.items():
            if n.lower() == name.lower():
                return t
        if self.spark.catalog.tableExists(name):
            self.tables[name] = Table(self.spark.table(name))
            return self.tables[name]
        raise KeyError(f"no table {name}")

    def _name(self, name: str) -> str:
        return next((n for n in self.tables if n.lower() == name.lower()), name)

    def _swap(self, name: str, df: DataFrame, verify: bool = True, fresh: DataFrame | None = None) -> None:
        """Put new contents in; of an INSERT that keeps keys apart itself only ``fresh`` rows are verified."""
        t = self.get(name)
        df = written(df)
        if verify:
            self._verify(t, df if fresh is None else fresh, fresh is None)
        t.df = df
        t.versions.append((time.time(), df))
        df.createOrReplaceTempView(self._name(name))

    def _verify(self, t: Table, df: DataFrame, keys: bool = True) -> None:
        """Keys by one aggregation each; columns that can't be NULL and checks in one pass over the rows."""
        for key in t.keys if keys else []:
            dml.check_unique(df, key)
        tests = {f"column {c} can't be null": F.col(f"`{c}`").isNull() for c in dict.fromkeys([*t.required, *t.key])}
        if self.session.system("check_constraint_checks") != 0:
            tests |= {f"check {n} is violated": ~F.expr(self.text(e)) for n, e in t.checks.items()}
        if tests:
            found = df.agg(*[F.max(F.coalesce(test.cast("boolean"), F.lit(False)).cast("int")).alias(f"t{i}") for i, test in enumerate(tests.values())]).first()
            for i, message in enumerate(tests):
                if found[i]:
                    raise dml.ConstraintError(message)
        if self.session.system("foreign_key_checks") != 0:
            for f in t.foreign.values():
                dml.check_foreign_key(df, f.columns, self.get(f.parent).df, f.other)

    def text(self, sql: str, columns: dict[str, str] | None = None) -> str:
        return dialect.expression(sql, self.session, columns).text

    def _children(self, name: str):
        for child, t in list(self.tables.items()):
            for f in t.foreign.values():
                if f.parent.lower() == name.lower():
                    yield child, t, f

    def _after_delete(self, name: str) -> None:
        if self.session.system("foreign_key_checks") == 0:
            return
        for child, t, f in self._children(name):
            new = dml.cascade(t.df, f.columns, self.get(name).df, f.other, f.on_delete)
            if f.on_delete != "restrict":
                self._swap(child, new)
                self._after_delete(child)

    def _after_update(self, name: str, moved: DataFrame) -> None:
        """``moved``: old_ and new_ values of the rows that an UPDATE changed."""
        if self.session.system("foreign_key_checks") == 0:
            return
        for child, t, f in self._children(name):
            before = t.df
            new = dml.cascade_update(before, f.columns, moved, f.other, f.on_update)
            if f.on_update == "restrict":
                continue
            both = None
            again = [c for c in f.columns if any(c in g.other for _, _, g in self._children(child))]
            if again:  # a chain of keys: children's old and new values follow the same way
                ided = written(before).withColumn("_id", F.monotonically_increasing_id())
                after = dml.cascade_update(ided, f.columns, moved, f.other, f.on_update)
                both = written(ided.select("_id", *[F.col(c).alias(f"old_{c}") for c in before.columns]).join(after.select(F.col("_id").alias("_n"), *[F.col(c).alias(f"new_{c}") for c in before.columns]), F.col("_id") == F.col("_n")))
            self._swap(child, new)
            if both is not None:
                self._after_update(child, both)

    # --- statements -----------------------------------------------------------------------------------

    def run(self, p: Parser) -> int | None:
        """Rows affected if the statement is this catalog's, else None; all or nothing."""
        word, nxt = p.t.up, p.ahead().up
        two = {("CREATE", "TABLE"): self._create, ("CREATE", "TEMPORARY"): self._create, ("DROP", "TABLE"): self._drop, ("DROP", "TEMPORARY"): self._drop, ("ALTER", "TABLE"): self._alter, ("RENAME", "TABLE"): self._rename, ("ANALYZE", "TABLE"): self._analyze, ("DROP", "INDEX"): self._drop_index, ("LOAD", "DATA"): self._load}
        one = {"INSERT": self._insert, "REPLACE": self._insert, "UPDATE": self._update, "DELETE": self._delete, "TRUNCATE": self._truncate}
        f = two.get((word, nxt)) or one.get(word) or (self._index if word == "CREATE" and "INDEX" in (nxt, p.ahead(2).up) and nxt in ("INDEX", "UNIQUE", "FULLTEXT", "SPATIAL", "VECTOR") else None)
        if f is None:
            return None
        before = self.snapshot()
        try:
            return f(p)
        except Exception:
            self.restore(before)
            raise

    # --- definitions ------------------------------------------------------------------------------------

    def _create(self, p: Parser) -> int:
        p.take()
        p.accept("TEMPORARY")
        p.expect("TABLE")
        maybe = p.accept("IF", "NOT", "EXISTS")
        name = p.qualified()[-1]
        if self._name(name) in self.tables:
            if maybe:
                return 0
            raise ValueError(f"table {name} exists")
        if p.accept("LIKE"):
            source = self.get(p.qualified()[-1])
            frame, versions = source.df, source.versions
            source.df, source.versions = None, []
            t = copy.deepcopy(source)
            source.df, source.versions = frame, versions
            t.df, t.last_auto, t.triggers = frame.limit(0), 0, []
            self.tables[name] = t
            self._swap(name, t.df)
            return 0
        t, cols = Table(None), []
        if p.at("(") and p.ahead().up not in ("SELECT", "WITH"):
            p.take()
            while True:
                self._part(p, name, t, cols)
                if not p.accept(","):
                    break
            p.expect(")")
        while p.t.kind == "word" and p.t.up not in ("AS", "SELECT", "WITH") or p.at("="):
            w = p.take().up
            if w in ("COMMENT", "COLLATE", "AUTO_INCREMENT"):
                p.accept("=")
                v = p.take()
                if w == "COMMENT":
                    t.comment = dialect.unquote(v.text)
                elif w == "COLLATE":
                    t.collation = v.text
                else:
                    t.last_auto = int(v.text) - 1
            elif w == "PARTITION":
                p.i = len(p.toks) - 1
            elif p.accept("="):
                p.take()
        if p.t.kind != "end" and not p.at(";"):
            p.accept("AS")
            rows = self.spark.sql(p.query())
            t.df = rows if not cols else self.spark.createDataFrame([], ", ".join(f"{quoted(n)} {k}" for n, k in cols)).unionByName(rows, True)
            self.tables[name] = t
            self._swap(name, t.df)
            return t.df.count()
        if not cols:
            raise ParseError("a table needs columns")
        t.df = self.spark.createDataFrame([], ", ".join(f"{quoted(n)} {k}" for n, k in cols))
        self.tables[name] = t
        self._swap(name, t.df)
        return 0

    def _bracket(self, p: Parser) -> str:
        """The text between a bracket here and its partner."""
        p.expect("(")
        start, depth = p.t.start, 1
        while depth:
            t = p.take()
            depth += (t.kind == "op" and t.text == "(") - (t.kind == "op" and t.text == ")")
        return p.sql[start : p.toks[p.i - 1].start].strip()

    def _index_columns(self, p: Parser) -> list[str]:
        out = []
        for part in split_list(self._bracket(p)):
            m = re.match(r"`?(\w+)`?\s*(?:\(\d+\))?\s*(?:ASC|DESC)?$", part, re.I)
            out.append(m[1] if m else part)
        return out

    def _part(self, p: Parser, name: str, t: Table, cols: list | None) -> None:
        """A column or constraint of CREATE TABLE or ALTER TABLE ADD."""
        label = None
        if p.accept("CONSTRAINT"):
            label = None if p.t.up in ("PRIMARY", "CHECK", "FOREIGN", "UNIQUE") else p.ident()
        if p.accept("PRIMARY", "KEY"):
            t.key = self._index_columns(p)
        elif p.accept("CHECK"):
            t.checks[label or f"{name}_chk_{len(t.checks) + 1}"] = self._bracket(p)
            if p.accept("NOT", "ENFORCED"):
                t.checks.popitem()
            p.accept("ENFORCED")
        elif p.accept("FOREIGN", "KEY"):
            label = label or (p.ident() if not p.at("(") else None)
            columns = self._index_columns(p)
            t.foreign[label or f"{name}_ibfk_{len(t.foreign) + 1}"] = self._references(p, columns)
        elif p.t.up in ("UNIQUE", "INDEX", "KEY", "FULLTEXT", "SPATIAL", "VECTOR") and p.t.kind == "word" and not (p.ahead().kind == "word" and p.ahead().up in TYPES):
            kind = p.take().up
            p.accept("KEY") or p.accept("INDEX")
            label = label or (p.ident() if not p.at("(") else None)
            columns = self._index_columns(p)
            self._add_index(t, label, columns, kind == "UNIQUE", {"FULLTEXT": "FULLTEXT", "SPATIAL": "SPATIAL", "VECTOR": "VECTOR"}.get(kind, "BTREE"))
        else:
            cols.append(self._column(p, name, t))

    def _add_index(self, t: Table, label: str | None, columns: list[str], unique: bool, kind: str = "BTREE") -> None:
        base = label or columns[0]
        found, k = base, 2
        while found in t.indexes:
            found, k = f"{base}_{k}", k + 1
        t.indexes[found] = (columns, unique, kind)

    def _references(self, p: Parser, columns: list[str]) -> Foreign:
        p.expect("REFERENCES")
        f = Foreign(columns, p.qualified()[-1], self._index_columns(p))
        while p.accept("ON"):
            event = p.take().up
            word = p.take().up
            if word in ("SET", "NO"):
                word += " " + p.take().up
            setattr(f, "on_delete" if event == "DELETE" else "on_update", ACTIONS[word])
        return f

    def _column(self, p: Parser, table: str, t: Table) -> tuple[str, str]:
        name = p.ident()
        start = p.t.start
        p.take()
        if p.at("("):
            self._bracket(p)
        p.accept("PRECISION")
        p.accept("UNSIGNED")
        declared = p.sql[start : p.toks[p.i - 1].end]
        kind = spark_type(declared)
        t.declared[name] = declared.lower()
        while p.t.kind == "word" and not p.at("AFTER") and not p.at("FIRST"):
            if p.accept("PRIMARY", "KEY") or p.accept("KEY"):
                t.key = [name]
            elif p.accept("UNIQUE"):
                p.accept("KEY")
                self._add_index(t, name, [name], True)
            elif p.accept("NOT", "NULL"):
                t.required.append(name)
            elif p.accept("NULL") or p.accept("STORED") or p.accept("VIRTUAL") or p.accept("VISIBLE") or p.accept("INVISIBLE"):
                pass
            elif p.accept("AUTO_INCREMENT"):
                t.auto = name
            elif p.accept("DEFAULT"):
                start = p.t.start
                if p.at("("):
                    self._bracket(p)
                else:
                    p._unary()
                t.defaults[name] = p.sql[start : p.toks[p.i - 1].end]
            elif p.accept("ON", "UPDATE"):
                p._unary()
            elif p.accept("GENERATED", "ALWAYS", "AS") or p.accept("AS"):
                t.generated[name] = self._bracket(p)
            elif p.accept("CHECK"):
                t.checks[f"{table}_chk_{len(t.checks) + 1}"] = self._bracket(p)
            elif p.accept("CONSTRAINT"):
                label = p.ident()
                p.expect("CHECK")
                t.checks[label] = self._bracket(p)
            elif p.accept("COMMENT"):
                t.comments[name] = dialect.unquote(p.take().text)
            elif p.accept("COLLATE") or p.accept("CHARACTER", "SET") or p.accept("SRID") or p.accept("CHARSET"):
                p.take()
            elif p.at("REFERENCES"):
                t.foreign[f"{table}_ibfk_{len(t.foreign) + 1}"] = self._references(p, [name])
            else:
                raise ParseError(f"unexpected {p.sql[p.t.start : p.t.start + 30]!r}")
        return name, kind

    def _drop(self, p: Parser) -> int:
        p.take()
        p.accept("TEMPORARY")
        p.expect("TABLE")
        maybe = p.accept("IF", "EXISTS")
        names = [self._name(p.qualified()[-1])]
        while p.accept(","):
            names.append(self._name(p.qualified()[-1]))
        for n in names:
            if n not in self.tables:
                if maybe:
                    continue
                raise KeyError(f"no table {n}")
            if self.session.system("foreign_key_checks") != 0 and any(c not in names for c, _, _ in self._children(n)):
                raise dml.ConstraintError(f"{n} is referenced")
        for n in names:
            self.tables.pop(n, None)
            self.spark.catalog.dropTempView(n)
        return 0

    def _truncate(self, p: Parser) -> int:
        p.take()
        p.accept("TABLE")
        name = p.qualified()[-1]
        t = self.get(name)
        if any(c != self._name(name) for c, _, _ in self._children(name)) and self.session.system("foreign_key_checks") != 0:
            raise dml.ConstraintError(f"{name} is referenced")
        n = t.df.count()
        self._swap(name, t.df.limit(0), False)
        t.last_auto = 0
        return n

    def _rename(self, p: Parser) -> int:
        p.take(), p.take()
        while True:
            old = p.qualified()[-1]
            p.expect("TO")
            self._move(old, p.qualified()[-1])
            if not p.accept(","):
                return 0

    def _move(self, old: str, new: str) -> None:
        old = self._name(old)
        self.get(old)
        self.tables[new] = self.tables.pop(old)
        self.spark.catalog.dropTempView(old)
        self.tables[new].df.createOrReplaceTempView(new)
        for t in self.tables.values():
            for f in t.foreign.values():
                if f.parent.lower() == old.lower():
                    f.parent = new

    def _index(self, p: Parser) -> int:
        p.take()
        kind = p.take().up if not p.at("INDEX") else ""
        p.expect("INDEX")
        label = p.ident()
        if p.accept("USING"):
            p.take()
        p.expect("ON")
        t = self.get(p.qualified()[-1])
        self._add_index(t, label, self._index_columns(p), kind == "UNIQUE", kind if kind in ("FULLTEXT", "SPATIAL", "VECTOR") else "BTREE")
        self._verify(t, t.df)
        return 0

    def _drop_index(self, p: Parser) -> int:
        p.take(), p.take()
        label = p.ident()
        p.expect("ON")
        del self.get(p.qualified()[-1]).indexes[label]
        return 0

    def _rename_column(self, name: str, old: str, new: str) -> None:
        """A column's new name goes into every key, check, default and foreign key that has it."""
        t = self.get(name)
        swap = lambda xs: [new if x == old else x for x in xs]
        word = lambda e: re.sub(rf"`{re.escape(old)}`|\b{re.escape(old)}\b", quoted(new), e)
        move = lambda d: {new if k == old else k: v for k, v in d.items()}
        t.key, t.required = swap(t.key), swap(t.required)
        t.indexes = {n: (swap(c), u, k) for n, (c, u, k) in t.indexes.items()}
        t.checks = {n: word(e) for n, e in t.checks.items()}
        t.generated = {k: word(e) for k, e in move(t.generated).items()}
        t.defaults, t.declared, t.comments = move(t.defaults), move(t.declared), move(t.comments)
        t.auto = new if t.auto == old else t.auto
        for f in t.foreign.values():
            f.columns = swap(f.columns)
        for _, _, f in self._children(name):
            f.other = swap(f.other)
        self._swap(name, t.df.withColumnRenamed(old, new))

    def _place(self, p: Parser, name: str, column: str) -> None:
        """FIRST or AFTER."""
        t = self.get(name)
        rest = [c for c in t.df.columns if c != column]
        if p.accept("FIRST"):
            self._swap(name, t.df.select(column, *rest), False)
        elif p.accept("AFTER"):
            at = rest.index(p.ident()) + 1
            self._swap(name, t.df.select(*rest[:at], column, *rest[at:]), False)

    def _retype(self, name: str, column: str, kind: str) -> None:
        """A value that the new type can't hold refuses the change."""
        t = self.get(name)
        new = F.col(quoted(column)).try_cast(kind)
        if not t.df.where(F.col(quoted(column)).isNotNull() & new.isNull()).isEmpty():
            raise dml.ConstraintError(f"a value of {column} is out of the range of {kind}")
        self._swap(name, t.df.withColumn(column, new))

    def _alter(self, p: Parser) -> int:
        p.take(), p.take()
        name = self._name(p.qualified()[-1])
        while True:
            name = self._alter_one(p, name)
            if not p.accept(","):
                return 0

    def _alter_one(self, p: Parser, name: str) -> str:
        t = self.get(name)
        if p.accept("ADD"):
            if p.t.up in ("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "INDEX", "KEY", "FULLTEXT", "SPATIAL", "VECTOR"):
                self._part(p, name, t, None)
                self._verify(t, t.df)
                return name
            p.accept("COLUMN")
            c, kind = self._column(p, name, t)
            e = F.expr(self.text(t.generated.get(c) or t.defaults.get(c) or "NULL"))
            if t.auto == c:
                new = dml.number_rows(t.df.withColumn(c, F.lit(None).cast("long")), c, t.last_auto).drop(dml.ORDER)
                self._swap(name, new.withColumn(c, F.col(c).cast(kind)))
            else:
                if c in t.required and c not in t.defaults and c not in t.generated:
                    e = F.lit(0) if kind not in ("string", "binary") else F.lit("")
                self._swap(name, t.df.withColumn(c, e.cast(kind)))
            self._place(p, name, c)
        elif p.accept("DROP", "PRIMARY", "KEY"):
            t.key = []
        elif p.accept("DROP", "CONSTRAINT") or p.accept("DROP", "CHECK") or p.accept("DROP", "FOREIGN", "KEY"):
            label = p.ident()
            held = next((d for d in (t.checks, t.foreign, t.indexes) if label in d), None)
            if held is None:
                raise KeyError(f"no constraint {label}")
            del held[label]
        elif p.accept("DROP", "INDEX") or p.accept("DROP", "KEY"):
            del t.indexes[p.ident()]
        elif p.accept("DROP"):
            p.accept("COLUMN")
            c = p.ident()
            if any(c in f.other for _, _, f in self._children(name)) or any(c in f.columns for f in t.foreign.values()):
                raise dml.ConstraintError(f"{c} is in a foreign key")
            if any(re.search(rf"\b{re.escape(c)}\b", e) for e in [*t.checks.values(), *t.generated.values()]):
                raise dml.ConstraintError(f"a check or generated column needs {c}")
            t.key = [k for k in t.key if k != c]
            t.required = [k for k in t.required if k != c]
            t.indexes = {n: ([k for k in cs if k != c], u, k) for n, (cs, u, k) in t.indexes.items() if cs != [c]}
            for d in (t.defaults, t.declared, t.comments, t.generated):
                d.pop(c, None)
            t.auto = None if t.auto == c else t.auto
            self._swap(name, t.df.drop(c))
        elif p.accept("RENAME", "COLUMN"):
            old = p.ident()
            p.expect("TO")
            self._rename_column(name, old, p.ident())
        elif p.accept("RENAME", "INDEX") or p.accept("RENAME", "KEY"):
            old = p.ident()
            p.expect("TO")
            new = p.ident()
            t.indexes = {new if n == old else n: v for n, v in t.indexes.items()}
        elif p.accept("RENAME"):
            p.accept("TO") or p.accept("AS")
            new = p.qualified()[-1]
            self._move(name, new)
            return new
        elif p.at("MODIFY") or p.at("CHANGE"):
            change = p.take().up == "CHANGE"
            p.accept("COLUMN")
            old = p.ident() if change else name_at(p)
            t.required = [c for c in t.required if c != old]
            t.defaults.pop(old, None)
            c, kind = self._column(p, name, t)
            if change and c != old:
                self._rename_column(name, old, c)
            self._retype(name, c, kind)
            self._place(p, name, c)
        elif p.accept("ALTER"):
            if p.accept("INDEX"):
                p.ident(), p.take()
                return name
            p.accept("COLUMN")
            c = p.ident()
            if p.accept("DROP", "DEFAULT"):
                t.defaults.pop(c, None)
            else:
                p.expect("SET", "DEFAULT")
                start = p.t.start
                p._unary()
                t.defaults[c] = p.sql[start : p.toks[p.i - 1].end]
        elif p.accept("AUTO_INCREMENT"):
            p.accept("=")
            t.last_auto = int(p.take().text) - 1
        elif p.accept("COMMENT"):
            p.accept("=")
            t.comment = dialect.unquote(p.take().text)
        elif p.accept("COLLATE") or p.accept("CONVERT", "TO", "CHARACTER", "SET") or p.accept("DEFAULT", "CHARACTER", "SET") or p.accept("CHARACTER", "SET"):
            p.accept("=")
            word = p.take().text
            t.collation = p.take().text if p.accept("COLLATE") and (p.accept("=") or True) else word if "_" in word else t.collation
        elif p.accept("ENGINE"):
            p.accept("=")
            p.take()
        elif p.accept("DISABLE", "KEYS") or p.accept("ENABLE", "KEYS"):
            pass
        else:
            raise NotImplementedError(f"ALTER TABLE {p.sql[p.t.start :]}")
        return name

    def _analyze(self, p: Parser) -> int:
        """ANALYZE TABLE t [UPDATE HISTOGRAM ON c, ... | DROP HISTOGRAM ON c, ...]; without a list all columns of numbers."""
        from ..sources.tables import histogram

        p.take(), p.take()
        names = [p.qualified()[-1]]
        while p.accept(","):
            names.append(p.qualified()[-1])
        drop = p.at("DROP")
        chosen = None
        if drop or p.at("UPDATE"):
            p.take()
            p.expect("HISTOGRAM", "ON")
            chosen = [p.ident()]
            while p.accept(","):
                chosen.append(p.ident())
        for n in names:
            t = self.get(n)
            for c in chosen or [f.name for f in t.df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]:
                if drop:
                    t.histograms.pop(c, None)
                else:
                    t.histograms[c] = [tuple(r) for r in histogram(t.df.select(F.col(quoted(c)).cast("double").alias(c)), c).orderBy("bucket").collect()]
        return 0

    # --- rows -----------------------------------------------------------------------------------------------

    def _insert(self, p: Parser) -> int:
        replace = p.take().up == "REPLACE"
        ignore = False
        while p.t.up in ("IGNORE", "LOW_PRIORITY", "DELAYED", "HIGH_PRIORITY", "INTO"):
            ignore |= p.take().up == "IGNORE"
        name = p.qualified()[-1]
        t = self.get(name)
        columns = [c for c in t.df.columns if c not in t.generated]
        if p.at("(") and p.ahead().up not in ("SELECT", "WITH", "(", "VALUES"):
            given = p.names()
            names = [next((c for c in t.df.columns if c.lower() == g.lower()), g) for g in given]
            for g in names:
                if g not in t.df.columns:
                    raise KeyError(f"no column {g}")
        else:
            names = columns
        default = lambda n: "CAST(NULL AS BIGINT)" if n == t.auto else self.text(t.defaults[n]) if n in t.defaults else "NULL"
        columns_ = p.columns
        p.columns = columns_ | {f"default({n.lower()})": default(n) for n in t.df.columns}
        if p.accept("SET"):
            names, row = [], []
            while True:
                names.append(p.qualified()[-1])
                p.expect("=")
                row.append(default(names[-1]) if p.accept("DEFAULT") else p.expr().text)
                if not p.accept(","):
                    break
            query = "SELECT " + ", ".join(row)
        elif p.at("VALUES") or p.at("VALUE"):
            p.take()
            query = self._values(p, names, default)
        else:
            query = p.query()
        alias = ""
        if p.accept("AS"):
            alias = p.ident()
            if p.at("("):
                p.names()
        changes = {}
        if p.accept("ON", "DUPLICATE", "KEY", "UPDATE"):
            p.columns = columns_ | {c.lower(): f"old.{quoted(c)}" for c in t.df.columns} | {f"{name}.{c}".lower(): f"old.{quoted(c)}" for c in t.df.columns}
            p.columns |= {f"{a}.{c}".lower(): f"new.{quoted(c)}" for c in t.df.columns for a in (alias, "new", "values") if a}
            while True:
                c = p.qualified()[-1]
                p.expect("=")
                changes[next(x for x in t.df.columns if x.lower() == c.lower())] = F.expr(p.expr().text)
                if not p.accept(","):
                    break
        p.columns = columns_
        p.done()
        rows = self.spark.sql(query).toDF(*names)
        return self.insert_rows(name, rows, "replace" if replace else "ignore" if ignore else "update" if changes else "error", changes)

    def _values(self, p: Parser, names: list[str], default) -> str:
        rows = []
        while True:
            p.accept("ROW")
            p.expect("(")
            row = []
            while not p.at(")"):
                row.append(default(names[len(row)]) if p.at("DEFAULT") and p.ahead().text != "(" and p.accept("DEFAULT") else p.expr().text)
                if not p.accept(","):
                    break
            p.expect(")")
            if not row:
                row = [default(n) for n in names]
            if len(row) != len(names):
                raise ValueError(f"{len(names)} columns, but {len(row)} values")
            rows.append(row)
            if not p.accept(","):
                break
        return " UNION ALL ".join("SELECT " + ", ".join(f"{v} AS {quoted(n)}" for n, v in zip(names, r, strict=True)) for r in rows)

    def insert_rows(self, name: str, rows: DataFrame, mode: str = "error", changes: dict | None = None) -> int:
        t = self.get(name)
        for n in [n for n, e in t.defaults.items() if re.match(r"\(?\s*uuid\s*\(", e, re.I) and n in rows.columns]:
            rows = rows.withColumn(n, F.coalesce(F.col(n), F.expr("uuid()")))
        strict = {c: F.col(quoted(c)) for c in rows.columns}
        rows = rows.select(*[self._coerced(t, c).alias(c) if c in t.df.columns else e for c, e in strict.items()]) if mode == "ignore" else rows
        filled = dml.fill(rows, t.df.columns, {n: F.expr(self.text(e)) for n, e in t.defaults.items()}, {n: F.expr(self.text(e)) for n, e in t.generated.items()}, (t.auto, t.last_auto) if t.auto else None, True)
        extra = [c for c in (dml.ORDER,) if c in filled.columns]
        rows = written(filled.select(*[F.col(quoted(c)).cast(t.df.schema[c].dataType).alias(c) for c in t.df.columns], *extra))
        rows = self._fire("BEFORE", "INSERT", name, rows)
        n = rows.count()
        if mode == "ignore" and t.foreign:
            for f in t.foreign.values():
                whole = reduce(lambda a, b: a & b, [F.col(quoted(c)).isNotNull() for c in f.columns])
                parent = self.get(f.parent).df.select(*[F.col(quoted(o)).alias(f"_p{i}") for i, o in enumerate(f.other)]).distinct()
                found = rows.join(parent, [F.col(quoted(c)) == F.col(f"_p{i}") for i, c in enumerate(f.columns)], "left_semi")
                rows = written(found.unionByName(rows.where(~whole)))
        before = t.df.count() if mode in ("ignore", "replace") else 0
        old = t.df
        self._swap(name, dml.insert(t.df, rows, t.keys or None, mode, changes or {}), fresh=None if mode == "update" else rows)
        if t.auto:
            t.last_auto = max(t.last_auto, t.df.agg(F.max(F.col(quoted(t.auto)).cast("long"))).first()[0] or 0)
            given = rows.agg(F.min(F.col(quoted(t.auto)).cast("long"))).first()[0]
            self.session.last_insert_id = given or self.session.last_insert_id
        if mode == "replace" and t.keys:
            n = n + (before + n - t.df.count())
            self._after_delete(name)
        elif mode == "ignore":
            n, given = t.df.count() - before, n
            if n < given:
                self.session.warn(f"{given - n} of {given} rows ignored: duplicate entry or no parent", 1062)
        self._fire("AFTER", "INSERT", name, rows, old)
        return n

    def _coerced(self, t: Table, c: str):
        """INSERT IGNORE: a value that its column can't hold becomes the nearest it can."""
        kind, x = t.df.schema[c].dataType, F.col(quoted(c))
        if kind.typeName() in ("byte", "short", "integer", "long"):
            low, high = {"byte": (-128, 127), "short": (-(2**15), 2**15 - 1), "integer": (-(2**31), 2**31 - 1)}.get(kind.typeName(), (-(2**63), 2**63 - 1))
            return F.greatest(F.least(x.try_cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), F.lit(str(low)).cast("decimal(38,0)")).cast(kind)
        if c in t.required and c != t.auto:
            return F.coalesce(x.cast(kind), F.lit("" if kind.typeName() == "string" else 0).try_cast(kind))
        return x.cast(kind)

    def _fire(self, when: str, event: str, name: str, rows: DataFrame, old: DataFrame | None = None) -> DataFrame:
        for trigger in [x for x in self.get(name).triggers if (x.when, x.event) == (when, event)]:
            rows = self.session.fire(trigger, rows, self.get(name).df.columns)
        return rows

    def _targets(self, p: Parser) -> tuple[str, dict[str, str], str]:
        """FROM's text with row ids on the tables it names, alias -> table, and the ids' column."""
        outer, held = self.session.relation, {}

        def relation(parts, as_of):
            name = self._name(parts[-1])
            if len(parts) == 1 and as_of is None and (name in self.tables or name.lower() in (v.lower() for v in self.session.registered)):
                t = self.get(name)
                view = f"_rows_of_{name}"
                if name not in held:
                    t.df = held[name] = written(t.df)
                    t.df.withColumn("_row_id", F.monotonically_increasing_id()).createOrReplaceTempView(view)
                return f"(SELECT * FROM {quoted(view)})"
            return outer(parts, as_of)

        self.session.relation = relation
        first = len(p.seen)
        try:
            text = p.sources()
        finally:
            del self.session.relation
        return text, {a.lower(): self._name(n) for a, n in p.seen[first:]}, "_row_id"

    def _owner(self, column: list[str], aliases: dict[str, str]) -> tuple[str, str]:
        """(alias, column) of an assignment's target."""
        if len(column) > 1:
            a = column[-2].lower()
            return a, next(c for c in self.get(aliases[a]).df.columns if c.lower() == column[-1].lower())
        for a, n in aliases.items():
            for c in self.get(n).df.columns:
                if c.lower() == column[-1].lower():
                    return a, c
        raise KeyError(f"no column {column[-1]}")

    def _update(self, p: Parser) -> int:
        p.take()
        ignore = False
        while p.t.up in ("IGNORE", "LOW_PRIORITY"):
            ignore |= p.take().up == "IGNORE"
        text, aliases, rid = self._targets(p)
        p.expect("SET")
        sets: dict[str, dict[str, str]] = {}
        outer = p.columns
        p.columns = dict(outer)
        while True:
            a, c = self._owner(p.qualified(), aliases)
            p.expect("=")
            t = self.get(aliases[a])
            if p.at("DEFAULT") and p.ahead().text != "(":
                p.take()
                e = self.text(t.defaults[c]) if c in t.defaults else "NULL"
            else:
                e = p.expr().text
            if c in t.generated:
                raise ValueError(f"{c} is generated")
            sets.setdefault(a, {})[c] = e
            # assignments are made from left to right
            for n in (c.lower(), f"{a}.{c}".lower()):
                if n == c.lower() and len(aliases) > 1:
                    continue
                p.columns[n] = f"CAST({e} AS {t.df.schema[c].dataType.simpleString()})"
            if not p.accept(","):
                break
        p.columns = outer
        tail = f" WHERE {p.expr().boolean()}" if p.accept("WHERE") else ""
        tail += p._tail()
        p.done()
        total = 0
        plan = []
        for a, changes in sets.items():
            news = [f"CAST({e} AS {self.get(aliases[a]).df.schema[c].dataType.simpleString()}) AS `_new_{c}`" for c, e in changes.items()]
            hits = self.spark.sql(f"SELECT {quoted(a)}.{rid} AS `_hit`, {', '.join(news)} FROM {text}{tail}").where("`_hit` is not null")
            plan.append((aliases[a], list(changes), written(hits.dropDuplicates(["_hit"]))))
        for name, columns, hits in plan:
            t = self.get(name)
            base = t.df.withColumn("_row_id", F.monotonically_increasing_id())
            j = base.join(hits, F.col("_row_id") == F.col("_hit"))
            new = {c: F.col(f"_new_{c}") if c in columns else F.col(quoted(c)) for c in t.df.columns}
            changed = j.select("_row_id", *[F.col(quoted(c)).alias(f"old_{c}") for c in t.df.columns], *[new[c].alias(f"new_{c}") for c in t.df.columns])
            changed = written(changed)
            for trigger in [x for x in t.triggers if (x.when, x.event) == ("BEFORE", "UPDATE")]:
                changed = self.session.fire(trigger, changed, t.df.columns)
            if t.generated:
                swap = {c.lower(): f"`new_{c}`" for c in t.df.columns}
                changed = changed.withColumns({f"new_{g}": F.expr(self.text(e, swap)).cast(t.df.schema[g].dataType) for g, e in t.generated.items()})
            differs = reduce(lambda x, y: x | y, [~F.col(quoted(f"old_{c}")).eqNullSafe(F.col(quoted(f"new_{c}"))) for c in t.df.columns])
            changed = written(changed)
            n = changed.where(differs).count()
            total += n
            rest = base.join(changed.select(F.col("_row_id").alias("_hit")), F.col("_row_id") == F.col("_hit"), "left_anti").select(*t.df.columns)
            out = rest.unionByName(changed.select(*[F.col(quoted(f"new_{c}")).alias(c) for c in t.df.columns]))
            try:
                self._swap(name, out)
            except dml.ConstraintError:
                if not ignore:
                    raise
                total -= n
                continue
            self._after_update(name, changed.drop("_row_id"))
            for trigger in [x for x in t.triggers if (x.when, x.event) == ("AFTER", "UPDATE")]:
                self.session.fire(trigger, changed, t.df.columns)
        return total

    def _delete(self, p: Parser) -> int:
        p.take()
        while p.t.up in ("IGNORE", "LOW_PRIORITY", "QUICK"):
            p.take()
        named = None
        if not p.at("FROM"):
            named = [p.qualified()[-1].lower()]
            while p.accept(",") or p.accept(".", "*"):
                if p.t.kind in ("word", "quoted") and not p.at("FROM"):
                    named.append(p.qualified()[-1].lower())
        p.expect("FROM")
        back = p.i
        if named is None:
            listed = [p.qualified()[-1].lower()]
            while p.accept(","):
                listed.append(p.qualified()[-1].lower())
            if p.accept("USING"):
                named = listed
            else:
                p.i = back
        text, aliases, rid = self._targets(p)
        named = named or [next(iter(aliases))]
        tail = f" WHERE {p.expr().boolean()}" if p.accept("WHERE") else ""
        tail += p._tail()
        p.done()
        plan = [(aliases[a], written(self.spark.sql(f"SELECT {quoted(a)}.{rid} AS `_hit` FROM {text}{tail}").where("`_hit` is not null").distinct())) for a in named]
        total = 0
        for name, hits in plan:
            t = self.get(name)
            base = t.df.withColumn("_row_id", F.monotonically_increasing_id())
            gone = base.join(hits, F.col("_row_id") == F.col("_hit"), "left_semi")
            if t.triggers:
                gone = written(gone.select(*[F.col(quoted(c)).alias(f"old_{c}") for c in t.df.columns]))
                for trigger in [x for x in t.triggers if (x.when, x.event) == ("BEFORE", "DELETE")]:
                    self.session.fire(trigger, gone, t.df.columns)
            total += gone.count()
            self._swap(name, base.join(hits, F.col("_row_id") == F.col("_hit"), "left_anti").select(*t.df.columns), False)
            self._after_delete(name)
            for trigger in [x for x in t.triggers if (x.when, x.event) == ("AFTER", "DELETE")]:
                self.session.fire(trigger, gone, t.df.columns)
        return total

    def _load(self, p: Parser) -> int:
        """LOAD DATA [LOCAL] INFILE '...' [REPLACE | IGNORE] INTO TABLE t [options] [IGNORE n LINES] [(columns)] [SET ...]"""
        from ..sources.delimited import load_data

        p.take(), p.take()
        p.accept("LOCAL")
        p.expect("INFILE")
        path = dialect.unquote(p.take().text)
        mode = "replace" if p.accept("REPLACE") else "ignore" if p.accept("IGNORE") else "error"
        p.expect("INTO", "TABLE")
        name = p.qualified()[-1]
        t = self.get(name)
        o = p.file_options()
        skip = 0
        if p.accept("IGNORE"):
            skip = int(p.take().text)
            p.accept("LINES") or p.accept("ROWS")
        names = p.names() if p.at("(") else [c for c in t.df.columns if c not in t.generated]
        sets = {}
        if p.accept("SET"):
            while True:
                c = p.ident()
                p.expect("=")
                sets[c] = p.expr().text
                if not p.accept(","):
                    break
        p.done()
        schema = ", ".join(f"{quoted(n.lstrip('@'))} string" for n in names)
        rows = load_data(self.spark, path, schema, o.get("fields_terminated", "\t"), o.get("fields_enclosed", ""), o.get("fields_escaped", "\\"), o.get("lines_terminated", "\n"), skip)
        for c, e in sets.items():
            rows = rows.withColumn(c, F.expr(e))
        return self.insert_rows(name, rows.select(*[c for c in rows.columns if c in t.df.columns]), mode)


def name_at(p: Parser) -> str:
    return dialect.name_of(p.t)
