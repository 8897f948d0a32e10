"""SQL front door: statements in the dialect, run on Spark SQL, with session state on the driver.

Queries are parsed, their functions lowered through the registry, and go to
Catalyst whole (``plans.dialect``).  Data changes rewrite a table's DataFrame
(``plans.catalog``); procedures and triggers are in ``plans.procedures``.
"""

from __future__ import annotations

import datetime as dt
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import session
from ..operators import json_table
from ..operators import recursive as recursion
from ..session import prepare
from . import dialect, information_schema, procedures, render
from .catalog import Catalog, Trigger
from .dialect import ParseError


class UnsupportedStatement(NotImplementedError):
    pass


# Function names whose Spark equivalent is a call of another name.
RENAMED = {"LENGTH": "octet_length", "OCT": "bin_oct", "STD": "stddev_pop", "STDDEV": "stddev_pop", "VARIANCE": "var_pop", "CURDATE": "current_date", "FROM_BASE64": "unbase64", "SCHEMA": "current_schema", "DATABASE": "current_schema", "IFNULL": "ifnull"}
_STRING = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`")
_OUT_OF_SCOPE = re.compile(r"^\s*(BINLOG|CHANGE\s+REPLICATION|RESET\s+REPLICA|START\s+REPLICA|STOP\s+REPLICA|CREATE\s+EVENT|ALTER\s+EVENT|DROP\s+EVENT)\b", re.I)


def _outside_strings(sql: str, change) -> str:
    """Apply ``change`` to the parts of a statement that aren't quoted."""
    out, at = [], 0
    for m in _STRING.finditer(sql):
        out += [change(sql[at : m.start()]), m[0]]
        at = m.end()
    return "".join(out) + change(sql[at:])


def translate(sql: str) -> str:
    """A query as Spark SQL by names alone: for texts in Spark's own syntax that the dialect's parser doesn't take."""

    def change(s: str) -> str:
        s = re.sub(r"\b(" + "|".join(RENAMED) + r")\s*\(", lambda m: RENAMED[m[1].upper()] + "(", s, flags=re.I)
        s = re.sub(r"\bSTRAIGHT_JOIN\b", "JOIN", s, flags=re.I)
        s = re.sub(r"\bSQL_CALC_FOUND_ROWS\b|\bHIGH_PRIORITY\b|\bFOR\s+UPDATE\b(\s+SKIP\s+LOCKED|\s+NOWAIT)?|\bLOCK\s+IN\s+SHARE\s+MODE\b", "", s, flags=re.I)
        s = re.sub(r"\bLIMIT\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1", s, flags=re.I)
        s = re.sub(r"\bFROM\s+DUAL\b", "", s, flags=re.I)
        s = re.sub(r"\bREGEXP\b", "RLIKE", s, flags=re.I)
        return re.sub(r"/\*\+.*?\*/", _hints, s, flags=re.S)

    return _outside_strings(sql, change)


def _hints(m: re.Match) -> str:
    """Join hints by their Spark names; others are dropped."""
    known = {"HASH_JOIN": "SHUFFLE_HASH", "MERGE_JOIN": "MERGE", "LOOKUP_JOIN": "BROADCAST"}
    found = [f"{known[n.upper()]}({a})" for n, a in re.findall(r"(\w+)\(([^)]*)\)", m[0]) if n.upper() in known]
    return f"/*+ {', '.join(found)} */" if found else ""


class Engine(dialect.Session):
    """A session: tables, variables, prepared statements, procedures, triggers, users, warnings.

    Metadata and variables live on the driver; rows stay in DataFrames.
    """

    def __init__(self, spark: SparkSession):
        super().__init__(prepare(spark))
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "1001")
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        self.variables: dict[str, object] = {}
        self.settings = {
            "sql_mode": "NO_ENGINE_SUBSTITUTION,ONLY_FULL_GROUP_BY,STRICT_TRANS_TABLES", "autocommit": 1, "group_concat_max_len": 1024, "sql_select_limit": None, "version": "8.0.33", "version_comment": "Tidewheel", "foreign_key_checks": 1,
            "check_constraint_checks": 1, "character_set_client": "utf8mb4", "collation_connection": "utf8mb4_0900_bin", "time_zone": "SYSTEM", "system_time_zone": "UTC", "max_allowed_packet": 67108864, "transaction_isolation": "REPEATABLE-READ", "cte_max_recursion_depth": 1000, "lower_case_table_names": 0,
        }
        self.prepared: dict[str, str] = {}
        self.procedures: dict[str, object] = {}
        self.functions: dict[str, object] = {}
        self.table_functions: dict[str, object] = {}
        self.views: dict[str, str] = {}
        self.view_tables: dict[str, list[str]] = {}
        self.databases: dict[str, str] = {"default": "utf8mb4_0900_bin"}
        self.registered: dict[str, str] = {}
        self.warnings: list[tuple[str, int, str]] = []
        self.locks: dict[str, int] = {}
        self.table_locks: dict[str, str] = {}
        self.users: dict[tuple[str, str], dict[tuple[str, str], bool]] = {("root", "localhost"): {("ALL PRIVILEGES", "*.*"): True}}
        self.roles: dict[tuple[str, str], set[str]] = {}
        self.role_names: set[str] = set()
        self.proxies: set[tuple] = set()
        self.reference_systems: dict[int, tuple] = {0: ("", None, None, "", None), 4326: ("WGS 84", "EPSG", 4326, "GEOGCS", None)}
        self.saved, self.savepoints = None, {}
        self.database, self.running, self.role = "default", "", "NONE"
        self.found_rows, self.row_count, self.last_insert_id = 0, -1, 0
        self._made = 0
        self.catalog = Catalog(self)

    # --- what a parser asks --------------------------------------------------------------------

    def user(self, name: str):
        return self.variables.get(name)

    def system(self, name: str):
        return self.settings.get(name)

    def assign(self, name: str, node: dialect.Node) -> dialect.Node:
        v = node.value if node.known else self.spark.sql(f"SELECT {node.text}").first()[0]
        self.variables[name] = v
        return dialect.Node(render.value(v), True, v)

    def function(self, name: str):
        return self.functions.get(name)

    def relation(self, parts: list[str], as_of: str | None) -> str:
        name = parts[-1]
        if len(parts) == 2 and parts[0].lower() == "information_schema" or self.database == "information_schema" and len(parts) == 1:
            view = f"_information_schema_{name.lower()}"
            information_schema.table(self, name).createOrReplaceTempView(view)
            return f"(SELECT * FROM {dialect.quoted(view)})"
        if as_of is not None:
            return f"(SELECT * FROM {dialect.quoted(self._version(name, as_of))})"
        if len(parts) == 2 and parts[0].lower() in (d.lower() for d in self.databases):
            parts = parts[1:]
        return ".".join(dialect.quoted(p) for p in parts)

    def _version(self, name: str, as_of: str) -> str:
        """A view of a table's contents at a time (or by the number of the change)."""
        versions = self.catalog.get(name).versions
        if re.fullmatch(r"\d+", as_of):
            found = [df for i, (_, df) in enumerate(versions, 1) if i <= int(as_of)]
        else:
            t = dt.datetime.fromisoformat(as_of).replace(tzinfo=dt.UTC).timestamp()
            found = [df for at, df in versions if at <= t]
        if not found:
            raise ValueError(f"no version of {name} as of {as_of}")
        return self._view(found[-1], "version")

    def _view(self, df: DataFrame, kind: str) -> str:
        self._made += 1
        name = f"_{kind}_{self._made}"
        df.createOrReplaceTempView(name)
        return name

    def table_function(self, name: str, args: list[dialect.Node]) -> str | None:
        if name not in self.table_functions:
            return None
        values = [a.value if a.known else self.spark.sql(f"SELECT {a.text}").first()[0] for a in args]
        return f"SELECT * FROM {dialect.quoted(self._view(self.table_functions[name](self.spark, *values), 'function'))}"

    def json_table(self, doc: str, path: str, columns: list) -> tuple[str, list[str]]:
        names = json_table.column_names(columns)
        key = (path, repr(columns))
        call = render.session(self.spark).name(key, lambda: json_table.rows_function(path, columns))
        return f"inline(from_json({call}(CAST({doc} AS STRING)), '{json_table.row_type(columns)}'))", names

    def recursive(self, name: str, columns: list[str], base: str, step: str) -> str:
        first = self.spark.sql(base)
        first = first.toDF(*columns) if columns else first
        self._made += 1
        view = f"_recursion_{self._made}"
        step = step.replace(dialect.quoted(name), dialect.quoted(view))

        def run(new: DataFrame) -> DataFrame:
            new.createOrReplaceTempView(view)
            out = self.spark.sql(step)
            return out.select(*[F.col(dialect.quoted(c)).cast(f.dataType) for c, f in zip(out.columns, first.schema, strict=True)])

        done = self._view(recursion.fixpoint(first, run), "cte")
        return f"SELECT * FROM {dialect.quoted(done)}"

    # --- host functions ---------------------------------------------------------------------------

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)
        self.registered[name.lower()] = name
        self.catalog.tables.pop(name, None)

    def register_function(self, name: str, f, returns: str = "string") -> None:
        """A scalar function of any number of arguments: a pandas UDF over Arrow batches, or a builder of Columns."""
        if returns == "column":
            self.functions[name.lower()] = lambda *a: render.expression(self.spark, f, [(x, False, None) for x in a])
            return
        from ..functions.registry import python

        made = python(f, returns, pure=False)
        self.functions[name.lower()] = lambda *a: render.expression(self.spark, made, [(x, False, None) for x in a])

    def register_aggregate(self, name: str, f, returns: str = "double") -> None:
        """An aggregate function of a column: a grouped pandas UDF (Series to scalar)."""
        import pandas as pd

        def call(x: pd.Series) -> float:
            return f(x)

        made = F.pandas_udf(call, returns, F.PandasUDFType.GROUPED_AGG) if hasattr(F, "PandasUDFType") else F.pandas_udf(call, returns)
        spark_name = f"tw_agg_{name.lower()}"
        self.spark.udf.register(spark_name, made)
        self.functions[name.lower()] = lambda *a: f"{spark_name}({', '.join(a)})"

    def register_table_function(self, name: str, f) -> None:
        """A set-returning function: (session, values) to a DataFrame."""
        self.table_functions[name.lower()] = f

    # --- statements ---------------------------------------------------------------------------------

    def sql(self, statement: str, *args) -> DataFrame:
        """Run one statement; statements without a result give an empty frame."""
        out = self.statement(statement, None, None, list(args))
        return self._none() if out is None else out

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "ok int")

    def _rows(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def statement(self, text: str, columns: dict[str, str] | None = None, assign=None, args: list | None = None) -> DataFrame | None:
        s = text.strip().rstrip(";").strip()
        if not s:
            return None
        if _OUT_OF_SCOPE.match(s):
            raise UnsupportedStatement(s.split("\n")[0])
        session.CURRENT.update(found_rows=self.found_rows, row_count=self.row_count, last_insert_id=self.last_insert_id, database=self.database, locks=self.locks, secure_file_priv=self.settings.get("secure_file_priv"), max_allowed_packet=self.settings["max_allowed_packet"])
        self.running = s
        render.session(self.spark).forget()
        try:
            p = dialect.Parser(s, self, columns)
        except ParseError:
            return self.spark.sql(translate(s), args=args or None)
        word, nxt = p.t.up, p.ahead().up
        if word in ("SELECT", "WITH", "VALUES", "TABLE") or p.t.text == "(":
            return self._query(p, s, assign, args)
        if not (word == "SHOW" and nxt == "WARNINGS"):
            self.warnings = []
        changed = self.catalog.run(p)
        if changed is not None:
            self.row_count = changed
            return self._rows([(changed,)], "rows_affected long")
        f = getattr(self, f"_do_{word.lower()}", None)
        if f is None:
            raise UnsupportedStatement(s)
        return f(p, s, columns or {}, assign)

    def _query(self, p, s: str, assign, args) -> DataFrame | None:
        try:
            text = p.query()
            if p.into is None and p.at("INTO"):
                p._into()
            p.done()
        except ParseError:
            if p.columns or self.catalog.tables:
                raise
            text, p.into = translate(s), None
        limit = self.settings["sql_select_limit"]
        if limit is not None and not re.search(r"\bLIMIT\s+\S+(\s+OFFSET\s+\S+)?\s*$", text, re.I):
            text += f" LIMIT {int(limit)}"
        out = self.spark.sql(text, args=args or None)
        if re.search(r"\bSQL_CALC_FOUND_ROWS\b", s, re.I):
            self.found_rows = self.spark.sql(re.sub(r"\bLIMIT\b[^)]*$", "", text, flags=re.I)).count()
        if p.into is None:
            self.row_count = -1
            return out
        from ..sources import delimited

        if p.into[0] == "OUTFILE":
            o = p.into[2]
            delimited.into_outfile(out, p.into[1], o.get("fields_terminated", "\t"), o.get("fields_enclosed", ""), o.get("fields_escaped", "\\"))
        elif p.into[0] == "DUMPFILE":
            delimited.into_dumpfile(out, p.into[1])
        else:
            values = delimited.into_variables(out)
            for name, v in zip(p.into, values, strict=True):
                assign(name, v) if assign else self.variables.__setitem__(name, v)
        return None

    def warn(self, message: str, code: int = 1105, level: str = "Warning") -> None:
        self.warnings.append((level, code, message))

    # prepared statements

    def _do_prepare(self, p, s, columns, assign):
        p.take()
        name = p.ident().lower()
        p.expect("FROM")
        self.prepared[name] = dialect.unquote(p.take().text) if p.t.kind == "string" else str(self.variables[p.take().text[1:].lower()])

    def _do_execute(self, p, s, columns, assign):
        p.take()
        name = p.ident().lower()
        values = []
        if p.accept("USING"):
            values = [x.value for x in p.list()]
        text = self.prepared[name]
        if re.match(r"\s*(SELECT|WITH)\b", text, re.I):
            return self.statement(text, None, assign, values)
        parts, at, k = [], 0, 0  # data changes take their parameters as literals
        for t in dialect.tokens(text):
            if t.kind == "op" and t.text == "?":
                parts += [text[at : t.start], procedures.dialect_literal(values[k])]
                at, k = t.end, k + 1
        return self.statement("".join(parts) + text[at:])

    def _do_deallocate(self, p, s, columns, assign):
        p.take()
        p.expect("PREPARE")
        del self.prepared[p.ident().lower()]

    # procedures, triggers, views, databases

    def _do_call(self, p, s, columns, assign):
        p.take()
        name = p.qualified()[-1].lower()
        args = dialect.split_top(s[p.t.end : s.rindex(")")]) if p.at("(") else []
        made = self.procedures[name]
        if callable(made):
            values = [n.value if n.known else self.spark.sql(f"SELECT {n.text}").first()[0] for n in (dialect.expression(a, self, columns) for a in args)]
            return made(self, *values)
        frame = procedures.Frame() if not columns else None
        if columns:
            frame = procedures.Frame()
            frame.variables = {n: dialect.expression(a, self, columns).value for a in args for n in [a.strip().lower()] if n in columns}
        out = procedures.call(self, made, args, frame)
        if columns and assign:
            for n, v in frame.variables.items():
                assign(n, v)
        return out

    def _do_create(self, p, s, columns, assign):
        p.take()
        replace = p.accept("OR", "REPLACE")
        while p.t.up in ("DEFINER", "ALGORITHM", "SQL"):
            p.take()
            if p.accept("="):
                p.take()
                if p.t.kind in ("user", "system"):
                    p.take()
            else:
                p.expect("SECURITY")
                p.take()
        if p.accept("VIEW"):
            return self._create_view(p, s, replace)
        if p.accept("PROCEDURE"):
            maybe = p.accept("IF", "NOT", "EXISTS")
            name = p.qualified()[-1]
            if name.lower() in self.procedures and not replace:
                if maybe:
                    return None
                raise ValueError(f"procedure {name} exists")
            self.procedures[name.lower()] = procedures.parse_procedure(p, name.lower())
            p.done()
            return None
        if p.accept("TRIGGER"):
            return self._create_trigger(p, s)
        if p.accept("DATABASE") or p.accept("SCHEMA"):
            maybe = p.accept("IF", "NOT", "EXISTS")
            name = p.ident()
            if name in self.databases and not maybe:
                raise ValueError(f"database {name} exists")
            self.databases.setdefault(name, "utf8mb4_0900_bin")
            if m := re.search(r"COLLATE\s*=?\s*(\w+)", s, re.I):
                self.databases[name] = m[1]
            self.row_count = 1
            return self._rows([(1,)], "rows_affected long")
        if p.accept("USER"):
            maybe = p.accept("IF", "NOT", "EXISTS")
            for who in self._people(p):
                if who in self.users and not maybe:
                    raise ValueError(f"user {who[0]} exists")
                self.users.setdefault(who, {})
            return None
        if p.accept("ROLE"):
            maybe = p.accept("IF", "NOT", "EXISTS")
            for who in self._people(p):
                if who[0] in self.role_names and not maybe:
                    raise ValueError(f"role {who[0]} exists")
                self.role_names.add(who[0])
                self.users.setdefault(who, {})
            return None
        if p.accept("SPATIAL", "REFERENCE", "SYSTEM"):
            maybe = p.accept("IF", "NOT", "EXISTS")
            srid = int(p.take().text)
            if srid in self.reference_systems and not (replace or maybe):
                raise ValueError(f"spatial reference system {srid} exists")
            given = {}
            while p.t.kind == "word":
                k = p.take().up
                if k == "ORGANIZATION":
                    given[k] = dialect.unquote(p.take().text)
                    p.expect("IDENTIFIED", "BY")
                    given["ID"] = int(p.take().text)
                else:
                    given[k] = dialect.unquote(p.take().text)
            if srid not in self.reference_systems or replace:
                self.reference_systems[srid] = (given.get("NAME", ""), given.get("ORGANIZATION"), given.get("ID"), given.get("DEFINITION", ""), given.get("DESCRIPTION"))
            return None
        raise UnsupportedStatement(s)

    def _create_view(self, p, s, replace):
        maybe = p.accept("IF", "NOT", "EXISTS")
        name = p.qualified()[-1]
        if name.lower() in self.views and not replace:
            if maybe:
                return None
            raise ValueError(f"view {name} exists")
        names = p.names() if p.at("(") else None
        p.expect("AS")
        start, first = p.t.start, len(p.seen)
        text = p.query()
        body = s[start : p.toks[p.i - 1].end]
        if p.accept("WITH"):
            p.i = len(p.toks) - 1
        p.done()
        df = self.spark.sql(text)
        (df.toDF(*names) if names else df).createOrReplaceTempView(name)
        self.views[name.lower()] = body
        self.view_tables[name.lower()] = list(dict.fromkeys(t for _, t in p.seen[first:]))
        self.registered[name.lower()] = name
        return None

    def _create_trigger(self, p, s):
        maybe = p.accept("IF", "NOT", "EXISTS")
        name = p.qualified()[-1]
        if any(x.name == name for t in self.catalog.tables.values() for x in t.triggers):
            if maybe:
                return None
            raise ValueError(f"trigger {name} exists")
        when, event = p.take().up, p.take().up
        p.expect("ON")
        table = p.qualified()[-1]
        p.expect("FOR", "EACH", "ROW")
        place = None
        if p.t.up in ("FOLLOWS", "PRECEDES"):
            place = p.take().up, p.ident()
        made = Trigger(name, when, event, table, s[p.t.start :])
        held = self.catalog.get(table).triggers
        at = len(held)
        if place:
            at = next(i for i, x in enumerate(held) if x.name == place[1]) + (place[0] == "FOLLOWS")
        held.insert(at, made)
        return None

    def fire(self, trigger, rows: DataFrame, columns: list[str]) -> DataFrame:
        return procedures.fire(self, trigger, rows, columns)

    def _do_alter(self, p, s, columns, assign):
        p.take()
        if p.accept("DATABASE") or p.accept("SCHEMA"):
            name = p.ident() if p.t.up not in ("COLLATE", "DEFAULT", "CHARACTER") else self.database
            if m := re.search(r"COLLATE\s*=?\s*(\w+)", s, re.I):
                self.databases[name] = m[1]
            return self._rows([(1,)], "rows_affected long")
        if p.accept("USER"):
            maybe = p.accept("IF", "EXISTS")
            for who in self._people(p):
                if who not in self.users and not maybe:
                    raise KeyError(f"no user {who[0]}")
            return None
        if p.accept("VIEW"):
            return self._create_view(p, s, True)
        raise UnsupportedStatement(s)

    def _do_drop(self, p, s, columns, assign):
        p.take()
        what = p.take().up
        if what == "SPATIAL":
            p.expect("REFERENCE", "SYSTEM")
        maybe = p.accept("IF", "EXISTS")
        if what == "PREPARE":
            del self.prepared[p.ident().lower()]
            return None
        if what == "SPATIAL":
            self.reference_systems.pop(int(p.take().text), None)
            return None
        if what in ("USER", "ROLE"):
            for who in self._people(p):
                if self.users.pop(who, None) is None and not maybe:
                    raise KeyError(f"no {what.lower()} {who[0]}")
                self.role_names.discard(who[0])
                self.roles.pop(who, None)
                for held in self.roles.values():
                    held.discard(who[0])
            return None
        names = [p.qualified()[-1]]
        while p.accept(","):
            names.append(p.qualified()[-1])
        for n in names:
            if what == "VIEW":
                if self.views.pop(n.lower(), None) is None:
                    if maybe:
                        continue
                    raise KeyError(f"no view {n}")
                self.spark.catalog.dropTempView(n)
                self.registered.pop(n.lower(), None)
            elif what == "PROCEDURE":
                if self.procedures.pop(n.lower(), None) is None and not maybe:
                    raise KeyError(f"no procedure {n}")
            elif what == "TRIGGER":
                held = [t for t in self.catalog.tables.values() if any(x.name == n for x in t.triggers)]
                if not held and not maybe:
                    raise KeyError(f"no trigger {n}")
                for t in held:
                    t.triggers = [x for x in t.triggers if x.name != n]
            elif what in ("DATABASE", "SCHEMA"):
                if self.databases.pop(n, None) is None and not maybe:
                    raise KeyError(f"no database {n}")
                if n == self.database:
                    self.database = "default"
            else:
                raise UnsupportedStatement(s)
        return None

    def _do_use(self, p, s, columns, assign):
        p.take()
        name = p.ident()
        if name not in self.databases and name.lower() != "information_schema":
            raise KeyError(f"no database {name}")
        self.database = name

    def _do_kill(self, p, s, columns, assign):
        """KILL cancels the jobs of a connection's group."""
        p.take()
        p.accept("QUERY") or p.accept("CONNECTION")
        self.spark.sparkContext.cancelJobGroup(f"connection-{p.take().text}")

    # transactions: contents are immutable, so a rollback puts the old ones back

    def _do_start(self, p, s, columns, assign):
        p.take()
        p.expect("TRANSACTION")
        self.saved, self.savepoints = self.catalog.snapshot(), {}

    def _do_begin(self, p, s, columns, assign):
        self.saved, self.savepoints = self.catalog.snapshot(), {}

    def _do_commit(self, p, s, columns, assign):
        self.saved, self.savepoints = None, {}

    def _do_savepoint(self, p, s, columns, assign):
        p.take()
        self.savepoints[p.ident().lower()] = self.catalog.snapshot()

    def _do_release(self, p, s, columns, assign):
        p.take()
        p.expect("SAVEPOINT")
        name = p.ident().lower()
        if name not in self.savepoints:
            raise KeyError(f"no savepoint {name}")
        del self.savepoints[name]

    def _do_rollback(self, p, s, columns, assign):
        p.take()
        p.accept("WORK")
        if p.accept("TO"):
            p.accept("SAVEPOINT")
            name = p.ident().lower()
            if name not in self.savepoints:
                raise KeyError(f"no savepoint {name}")
            kept = self.savepoints[name]
            self.catalog.restore(kept)
            self.savepoints[name] = self.catalog.snapshot()
        elif self.saved is not None:
            self.catalog.restore(self.saved)
            self.saved, self.savepoints = None, {}

    def _do_lock(self, p, s, columns, assign):
        p.take()
        p.take()
        while True:
            name = p.qualified()[-1]
            p._alias()
            self.table_locks[name.lower()] = p.take().up
            if not p.accept(","):
                return None

    def _do_unlock(self, p, s, columns, assign):
        self.table_locks.clear()

    def _do_flush(self, p, s, columns, assign):
        return None

    _do_do = _do_flush

    # accounts

    def _people(self, p) -> list[tuple[str, str]]:
        """'user'@'host', ... up to a clause."""
        out = []
        while True:
            name = p.ident()
            host = "%"
            if p.t.kind == "user":
                host = p.take().text[1:].strip("'`")
            out.append((name, host))
            while p.t.kind not in ("end",) and not p.at(",") and p.t.up not in ("TO", "FROM", "WITH", "ON"):
                p.take()
            if not p.accept(","):
                return out

    def _privileges(self, p) -> list[str]:
        out, words = [], []
        while not p.at("ON") and not p.at("TO") and not p.at("FROM") and p.t.kind != "end":
            if p.accept(","):
                out.append(" ".join(words))
                words = []
            elif p.at("("):
                words[-1] += "(" + ",".join(p.names()) + ")"
            else:
                words.append(dialect.unquote(p.take().text) if p.t.kind == "string" else p.take().text)
                if p.t.kind == "user":
                    p.take()
        return [*out, " ".join(words)]

    def _target(self, p) -> str:
        parts = []
        while p.t.kind in ("word", "quoted") and not p.at("TO") and not p.at("FROM") or p.at("*") or p.at("."):
            parts.append(p.take().text.strip("`"))
        text = "".join(parts)
        return text if "." in text else "*.*" if text == "*" else f"{self.database}.{text}"

    def _do_grant(self, p, s, columns, assign):
        p.take()
        if p.accept("PROXY"):
            p.expect("ON")
            who = self._people(p)[0]
            p.expect("TO")
            self.proxies |= {(who, x) for x in self._people(p)}
            return None
        named = self._privileges(p)
        if p.accept("ON"):
            p.accept("TABLE") or p.accept("PROCEDURE") or p.accept("FUNCTION")
            on = self._target(p)
            p.expect("TO")
            people = self._people(p)
            option = bool(re.search(r"WITH\s+GRANT\s+OPTION", s, re.I))
            for who in people:
                if who not in self.users:
                    raise KeyError(f"no user {who[0]}")
                for x in named:
                    x = "ALL PRIVILEGES" if x.upper() in ("ALL", "ALL PRIVILEGES") else x.upper()
                    self.users[who][x, on] = option or self.users[who].get((x, on), False)
            return None
        p.expect("TO")
        for who in self._people(p):
            self.roles.setdefault(who, set()).update(named)
        return None

    def _do_revoke(self, p, s, columns, assign):
        p.take()
        if p.accept("PROXY"):
            p.expect("ON")
            who = self._people(p)[0]
            p.expect("FROM")
            self.proxies -= {(who, x) for x in self._people(p)}
            return None
        named = self._privileges(p)
        if p.accept("ON"):
            on = self._target(p)
            p.expect("FROM")
            for who in self._people(p):
                for x in named:
                    self.users[who].pop(("ALL PRIVILEGES" if x.upper() in ("ALL", "ALL PRIVILEGES") else x.upper(), on), None)
            return None
        p.expect("FROM")
        for who in self._people(p):
            if [n.upper() for n in named] == ["ALL PRIVILEGES", "GRANT OPTION"]:
                self.users[who].clear()
            self.roles.get(who, set()).difference_update(named)
        return None

    def _do_rename(self, p, s, columns, assign):
        p.take()
        p.expect("USER")
        while True:
            old = self._people(p)[0]
            p.expect("TO")
            new = self._people(p)[0]
            self.users[new] = self.users.pop(old)
            self.roles[new] = self.roles.pop(old, set())
            if not p.accept(","):
                return None

    # SET

    def _do_set(self, p, s, columns, assign):
        p.take()
        if p.accept("NAMES") or p.accept("CHARACTER", "SET") or p.accept("CHARSET"):
            self.settings["character_set_client"] = p.ident()
            if p.accept("COLLATE"):
                self.settings["collation_connection"] = p.ident()
            return None
        if re.match(r"SET\s+(SESSION\s+|GLOBAL\s+)?TRANSACTION\b|SET\s+PASSWORD\b", s, re.I):
            return None
        if p.accept("ROLE") or p.accept("DEFAULT", "ROLE"):
            self.role = s[p.t.start :]
            return None
        while True:
            for w in ("GLOBAL", "SESSION", "LOCAL", "PERSIST", "PERSIST_ONLY"):
                if p.at(w) and p.ahead().kind in ("word", "quoted"):
                    p.take()
            t = p.take()
            name = t.text.lower()
            p.accept(":=") or p.expect("=")
            if p.at("DEFAULT") or p.at("ON") or p.at("OFF"):
                word = p.take().up
                got = {"ON": 1, "OFF": 0, "DEFAULT": None}[word]
            elif p.t.kind == "word" and p.ahead().text in (",", "") and p.t.up not in ("NULL", "TRUE", "FALSE", "CURRENT_DATE", "CURRENT_TIMESTAMP") and dialect.name_of(p.t).lower() not in p.columns and t.kind != "user":
                got = p.take().text  # a bare word
            else:
                node = p.expr()
                got = node.value if node.known else self.spark.sql("SELECT " + node.text).first()[0]
            if t.kind == "user":
                self.variables[name[1:].strip("`'")] = got
            else:
                self.settings[name.lstrip("@").split(".")[-1]] = got
            if not p.accept(","):
                return None

    # EXPLAIN and DESCRIBE

    def _do_explain(self, p, s, columns, assign):
        p.take()
        if p.accept("FORMAT"):
            p.expect("=")
            p.take()
        p.accept("ANALYZE") or p.accept("EXTENDED") or p.accept("PLAN")
        if p.t.up in ("SELECT", "WITH", "TABLE", "VALUES") or p.t.text == "(":
            return self.spark.sql("EXPLAIN FORMATTED " + p.query())
        if p.t.up in ("INSERT", "UPDATE", "DELETE", "REPLACE"):
            return self._rows([(f"{p.t.up} by a rewrite of its table, see operators.dml",)], "plan string")
        return self._columns_of(p.qualified()[-1], lambda n: True)

    _do_describe = _do_desc = _do_explain

    def _do_check(self, p, s, columns, assign):
        return self._rows([(p.toks[2].text, "check", "status", "OK")], "table string, op string, msg_type string, msg_text string")

    _do_optimize = _do_repair = _do_check

    # SHOW

    def relations(self) -> list[str]:
        """Tables and views by name, without the engine's own."""
        seen = {t.name for t in self.spark.catalog.listTables() if not t.name.startswith("_")}
        low = {n.lower(): n for n in [*seen, *self.registered.values(), *self.catalog.tables]}
        return sorted(low.values())

    def _columns_of(self, name: str, keep, full: bool = False) -> DataFrame:
        name = next((n for n in self.relations() if n.lower() == name.lower()), name)
        facts = [f for f in information_schema.column_facts(self, name) if keep(f["name"])]
        if full:
            return self._rows([(f["name"], f["type"], None, f["null"], f["key"], f["default"], f["extra"], "insert,references,select,update", f["comment"]) for f in facts], "field string, type string, collation string, null string, key string, default string, extra string, privileges string, comment string")
        return self._rows([(f["name"], f["type"], f["null"], f["key"], f["default"], f["extra"]) for f in facts], "field string, type string, null string, key string, default string, extra string")

    def _filtered(self, p, df: DataFrame, name: str | None = None) -> DataFrame:
        """LIKE or WHERE at the end of a SHOW."""
        if p.accept("LIKE"):
            pattern = dialect.unquote(p.take().text)
            return df.where(F.col(name or df.columns[0]).ilike(pattern))
        if p.accept("WHERE"):
            return df.where(p.expr().boolean())
        return df

    def _do_show(self, p, s, columns, assign):
        p.take()
        full = p.accept("FULL")
        p.accept("EXTENDED") or p.accept("GLOBAL") or p.accept("SESSION") or p.accept("LOCAL")
        if p.accept("CREATE"):
            return self._show_create(p)
        word = p.take().up
        info = lambda n: information_schema.table(self, n)
        if word == "TABLES":
            if p.accept("FROM") or p.accept("IN"):
                p.ident()
            rows = [(n, "VIEW" if n.lower() in self.views else "BASE TABLE") for n in self.relations()]
            return self._filtered(p, self._rows(rows, "table_name string, table_type string"))
        if word in ("DATABASES", "SCHEMAS"):
            return self._filtered(p, self._rows([(d,) for d in ["information_schema", *self.databases]], "database string"))
        if word in ("COLUMNS", "FIELDS"):
            p.take()
            name = p.qualified()[-1]
            return self._filtered(p, self._columns_of(name, lambda n: True, full))
        if word == "VARIABLES":
            return self._filtered(p, self._rows([(k, None if v is None else str(v)) for k, v in sorted(self.settings.items())], "variable_name string, value string"))
        if word == "STATUS":
            status = {"Threads_connected": "1", "Threads_running": "1", "Uptime": str(int(time.time() - self.spark.sparkContext.startTime / 1000)), "Com_select": "0"}
            return self._filtered(p, self._rows(sorted(status.items()), "variable_name string, value string"))
        if word in ("WARNINGS", "ERRORS"):
            return self._rows(self.warnings, "level string, code int, message string")
        if word in ("CHARSET", "CHARACTER"):
            p.accept("SET")
            return self._filtered(p, self._rows([(c, x, d, m) for c, d, x, m in information_schema.CHARSETS], "charset string, description string, default_collation string, maxlen int"))
        if word == "COLLATION":
            return self._filtered(p, info("collations").select("collation_name", "character_set_name", "id", "is_default", "is_compiled", "sortlen", "pad_attribute"))
        if word == "ENGINES":
            return info("engines")
        if word in ("INDEX", "INDEXES", "KEYS"):
            p.take()
            name = p.qualified()[-1]
            df = info("statistics").where(F.lower("table_name") == name.lower())
            return self._filtered(p, df.select(F.col("table_name").alias("table"), "non_unique", F.col("index_name").alias("key_name"), "seq_in_index", "column_name", "collation", "nullable", "index_type", "is_visible"))
        if word == "PROCESSLIST":
            return info("processlist").select("id", "user", "host", "db", "command", "time", "state", "info")
        if word == "TRIGGERS":
            df = info("triggers").select(F.col("trigger_name").alias("trigger"), F.col("event_manipulation").alias("event"), F.col("event_object_table").alias("table"), F.col("action_statement").alias("statement"), F.col("action_timing").alias("timing"))
            return self._filtered(p, df, "table")
        if word in ("PROCEDURE", "FUNCTION"):
            p.expect("STATUS")
            kind = word
            return self._filtered(p, info("routines").where(F.col("routine_type") == kind).select(F.col("routine_schema").alias("db"), F.col("routine_name").alias("name"), F.col("routine_type").alias("type"), "definer", F.col("routine_comment").alias("comment")), "name")
        if word == "EVENTS":
            return self._rows([], "db string, name string")
        if word == "GRANTS":
            who = ("root", "localhost")
            if p.accept("FOR"):
                who = self._people(p)[0]
            return self._rows([(g,) for g in self._grants(who)], "grants string")
        if word == "PRIVILEGES":
            return self._rows([(n.capitalize(), "Tables", "") for n in information_schema.PRIVILEGES], "privilege string, context string, comment string")
        if word == "TABLE":
            p.expect("STATUS")
            if p.accept("FROM") or p.accept("IN"):
                p.ident()
            df = info("tables").select(F.col("table_name").alias("name"), "engine", "version", "row_format", F.col("table_rows").alias("rows"), "auto_increment", F.col("table_collation").alias("collation"), F.col("table_comment").alias("comment"))
            return self._filtered(p, df, "name")
        if word in ("REPLICA", "SLAVE"):
            return self._rows([], "replica_io_state string, source_host string, source_user string, source_port int, replica_io_running string, replica_sql_running string")
        if word == "BINARY":
            if p.accept("LOG", "STATUS"):
                return self._rows([], "file string, position long, binlog_do_db string, binlog_ignore_db string, executed_gtid_set string")
            return self._rows([], "log_name string, file_size long, encrypted string")
        if word == "MASTER":
            if p.accept("STATUS"):
                return self._rows([], "file string, position long, binlog_do_db string, binlog_ignore_db string, executed_gtid_set string")
            return self._rows([], "log_name string, file_size long, encrypted string")
        if word == "COUNT":
            return self._rows([(len(self.warnings),)], "`@@session.warning_count` long")
        raise UnsupportedStatement(s)

    def _grants(self, who) -> list[str]:
        if who not in self.users:
            raise KeyError(f"no user {who[0]}")
        by: dict[tuple[str, bool], list[str]] = {}
        for (x, on), option in sorted(self.users[who].items()):
            by.setdefault((on, option), []).append(x)
        at = lambda u: f"`{u[0]}`@`{u[1]}`"
        out = [f"GRANT USAGE ON *.* TO {at(who)}"] if not any(on == "*.*" for on, _ in by) else []
        out += [f"GRANT {', '.join(xs)} ON {on if on == '*.*' else '.'.join(x if x == '*' else f'`{x}`' for x in on.split('.'))} TO {at(who)}{' WITH GRANT OPTION' * option}" for (on, option), xs in sorted(by.items())]
        out += [f"GRANT PROXY ON {at(a)} TO {at(b)}" for a, b in sorted(self.proxies) if b == who]
        roles = sorted(self.roles.get(who, ()))
        return out + [f"GRANT {', '.join(f'`{r}`@`%`' for r in roles)} TO {at(who)}"] * bool(roles)

    def _show_create(self, p) -> DataFrame:
        what = p.take().up
        p.accept("IF", "NOT", "EXISTS")
        if what in ("DATABASE", "SCHEMA"):
            name = p.ident()
            return self._rows([(name, f"CREATE DATABASE `{name}` /*!40100 DEFAULT CHARACTER SET utf8mb4 COLLATE {self.databases[name]} */")], "database string, create_database string")
        name = p.qualified()[-1]
        if what == "VIEW":
            return self._rows([(name, f"CREATE VIEW `{name}` AS {self.views[name.lower()]}")], "view string, create_view string")
        if what == "PROCEDURE":
            made = self.procedures[name.lower()]
            return self._rows([(name, self.settings["sql_mode"], getattr(made, "text", None))], "procedure string, sql_mode string, create_procedure string")
        if what == "TRIGGER":
            for t in self.catalog.tables.values():
                for x in t.triggers:
                    if x.name == name:
                        return self._rows([(name, self.settings["sql_mode"], f"CREATE TRIGGER {name} {x.when} {x.event} ON {x.table} FOR EACH ROW {x.body}")], "trigger string, sql_mode string, sql_original_statement string")
            raise KeyError(f"no trigger {name}")
        if what == "EVENT":
            raise KeyError(f"no event {name}")
        if name.lower() in self.views:
            return self._rows([(name, f"CREATE VIEW `{name}` AS {self.views[name.lower()]}")], "table string, create_table string")
        return self._rows([(name, self._table_text(name))], "table string, create_table string")

    def _table_text(self, name: str) -> str:
        name = next((n for n in self.relations() if n.lower() == name.lower()), name)
        t = self.catalog.tables.get(name)
        lines = []
        for f in information_schema.column_facts(self, name):
            line = f"  `{f['name']}` {f['type']}"
            if f["generated"]:
                line += f" GENERATED ALWAYS AS ({f['generated']}) STORED"
            line += " NOT NULL" * (f["null"] == "NO")
            line += " AUTO_INCREMENT" * (f["extra"] == "auto_increment")
            if t and f["name"] in t.defaults:
                line += f" DEFAULT {t.defaults[f['name']]}"
            line += f" COMMENT {render.text_literal(f['comment'])}" if f["comment"] else ""
            lines.append(line)
        names = lambda cols: ",".join(f"`{c}`" for c in cols)
        if t:
            lines += [f"  PRIMARY KEY ({names(t.key)})"] * bool(t.key)
            lines += [f"  {'UNIQUE ' * u}{k + ' ' if k not in ('BTREE',) else ''}KEY `{i}` ({names(c)})" for i, (c, u, k) in t.indexes.items()]
            for i, f in t.foreign.items():
                tail = "".join(f" ON {w} {information_schema.RULES[a]}" for w, a in (("DELETE", f.on_delete), ("UPDATE", f.on_update)) if a != "restrict")
                lines.append(f"  CONSTRAINT `{i}` FOREIGN KEY ({names(f.columns)}) REFERENCES `{f.parent}` ({names(f.other)}){tail}")
            lines += [f"  CONSTRAINT `{i}` CHECK ({e})" for i, e in t.checks.items()]
        tail = f" COMMENT={render.text_literal(t.comment)}" if t and t.comment else ""
        return f"CREATE TABLE `{name}` (\n" + ",\n".join(lines) + f"\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4 COLLATE={t.collation if t else 'utf8mb4_0900_bin'}{tail}"

    # --- locks and other driver-side functions -------------------------------------------------

    def get_lock(self, name: str, timeout: float = 0, owner: int = 1) -> int:
        """1 if the lock is ``owner``'s now, 0 if another held it all the time."""
        end = time.time() + timeout
        while self.locks.get(name, owner) != owner:
            if time.time() >= end:
                return 0
            time.sleep(0.01)
        self.locks[name] = owner
        return 1

    def release_lock(self, name: str, owner: int = 1) -> int | None:
        """1 if released, 0 if another's, None if nobody's."""
        if name not in self.locks:
            return None
        if self.locks[name] != owner:
            return 0
        del self.locks[name]
        return 1

    def is_free_lock(self, name: str) -> int:
        return int(name not in self.locks)

    def release_all_locks(self, owner: int = 1) -> int:
        mine = [n for n, o in self.locks.items() if o == owner]
        for n in mine:
            del self.locks[n]
        return len(mine)

    def information_schema(self, name: str) -> DataFrame:
        return information_schema.table(self, name)


def values_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """VALUES ROW(...), ..."""
    return spark.createDataFrame(rows, names) if rows else spark.range(0).select(*[F.lit(None).alias(n) for n in names])
