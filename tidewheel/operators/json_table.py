"""JSON_TABLE: documents to rows, with PATH, EXISTS, FOR ORDINALITY and NESTED columns."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json import dump, parse_path, walk


@dataclass
class Col:
    """A column: ``kind`` path, exists or ordinality; ``empty`` and ``error`` are defaults, or 'ERROR' to raise."""

    name: str
    type: str = "string"
    path: str = "$"
    kind: str = "path"
    empty: object = None
    error: object = None


@dataclass
class Nested:
    path: str
    columns: list = field(default_factory=list)


def _names(columns) -> list[Col]:
    return [c for x in columns for c in (_names(x.columns) if isinstance(x, Nested) else [x])]


def _cast(c: Col, v):
    if v is None:
        return None
    try:
        t = c.type.lower()
        if t == "json":
            return dump(v)
        if isinstance(v, dict | list):
            raise ValueError("not a scalar")
        if t in ("int", "long", "bigint"):
            return int(v) if not isinstance(v, str) else int(float(v))
        if t in ("double", "float"):
            return float(v)
        return v if isinstance(v, str) else dump(v)
    except (ValueError, TypeError):
        if c.error == "ERROR":
            raise
        return c.error


def rows(doc, path: str, columns) -> Iterator[dict]:
    """Rows of a document: nested siblings come one after another, each with the others NULL."""
    for n, (_, item) in enumerate(walk(doc, parse_path(path)), 1):
        own = {}
        for c in columns:
            if isinstance(c, Nested):
                continue
            if c.kind == "ordinality":
                own[c.name] = n
                continue
            found = [v for _, v in walk(item, parse_path(c.path))]
            if c.kind == "exists":
                own[c.name] = int(bool(found))
            elif not found:
                if c.empty == "ERROR":
                    raise ValueError(f"no value for {c.name}")
                own[c.name] = c.empty
            else:
                own[c.name] = _cast(c, found[0])
        some = False
        for c in columns:
            if isinstance(c, Nested):
                for r in rows(item, c.path, c.columns):
                    some = True
                    yield own | r
        if not some:
            yield own


def json_table(df: DataFrame, doc: str, path: str, columns: list, keep: list[str] | None = None) -> DataFrame:
    """A row of ``df`` for each row its document gives; a NULL or invalid document gives none."""
    import pyarrow as pa

    kept = keep if keep is not None else df.columns
    names = _names(columns)
    types = {"json": "string", "bigint": "long"}
    kind = "array<struct<" + ",".join(f"`{c.name}`:{'int' if c.kind != 'path' else types.get(c.type.lower(), c.type)}" for c in names) + ">>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(b.num_columns - 1):
                try:
                    d = json.loads(x.as_py()) if x.is_valid else None
                except ValueError:
                    d = None
                out.append([{c.name: r.get(c.name) for c in names} for r in rows(d, path, columns)] if d is not None else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, arrow)], [*kept, "_rows"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind))
    source = df.select(*kept, F.col(doc).alias("_doc"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    out = source.mapInArrow(run, (schema + ", " if schema else "") + f"_rows {kind}")
    return out.select(*kept, F.inline("_rows"))


def column_names(columns: list) -> list[str]:
    return [c.name for c in _names(columns)]


def row_type(columns: list) -> str:
    """The Spark type of a document's rows."""
    return "array<struct<" + ",".join(f"`{c.name}`:{'int' if c.kind != 'path' else 'string' if c.type.lower() == 'json' else c.type}" for c in _names(columns)) + ">>"


def rows_function(path: str, columns: list):
    """A pandas UDF from a document to its rows as JSON text, for JSON_TABLE in a statement."""
    import pandas as pd
    from pyspark.sql.pandas.functions import PandasUDFType, pandas_udf

    names = _names(columns)

    def one(x):
        try:
            doc = json.loads(x) if x is not None else None
        except ValueError:
            return None
        return None if x is None else json.dumps([{c.name: r.get(c.name) for c in names} for r in rows(doc, path, columns)])

    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in xs], dtype=object)

    run.__annotations__ = {}
    return pandas_udf(run, "string", PandasUDFType.SCALAR)
