"""Inputs of queries: tables with a key, files, literals, functions."""

from __future__ import annotations

import inspect
import json
import re
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Table:
    """A DataFrame whose rows variables range over. ``key``: columns that tell rows apart (and order them); without
    one, rows are numbered as they are read."""

    df: DataFrame
    key: list[str] = field(default_factory=list)

    def __init__(self, df: DataFrame, key: str | list[str] | None = None):
        self.df, self.key = df, [key] if isinstance(key, str) else list(key or [])


@dataclass
class Udf:
    """A Python function of values, run on the executors; ``returns`` is a Spark type. ``vectorized`` functions get and give
    pandas Series, a batch at a time. A call with too few or too many arguments is refused when the query is planned."""

    function: Callable
    returns: str = "string"
    vectorized: bool = False

    def __call__(self, *args: Column) -> Column:
        try:
            inspect.signature(self.function).bind(*args)
        except TypeError as error:
            raise TypeError(f"{getattr(self.function, '__name__', 'function')}: {error}") from None
        except ValueError:  # built-in functions without a signature
            pass
        return (F.pandas_udf if self.vectorized else F.udf)(self.function, self.returns)(*args)


@dataclass
class ColumnFunction:
    """A function of Columns, which stays inside generated code."""

    function: Callable[..., Column]

    def __call__(self, *args: Column) -> Column:
        return self.function(*args)


def _kind(value: Any):
    """A loose type: None, a Spark type, ("list", item) or ("record", fields)."""
    if value is None:
        return None
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, list | tuple):
        item = None
        for v in value:
            item = _unify(item, _kind(v))
        return ("list", item)
    return ("record", {str(k): _kind(v) for k, v in value.items()})


class Mixed(TypeError):
    pass


def _unify(a, b):
    if a is None or a == b:
        return b
    if b is None:
        return a
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0]:
        if a[0] == "list":
            return ("list", _unify(a[1], b[1]))
        return ("record", {k: _unify(a[1].get(k), b[1].get(k)) for k in {**a[1], **b[1]}})
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    raise Mixed(f"{a} and {b}")


def _type(kind, record: bool = False) -> T.DataType:
    """Records whose fields share a type are maps, unless they stand for rows that others like them lack fields of."""
    if kind is None:
        return T.StringType()
    if not isinstance(kind, tuple):
        return kind
    if kind[0] == "list":
        return T.ArrayType(_type(kind[1]))
    try:
        common = None
        for v in kind[1].values():
            common = _unify(common, v)
        return T.MapType(T.StringType(), _type(common))
    except Mixed:
        return T.StructType([T.StructField(k, _type(v)) for k, v in kind[1].items()])


def literal(value: Any) -> Column:
    """A nested Python value as a constant column."""
    if value is None or isinstance(value, str | int | float | bool):
        return F.lit(value)
    try:
        return F.from_json(F.lit(json.dumps(value)), _type(_kind(value)))
    except Mixed:
        return F.parse_json(F.lit(json.dumps(value)))


def preload(table: Table) -> Table:
    """The table read once, when first used, and held by the executors (memory, then disk) for all queries over it."""
    return Table(table.df.persist(StorageLevel.MEMORY_AND_DISK), table.key)


def load(spark: SparkSession, form: str, path: str | list[str], schema: str | T.StructType | None = None) -> Table:
    """A file as a table: csv (header line, commas), tbl (| after every field, no header), ndjson, json, parquet."""
    reader = spark.read
    if form == "parquet":
        df = reader.parquet(*([path] if isinstance(path, str) else path))
    elif form == "csv":
        df = reader.schema(schema).csv(path, header=True, quote="", enforceSchema=True)
    elif form == "tbl":
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        df = reader.schema(T.StructType([*wanted.fields, T.StructField("kf_end", T.StringType())])).csv(path, sep="|", header=False, quote="").drop("kf_end")
    elif form == "ndjson":
        df = (reader.schema(schema) if schema else reader).json(path)
    elif form == "json":
        df = (reader.schema(schema) if schema else reader).json(path, multiLine=True)
    else:
        raise ValueError(f"no source {form!r}")
    return Table(df)


#: What stands before the path in a file's address.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"


def named_files(files: list[str], paths: list[str]) -> list[tuple[str, str]]:
    """(file without its scheme, path) of every file and the path among ``paths`` that named it or a folder above it."""
    bare = lambda p: re.sub(SCHEME, "/", p).rstrip("/")
    by, out = {bare(p): p for p in paths}, []
    for file in files:
        at = bare(urllib.parse.unquote(file))
        while at and at not in by:
            at = at.rpartition("/")[0]
        if at:
            out.append((bare(file), by[at]))
    return out
