"""Results as files and text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def printed(column: Column, kind: T.DataType) -> Column:
    """A field as text output shows it: doubles with four digits, floats with three, undefined as null."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        shown = F.format_string("%.4f" if isinstance(kind, T.DoubleType) else "%.3f", column)
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        shown = F.date_format(column, "yyyy-MM-dd")
    elif isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        shown = F.to_json(column)
    else:
        shown = column.cast("string")
    return F.coalesce(F.when(column.isNotNull(), shown), F.lit("null"))


def bar_lines(df: DataFrame) -> DataFrame:
    """One line per row, with ``|`` after every field."""
    return df.select(F.concat(*[F.concat(printed(F.col(f"`{f.name}`"), f.dataType), F.lit("|")) for f in df.schema]).alias("line"))


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """parquet, json (one object per line), csv (with header) or bars (``|`` after every field)."""
    if form == "bars":
        bar_lines(df).write.mode(mode).text(path)
    elif form == "csv":
        df.write.mode(mode).csv(path, header=True)
    else:
        df.write.mode(mode).format(form).save(path)


def lines(df: DataFrame, form: str = "json") -> Iterator[str]:
    """Lines of a result for the terminal, a partition at a time."""
    shown = bar_lines(df) if form == "bars" else df.select(F.to_json(F.struct("*")).alias("line"))
    for row in shown.toLocalIterator():
        yield row["line"]


def dumps(value: Any) -> str:
    return "undefined" if value is None else json.dumps(value, default=str)
