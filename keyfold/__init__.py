"""keyfold: declarative nested-data queries over logic variables, planned as Spark DataFrames."""

from .api import ColumnFunction, Table, Udf, compile, load, op, pipe, preload, query, run  # noqa: A004

__all__ = ["ColumnFunction", "Table", "Udf", "compile", "load", "op", "pipe", "preload", "query", "run"]
