"""Entry points: compile a query, run it over named inputs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from .operators.lower import Lowering
from .plans import ir
from .result import Result
from .sources.tables import ColumnFunction, Table, Udf, load, preload

__all__ = ["ColumnFunction", "Compiled", "Pipe", "Table", "Udf", "compile", "load", "op", "pipe", "preload", "query", "run"]

query = ir.query


class Compiled:
    def __init__(self, source: Any):
        self.node = ir.to_node(source)

    def run(self, spark: SparkSession, **inputs: Any) -> Result:
        return Result(Lowering(spark, inputs, self.node))

    __call__ = run


def compile(source: Any) -> Compiled:  # noqa: A001
    return Compiled(source)


def run(spark: SparkSession, source: Any, **inputs: Any) -> Result:
    return Compiled(source).run(spark, **inputs)


class _Operations:
    """``op.sum(x)``, ``op.group(x, key)`` …: one function for each operator."""

    def __getattr__(self, name: str):
        known = name.removesuffix("_maybe")

        def call(*args: Any):
            nodes = [ir.to_node(a) if not isinstance(a, str) or known not in ("get", "sort") else ir.const(a) if known == "sort" and a is not args[0] else ir.to_node(a) for a in args]
            if known == "group":
                return ir.group(nodes[1], nodes[0])
            if known == "keyval" or known == "merge":
                return ir.Node("keyval", None, tuple(nodes))
            if known == "object":
                return ir.record(list(zip(nodes[::2], nodes[1::2], strict=True)))
            return ir.operation(known + ("?" if known != name else ""), nodes)

        return call


op = _Operations()


class Pipe:
    """A fluent wrapper: pipe("data.*.value").sum(), .group(key), .map(f), .get(key)."""

    def __init__(self, source: Any):
        self.node = ir.to_node(source)

    def __getattr__(self, name: str):
        if name.startswith("_") or name == "node":
            raise AttributeError(name)

        def call(*args: Any) -> Pipe:
            if name == "group":
                return Pipe(ir.group(ir.to_node(args[0]), self.node))
            if name == "get":
                return Pipe(ir.get(self.node, ir.to_node(args[0])))
            if name == "map":
                return Pipe(ir.pure("apply", ir.to_node(args[0]), self.node))
            return Pipe(ir.operation(name, [self.node, *map(ir.to_node, args)]))

        return call


def pipe(source: Any) -> Pipe:
    return Pipe(source)
