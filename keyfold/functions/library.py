"""Functions that queries find under ``udf``: column functions in generated code, by the names that puzzles and
scripts in the language commonly use."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import ColumnFunction


def _paths(text):
    out = []

    def visit(path, value):
        out.append((path, json.dumps(value)))
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for k, v in items:
            if v is not None:
                visit([*path, str(k)], v)

    if text is not None:
        visit([], json.loads(text))
    return out


#: All paths of a JSON text with the JSON below them; built-in functions cannot recurse.
tree_paths = F.udf(_paths, T.ArrayType(T.StructType([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("value", T.StringType())])))


def _split(text: Column, separator: Column) -> Column:
    return F.when(separator == "", F.filter(F.split(text, F.lit("")), lambda c: c != "")).otherwise(F.split(text, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), -1))


def _range(start: Column, stop: Column, step: Column) -> Column:
    """From start in steps up to, without, stop; a negative step goes down, a step of 0 nowhere."""
    some = ((step > 0) & (start < stop)) | ((step < 0) & (start > stop))
    return F.when(some, F.sequence(start, stop - F.when(step > 0, 1).otherwise(-1), step)).otherwise(F.array().cast("array<int>"))


def _truth(x: Column) -> Column:
    return F.coalesce(x.cast("boolean"), F.lit(False))


FUNCTIONS = {
    "udf": {
        name: ColumnFunction(f)
        for name, f in {
            "split": lambda separator, text: _split(text, separator),
            "matchAll": lambda pattern, text: F.regexp_extract_all(text, pattern, F.lit(0)),
            "toNum": lambda x: x.try_cast("double"),
            "asString": lambda x: x.cast("string"),
            "isEqual": lambda a, b: a == b,
            "notEqual": lambda a, b: a != b,
            "isLessThan": lambda a, b: a < b,
            "isLessOrEqual": lambda a, b: a <= b,
            "isGreaterThan": lambda a, b: a > b,
            "isGreaterOrEqual": lambda a, b: a >= b,
            "logicalAnd": lambda a, b: _truth(a) & _truth(b),
            "logicalOr": lambda a, b: _truth(a) | _truth(b),
            "ifThenElse": lambda p, a, b: F.when(_truth(p), a).otherwise(b),
            "exp": lambda n, x: F.pow(x, n),
            "modulo": lambda a, b: F.try_mod(a, b),
            "sqrt": F.sqrt,
            "floor": F.floor,
            "ceil": F.ceil,
            "abs": F.abs,
            "int2Char": lambda x: F.char(x),
            "range": _range,
            "slice": lambda n, xs: F.slice(xs, n + 1, F.greatest(F.size(xs) - n, F.lit(0))),
            "join": lambda separator, xs: F.call_function("array_join", F.transform(xs, lambda x: x.cast("string")), separator.cast("string")),
            "sort": F.sort_array,
            "values": F.map_values,
            "jsonNumber": lambda text, field: F.call_function("get_json_object", text, F.concat(F.lit("$['"), field, F.lit("']"))).try_cast("long"),
        }.items()
    }
}
