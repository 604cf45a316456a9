"""Scalar operators as Columns: undefined is NULL, comparisons give true or NULL, and no input raises; a whole number
that does not fit its type is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {"equal": "__eq__", "notEqual": "__ne__", "lessThan": "__lt__", "lessThanOrEqual": "__le__", "greaterThan": "__gt__", "greaterThanOrEqual": "__ge__"}
_BITS = {"8": 8, "16": 16, "32": 32, "64": 64}


def is_number(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.NumericType)


def is_plain(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.NumericType | T.StringType | T.BooleanType)


def is_time(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)


def number(x: Column, kind: T.DataType) -> Column:
    """A number as it is; anything else as the double it spells, or undefined."""
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(x, "$", "double")
    if isinstance(kind, T.MapType | T.ArrayType | T.StructType):
        return F.lit(None).cast("double")
    return x if is_number(kind) else x.cast("int").cast("double") if isinstance(kind, T.BooleanType) else x.try_cast("double")


def date_literal(value: int) -> Column:
    """yyyymmdd as a date."""
    return F.to_date(F.lit(str(value)), "yyyyMMdd")


def compare(op: str, a: Column, ka: T.DataType, b: Column, kb: T.DataType, literals=(None, None)) -> Column:
    """The bare condition; kinds that do not match are unequal, and their order is that of numbers."""
    la, lb = literals
    if is_time(ka) and isinstance(lb, int):
        b, kb = date_literal(lb), ka
    elif is_time(kb) and isinstance(la, int):
        a, ka = date_literal(la), kb
    for other, mine in ((ka, kb), (kb, ka)):
        if isinstance(mine, T.VariantType) and not isinstance(other, T.VariantType):
            as_other = "double" if is_number(other) else "boolean" if isinstance(other, T.BooleanType) else "string"
            if mine is kb:
                b, kb = F.try_variant_get(b, "$", as_other), T.DoubleType() if as_other == "double" else other
            else:
                a, ka = F.try_variant_get(a, "$", as_other), T.DoubleType() if as_other == "double" else other
    alike = is_number(ka) and is_number(kb) or ka == kb or is_time(ka) and is_time(kb) or isinstance(ka, T.StringType) and isinstance(kb, T.StringType)
    if not alike:
        if op == "equal":
            return F.lit(None).cast("boolean")
        if op == "notEqual":
            return a.isNotNull() & b.isNotNull()
        a, b = number(a, ka), number(b, kb)
    return getattr(a, _COMPARE[op])(b)


def arithmetic(op: str, a: Column, ka: T.DataType, b: Column, kb: T.DataType) -> Column:
    if op == "concat":
        return F.concat(text(a, ka), text(b, kb))
    a, b = number(a, ka), number(b, kb)
    if op == "plus":
        return F.try_add(a, b)
    if op == "minus":
        return F.try_subtract(a, b)
    if op == "times":
        return F.try_multiply(a, b)
    x, y = a.cast("double"), b.cast("double")
    if op == "fdiv":
        endless = F.when(x == 0, F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
        return F.when(y != 0, F.try_divide(x, y)).when(y == 0, endless)
    if op == "div":
        whole = F.try_divide(x, y)
        return F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole))
    return F.when(b != 0, F.try_mod(a, b))


def text(x: Column, kind: T.DataType) -> Column:
    """As the language prints it: whole doubles without a fraction."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("string")).otherwise(x.cast("string"))
    return F.try_variant_get(x, "$", "string") if isinstance(kind, T.VariantType) else x.cast("string")


def wrap(x: Column, kind: str) -> Column:
    """A whole number wrapped to i8 … i64 or u8 … u32, or rounded to f32 or f64 as a typed conversion does."""
    if kind[0] == "f":
        return x.cast("float" if kind == "f32" else "double")
    bits = _BITS[kind[1:]]
    if bits == 64:
        whole = x.cast("decimal(38,0)")
        span, half = F.lit(2**64).cast("decimal(38,0)"), F.lit(2**63).cast("decimal(38,0)")
        low = F.pmod(whole, span)
        return low if kind[0] == "u" else F.when(low >= half, low - span).otherwise(low).cast("long")
    low = x.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    return low if kind[0] == "u" else F.when(low >= (1 << (bits - 1)), low - (1 << bits)).otherwise(low)


def like(x: Column, pattern: str) -> Column:
    """Only % stands for other characters."""
    return x.like(pattern.replace("\\", "\\\\").replace("_", "\\_"))


def length(x: Column, kind: T.DataType) -> Column:
    return F.length(x) if isinstance(kind, T.StringType) else F.size(x) if isinstance(kind, T.ArrayType | T.MapType) else F.lit(len(kind)) if isinstance(kind, T.StructType) else F.lit(None).cast("int")


def year(x: Column, kind: T.DataType) -> Column:
    return F.year(x) if is_time(kind) else F.floor(x / 10000).cast("int")


def hour(x: Column, kind: T.DataType) -> Column:
    return F.hour(x) if is_time(kind) else F.pmod(F.floor(x.cast("double") / 3_600_000_000), F.lit(24)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
