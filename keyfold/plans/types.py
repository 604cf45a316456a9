"""The language's type texts as Spark types: ``{a: string, b: i32, *K: f64}``, ``[T]``, ``"A"``, ``T|U``."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Names of scalar types.
SCALARS = {
    "boolean": T.BooleanType(), "string": T.StringType(), "char": T.StringType(), "date": T.DateType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "f32": T.FloatType(), "f64": T.DoubleType(), "unknown": T.VariantType(), "any": T.VariantType(), "never": T.NullType(), "nothing": T.NullType(),
}
_TOKEN = re.compile(r"""\s*(?:(\*?[A-Za-z_]\w*)|("[^"]*")|([{}\[\],:|&=()]|=>))""")


class TypeText:
    def __init__(self, text: str):
        self.parts = [m[0].strip() for m in _TOKEN.finditer(text)]
        if "".join(self.parts) != re.sub(r"\s", "", text):
            raise ValueError(f"no type: {text!r}")
        self.at = 0

    def peek(self) -> str:
        return self.parts[self.at] if self.at < len(self.parts) else ""

    def take(self, expected: str | None = None) -> str:
        word = self.peek()
        if expected and word != expected:
            raise ValueError(f"{expected!r} expected, {word!r} found")
        self.at += 1
        return word

    def any_of(self) -> T.DataType:
        kind = self.one()
        while self.peek() in ("|", "&"):
            self.take()
            other = self.one()
            kind = kind if kind == other else T.VariantType()
        return kind

    def one(self) -> T.DataType:
        word = self.take()
        if word == "[":
            item = self.any_of()
            self.take("]")
            return T.ArrayType(item)
        if word == "{":
            return self.record()
        if word.startswith('"'):
            return T.StringType()
        if word not in SCALARS:
            raise ValueError(f"no type {word!r}")
        return SCALARS[word]

    def record(self) -> T.DataType:
        fields: list[T.StructField] = []
        keyed: T.DataType | None = None
        while self.peek() != "}":
            name = self.take()
            key = T.StringType()
            if name.startswith("*"):
                key = SCALARS.get(name[1:], key)
                if self.peek() == "=":
                    self.take()
                    self.take()
            self.take(":")
            kind = self.any_of()
            if name.startswith("*"):
                keyed = T.MapType(key, kind)
            else:
                fields.append(T.StructField(name.strip('"'), kind))
            if self.peek() != ",":
                break
            self.take()
        self.take("}")
        return keyed if keyed is not None and not fields else T.StructType(fields)


def parse_type(text: str) -> T.DataType:
    reader = TypeText(text)
    kind = reader.any_of()
    if reader.peek():
        raise ValueError(f"unexpected {reader.peek()!r}")
    return kind


def row_type(text: str) -> T.StructType:
    """The rows of a table type: ``{*u32: {a: string}}`` or ``[{a: string}]`` or ``{a: string}``."""
    kind = parse_type(text)
    kind = kind.valueType if isinstance(kind, T.MapType) else kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not isinstance(kind, T.StructType):
        raise ValueError(f"no rows in {text!r}")
    return kind
