"""Results of queries: flat DataFrames, and nested Python values for display and tests."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.lower import Frame, Lowering
from .operators.values import Col, Rec, Relation, Tab, columns


class Result:
    def __init__(self, lowering: Lowering):
        self.lowering = lowering
        self.frame = Frame(None, lowering.kinds)
        self.value = lowering.lazy(lowering.root, self.frame)

    def relation(self) -> Relation | None:
        return self.value.relation if isinstance(self.value, Tab) else None

    def df(self, limit: int | None = None, keys: bool | None = None) -> DataFrame:
        """One row per key. Records give a column per field, other values ``value``; ``keys`` adds key, key_1, …
        (by default only where values are not records). Nested groups of plain values unfold into further keys."""
        if not isinstance(self.value, Tab):
            return self.single()
        relation, held = self.value.relation, []
        while isinstance(relation.value, Tab) and not relation.listed:
            relation = relation.value.relation
            held = [c for v in relation.free for c in relation.free[v]]
        frame = Frame(relation.df, self.lowering.kinds)
        names = [*held, *relation.key]
        if isinstance(relation.value, Rec):
            fields = {k: self.lowering.as_column(frame, v) for k, v in relation.value.fields.items()}
            keys = bool(held) if keys is None else keys
        else:
            fields = {"value": self.lowering.as_column(frame, relation.value)}
            keys = (not relation.listed) if keys is None else keys
        out = [F.col(f"`{c}`").alias(f"key_{i}" if i else "key") for i, c in enumerate(names)] if keys else []
        df = frame.df.select(*out, *[c.alias(k) for k, c in fields.items()])
        if relation.sort:
            df = df.orderBy(*[F.col(f"`{f}`").desc() if down else F.col(f"`{f}`").asc() for f, down in relation.sort])
        return df if limit is None else df.limit(limit)

    def single(self) -> DataFrame:
        self.frame.rows(self.lowering.spark)
        if isinstance(self.value, Rec):
            fields = {k: self.lowering.as_column(self.frame, v) for k, v in self.value.fields.items() if v is not None}
        else:
            fields = {"value": self.lowering.as_column(self.frame, self.value)}
        return self.frame.df.select(*[c.alias(k) for k, c in fields.items()])

    def collect(self) -> Any:
        """The nested value: maps with text keys, lists, numbers; undefined parts are left out."""
        return plain(self._value(self.value, self.frame))

    def _value(self, value: Any, frame: Frame) -> Any:
        if isinstance(value, Tab):
            return self._whole(value.relation, frame)
        frame.rows(self.lowering.spark)
        if isinstance(value, Rec):
            return {k: self._value(v, frame) for k, v in value.fields.items() if v is not None}
        column = self.lowering.as_column(frame, value)
        row = frame.df.select(column.alias("x")).head()
        return row["x"] if row else None

    def _whole(self, relation: Relation, frame: Frame) -> Any:
        out: dict = {}
        if relation.base is not None:
            fixed = self.lowering.eval(relation.base, frame)
            out.update(self._value(fixed, frame) or {})
        rows = self._rows(relation)
        if relation.listed:
            return [v for _, _, v in rows]
        if all(len(key) == 1 and isinstance(key[0], list) for _, key, _ in rows):
            return self._tree(out, {tuple(key[0]): plain(v) for _, key, v in rows})
        for _, key, v in rows:
            self._put(out, key, v)
        return out

    @staticmethod
    def _tree(out: dict, at: dict[tuple, Any]) -> Any:
        """Values by path as one tree: what a path holds stands in what the path above it holds."""
        for path in sorted(at, key=len):
            if not path:
                out = at[path]
                continue
            above = out
            for k in path[:-1]:
                above = above.setdefault(k, {}) if isinstance(above, dict) else {}
            if isinstance(above, dict):
                above[path[-1]] = at[path]
        return out

    @staticmethod
    def _put(out: dict, key: tuple, value: Any) -> None:
        for k in key[:-1]:
            out = out.setdefault(str(k), {})
        out[str(key[-1])] = value

    def _rows(self, relation: Relation) -> list[tuple[tuple, tuple, Any]]:
        """(free, key, value) of every row, in order."""
        df = relation.df
        if relation.sort:
            fields = relation.value.fields
            df = df.orderBy(*[fields[f].column.desc() if down else fields[f].column.asc() for f, down in relation.sort])
        elif relation.order:
            df = df.orderBy(*columns(relation.order))
        nested: dict[int, dict] = {}
        frees = [c for v in relation.free for c in relation.free[v]]

        def build(value: Any, row) -> Any:
            if isinstance(value, Col):
                return row[value.name]
            if isinstance(value, Rec):
                return {k: build(v, row) for k, v in value.fields.items()}
            inner = value.relation
            if id(inner) not in nested:
                by: dict = {}
                for free, key, v in self._rows(inner):
                    if inner.listed:
                        by.setdefault(free, []).append(v)
                    else:
                        self._put(by.setdefault(free, {}), key, v)
                nested[id(inner)] = by
            at = tuple(row[c] for v in inner.free for c in value.bind_names[v])
            out = {}
            if inner.base is not None:
                out.update(nested_base(inner, at))
            found = nested[id(inner)].get(at)
            return found if isinstance(found, list) else {**out, **(found or {})}

        def nested_base(inner: Relation, at: tuple) -> dict:
            if ("base", id(inner)) not in nested:
                lowering = self.lowering
                names = list(inner.free)
                frame = Frame(inner.df.select(*columns([c for v in names for c in inner.free[v]])).distinct(), lowering.kinds)
                frame.vars = dict(inner.free)
                value = lowering.stored(frame, lowering.eval(inner.base, frame))
                rel = Relation(frame.df, {}, [c for v in names for c in inner.free[v]], value, [])
                nested["base", id(inner)] = {key: v for _, key, v in self._rows(rel)}
            return nested["base", id(inner)].get(at, {})

        return [(tuple(row[c] for c in frees), tuple(row[c] for c in relation.key), build(relation.value, row)) for row in df.collect()]


def plain(value: Any) -> Any:
    if hasattr(value, "toPython"):
        value = value.toPython()
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): x for k, v in value.items() if (x := plain(v)) is not None}
    if isinstance(value, list):
        return [x for v in value if (x := plain(v)) is not None]
    if isinstance(value, float) and abs(value) < 1e15 and value == int(value):
        return int(value)
    return value
