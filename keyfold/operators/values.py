"""Relations and the values that their rows hold, all by names of columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_numbers = count()


def fresh(hint: str = "c") -> str:
    return f"{hint[:24]}_{next(_numbers)}"


@dataclass
class Col:
    """A column expression; ``test`` is the bare condition of a value that is true or undefined."""

    column: Column
    test: Column | None = None
    literal: Any = None
    name: str | None = None


@dataclass
class Rec:
    """A record; ``present`` tells whether it is there at all where its fields may be undefined."""

    fields: dict[str, Any]
    present: Column | None = None
    present_name: str | None = None


@dataclass
class Tab:
    """A keyed collection that is a relation; ``bind`` gives columns for the variables that it depends on."""

    relation: Relation
    bind: dict[str, list[Column]] = field(default_factory=dict)
    present: Column | None = None
    bind_names: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Fun:
    call: Any


@dataclass
class Relation:
    """Rows by free variables and key. ``value`` holds Col and Rec over names of columns of ``df``."""

    df: DataFrame
    free: dict[str, list[str]]
    key: list[str]
    value: Any
    order: list[str] = field(default_factory=list)
    base: Any = None
    sort: list[tuple[Any, bool]] = field(default_factory=list)
    listed: bool = False

    def renamed(self, kinds: dict[str, Any]) -> Relation:
        """The same rows under fresh names, so that joins never confuse columns. ``kinds``: types of columns known by name."""
        names = {c: fresh(c.rsplit("_", 1)[0]) for c in self.df.columns}
        kinds.update({n: kinds[c] for c, n in names.items() if c in kinds})
        df = self.df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        value = rename(self.value, names)
        return Relation(df, {v: [names[c] for c in cs] for v, cs in self.free.items()}, [names[c] for c in self.key], value, [names[c] for c in self.order], self.base, self.sort, self.listed)


def named(name: str) -> Col:
    return Col(F.col(f"`{name}`"), name=name)


def columns(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def rename(value: Any, names: dict[str, str]) -> Any:
    if isinstance(value, Col):
        return named(names[value.name])
    if isinstance(value, Rec):
        present = names.get(value.present_name)
        return Rec({k: rename(v, names) for k, v in value.fields.items()}, F.col(f"`{present}`") if present else None, present)
    if isinstance(value, Tab):
        bound = {v: [names[c] for c in cs] for v, cs in value.bind_names.items()}
        return Tab(value.relation, {v: columns(cs) for v, cs in bound.items()}, None, bound)
    return value
