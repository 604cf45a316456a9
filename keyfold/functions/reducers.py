"""Reducers as aggregate Columns over a value and the order of its rows."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import is_number, is_plain, is_time, number

#: What a reducer gives for no value at all; reducers that are not here give undefined. ``maybe`` variants always do.
EMPTY = {"sum": 0, "product": 1, "count": 0, "min": float("inf"), "max": float("-inf"), "all": True, "array": (), "mkset": {}}
#: Reducers for which a repeated row makes no difference.
IDEMPOTENT = {"single", "first", "last", "all", "any", "min", "max", "mkset", "print"}
#: Steps at which a double is cut for an exact sum. Parts are multiples of a step, so that their sums stay exact below 2^53 steps.
STEPS = (20, -8, -36)


def _finite(x: Column, kind: T.DataType) -> Column:
    x = number(x, kind)
    return F.when(~F.isnan(x), x) if not is_number(kind) or isinstance(kind, T.DoubleType | T.FloatType) else x


def _exact(x: Column) -> Column:
    """A sum of doubles in parts: neither the order of rows nor how they are dealt to tasks changes its last bits, and groups of the same
    values tie. This holds for values of 2^-12 to 2^72, sums below 2^73 and 60 million rows a group; bits beyond these bounds are rounded
    as in any sum of doubles."""

    def cut(v: Column, step: int) -> Column:
        return F.rint(v * 2.0**-step) * 2.0**step

    small = F.when(F.abs(x) < 2.0**72, x).otherwise(0.0)  # larger ones, infinity too, are multiples of the first step
    cuts = [cut(small, step) for step in STEPS] + [small]
    total = F.try_sum(cuts[-1] - cuts[-2])
    for coarse, fine in reversed([*zip(cuts, cuts[1:-1])]):
        total = F.try_sum(fine - coarse) + total
    return F.try_sum(cut(x, STEPS[0])) + total


def reduce(op: str, x: Column, kind: T.DataType, order: list[str], maybe: bool, exact: bool = False) -> Column:
    """The aggregate; ``order`` names the columns that order rows, used only by reducers that depend on it; ``exact`` is for sums."""
    place = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    if op == "sum":
        value = _finite(x, kind)
        whole = is_number(kind) and not isinstance(kind, T.DoubleType | T.FloatType)
        total = _exact(value.cast("double")) if exact and not whole else F.try_sum(value)
        return total if maybe else F.coalesce(total, F.lit(0))
    if op == "product":
        total = F.product(number(x, kind))
        return total if maybe else F.coalesce(total, F.lit(1.0))
    if op == "count":
        return F.nullif(F.count(x), F.lit(0)) if maybe else F.count(x)
    if op in ("min", "max"):
        best = (F.min if op == "min" else F.max)(x)
        return F.coalesce(best, F.lit(EMPTY[op])) if is_number(kind) and not maybe and isinstance(kind, T.DoubleType | T.FloatType) else best
    if op in ("single", "print"):
        return F.max(x) if is_plain(kind) or is_time(kind) else F.any_value(x, True)  # the greatest, where values differ
    if op in ("first", "any"):
        return F.min_by(x, F.when(x.isNotNull(), place))
    if op == "last":
        return F.max_by(x, F.when(x.isNotNull(), place))
    if op == "all":
        return F.when(F.count(F.lit(1)) == F.count(x), F.lit(True))
    if op == "array":
        rows = F.collect_list(F.when(x.isNotNull(), F.struct(place.alias("place"), x.alias("item"))))
        ordered = F.array_sort(rows, lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)) if order else rows
        items = F.transform(ordered, lambda r: r["item"])
        return F.when(F.size(items) > 0, items) if maybe else items
    if op == "mkset":
        keys = F.array_sort(F.collect_set(x))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.lit(True)))
    raise NameError(f"no reducer {op!r}")


def running(op: str, x: Column, kind: T.DataType, window: WindowSpec) -> Column:
    """The reducer over the rows of a window up to the current one."""
    if op in ("first", "any"):
        return F.first(x, True).over(window)
    if op == "last":
        return F.last(x, True).over(window)
    if op == "all":
        return F.when(F.count(F.lit(1)).over(window) == F.count(x).over(window), F.lit(True))
    if op == "array":
        return F.collect_list(x).over(window)
    if op == "mkset":
        keys = F.array_sort(F.collect_set(x).over(window))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.lit(True)))
    return (F.count(x) if op == "count" else reduce(op, x, kind, [], True)).over(window)


def alone(op: str, x: Column, kind: T.DataType, maybe: bool) -> Column:
    """What ``reduce`` gives for a group of one row."""
    if op in ("min", "max") and isinstance(kind, T.DoubleType | T.FloatType) and not maybe:
        return F.coalesce(x, F.lit(EMPTY[op]))
    one = only(op, x, kind, maybe)
    if op == "product":
        return one.cast("double")
    return one.cast("long") if op == "sum" and isinstance(kind, T.IntegralType) else one


def only(op: str, x: Column, kind: T.DataType, maybe: bool) -> Column:
    """A reducer over exactly one value."""
    if op == "count":
        one = F.when(x.isNotNull(), F.lit(1).cast("long"))
        return one if maybe else F.coalesce(one, F.lit(0).cast("long"))
    if op in ("sum", "product"):
        value = _finite(x, kind)
        return value if maybe else F.coalesce(value, F.lit(EMPTY[op]))
    if op == "array":
        return F.when(x.isNotNull(), F.array(x)) if maybe else F.filter(F.array(x), lambda v: v.isNotNull())
    if op == "all":
        return F.when(x.isNotNull(), F.lit(True))
    if op == "mkset":
        return F.when(x.isNotNull(), F.create_map(x, F.lit(True)))
    return x
