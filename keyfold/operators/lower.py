"""Analysed queries to DataFrames.

The domain of some variables is the join of every collection that they range over (and of those that these depend on).
A reducer aggregates its argument over the domain of its free, bound and hidden variables, grouped by the free ones;
reducers over the same domain share one aggregation. A group is a relation keyed by its free variables and its key; it
is never built as a map unless a query uses it as a plain value. Lookups, references to reducers and optional
collections are left joins, definedness becomes a filter, so Catalyst sees an ordinary plan of joins and aggregations.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import library, reducers, scalars
from ..plans.ir import Node
from ..plans.scope import Scopes
from ..sources import tables
from .values import Col, Fun, Rec, Relation, Tab, columns, fresh, named

_COMPARISONS = {"equal", "notEqual", "lessThan", "lessThanOrEqual", "greaterThan", "greaterThanOrEqual"}
#: Hints that Spark's planner knows; a hint of another name changes nothing.
_HINTS = {"broadcast", "merge", "shuffle_merge", "shuffle_hash", "shuffle_replicate_nl", "rebalance"}
_ARITHMETIC = {"plus", "minus", "times", "fdiv", "div", "mod", "concat"}


class Frame:
    """A DataFrame under construction with the columns of its variables and the values of terms met so far."""

    def __init__(self, df: DataFrame | None, kinds: dict[str, T.DataType]):
        self.df, self.kinds = df, kinds
        self.vars: dict[str, list[str]] = {}
        self.order: dict[str, list[str]] = {}
        self.known: dict[str, Any] = {}
        #: Columns that no two rows have alike, if any are known: a declared key and what it was joined to by key.
        self.unique: list[str] | None = None

    def rows(self, spark: SparkSession) -> DataFrame:
        if self.df is None:
            self.df = spark.range(1).select(F.lit(1).alias(fresh("one")))
        return self.df

    def kind(self, column: Column) -> T.DataType:
        """The type of a column. Names are never used twice, so a text of a column always means the same type."""
        text = str(column)[8:-2]  # without Column<'…'>
        if text not in self.kinds:
            self.kinds[text] = self.df.select(column.alias("x")).schema["x"].dataType
        return self.kinds[text]

    def add(self, new: dict[str, Column]) -> None:
        if new:
            self.df = self.df.withColumns(new)

    def where(self, condition: Column) -> None:
        self.df = self.df.where(condition)

    def order_of(self, names) -> list[str]:
        return list(dict.fromkeys(c for v in names for c in self.order.get(v, self.vars.get(v, []))))


class Lowering:
    def __init__(self, spark: SparkSession, catalog: dict[str, Any], root: Node):
        self.spark, self.catalog = spark, catalog
        self.kinds: dict[str, T.DataType] = {}
        self.scopes = Scopes(root)
        self.root = self.scopes.root
        if self.scopes.out:
            out = self.scopes.out
            wrap = Node("group", None, (Node("const", {}), Node("pure", "vars", tuple(Node("var", v) for v in out)), self.root))
            for k in (*wrap.args[1].args, wrap.args[1]):
                k.free = out if k is wrap.args[1] else (k.op,)
                k.uses = k.free
            wrap.bound, wrap.free = out, ()
            wrap.hidden = tuple(v for v in self.scopes.closure(out) if v not in out)
            self.root = wrap
        self.ranges: dict[str, list[Node]] = {}
        for n in self.root.walk():
            if n.kind == "get" and n.args[1].kind == "var":
                seen = self.ranges.setdefault(n.args[1].op, [])
                if all(m.sign() != n.sign() for m in seen):
                    seen.append(n)
        self.reduced: dict[str, Relation] = {}
        self.grouped: dict[str, Relation] = {}
        self.inputs: dict[str, Any] = {}
        self.busy: set[str] = set()
        #: Sums that == or != compares: groups of the same values must tie in whatever order rows come.
        self.compared = {m.sign() for n in self.root.walk() if n.kind == "pure" and n.op in ("equal", "notEqual") for m in n.walk() if m.kind == "agg" and m.op == "sum"}

    # ---- domains ----

    def domain(self, names: tuple[str, ...]) -> Frame:
        """A frame with one row for each combination of keys of the variables, in terms of all their collections."""
        frame, todo = Frame(None, self.kinds), list(self.scopes.closure(names))
        waiting = [g for v in todo for g in self.ranges.get(v, [])]
        while waiting:
            ready = [g for g in waiting if all(v in frame.vars for v in g.args[0].free)]
            if not ready:
                raise ValueError(f"variables {todo} depend on each other in a circle")
            plain = [g for g in ready if g.mode != "maybe"]
            placed = [g for g in plain if g.args[1].op in frame.vars]
            if placed or plain:
                g = (placed or plain)[0]
                self.range_over(frame, g)
                waiting.remove(g)
                continue
            v = ready[0].args[1].op
            if any(g.args[1].op == v and g.mode != "maybe" for g in waiting):
                blocked = [g for g in ready if g.args[1].op != v]
                if not blocked:
                    raise ValueError(f"an optional collection of {v} comes before the others")
                v = blocked[0].args[1].op
            mine = [g for g in ready if g.args[1].op == v]
            if v not in frame.vars:
                self.union_of(frame, v, mine)
            for g in mine:
                self.optionally(frame, g)
                waiting.remove(g)
        return frame

    def union_of(self, frame: Frame, v: str, mine: list[Node]) -> None:
        """The keys of a variable that only optional collections have: those of any of them."""
        start, parts = (frame.df, dict(frame.vars), dict(frame.order), dict(frame.known)), []
        for g in mine:
            part = Frame(start[0], self.kinds)
            part.vars, part.order, part.known = dict(start[1]), dict(start[2]), dict(start[3])
            self.range_over(part, g)
            parts.append(part)
        held = [c for cs in start[1].values() for c in cs]
        names = [fresh(v) for _ in parts[0].vars[v]]
        kinds = [{p.df.schema[c].dataType.simpleString() for p in parts for c in [p.vars[v][i]]} for i in range(len(names))]
        keys = None
        for p in parts:
            cols = [F.col(f"`{c}`").cast("string") if len(kinds[i]) > 1 else F.col(f"`{c}`") for i, c in enumerate(p.vars[v])]
            one = p.df.select(*columns(held), *[c.alias(n) for c, n in zip(cols, names, strict=True)])
            keys = one if keys is None else keys.unionByName(one)
        keys = keys.distinct()
        if start[0] is None or not held:
            frame.df = keys if start[0] is None else frame.df.crossJoin(keys)
        else:
            other = {c: fresh("u") for c in held}
            keys = keys.select(*[F.col(f"`{c}`").alias(n) for c, n in other.items()], *columns(names))
            on = [F.col(f"`{c}`") == F.col(f"`{n}`") for c, n in other.items()]
            frame.df = frame.df.join(keys, on, "inner").drop(*other.values())
        frame.vars[v] = frame.order[v] = names
        frame.unique = None

    def optionally(self, frame: Frame, g: Node) -> None:
        base = self.eval(g.args[0], frame)
        key = columns(frame.vars[g.args[1].op])
        frame.known[g.sign()] = self.lookup(frame, base, key)

    def range_over(self, frame: Frame, g: Node) -> None:
        """Binds the variable to the keys of a collection, or keeps rows whose key it has."""
        source, v = g.args[0], g.args[1].op
        if source.kind == "setof":
            parts = source.args[0].args if source.args[0].kind == "pure" and source.args[0].op == "combine" else source.args
            frame.rows(self.spark)
            values = [self.eval(self.without_conditions(frame, p), frame) for p in parts]
            cols = [self.as_column(frame, x) for x in values]
            for i, c in enumerate(cols):
                if isinstance(frame.kind(c), T.VariantType):  # variants cannot be keys of groups
                    cols[i], values[i] = F.try_variant_get(c, "$", "string"), Col(F.try_variant_get(c, "$", "string"))
            if v in frame.vars:
                for a, b in zip(columns(frame.vars[v]), cols, strict=True):
                    frame.where(a == b)
            else:
                names = [x.name if x.name else fresh(v) for x in map(self._bare, values)]
                frame.add({n: c for n, c, x in zip(names, cols, values, strict=True) if self._bare(x).name is None})
                for n in names:
                    frame.where(F.col(f"`{n}`").isNotNull())
                frame.vars[v] = frame.order[v] = names
                frame.known[f"key {v}"] = [p.sign() for p in parts]
            frame.known[g.sign()] = Col(F.lit(True))
            return
        base = self.lazy(source, frame)
        if isinstance(base, Tab) and not v.startswith("**"):
            relation = base.relation.renamed(self.kinds)
            on = [a == b for w, cs in base.bind.items() if w in relation.free for a, b in zip(cs, columns(relation.free[w]), strict=True)]
            if v in frame.vars:
                on += self.equal_keys(frame, columns(frame.vars[v]), relation.df, relation.key)
            by_key = v in frame.vars and all(w in base.bind for w in relation.free)
            if frame.df is None:
                frame.df = relation.df
                frame.unique = None if relation.free else relation.key
            else:
                frame.unique = frame.unique if by_key else None
                frame.df = frame.df.join(relation.df, on, "inner") if on else frame.df.crossJoin(relation.df)
            if v not in frame.vars:
                frame.vars[v], frame.order[v] = relation.key, relation.order or relation.key
            frame.known[g.sign()] = relation.value
            return
        frame.rows(self.spark)
        column = self.as_column(frame, base)
        kind = frame.kind(column)
        if v.startswith("**"):
            self.range_over_paths(frame, g, column, kind)
            return
        if isinstance(kind, T.VariantType):
            listed = F.schema_of_variant(column).startswith("ARRAY")
            items = F.try_variant_get(column, "$", "array<variant>")
            numbered = F.map_from_arrays(F.transform(items, lambda _, i: i.cast("string")), items)
            column = F.when(listed, numbered).otherwise(F.try_variant_get(column, "$", "map<string,variant>"))
            kind = frame.kind(column)
        if isinstance(kind, T.StructType):
            if len({f.dataType.simpleString() for f in kind}) > 1:
                column = F.struct(*[(column[f.name].cast("variant") if scalars.is_plain(f.dataType) else F.parse_json(F.to_json(column[f.name]))).alias(f.name) for f in kind])
                kind = frame.kind(column)
            column = F.map_from_arrays(F.array(*[F.lit(f.name) for f in kind]), F.array(*[column[f.name] for f in kind]))
            kind = frame.kind(column)
        if isinstance(kind, T.StringType):
            column, kind = F.filter(F.split(column, ""), lambda c: c != ""), T.ArrayType(T.StringType())
        if v in frame.vars:
            found = self.element(frame, column, kind, F.col(f"`{frame.vars[v][0]}`"))
            name = fresh("v")
            frame.add({name: found})
            frame.where(F.col(f"`{name}`").isNotNull())
            frame.known[g.sign()] = named(name)
            return
        place, item, key = fresh("place"), fresh("v"), fresh(v)
        frame.unique = None
        if isinstance(kind, T.MapType):
            entry = fresh("entry")
            frame.df = frame.df.select("*", F.posexplode(F.map_entries(column)).alias(place, entry))
            frame.add({key: F.col(f"`{entry}`.key"), item: F.col(f"`{entry}`.value")})
            frame.order[v] = [place]
        elif isinstance(kind, T.ArrayType):
            frame.df = frame.df.select("*", F.posexplode(column).alias(key, item))
            frame.order[v] = [key]
        else:
            frame.add({key: F.lit(None).cast("string"), item: F.lit(None).cast("string")})
        frame.where(F.col(f"`{item}`").isNotNull())
        frame.vars[v] = [key]
        frame.known[g.sign()] = named(item)

    def range_over_paths(self, frame: Frame, g: Node, column: Column, kind: T.DataType) -> None:
        """Binds the variable to the paths of a tree (lists of keys), the root first, each before what lies below it."""
        v = g.args[1].op
        whole = column if isinstance(kind, T.VariantType) else column.cast("variant") if scalars.is_plain(kind) else F.parse_json(F.to_json(column))
        place, entry, item = fresh("place"), fresh("entry"), fresh("v")
        frame.unique = None
        frame.df = frame.df.select("*", F.posexplode(library.tree_paths(F.to_json(whole))).alias(place, entry))
        path = F.col(f"`{entry}`.path")
        if v in frame.vars:
            frame.where(path == F.col(f"`{frame.vars[v][0]}`"))
            frame.add({item: F.parse_json(F.col(f"`{entry}`.value"))})
        else:
            key = fresh("path")
            frame.add({key: path, item: F.parse_json(F.col(f"`{entry}`.value"))})
            frame.vars[v], frame.order[v] = [key], [place]
        frame.known[g.sign()] = named(item)

    @staticmethod
    def _bare(value: Any) -> Any:
        return value if isinstance(value, Col) else Col(None)

    def without_conditions(self, frame: Frame, n: Node) -> Node:
        """``c & x`` as a key: keeps rows with c and gives x, so that filters stand in the open."""
        while n.kind == "pure" and n.op == "and":
            self.restrict(frame, n.args[0])
            n = n.args[1]
        return n

    def restrict(self, frame: Frame, n: Node) -> None:
        """Keeps rows for which a condition holds; a lookup that must find nothing is an anti join."""
        if n.kind == "pure" and n.op in ("and", "andAlso"):
            for part in n.args:
                self.restrict(frame, part)
        elif not (n.kind == "pure" and n.op == "isUndef" and self.without_partner(frame, n.args[0])):
            frame.where(self.defined(n, frame))

    def without_partner(self, frame: Frame, n: Node) -> bool:
        """Drops the rows whose lookup finds something; False where the term is no lookup in a relation or is joined already."""
        if n.kind != "get" or n.args[0].kind == "input" or n.args[1].kind in ("const", "var") or n.sign() in frame.known:
            return False
        base = self.eval(n.args[0], frame)
        if not isinstance(base, Tab) or base.present is not None:
            return False
        frame.rows(self.spark)
        key = n.args[1].args if n.args[1].kind == "pure" and n.args[1].op in ("combine", "vars") else n.args[1:]
        cols = [c for p in key for c in (columns(frame.vars[p.op]) if p.kind == "var" else [self.column(p, frame)])]
        relation = base.relation.renamed(self.kinds)
        on = [a == b for w, cs in base.bind.items() if w in relation.free for a, b in zip(cs, columns(relation.free[w]), strict=True)]
        on += self.equal_keys(frame, cols, relation.df, relation.key)
        there = Frame(relation.df, self.kinds)
        there.where(self.has_value(there, relation.value))
        frame.df = frame.df.join(there.df, on, "left_anti")
        return True

    def equal_keys(self, frame: Frame, mine: list[Column], df: DataFrame, names: list[str]) -> list[Column]:
        out = []
        for a, name in zip(mine, names, strict=True):
            b = F.col(f"`{name}`")
            ka, kb = frame.kind(a), self.kinds.get(name) or df.schema[name].dataType
            if ka != kb and not (scalars.is_number(ka) and scalars.is_number(kb)):
                a, b = a.cast("string"), b.cast("string")
            out.append(a == b)
        return out

    def element(self, frame: Frame, column: Column, kind: T.DataType, key: Column) -> Column:
        if isinstance(kind, T.VariantType):
            inner, items = F.try_variant_get(column, "$", "map<string,variant>"), F.try_variant_get(column, "$", "array<variant>")
            return F.coalesce(F.try_element_at(inner, key.cast("string")), F.get(items, key.try_cast("int")))
        if isinstance(kind, T.ArrayType):
            at = key if scalars.is_number(frame.kind(key)) else key.try_cast("double")
            return F.when((at == F.floor(at)) & (at >= 0), F.get(column, at.cast("int")))
        if isinstance(kind, T.MapType):
            return F.try_element_at(column, key.cast(kind.keyType) if scalars.is_number(frame.kind(key)) else key.try_cast(kind.keyType))
        if isinstance(kind, T.StructType):
            out = F.lit(None)
            for f in kind:
                out = F.when(key.cast("string") == f.name, column[f.name]).otherwise(out)
            return out
        return F.lit(None).cast("string")

    # ---- terms ----

    def eval(self, n: Node, frame: Frame) -> Any:
        sign = n.sign()
        if sign not in frame.known:
            frame.known[sign] = getattr(self, "eval_" + n.kind)(n, frame)
        return frame.known[sign]

    def lazy(self, n: Node, frame: Frame) -> Any:
        """Like eval, but a list stays a relation of its items."""
        if n.kind == "agg" and n.op == "array" and n.bound:
            relation = self.listed(n)
            return Tab(relation, {v: columns(frame.vars[v]) for v in n.free})
        if n.kind == "pure" and n.op == "sort":
            return self.eval_sort(n, frame)
        return self.eval(n, frame)

    def column(self, n: Node, frame: Frame) -> Column:
        return self.as_column(frame, self.eval(n, frame))

    def defined(self, n: Node, frame: Frame) -> Column:
        """A condition for the term to be defined, as plain as possible."""
        if n.kind == "pure" and n.op in ("and", "andAlso"):
            return self.defined(n.args[0], frame) & self.defined(n.args[1], frame)
        if n.kind == "pure" and n.op == "orElse":
            return F.coalesce(self.defined(n.args[0], frame), F.lit(False)) | F.coalesce(self.defined(n.args[1], frame), F.lit(False))
        if n.kind == "pure" and n.op == "isUndef":
            return ~F.coalesce(self.defined(n.args[0], frame), F.lit(False))
        value = self.eval(n, frame)
        if isinstance(value, Col):
            return value.test if value.test is not None else value.column.isNotNull()
        if isinstance(value, Rec):
            return self.present(frame, value)
        if isinstance(value, Tab) and value.present is not None:
            return value.present
        return F.lit(True)

    def present(self, frame: Frame, value: Rec) -> Column:
        if value.present is not None:
            return value.present
        out = F.lit(False)
        for x in value.fields.values():
            inner = x.column.isNotNull() if isinstance(x, Col) else self.present(frame, x) if isinstance(x, Rec) else F.lit(True)
            out = out | inner
        return out

    def as_column(self, frame: Frame, value: Any) -> Column:
        if isinstance(value, Col):
            return value.column
        if isinstance(value, Rec):
            if not value.fields:
                return F.lit(None).cast("string")
            whole = F.struct(*[self.as_column(frame, v).alias(k) for k, v in value.fields.items()])
            return F.when(self.present(frame, value), whole)
        if isinstance(value, Tab):
            return self.collected(frame, value)
        raise TypeError(f"{value!r} is no value")

    def collected(self, frame: Frame, value: Tab) -> Column:
        """A keyed relation as a map (a list as an array), for the rows of the frame that it belongs to."""
        relation = value.relation.renamed(self.kinds)
        inner = Frame(relation.df, self.kinds)
        item = self.as_column(inner, relation.value)
        frees = [c for v in value.bind for c in relation.free[v]]
        order = F.struct(*columns(relation.order or relation.key))
        key = F.concat_ws(",", *[c.cast("string") for c in columns(relation.key)])
        rows = inner.df.where(item.isNotNull()).groupBy(*columns(frees)).agg(F.collect_list(F.struct(order.alias("place"), key.alias("k"), item.alias("v"))).alias("rows"))
        placed = F.array_sort(F.col("rows"), lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))
        name = fresh("map")
        built = F.transform(placed, lambda r: r["v"]) if relation.listed else F.map_from_arrays(F.transform(placed, lambda r: r["k"]), F.transform(placed, lambda r: r["v"]))
        rows = rows.select(*columns(frees), built.alias(name))
        on = [a == b for v, cs in value.bind.items() for a, b in zip(cs, columns(relation.free[v]), strict=True)]
        frame.rows(self.spark)
        frame.df = frame.df.join(rows, on, "left") if on else frame.df.crossJoin(rows)
        return F.col(f"`{name}`")

    def eval_const(self, n: Node, frame: Frame) -> Any:
        if isinstance(n.op, dict):
            return Rec({})
        return Col(F.lit(n.op), literal=n.op)

    def eval_input(self, n: Node, frame: Frame) -> Any:
        return Rec({k: None for k in self.catalog})

    def eval_var(self, n: Node, frame: Frame) -> Any:
        names = frame.vars[n.op]
        if len(names) > 1:
            return Col(F.struct(*columns(names)))
        if n.op.startswith("K"):
            return named(names[0])
        kind = frame.kind(F.col(f"`{names[0]}`"))
        return named(names[0]) if isinstance(kind, T.StringType | T.ArrayType) else Col(F.col(f"`{names[0]}`").cast("string"))

    def eval_setof(self, n: Node, frame: Frame) -> Any:
        x = self.column(n.args[0], frame)
        return Col(F.when(x.isNotNull(), F.create_map(x, F.lit(True))))

    def named_input(self, name: str) -> Any:
        if name not in self.inputs:
            if name not in self.catalog:
                return Col(F.lit(None).cast("string"))
            self.inputs[name] = self.source(self.catalog[name], name)
        return self.inputs[name]

    def source(self, x: Any, name: str) -> Any:
        if isinstance(x, DataFrame):
            x = tables.Table(x)
        if isinstance(x, tables.Table):
            df, key = x.df, x.key
            if not key:
                key = [fresh("row")]
                df = df.withColumn(key[0], F.monotonically_increasing_id())
            marker, names = fresh("there"), {f.name: fresh(f.name) for f in df.schema}
            self.kinds.update({names[f.name]: f.dataType for f in df.schema})
            df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.lit(True).alias(marker))
            value = Rec({c: named(names[c]) for c in x.df.columns}, F.col(f"`{marker}`"), marker)
            key = [names[c] for c in key]
            return Tab(Relation(df, {}, key, value, key))
        if isinstance(x, tables.Udf | tables.ColumnFunction):
            return Fun(x)
        if isinstance(x, dict) and any(isinstance(v, DataFrame | tables.Table | tables.Udf | tables.ColumnFunction) for v in x.values()):
            return Rec({k: self.source(v, k) for k, v in x.items()}, F.lit(True))
        return Col(tables.literal(x))

    def eval_load(self, n: Node, frame: Frame) -> Any:
        schema = n.args[1].op if len(n.args) > 1 else None
        if n.args[0].kind == "const":
            return self.source(tables.load(self.spark, n.op, n.args[0].op, schema), str(n.args[0].op))
        # names that a query computes: all files in one scan, joined back to the rows that name them
        names = self.domain(n.args[0].free)
        file, listed = fresh("file"), fresh("listed")
        names.add({listed: self.column(n.args[0], names)})
        free = {v: names.vars[v] for v in n.args[0].free}
        rows = names.df.select(*columns([c for cs in free.values() for c in cs]), F.col(f"`{listed}`"))
        paths = [r[0] for r in names.df.select(F.col(f"`{listed}`")).where(F.col(f"`{listed}`").isNotNull()).distinct().collect()]
        whole = tables.load(self.spark, n.op, sorted(paths), schema).df
        fields, row, place = whole.columns, fresh("row"), fresh("place")
        whole = whole.withColumn(place, F.regexp_replace("_metadata.file_path", tables.SCHEME, "/")).withColumn(row, F.monotonically_increasing_id())
        found = F.broadcast(self.spark.createDataFrame(tables.named_files(whole.inputFiles(), paths), f"`{place}_` string, `{file}` string"))
        joined = whole.join(found, F.col(f"`{place}`") == F.col(f"`{place}_`")).join(rows, F.col(f"`{file}`") == F.col(f"`{listed}`"))
        return Tab(Relation(joined, free, [row], Rec({c: named(c) for c in fields}), [row]), {v: columns(frame.vars[v]) for v in free})

    def eval_get(self, n: Node, frame: Frame) -> Any:
        base, key = n.args
        if base.kind == "input" and key.kind == "const":
            return self.named_input(key.op)
        if key.kind == "var" and n.sign() in frame.known:
            return frame.known[n.sign()]
        value = self.lazy(base, frame) if base.kind == "pure" and base.op == "sort" else self.eval(base, frame)
        if isinstance(value, Rec):
            if key.kind == "const":
                found = value.fields.get(str(key.op))
                return found if found is not None else Col(F.lit(None).cast("string"))
            value = Col(self.as_column(frame, value))
        if isinstance(value, Tab):
            if key.kind == "const" and isinstance(value.relation.base, Node):
                fixed = self.eval(value.relation.base, frame)
                if isinstance(fixed, Rec) and str(key.op) in fixed.fields:
                    return fixed.fields[str(key.op)]
            parts = key.args if key.kind == "pure" and key.op in ("combine", "vars") else (key,)
            cols = [c for p in parts for c in (columns(frame.vars[p.op]) if p.kind == "var" else [self.column(p, frame)])]
            return self.lookup(frame, value, cols)
        frame.rows(self.spark)
        column, kind = value.column, frame.kind(value.column)
        if key.kind == "const" and isinstance(kind, T.StructType):
            return Col(column[str(key.op)]) if str(key.op) in kind.names else Col(F.lit(None).cast("string"))
        where = F.col(f"`{frame.vars[key.op][0]}`") if key.kind == "var" else self.column(key, frame)
        return Col(self.element(frame, column, kind, where))

    def lookup(self, frame: Frame, value: Any, key: list[Column]) -> Any:
        """The value at a key, by a left join where the collection is a relation."""
        frame.rows(self.spark)
        if not isinstance(value, Tab):
            column = self.as_column(frame, value)
            return Col(self.element(frame, column, frame.kind(column), key[0]))
        relation = value.relation.renamed(self.kinds)
        on = [a == b for w, cs in value.bind.items() if w in relation.free for a, b in zip(cs, columns(relation.free[w]), strict=True)]
        on += self.equal_keys(frame, key, relation.df, relation.key)
        frame.df = frame.df.join(relation.df, on, "left")
        found = relation.value
        there = F.col(f"`{relation.key[0]}`").isNotNull()
        if isinstance(found, Rec):
            return Rec(found.fields, there)
        if isinstance(found, Tab):
            return Tab(found.relation, found.bind, there, found.bind_names)
        return found

    def eval_pure(self, n: Node, frame: Frame) -> Any:
        op, args = n.op, n.args
        if op == "mkTuple":
            return Rec({str(args[i].op): self.eval(args[i + 1], frame) for i in range(0, len(args), 2)})
        if op in ("and", "andAlso"):
            return self.guarded(frame, self.defined(args[0], frame), self.eval(args[1], frame), args[1])
        if op == "orElse":
            return self.either(frame, args)
        if op == "ifElse":
            c, a, b = self.defined(args[0], frame), self.eval(args[1], frame), self.eval(args[2], frame)
            return Col(F.when(c, self.as_column(frame, a)).otherwise(self.as_column(frame, b)))
        if op == "isUndef":
            test = self.defined(n, frame)
            return Col(F.when(test, F.lit(True)), test)
        if op == "sort":
            return self.eval_sort(n, frame)
        if op == "put":
            return self.updated(n, frame)
        if op == "hint":
            value = self.eval(args[-1], frame)
            if isinstance(args[0].op, str) and args[0].op.lower() in _HINTS and frame.df is not None:
                frame.df = frame.df.hint(args[0].op)
            return value
        if op == "apply":
            function = self.eval(args[0], frame)
            if not isinstance(function, Fun):
                return Col(F.lit(None).cast("string"))
            return Col(function.call(*[self.column(a, frame) for a in args[1:]]))
        if op in ("combine", "vars"):
            return Col(F.struct(*[self.column(a, frame) for a in args]))
        frame.rows(self.spark)
        values = [self.eval(a, frame) for a in args]
        cols = [self.as_column(frame, v) for v in values]
        kinds = [frame.kind(c) for c in cols]
        literals = [v.literal if isinstance(v, Col) else None for v in values]
        if op in _COMPARISONS:
            test = scalars.compare(op, cols[0], kinds[0], cols[1], kinds[1], (literals[0], literals[1]))
            return Col(F.when(test, F.lit(True)), test)
        if op in _ARITHMETIC:
            return Col(scalars.arithmetic(op, cols[0], kinds[0], cols[1], kinds[1]))
        if op == "like":
            test = scalars.like(cols[0], args[1].op)
            return Col(F.when(test, F.lit(True)), test)
        if op == "substr":
            return Col(F.substring(cols[0], cols[1].cast("int") + 1, (cols[2] - cols[1]).cast("int")))
        if op == "join":
            return Col(F.array_join(F.transform(cols[0], lambda x: x.cast("string")), ","))
        if op == "flatten":
            return Col(F.concat(*self.alike(cols, kinds)))
        if op == "singleton":
            return Col(F.when(cols[0].isNotNull(), F.create_map(cols[0], F.lit(True))))
        if op == "dot":
            return Col(scalars.dot(*cols))
        if op.startswith("convert_"):
            return Col(cols[0].cast("string") if op == "convert_string" else scalars.wrap(cols[0], op[8:]))
        return Col(getattr(scalars, op)(cols[0], kinds[0]))

    def alike(self, cols: list[Column], kinds: list[T.DataType]) -> list[Column]:
        """Arrays with items of one type: as they are, as doubles, or as variants where kinds are mixed."""
        items = [k.elementType for k in kinds if isinstance(k, T.ArrayType)]
        if all(k == items[0] for k in items) or len(items) < len(kinds):
            return cols
        if all(scalars.is_number(k) for k in items):
            return [c.cast("array<double>") for c in cols]
        plain = (T.StringType, T.BooleanType, T.NumericType)
        return [F.transform(c, lambda x: x.cast("variant")) if isinstance(k, plain) else F.transform(c, lambda x: F.parse_json(F.to_json(x))) for c, k in zip(cols, items, strict=True)]

    def guarded(self, frame: Frame, condition: Column, value: Any, node: Node) -> Any:
        if isinstance(value, Rec):
            return Rec(value.fields, condition & self.present(frame, value)) if not value.fields or value.present is not None else Rec({k: self.guarded(frame, condition, v, node) for k, v in value.fields.items()}, condition & self.present(frame, value))
        if isinstance(value, Tab):
            return Tab(value.relation, value.bind, condition if value.present is None else condition & value.present, value.bind_names)
        test = condition & value.test if value.test is not None else None
        return Col(F.when(condition, value.column), test)

    def either(self, frame: Frame, args: tuple[Node, ...]) -> Any:
        a, b = (self.eval(x, frame) for x in args)
        if isinstance(a, Col) and isinstance(b, Col) and a.test is not None and b.test is not None:
            test = F.coalesce(a.test, F.lit(False)) | F.coalesce(b.test, F.lit(False))
            return Col(F.when(test, F.lit(True)), test)
        ca, cb = self.as_column(frame, a), self.as_column(frame, b)
        frame.rows(self.spark)
        ka, kb = frame.kind(ca), frame.kind(cb)
        if ka != kb and not (scalars.is_number(ka) and scalars.is_number(kb)):
            if isinstance(kb, T.StringType) and scalars.is_number(ka) and isinstance(b, Col) and b.literal is None:
                cb = cb.try_cast(ka)
            else:
                ca, cb = scalars.text(ca, ka), scalars.text(cb, kb)
        return Col(F.coalesce(ca, cb))

    def eval_sort(self, n: Node, frame: Frame) -> Any:
        value = self.lazy(n.args[0], frame)
        fields = [(n.args[i].op, bool(n.args[i + 1].op)) for i in range(1, len(n.args) - 1, 2)]
        if isinstance(value, Tab):
            r = value.relation
            return Tab(Relation(r.df, r.free, r.key, r.value, r.order, r.base, fields, True), value.bind)
        column = value.column
        frame.rows(self.spark)
        if isinstance(frame.kind(column), T.MapType):
            column = F.map_values(column)

        def before(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for f, descending in reversed(fields):
                x, y = (b[f], a[f]) if descending else (a[f], b[f])
                out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
            return out

        return Col(F.array_sort(column, before))

    # ---- reducers ----

    def eval_agg(self, n: Node, frame: Frame) -> Any:
        if not n.bound:
            value = self.eval(n.args[0], frame)
            if n.op in ("single", "first", "last", "any", "print"):
                return value
            frame.rows(self.spark)
            x = self.as_column(frame, value)
            return Col(reducers.only(n.op, x, frame.kind(x), n.mode == "maybe"))
        return self.attached(frame, self.reducer(n), n)

    def eval_scan(self, n: Node, frame: Frame) -> Any:
        return self.attached(frame, self.reducer(n), n)

    def attached(self, frame: Frame, relation: Relation, n: Node) -> Any:
        """A reducer's value for the rows of a frame."""
        relation = relation.renamed(self.kinds)
        frame.rows(self.spark)
        on = [a == b for v in n.free for a, b in zip(columns(frame.vars[v]), columns(relation.free[v]), strict=True)]
        if on:
            frame.df = frame.df.join(relation.df, on, "left")
        else:
            frame.df = frame.df.crossJoin(F.broadcast(relation.df))  # one row
        value = relation.value
        if n.kind == "agg" and n.op in reducers.EMPTY and n.mode != "maybe" and on and isinstance(value, Col):
            value = self.or_empty(frame, n.op, value)
        return value

    def or_empty(self, frame: Frame, op: str, value: Col) -> Col:
        kind = frame.kind(value.column)
        empty = reducers.EMPTY[op]
        if op in ("min", "max"):
            return Col(F.coalesce(value.column, F.lit(empty))) if isinstance(kind, T.DoubleType | T.FloatType) else value
        nothing = F.array().cast(kind) if op == "array" else F.create_map().cast(kind) if op == "mkset" else F.lit(empty)
        return Col(F.coalesce(value.column, nothing), name=None)

    def class_of(self, n: Node) -> tuple:
        return tuple(sorted(n.free)), tuple(sorted(n.bound)), tuple(sorted(n.hidden))

    def reducer(self, n: Node) -> Relation:
        sign = n.sign()
        if sign not in self.reduced:
            if n.kind == "scan":
                self.reduced[sign] = self.scanned(n)
            else:
                self.reduce_class(n)
        return self.reduced[sign]

    def reduce_class(self, wanted: Node) -> None:
        """Aggregates the reducer and all others over the same domain that do not contain it."""
        kind, members = self.class_of(wanted), {}
        self.busy.add(wanted.sign())
        for m in self.root.walk():
            if m.kind == "agg" and m.bound and self.class_of(m) == kind and m.sign() not in self.reduced and m.sign() not in members:
                inside = [x for a in m.args for x in a.walk() if x.kind in ("agg", "scan", "group")]
                if m.sign() == wanted.sign() or not any(x.sign() in self.busy or x.kind == "agg" and x.bound and self.class_of(x) == kind for x in inside) and m.sign() not in self.busy:
                    members[m.sign()] = m
        frame = self.domain((*wanted.free, *wanted.bound, *wanted.hidden))
        frame.rows(self.spark)
        keys = [c for v in wanted.free for c in frame.vars[v]]
        alone = frame.unique is not None and keys and {*frame.unique} <= {*keys}
        fixed = {s: c for s, m in members.items() if (c := self.determined(frame, m)) is not None}
        values = {s: self.eval(m.args[0], frame) for s, m in members.items() if s not in fixed}
        cols = {s: self.as_column(frame, v) for s, v in values.items()}
        order = frame.order_of([v for v in frame.vars if v in wanted.bound or v in wanted.hidden])
        plain, unique = {}, {}
        for s, m in members.items():
            if s not in fixed:
                (unique if wanted.hidden and m.op not in reducers.IDEMPOTENT and not alone else plain)[s] = m
        names = {s: fresh(m.op) for s, m in members.items()}
        parts = []
        bound = [c for v in (*wanted.free, *wanted.bound) for c in frame.vars[v]]
        for chosen, distinct in ((plain, False), (unique, True)):
            if not chosen and (distinct or unique or not fixed):
                continue
            df = frame.df.select(*columns(list(dict.fromkeys([*keys, *bound, *order]))), *[cols[s].alias(names[s]) for s in chosen])
            inner_order = [c for c in order if c in bound] if distinct else order
            if distinct:
                df = df.select(*columns(list(dict.fromkeys(bound))), *columns([names[s] for s in chosen])).dropDuplicates(list(dict.fromkeys(bound)))
            inner = Frame(df, self.kinds)
            if alone:  # the free variables are a key: each group is one row
                ones = [reducers.alone(m.op, F.col(f"`{names[s]}`"), frame.kind(cols[s]), m.mode == "maybe").alias(names[s] + "_r") for s, m in chosen.items()]
                parts.append((df.select(*columns(keys), *ones), [names[s] + "_r" for s in chosen]))
                continue
            aggs = [reducers.reduce(m.op, F.col(f"`{names[s]}`"), frame.kind(cols[s]), inner_order, m.mode == "maybe", s in self.compared).alias(names[s] + "_r") for s, m in chosen.items()]
            parts.append((inner.df.groupBy(*columns(keys)).agg(*aggs) if aggs else inner.df.select(*columns(keys)).distinct(), [names[s] + "_r" for s in chosen]))
        df = parts[0][0]
        for other, _ in parts[1:]:
            twin = {c: fresh("t") for c in keys}
            other = other.select(*[F.col(f"`{c}`").alias(t) for c, t in twin.items()], *[c for c in other.columns if c not in twin])
            df = df.join(other, [F.col(f"`{c}`") == F.col(f"`{t}`") for c, t in twin.items()], "inner").drop(*twin.values()) if keys else df.crossJoin(other)
        free = {v: frame.vars[v] for v in wanted.free}
        for s in members:
            value = named(fixed[s]) if s in fixed else named(names[s] + "_r")
            self.reduced[s] = Relation(df, free, [], value, [])
        self.busy.discard(wanted.sign())

    def determined(self, frame: Frame, m: Node) -> str | None:
        """The key column that a ``single`` of the key's own term would give."""
        if m.op not in ("single", "any", "first", "last"):
            return None
        sign = m.args[0].sign()
        for v in m.free:
            for p, c in zip(frame.known.get(f"key {v}", []), frame.vars[v], strict=False):
                if p == sign or p.endswith("," + sign + ")") and p.startswith("pure:'and'"):
                    return c
        return None

    def scanned(self, n: Node) -> Relation:
        """Running reducers: an array of the values after each row, in order."""
        from pyspark.sql import Window

        frame = self.domain((*n.free, *n.bound, *n.hidden))
        frame.rows(self.spark)
        x, keys = self.column(n.args[0], frame), [c for v in n.free for c in frame.vars[v]]
        order = frame.order_of([v for v in frame.vars if v not in n.free])
        item, run = fresh("x"), fresh(n.op)
        df = frame.df.select(*columns(list(dict.fromkeys([*keys, *order]))), x.alias(item))
        window = Window.partitionBy(*columns(keys)).orderBy(*columns(order)).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(run, reducers.running(n.op, F.col(f"`{item}`"), frame.kind(x), window))
        out = df.groupBy(*columns(keys)).agg(reducers.reduce("array", F.col(f"`{run}`"), df.schema[run].dataType, order, False).alias(run + "_r"))
        return Relation(out, {v: frame.vars[v] for v in n.free}, [], named(run + "_r"), [])

    def listed(self, n: Node) -> Relation:
        """The items of an array reducer as rows keyed by its variables."""
        sign = "list " + n.sign()
        if sign not in self.grouped:
            frame = self.domain((*n.free, *n.bound, *n.hidden))
            frame.rows(self.spark)
            if n.args[0].kind == "pure" and n.args[0].op in ("and", "andAlso"):
                self.restrict(frame, n.args[0].args[0])
                frame.where(self.defined(n.args[0].args[1], frame))
            value = self.stored(frame, self.eval(n.args[0], frame))
            frame.where(self.has_value(frame, value))
            order = frame.order_of([v for v in frame.vars if v not in n.free])
            if n.hidden:
                frame.df = frame.df.dropDuplicates([c for v in (*n.free, *n.bound) for c in frame.vars[v]])
                order = frame.order_of([v for v in frame.vars if v in n.bound])
            self.grouped[sign] = Relation(frame.df, {v: frame.vars[v] for v in n.free}, [c for v in n.bound for c in frame.vars[v]], value, order, listed=True)
        return self.grouped[sign]

    def stored(self, frame: Frame, value: Any) -> Any:
        """The value with every part a column of the frame."""
        new: dict[str, Column] = {}

        def keep(v: Any, hint: str) -> Any:
            if isinstance(v, Col):
                if v.name is not None:
                    return v
                name = fresh(hint)
                new[name] = v.column
                return named(name)
            if isinstance(v, Rec):
                present = v.present_name
                if v.present is not None and present is None:
                    present = fresh("there")
                    new[present] = v.present
                return Rec({k: keep(x, k) for k, x in v.fields.items() if x is not None}, F.col(f"`{present}`") if present else None, present)
            if isinstance(v, Tab):
                names = {}
                for w, cs in v.bind.items():
                    names[w] = [fresh(w) for _ in cs]
                    new.update(dict(zip(names[w], cs, strict=True)))
                return Tab(v.relation, {w: columns(cs) for w, cs in names.items()}, None, names)
            raise TypeError(f"{v!r} cannot be kept")

        out = keep(value, "value")
        frame.add(new)
        return out

    def has_value(self, frame: Frame, value: Any) -> Column:
        if isinstance(value, Col):
            return value.column.isNotNull()
        return self.present(frame, value) if isinstance(value, Rec) else F.lit(True)

    # ---- groups ----

    def eval_group(self, n: Node, frame: Frame) -> Any:
        relation = self.group(n)
        return Tab(relation, {v: columns(frame.vars[v]) for v in n.free})

    def updated(self, n: Node, frame: Frame) -> Any:
        """update o k v on a plain value."""
        base, value = self.eval(n.args[0], frame), self.eval(n.args[2], frame)
        if isinstance(base, Rec) and n.args[1].kind == "const":
            return Rec({**base.fields, str(n.args[1].op): value}, base.present)
        frame.rows(self.spark)
        column, key = self.as_column(frame, base), self.column(n.args[1], frame)
        kind, item = frame.kind(column), self.as_column(frame, value)
        if isinstance(kind, T.VariantType):
            inner, name, kind = F.try_variant_get(column, "$", "map<string,variant>"), key.cast("string"), frame.kind(item)
            new = item if isinstance(kind, T.VariantType) else item.cast("variant") if scalars.is_plain(kind) else F.parse_json(F.to_json(item))
            put = F.to_variant_object(F.map_concat(F.map_filter(inner, lambda k, _: k != name), F.create_map(name, new)))
            return Col(F.when(F.schema_of_variant(column).startswith("OBJECT") & item.isNotNull(), put).otherwise(column))
        if isinstance(kind, T.MapType):
            key = key.cast(kind.keyType)
            return Col(F.when(item.isNotNull(), F.map_concat(F.map_filter(column, lambda k, _: k != key), F.create_map(key, item.cast(kind.valueType)))).otherwise(column))
        if isinstance(kind, T.StructType) and n.args[1].kind == "const":
            return Col(column.withField(str(n.args[1].op), item))
        return Col(column)

    def group(self, n: Node) -> Relation:
        sign = n.sign()
        if sign not in self.grouped:
            self.grouped[sign] = self.make_group(n)
        return self.grouped[sign]

    def rests_on(self, n: Node, names: set[str]) -> bool:
        """Whether the term needs rows of collections, not only keys and reducers."""
        if n.kind in ("agg", "scan"):
            return False if n.bound else self.rests_on(n.args[0], names)
        if n.kind == "group":
            return False
        if n.kind == "get" and n.args[1].kind == "var":
            return True
        return any(self.rests_on(a, names) for a in n.args)

    def direct(self, n: Node):
        """Reducers of a term that are not inside other reducers."""
        if n.kind == "agg" and n.bound:
            yield n
        elif n.kind != "group":
            for a in n.args:
                yield from self.direct(a)

    def make_group(self, n: Node) -> Relation:
        base, key, value = n.args[:3]
        owner = tuple(dict.fromkeys((*n.free, *n.bound, *key.uses)))
        everything = set(self.scopes.closure((*owner, *n.hidden)))
        leaders = [m for m in self.direct(value) if set(m.free) == set(owner) and set(self.scopes.closure((*m.free, *m.bound, *m.hidden))) <= everything]
        if not self.rests_on(value, set(owner)) and leaders and owner:
            relation = self.reducer(leaders[0])
            frame = Frame(relation.df, self.kinds)
            frame.vars = dict(relation.free)
            for m in leaders:
                r = self.reducer(m)
                if r.df is relation.df:
                    frame.known[m.sign()] = r.value
        else:
            frame = self.domain((*owner, *n.hidden))
            frame.rows(self.spark)
            if n.hidden and not self.rests_on(value, set(owner)):
                names = [c for v in owner for c in frame.vars[v]]
                distinct = Frame(frame.df.select(*columns(names)).distinct(), self.kinds)
                distinct.vars = {v: frame.vars[v] for v in owner}
                frame = distinct
            elif n.hidden:
                frame.df = frame.df.dropDuplicates([c for v in owner for c in frame.vars[v]])
        stored = self.stored(frame, self.eval(value, frame))
        frame.where(self.has_value(frame, stored))
        keys = [c for v in key.uses for c in frame.vars[v]]
        return Relation(frame.df, {v: frame.vars[v] for v in n.free}, keys, stored, frame.order_of(key.uses), base if base.kind == "group" or base.args else None)


