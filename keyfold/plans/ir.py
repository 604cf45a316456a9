"""Syntax trees to the intermediate form: a few kinds of nodes over logic variables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from .syntax import parse

# The language's operators.
SIGNS = {"+": "plus", "-": "minus", "*": "times", "/": "fdiv", "//": "div", "%": "mod", "::": "concat", "==": "equal", "!=": "notEqual", "<": "lessThan", "<=": "lessThanOrEqual", ">": "greaterThan", ">=": "greaterThanOrEqual", "&": "and", "&&": "and", "||": "orElse"}
PURE = {*SIGNS.values(), "andAlso", "ifElse", "apply", "join", "flatten", "singleton", "sort", "year", "hour", "length", "like", "substr", "isUndef", "combine", "vars", "dot"}
REDUCERS = {"sum", "product", "count", "min", "max", "first", "last", "single", "all", "any", "array", "mkset", "print"}
LOADERS = {"loadJSON": "json", "loadNDJSON": "ndjson", "loadCSV": "csv", "loadTBL": "tbl", "loadParquet": "parquet"}


class Node:
    """kind: const, input, var, get, pure, agg, scan, group, setof, rest (all variables left)."""

    def __init__(self, kind: str, op: Any = None, args: tuple[Node, ...] = (), mode: str = ""):
        self.kind, self.op, self.args, self.mode = kind, op, tuple(args), mode
        self.uses: tuple = ()  # variables inside
        self.bound: tuple = ()
        self.free: tuple = ()
        self.hidden: tuple = ()  # implied by free and bound, projected out

    def copy(self) -> Node:
        return Node(self.kind, self.op, tuple(a.copy() for a in self.args), self.mode)

    def source(self) -> str:
        """Text that is the same for nodes with the same meaning before analysis."""
        return f"{self.kind}:{self.op if not isinstance(self.op, dict) else sorted(self.op)}:{self.mode}({','.join(a.source() for a in self.args)})"

    def sign(self) -> str:
        """The same for nodes with the same meaning after analysis."""
        own = f"{self.free}/{self.bound}" if self.kind in ("agg", "scan", "group") else ""
        op = self.op if not callable(self.op) else id(self.op)
        return f"{self.kind}:{op!r}:{self.mode}{own}({','.join(a.sign() for a in self.args)})"

    def walk(self):
        yield self
        for a in self.args:
            yield from a.walk()

    def __repr__(self) -> str:
        return self.source()

    def __call__(self, *_):
        raise TypeError("a query is compiled with keyfold.compile(query), then run")


class Function:
    """A function of the query text: a lambda, a let with parameters or a Python macro."""

    def __init__(self, call: Callable[[list], Any]):
        self.call = call


def const(value: Any) -> Node:
    return Node("const", value)


def pure(op: str, *args: Node) -> Node:
    return Node("pure", op, args)


def get(base: Node, key: Node, maybe: bool = False) -> Node:
    return Node("get", None, (base, key), "maybe" if maybe else "")


def agg(op: str, arg: Node) -> Node:
    return Node("agg", op.rstrip("?"), (arg,), "maybe" if op.endswith("?") else "")


def array(items: list[Node]) -> Node:
    return agg("array", items[0]) if len(items) == 1 else pure("flatten", *[agg("array", i) for i in items])


def record(entries: list[tuple[Node, Node]]) -> Node:
    """Constant keys make a record; others group, onto what stands before them."""
    if entries and all(k.kind == "const" for k, _ in entries):
        return Node("pure", "mkTuple", tuple(x for entry in entries for x in entry))
    base: Node = const({})
    done: list[tuple[Node, Node]] = []
    for k, v in entries:
        if v.kind == "keyval":
            k, v = v.args
        if k.kind == "const" and base.kind != "group":
            done.append((k, v))
            base = Node("pure", "mkTuple", tuple(x for entry in done for x in entry))
        else:
            base = Node("group", None, (base, k, v))
    return base


def group(key: Node | None, value: Node) -> Node:
    return Node("group", None, (const({}), key or Node("rest"), value))


def operation(name: str, args: list[Node]) -> Node:
    plain = name.rstrip("?")
    if name in ("get", "get?"):
        return get(*(args if len(args) == 2 else [Node("input"), args[0]]), maybe=name == "get?")
    if name in ("group",):
        return group(args[0], args[1]) if len(args) == 2 else group(None, args[0])
    if name == "update_inplace" and (args[1].kind == "var" or args[1].kind == "pure" and args[1].op == "vars"):
        # nothing is changed in place: what a variable ranges over is filled anew
        return Node("group", None, (const({}), Node("rest") if args[1].op == "*WILDCARD" else args[1], args[2]))
    if name in ("update", "update_inplace"):
        return Node("group", None, tuple(args))
    if name in ("merge", "keyval"):
        return Node("keyval", None, tuple(args))
    if name in ("object", "array_of"):
        return record(list(zip(args[::2], args[1::2], strict=True)))
    if name == "array":
        return array(args)
    if name == "hint":
        return Node("pure", "hint", tuple(args))
    if name.startswith("prefix_") and name[7:] in REDUCERS:
        return Node("scan", name[7:], tuple(args))
    if plain in REDUCERS:
        return agg(name, args[0])
    if name == "andAlso":
        return pure("and", *args)
    if name in PURE or name.startswith("convert_"):
        return pure(name, *args)
    if name in LOADERS:
        return Node("load", LOADERS[name], tuple(args))
    raise NameError(f"no operator {name!r}")


def is_operation(name: str) -> bool:
    return name.rstrip("?") in REDUCERS or name in PURE or name in LOADERS or name in ("get", "group", "update", "update_inplace", "merge", "keyval", "object", "hint") or name.startswith(("prefix_", "convert_"))


class Elaborator:
    """Resolves names, applications, pipes and holes of a syntax tree."""

    def __init__(self):
        self.piped: Node | None = None
        self.used = False

    def node(self, tree, env: dict[str, Any]) -> Node:
        value = self.value(tree, env)
        if isinstance(value, Function):
            raise TypeError("a function stands where a value is needed")
        return value

    def value(self, tree, env):
        return getattr(self, "on_" + tree[0])(env, *tree[1:])

    def on_num(self, env, value):
        return const(value)

    def on_str(self, env, value):
        return const(value)

    def on_var(self, env, name):
        return Node("var", name)

    def on_name(self, env, name):
        if name in env:
            return env[name].copy() if isinstance(env[name], Node) else env[name]
        return const({"true": True, "false": False}.get(name, name))

    def on_hole(self, env, value):
        if callable(value) and not isinstance(value, Node) and getattr(value, "_keyfold_macro", True) and not hasattr(value, "node"):
            return Function(lambda args: to_node(value(*args)))
        return to_node(value)

    def base(self, tree, env) -> Node:
        if tree is None:
            if self.piped is None:
                return Node("input")
            self.used = True
            return self.piped.copy()
        if tree[0] == "name" and tree[1] not in env:
            return get(Node("input"), const(tree[1]))
        if tree[0] == "hole" and isinstance(tree[1], str):
            return to_node(tree[1])
        return self.node(tree, env)

    def on_get(self, env, base, key):
        return get(self.base(base, env), self.node(key, env))

    def on_maybe(self, env, inner):
        if inner[0] == "get":
            return get(self.base(inner[1], env), self.node(inner[2], env), maybe=True)
        if inner[0] == "name":
            return ("operation", inner[1] + "?")
        raise TypeError("? follows a path or a reducer")

    def on_op(self, env, sign, left, right):
        return pure(SIGNS[sign], self.node(left, env), self.node(right, env))

    def on_object(self, env, entries):
        out = []
        for k, v in entries:
            key = pure("combine", *[self.node(x, env) for x in k[1]]) if k[0] == "array" and len(k[1]) > 1 else self.node(k[1][0] if k[0] == "array" else k, env)
            out.append((key, self.node(v, env)))
        return record(out)

    def on_array(self, env, items):
        return array([self.node(i, env) for i in items])

    def on_let(self, env, name, parameters, value, body):
        bound = self.closure(parameters, value, env) if parameters else self.value(value, env)
        return self.value(body, {**env, name: bound})

    def on_fn(self, env, name, body):
        return self.closure([name], body, env)

    def closure(self, parameters, body, env) -> Function:
        def call(args):
            inner = {**env, **dict(zip(parameters, args, strict=False))}
            if len(args) < len(parameters):
                return self.closure(parameters[len(args) :], body, inner)
            result = self.value(body, inner)
            return self.apply(result, args[len(parameters) :]) if len(args) > len(parameters) else result

        return Function(call)

    def key_of(self, tree, env) -> Node:
        if tree[0] == "array":
            return pure("combine", *[self.node(x, env) for x in tree[1]]) if len(tree[1]) > 1 else self.node(tree[1][0], env)
        return self.node(tree, env)

    def on_call(self, env, head, arguments):
        while head[0] == "call":
            head, arguments = head[1], [*head[2], *arguments]
        name = self.operation_name(head, env)
        if name == "group":
            return group(self.key_of(arguments[0], env), self.node(arguments[1], env)) if len(arguments) > 1 else group(None, self.node(arguments[0], env))
        args = [self.value(a, env) for a in arguments]
        if name is not None:
            return operation(name, args)
        return self.apply(self.value(head, env), args)

    def operation_name(self, head, env) -> str | None:
        if head[0] == "maybe" and head[1][0] == "name":
            return head[1][1] + "?"
        if head[0] == "name" and head[1] not in env and is_operation(head[1]):
            return head[1]
        return None

    def apply(self, function, args):
        if isinstance(function, Function):
            return function.call(args)
        if isinstance(function, tuple):
            return operation(function[1], args)
        if function.kind == "const" and isinstance(function.op, str) and is_operation(function.op):
            return operation(function.op, args)
        return pure("apply", function, *args)

    def on_pipe(self, env, value, function):
        piped = self.node(value, env)
        if function[0] == "call":
            name = self.operation_name(function[1], env)
            if name == "group" and len(function[2]) == 1:
                return group(self.key_of(function[2][0], env), piped)
            if name == "get" and len(function[2]) == 1:
                return get(piped, self.node(function[2][0], env))
        name = self.operation_name(function, env)
        if name is not None:
            return operation(name, [piped])
        before, self.piped, self.used = (self.piped, self.used), piped, False
        result = self.value(function, env)
        used, (self.piped, self.used) = self.used, before
        return result if used else self.apply(result, [piped])


def to_node(value: Any) -> Node:
    """A query in any form: node, text (a query of its own), number, dict, list or fluent wrapper."""
    if isinstance(value, Node):
        return value.copy()
    if hasattr(value, "node"):
        return to_node(value.node)
    if isinstance(value, str):
        tree = parse(value)
        return Elaborator().node(tree, {})
    if isinstance(value, dict):
        entries = []
        for k, v in value.items():
            v = to_node(v)
            entries.append(v.args if v.kind == "keyval" else (to_node(k), v))
        return record([tuple(e) for e in entries])
    if isinstance(value, list | tuple):
        return array([to_node(v) for v in value])
    return const(value)


def query(text: str, **holes) -> Node:
    """A node from query text; ``@name`` stands for the keyword argument of that name."""
    return Elaborator().node(parse(text, **holes), {})
