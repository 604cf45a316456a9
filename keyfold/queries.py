"""Queries over the driver's tables, one for each operator of the language, and the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import api
from .functions import library
from .operators.fixpoint import fixpoint
from .plans.ir import const
from .sources import sinks
from .sources.shared import delete, shared_root
from .sources.tables import Udf

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"],
    "labels": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}


class Inputs(dict):
    """Tables of a folder, read when a query names them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(library.FUNCTIONS | {"own": {"initial": Udf(lambda name: name and name[:1].lower()), "spread": Udf(lambda values: values and float(max(values) - min(values)), "double")}})
        self.spark, self.sf_dir = spark, sf_dir

    def __contains__(self, name) -> bool:
        return name in KEYS or super().__contains__(name)

    def __missing__(self, name: str):
        self[name] = api.Table(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"), KEYS[name])
        return self[name]


@dataclass
class Query:
    text: str
    sql: str | None
    digits: int = 2
    limit: int | None = None
    after: Callable[[DataFrame], DataFrame] | None = None
    #: Files to write from tables before the query reads them: {hole: (form, table, columns)}.
    files: dict[str, tuple[str, str, list[str]]] = field(default_factory=dict)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        from .operators.lower import Lowering
        from .result import Result

        inputs, holes = Inputs(spark, sf_dir), {}
        if self.files:
            folder = f"{shared_root(spark)}/keyfold-files-{uuid.uuid4().hex}"
            atexit.register(_gone, spark, folder)
            for name, (form, table, cols) in self.files.items():
                df = inputs[table].df.selectExpr(*cols)
                holes[name], holes[name + "_type"] = const(f"{folder}/{name}"), const(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))
                _put(df, form, f"{folder}/{name}")
        df = Result(Lowering(spark, inputs, api.query(self.text, **holes) if holes else api.query(self.text))).df(self.limit)
        df = self.after(df) if self.after else df
        return df.select(*[(F.round(f.name, self.digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


ASIA_1996 = "o_orderdate >= date '1996-01-01' AND o_orderdate < date '1997-01-01'"

QUERIES: dict[str, Query] = {}


@dataclass
class Made(Query):
    """A query that is a function of the inputs rather than text."""

    make: Callable[[Inputs], DataFrame] | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.make(Inputs(spark, sf_dir))


def _put(df: DataFrame, form: str, path: str) -> None:
    if form == "tbl":
        sinks.write(df, path, "bars")
    elif form == "json":  # one document, a list of records
        df.select(F.to_json(F.struct("*")).alias("x")).groupBy().agg(F.concat(F.lit("["), F.array_join(F.collect_list("x"), ",\n"), F.lit("]"))).write.text(path)
    else:
        sinks.write(df, path, "json" if form == "ndjson" else form)


def _gone(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the JVM may have ended before Python
        pass


def add(name: str, text: str, sql: str | None, digits: int = 2, limit: int | None = None, after=None, files=None) -> None:
    QUERIES[name] = Query(text, sql, digits, limit, after, files or {})


# ---- reducers ----
for _op, _sql in {"sum": "coalesce(sum(o_totalprice), 0)", "count": "count(o_totalprice)", "min": "min(o_totalprice)", "max": "max(o_totalprice)"}.items():
    add(f"agg_{_op}", f"{_op} orders.*o.o_totalprice", f"SELECT round({_sql}, 2) AS value FROM orders" if _op != "count" else f"SELECT {_sql} AS value FROM orders")
add("agg_sum_maybe", "{none: sum? (orders.*o.o_totalprice < 0 & orders.*o.o_totalprice), some: sum? orders.*o.o_totalprice, zero: sum (orders.*o.o_totalprice < 0 & orders.*o.o_totalprice)}",
    "SELECT round(sum(o_totalprice) FILTER (WHERE o_totalprice < 0), 2) AS none, round(sum(o_totalprice), 2) AS some, round(coalesce(sum(o_totalprice) FILTER (WHERE o_totalprice < 0), 0), 2) AS zero FROM orders")
add("agg_product", "product (1 + nation.*n.n_nationkey / 100)", "SELECT round(product(1 + n_nationkey / 100.0), 6) AS value FROM nation", 6)
add("agg_first", "{orders.*o.o_orderstatus: {status: single orders.*o.o_orderstatus, first: first orders.*o.o_totalprice}}", "SELECT o_orderstatus AS status, round(arg_min(o_totalprice, o_orderkey), 2) AS first FROM orders GROUP BY 1")
add("agg_last", "{orders.*o.o_orderstatus: {status: single orders.*o.o_orderstatus, last: last orders.*o.o_totalprice}}", "SELECT o_orderstatus AS status, round(arg_max(o_totalprice, o_orderkey), 2) AS last FROM orders GROUP BY 1")
add("agg_single", "{nation.*n.n_regionkey: single region.(nation.*n.n_regionkey).r_name}", "SELECT n_regionkey AS key, any_value(r_name) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("agg_all", "{supplier.*s.s_nationkey: all (supplier.*s.s_acctbal > 0)}", "SELECT s_nationkey AS key, true AS value FROM supplier GROUP BY 1 HAVING bool_and(s_acctbal > 0)")
add("agg_any", "{supplier.*s.s_nationkey: any (supplier.*s.s_acctbal > 5000 & supplier.*s.s_suppkey)}", "SELECT s_nationkey AS key, min(s_suppkey) AS value FROM supplier WHERE s_acctbal > 5000 GROUP BY 1")
add("agg_array", "{nation.*n.n_regionkey: array nation.*n.n_name}", "SELECT n_regionkey AS key, list(n_name ORDER BY n_nationkey) AS value FROM nation GROUP BY 1")
add("agg_mkset", "{nation.*n.n_regionkey: count (mkset nation.*n.n_name).*}", "SELECT n_regionkey AS key, count(DISTINCT n_name) AS value FROM nation GROUP BY 1")
add("agg_avg", "{lineitem.*l.l_returnflag: (sum lineitem.*l.l_quantity) / (count lineitem.*l.l_quantity)}", "SELECT l_returnflag AS key, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1", 6)
add("count_distinct", "let per = {events.*e.event_type: {events.*e.user_id: count? events.*e.user_id}}; {*t: count per.*t.*u}", "SELECT event_type AS key, count(DISTINCT user_id) AS value FROM events GROUP BY 1")

# ---- grouping ----
add("group_single", "{customer.*c.c_mktsegment: sum customer.*c.c_acctbal}", "SELECT c_mktsegment AS key, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1")
add("group_composite", "{flag: single lineitem.*l.l_returnflag, status: single lineitem.*l.l_linestatus, n: count lineitem.*l.l_quantity} | group [lineitem.*l.l_returnflag, lineitem.*l.l_linestatus]", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
add("group_nested", "{orders.*o.o_orderstatus: {orders.*o.o_orderpriority: sum orders.*o.o_totalprice}}", "SELECT o_orderstatus AS key, o_orderpriority AS key_1, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2")
add("group_total_and_key", "{total: single (sum orders.*o.o_totalprice), parts: {orders.*p.o_orderstatus: sum orders.*p.o_totalprice}}.parts", "SELECT o_orderstatus AS key, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
add("group_uncorrelated", "{customer.*c.c_mktsegment: sum customer.*d.c_acctbal}", "SELECT DISTINCT c_mktsegment AS key, round((SELECT sum(c_acctbal) FROM customer), 2) AS value FROM customer")
add("group_relative_share", "{customer.*c.c_mktsegment: (sum customer.*c.c_acctbal) / (sum customer.*d.c_acctbal)}", "SELECT c_mktsegment AS key, round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer), 9) AS value FROM customer GROUP BY 1", 9)
add("group_by_key_var", "{*r: {name: single region.*r.r_name, nations: count (region.*r & {nation.*n.n_regionkey: array nation.*n.n_name}.*r.*i)}}", "SELECT r_name AS name, count(n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
add("aggregate_as_key", "{{customer.*c.c_nationkey: count customer.*c.c_custkey}.*n: count {customer.*c.c_nationkey: count customer.*c.c_custkey}.*n}", "SELECT n AS key, count(*) AS value FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) GROUP BY 1")
add("group_undefined_keys", "{customer.*c.c_acctbal > 9000 & customer.*c.c_mktsegment: count customer.*c.c_custkey}", "SELECT c_mktsegment AS key, count(*) AS value FROM customer WHERE c_acctbal > 9000 GROUP BY 1")
add("filter_in_value", "{customer.*c.c_mktsegment: sum (customer.*c.c_acctbal > 9900 & customer.*c.c_acctbal)}", "SELECT c_mktsegment AS key, round(coalesce(sum(c_acctbal) FILTER (WHERE c_acctbal > 9900), 0), 2) AS value FROM customer GROUP BY 1")
add("filter_by_index", "sum orders.*o.o_totalprice | group orders.*o.o_orderstatus | .F", "SELECT round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F'")

# ---- joins ----
add("join_zip_keys", "{lang: documents.*d.lang, quality: labels.*d.quality}", "SELECT lang, quality FROM documents JOIN labels USING (doc_id)")
add("join_hash_lookup", "{customer.*c.c_custkey: nation.(customer.*c.c_nationkey).n_name}", "SELECT c_custkey AS key, n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")
add("join_many_to_many", "let s = {supplier.*s.s_nationkey: array supplier.*s.s_suppkey}; let c = {customer.*c.c_nationkey: array customer.*c.c_custkey}; {*n: count (s.*n.*i & c.*n.*j)}", "SELECT s_nationkey AS key, count(*) AS value FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY 1")
add("join_left_default", "{documents.*d.doc_id: labels.(documents.*d.doc_id).quality || 9}", "SELECT doc_id AS key, coalesce(quality, 9) AS value FROM documents LEFT JOIN labels USING (doc_id)")
add("join_left_maybe", "{documents.*d.doc_id: labels.*d?.toxic || 7}", "SELECT doc_id AS key, coalesce(toxic, 7) AS value FROM documents LEFT JOIN labels USING (doc_id)")
add("join_full_outer", "let a = {customer.*c.c_acctbal > 9800 & customer.*c.c_nationkey: count customer.*c.c_custkey}; let b = {supplier.*s.s_acctbal > 5000 & supplier.*s.s_nationkey: count supplier.*s.s_suppkey}; {*n: {nation: *n, customers: a.*n? || 0, suppliers: b.*n? || 0}}", "SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey k, count(*) n FROM customer WHERE c_acctbal > 9800 GROUP BY 1) a FULL JOIN (SELECT s_nationkey k, count(*) n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b USING (k)")
add("join_cross_theta", "count (nation.*a.n_nationkey < nation.*b.n_nationkey & nation.*a.n_regionkey == nation.*b.n_regionkey & 1)", "SELECT count(*) AS value FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
add("join_semi", "let has = {lineitem.*l.l_quantity > 49 & lineitem.*l.l_orderkey: count lineitem.*l.l_orderkey}; {has.(orders.*o.o_orderkey) & orders.*o.o_orderpriority: count orders.*o.o_orderkey}", "SELECT o_orderpriority AS key, count(*) AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) GROUP BY 1")
add("join_anti", "let has = {lineitem.*l.l_orderkey: count lineitem.*l.l_orderkey}; array ((isUndef has.(orders.*o.o_orderkey)) & {o: orders.*o.o_orderkey})", "SELECT o_orderkey AS o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
add("join_lateral_unnest", "{embeddings.*v.vec_id: {vec: single embeddings.*v.vec_id, sum: sum embeddings.*v.embedding.*i, n: count embeddings.*v.embedding.*i}}", "SELECT vec_id AS vec, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS sum, len(embedding) AS n FROM embeddings", 4)
add("join_scalar_subquery", "let average = {lineitem.*l.l_partkey: (sum lineitem.*l.l_quantity) / (count lineitem.*l.l_quantity)}; sum (lineitem.*m.l_quantity < 0.4 * average.(lineitem.*m.l_partkey) & lineitem.*m.l_extendedprice)", "SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem l WHERE l_quantity < 0.4 * (SELECT avg(l_quantity) FROM lineitem m WHERE m.l_partkey = l.l_partkey)")

# ---- sets ----
add("set_intersect", "let a = {customer.*c.c_acctbal > 9000 & customer.*c.c_nationkey: count customer.*c.c_custkey}; let b = {supplier.*s.s_acctbal > 5000 & supplier.*s.s_nationkey: count supplier.*s.s_suppkey}; {*n: a.*n + b.*n}", "SELECT k AS key, a.n + b.n AS value FROM (SELECT c_nationkey k, count(*) n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a JOIN (SELECT s_nationkey k, count(*) n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b USING (k)")
add("set_union", "let a = {customer.*c.c_acctbal > 9800 & customer.*c.c_nationkey: count customer.*c.c_custkey}; let b = {supplier.*s.s_acctbal > 5000 & supplier.*s.s_nationkey: count supplier.*s.s_suppkey}; {*n: (a.*n? || b.*n?) & 1}", "SELECT key, 1 AS value FROM (SELECT c_nationkey AS key FROM customer WHERE c_acctbal > 9800 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
add("set_union_all", "count [nation.*n.n_name, region.*r.r_name].*x", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS value")
add("set_except", "let b = {orders.*o.o_totalprice > 300000 & orders.*o.o_custkey: count orders.*o.o_orderkey}; array ((isUndef b.(customer.*c.c_custkey)) & {c: customer.*c.c_custkey})", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
add("distinct", "{part.*p.p_brand: single part.*p.p_brand}", "SELECT DISTINCT p_brand AS key, p_brand AS value FROM part")

# ---- predicates and conditions ----
add("pred_eq_ne", '{eq: count (orders.*o.o_orderstatus == "F"), ne: count (orders.*o.o_orderstatus != "F"), mixed: count (orders.*o.o_orderkey == "1")}', "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS eq, count(*) FILTER (WHERE o_orderstatus <> 'F') AS ne, 0::BIGINT AS mixed FROM orders")
add("pred_range", "sum (lineitem.*l.l_shipdate >= 19960101 && lineitem.*l.l_shipdate < 19970101 && lineitem.*l.l_quantity <= 10 & lineitem.*l.l_quantity)", "SELECT round(sum(l_quantity), 2) AS value FROM lineitem WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01' AND l_quantity <= 10")
add("pred_or_else", '{count: count (part.*p.p_size < 5 || part.*p.p_type == "PROMO"), first: min ((part.*p.p_size > 49 & part.*p.p_size) || 100 + part.*p.p_size)}', "SELECT count(*) FILTER (WHERE p_size < 5 OR p_type = 'PROMO') AS count, min(CASE WHEN p_size > 49 THEN p_size ELSE 100 + p_size END) AS first FROM part")
add("pred_if_else", "{part.*p.p_brand: sum (ifElse (part.*p.p_size > 25) 1 0)}", "SELECT p_brand AS key, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END)::BIGINT AS value FROM part GROUP BY 1")
add("pred_like", '{a: count (like part.*p.p_type "PRO%"), b: count (like part.*p.p_name "%1"), c: count (like part.*p.p_brand "%_%")}', "SELECT count(*) FILTER (WHERE p_type LIKE 'PRO%') AS a, count(*) FILTER (WHERE p_name LIKE '%1') AS b, count(*) FILTER (WHERE contains(p_brand, '_')) AS c FROM part")
add("pred_is_undef", "count (isUndef labels.(documents.*d.doc_id) & documents.*d.doc_id)", "SELECT count(*) AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")

# ---- scalars ----
add("math_ops", "{part.*p.p_partkey: {k: single part.*p.p_partkey, a: part.*p.p_retailprice * 2 - 1, b: part.*p.p_retailprice / part.*p.p_size, c: part.*p.p_retailprice + part.*p.p_size}}", "SELECT p_partkey AS k, round(p_retailprice * 2 - 1, 4) AS a, round(p_retailprice / p_size, 4) AS b, round(p_retailprice + p_size, 4) AS c FROM part", 4)
add("int_div_mod", "{part.*p.p_partkey: {k: single part.*p.p_partkey, d: (10 - part.*p.p_size) // 7, m: (10 - part.*p.p_size) % 7}}", "SELECT p_partkey AS k, trunc((10 - p_size) / 7.0)::BIGINT AS d, ((10 - p_size) % 7)::INTEGER AS m FROM part")
add("concat", '{part.*p.p_partkey: part.*p.p_brand :: "/" :: part.*p.p_size}', "SELECT p_partkey AS key, p_brand || '/' || p_size AS value FROM part")
add("substr", "{substr nation.*n.n_name 0 3: count nation.*n.n_name}", "SELECT substr(n_name, 1, 3) AS key, count(*) AS value FROM nation GROUP BY 1")
add("year", "{year orders.*o.o_orderdate: count orders.*o.o_orderkey}", "SELECT year(o_orderdate)::INTEGER AS key, count(*) AS value FROM orders GROUP BY 1")
add("hour", "{hour events.*e.ts: count events.*e.event_id}", "SELECT hour(ts)::INTEGER AS key, count(*) AS value FROM events GROUP BY 1")
add("length", "sum (length documents.*d.text)", "SELECT sum(length(text))::BIGINT AS value FROM documents")
add("join_array", "{nation.*n.n_regionkey: join (array nation.*n.n_nationkey)}", "SELECT n_regionkey AS key, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS value FROM nation GROUP BY 1")
add("flatten", "{nation.*n.n_regionkey: flatten (array nation.*n.n_nationkey) (array nation.*n.n_nationkey)}", "SELECT n_regionkey AS key, list_concat(list(n_nationkey ORDER BY n_nationkey), list(n_nationkey ORDER BY n_nationkey)) AS value FROM nation GROUP BY 1")
add("convert_wrap", "{part.*p.p_partkey: {k: single part.*p.p_partkey, u8: convert_u8 (part.*p.p_partkey * 7), i8: convert_i8 (part.*p.p_partkey * 7), i16: convert_i16 (part.*p.p_partkey * 999)}}", "SELECT p_partkey AS k, (p_partkey * 7) & 255 AS u8, CASE WHEN (p_partkey * 7) & 255 >= 128 THEN ((p_partkey * 7) & 255) - 256 ELSE (p_partkey * 7) & 255 END AS i8, CASE WHEN (p_partkey * 999) & 65535 >= 32768 THEN ((p_partkey * 999) & 65535) - 65536 ELSE (p_partkey * 999) & 65535 END AS i16 FROM part")
add("udf_library", "{part.*p.p_partkey: (udf.sqrt part.*p.p_size) + (udf.abs (0 - part.*p.p_size))}", "SELECT p_partkey AS key, round(sqrt(p_size) + abs(0 - p_size), 6) AS value FROM part", 6)
add("udtf_split", '{(udf.split "_" nation.*n.n_name).*i: count nation.*n.n_name}', "SELECT unnest(string_split(n_name, '_')) AS key, count(*) AS value FROM nation GROUP BY 1")

# ---- scans, sorts ----
_RUN = "SELECT list(x ORDER BY e) AS value FROM (SELECT event_id AS e, {} OVER (ORDER BY event_id) AS x FROM events WHERE event_type = 'purchase')"
for _op, _sql in {"sum": "sum(value)", "count": "count(value)", "min": "min(value)", "max": "max(value)"}.items():
    add(f"prefix_{_op}", f'let v = array (events.*e.event_type == "purchase" & events.*e.value); prefix_{_op} v.*i', _RUN.format(_sql).replace("list(x ", "list(round(x, 2) " if _op == "sum" else "list(x "), after=(lambda df: df.select(F.transform("value", lambda x: F.round(x, 2)).alias("value"))) if _op == "sum" else None)
add("prefix_by_group", "{nation.*n.n_regionkey: prefix_sum nation.*n.n_nationkey}", "SELECT key, list(x ORDER BY n) AS value FROM (SELECT n_regionkey AS key, n_nationkey AS n, sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS x FROM nation) GROUP BY 1")
add("sort_multi", 'sort (array {name: nation.*n.n_name, region: nation.*n.n_regionkey}) "region" 1 "name" 0', "SELECT n_name AS name, n_regionkey AS region FROM nation")
add("top_k", 'sort (array {key: customer.*c.c_custkey, balance: customer.*c.c_acctbal}) "balance" 1 "key" 0', "SELECT c_custkey AS key, round(c_acctbal, 2) AS balance FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10", limit=10)

# ---- JSON analytics on events ----
add("json_group_count", 'sort {events.*e.event_type || "(none)": {event: single events.*e.event_type, count: count events.*e.event_id}} "count" 1', "SELECT event_type AS event, count(*) AS count FROM events GROUP BY 1")
add("json_count_distinct_by_type", "let per = {events.*e.event_type: {event: single events.*e.event_type, count: count events.*e.event_id, users: {events.*e.user_id: count? events.*e.user_id}}}; {event: single per.*B.event, count: single per.*B.count, users: count per.*B.users.*C} | group per.*B.event", "SELECT event_type AS event, count(*) AS count, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
add("json_hour_histogram", '{hour: single (hour events.*e.ts), event: single events.*e.event_type, count: count events.*e.event_id} | group [events.*e.value > 10 & events.*e.event_type, hour events.*e.ts]', "SELECT hour(ts)::INTEGER AS hour, event_type AS event, count(*) AS count FROM events WHERE value > 10 GROUP BY 1, 2")
add("json_first_event", 'sort {events.*e.event_type == "purchase" & events.*e.user_id: {user: single events.*e.user_id, first: min? events.*e.ts}} "first" 0', "SELECT user_id AS user, min(ts) AS first FROM events WHERE event_type = 'purchase' GROUP BY 1")
add("json_activity_span", '{events.*e.event_type == "purchase" & events.*e.user_id: {user: single events.*e.user_id, span: (max? events.*e.event_id) - (min? events.*e.event_id)}}', "SELECT user_id AS user, max(event_id) - min(event_id) AS span FROM events WHERE event_type = 'purchase' GROUP BY 1")
add("json_parse", '{udf.jsonNumber events.*e.props "k": count events.*e.event_id}', "SELECT (props->>'$.k')::BIGINT AS key, count(*) AS value FROM events WHERE props->>'$.k' IS NOT NULL GROUP BY 1")

# ---- tensors ----
add("dot_product", "{embeddings.*v.vec_id: dot embeddings.*v.embedding embeddings.*v.embedding}", "SELECT vec_id AS key, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS value FROM embeddings", 4)
add("einsum_dot", "{embeddings.*v.vec_id: sum ((convert_f64 embeddings.*v.embedding.*i) * (convert_f64 embeddings.*v.embedding.*i))}", "SELECT vec_id AS key, round(sum(x::DOUBLE * x::DOUBLE), 3) AS value FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1", 3)
add("row_sum", "{*v: sum (convert_f64 embeddings.*v.embedding.*i)}", "SELECT vec_id AS key, round(sum(x::DOUBLE), 4) AS value FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1", 4)
add("column_sum", "{*i: sum (convert_f64 embeddings.*v.embedding.*i)}", "SELECT i AS key, round(sum(x::DOUBLE), 4) AS value FROM (SELECT unnest(embedding) AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS i FROM embeddings) GROUP BY 1", 4)
add("matmul", "{*i: {*j: sum ((convert_f64 embeddings.*v.embedding.*i) * (convert_f64 embeddings.*v.embedding.*j))}}", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS i FROM embeddings) SELECT a.i AS key, b.i AS key_1, round(sum(a.x * b.x), 3) AS value FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2", 3)
add("transpose", "{*i: {*v: embeddings.*v.embedding.*i}}", "SELECT (generate_subscripts(embedding, 1) - 1)::INTEGER AS key, vec_id AS key_1, unnest(embedding) AS value FROM embeddings")

# ---- files written from tables, then read by the query ----
_ORDERS = ["o_orderkey", "o_orderstatus", "o_totalprice"]
for _form, _loader in {"csv": "loadCSV", "tbl": "loadTBL", "ndjson": "loadNDJSON"}.items():
    add(f"load_{_form}", f"{{({_loader} @file @file_type).*r.o_orderstatus: sum ({_loader} @file @file_type).*r.o_totalprice}}", "SELECT o_orderstatus AS key, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1", files={"file": (_form, "orders", _ORDERS)})
add("load_json", "{(loadJSON @file @file_type).*r.n_regionkey: count (loadJSON @file @file_type).*r.n_name}", "SELECT n_regionkey AS key, count(n_name) AS value FROM nation GROUP BY 1", files={"file": ("json", "nation", ["n_nationkey", "n_name", "n_regionkey"])})
add("load_parquet", "{(loadParquet @file).*r.c_mktsegment: max (loadParquet @file).*r.c_acctbal}", "SELECT c_mktsegment AS key, round(max(c_acctbal), 2) AS value FROM customer GROUP BY 1", files={"file": ("parquet", "customer", ["c_mktsegment", "c_acctbal"])})
add("load_named_files", '{region.*r.r_regionkey < 2 & region.*r.r_regionkey: count (loadCSV (ifElse (region.*r.r_regionkey == 0) @low @high) @low_type).*q.k}', "SELECT r_regionkey AS key, CASE WHEN r_regionkey = 0 THEN (SELECT count(*) FROM nation) ELSE (SELECT count(*) FROM supplier) END AS value FROM region WHERE r_regionkey < 2",
    files={"low": ("csv", "nation", ["n_nationkey AS k"]), "high": ("csv", "supplier", ["CAST(s_suppkey AS int) AS k"])})

# ---- functions, variables, trees ----
add("fn", "{part.*p.p_partkey: (fn x (x * 2 + 1)) part.*p.p_size}", "SELECT p_partkey AS key, p_size * 2 + 1 AS value FROM part")
add("diagonal", "let m = {nation.*n.n_regionkey: {nation.*n.n_nationkey: count nation.*n.n_name}}; sum m.*i.*i", "SELECT count(*) AS value FROM nation WHERE n_regionkey = n_nationkey")
add("singleton", "{region.*r.r_regionkey: count (singleton region.*r.r_name).*k}", "SELECT r_regionkey AS key, 1 AS value FROM region")
add("filter_by_generator", "{documents.*d.doc_id: labels.*d & documents.*d.lang}", "SELECT doc_id AS key, lang AS value FROM documents SEMI JOIN labels USING (doc_id) WHERE lang IS NOT NULL")
add("filter_by_factor", "sum ((udf.isGreaterThan lineitem.*l.l_quantity 25) * lineitem.*l.l_quantity)", "SELECT round(sum(l_quantity) FILTER (WHERE l_quantity > 25), 2) AS value FROM lineitem")
add("udf_scalar", "{own.initial part.*p.p_name: count part.*p.p_partkey}", "SELECT lower(p_name[1]) AS key, count(*) AS value FROM part GROUP BY 1")
add("udaf_array", "{supplier.*s.s_nationkey: own.spread (array supplier.*s.s_acctbal)}", "SELECT s_nationkey AS key, round(max(s_acctbal) - min(s_acctbal), 2) AS value FROM supplier GROUP BY 1")
add("udf_range_join", '{part.*p.p_partkey: udf.join "+" (udf.range part.*p.p_size (part.*p.p_size - 4) (0 - 2))}', "SELECT p_partkey AS key, p_size || '+' || (p_size - 2) AS value FROM part")
add("tree_paths", "let t = {orders.*o.o_orderstatus: {orders.*o.o_orderpriority: sum orders.*o.o_totalprice}}; sum t.**p", "SELECT round(sum(o_totalprice), 2) AS value FROM orders")
add("update_map", 'count (update {region.*r.r_name: single region.*r.r_regionkey} "another" 9).*k', "SELECT count(*) + 1 AS value FROM region")
add("group_totals", "{orders.*o.o_orderstatus: {status: single orders.*o.o_orderstatus, total: sum orders.*o.o_totalprice, share: (sum orders.*o.o_totalprice) / (sum orders.*all.o_totalprice), urgent: sum {orders.*o.o_orderpriority == \"1-URGENT\" & orders.*o.o_orderpriority: sum orders.*o.o_totalprice}.*u}}",
    "SELECT o_orderstatus AS status, round(sum(o_totalprice), 4) AS total, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 4) AS share, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 0), 4) AS urgent FROM orders GROUP BY 1", 4)

def _halves(inputs: Inputs) -> DataFrame:
    """All (a, b) where b is reached from a by halving."""
    start = inputs["nation"].df.where("n_nationkey > 0").selectExpr("n_nationkey AS a", "n_nationkey div 2 AS b")
    return fixpoint(start, lambda r: r.unionByName(r.where("b > 0").selectExpr("a", "b div 2 AS b")))


QUERIES["fixed_point"] = Made("", "WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, (n_nationkey // 2)::BIGINT FROM nation WHERE n_nationkey > 0 UNION SELECT a, b // 2 FROM r WHERE b > 0) SELECT a, b FROM r", make=_halves)

# ---- TPC-H ----
_REVENUE = "lineitem.*l.l_extendedprice * (1 - lineitem.*l.l_discount)"
add("q1", f"""sort ({{l_returnflag: single lineitem.*l.l_returnflag, l_linestatus: single lineitem.*l.l_linestatus, sum_qty: sum lineitem.*l.l_quantity, sum_base_price: sum lineitem.*l.l_extendedprice,
  sum_disc_price: sum ({_REVENUE}), sum_charge: sum ({_REVENUE} * (1 + lineitem.*l.l_tax)), avg_qty: (sum lineitem.*l.l_quantity) / (count lineitem.*l.l_quantity),
  avg_price: (sum lineitem.*l.l_extendedprice) / (count lineitem.*l.l_extendedprice), avg_disc: (sum lineitem.*l.l_discount) / (count lineitem.*l.l_discount), count_order: count lineitem.*l.l_orderkey}}
  | group [lineitem.*l.l_shipdate <= 19980902 & lineitem.*l.l_returnflag, lineitem.*l.l_linestatus]) "l_returnflag" 0 "l_linestatus" 0""",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 2) AS avg_qty, round(avg(l_extendedprice), 2) AS avg_price, round(avg(l_discount), 2) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= date '1998-09-02' GROUP BY 1, 2")
add("q3", f"""let c = single customer.*c.c_custkey | group (customer.*c.c_mktsegment == "BUILDING" & customer.*c.c_custkey)
  let o = {{o_orderdate: single orders.*o.o_orderdate, o_orderpriority: single orders.*o.o_orderpriority}} | group (c.(orders.*o.o_custkey) && orders.*o.o_orderdate < 19950315 & orders.*o.o_orderkey)
  sort ({{l_orderkey: lineitem.*l.l_orderkey, revenue: sum ({_REVENUE}), o_orderdate: o.(lineitem.*l.l_orderkey).o_orderdate, o_orderpriority: o.(lineitem.*l.l_orderkey).o_orderpriority}}
  | group [o.(lineitem.*l.l_orderkey) && lineitem.*l.l_shipdate > 19950315 & lineitem.*l.l_orderkey, o.(lineitem.*l.l_orderkey).o_orderdate, o.(lineitem.*l.l_orderkey).o_orderpriority]) "revenue" 1 "o_orderdate" 0""",
    "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate, o_orderpriority FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < date '1995-03-15' AND l_shipdate > date '1995-03-15' GROUP BY 1, 3, 4 ORDER BY 2 DESC, 3 LIMIT 10", limit=10)
add("q4", """let late = count lineitem.*l.l_orderkey | group (lineitem.*l.l_returnflag == "R" & lineitem.*l.l_orderkey)
  {o_orderpriority: single orders.*o.o_orderpriority, order_count: count orders.*o.o_orderkey} | group (late.(orders.*o.o_orderkey) && 19960701 <= orders.*o.o_orderdate && orders.*o.o_orderdate < 19961001 & orders.*o.o_orderpriority)""",
    "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= date '1996-07-01' AND o_orderdate < date '1996-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
add("q5", f"""let r = single region.*r.r_regionkey | group (region.*r.r_name == "ASIA" & region.*r.r_regionkey)
  let n = {{n_name: single nation.*n.n_name}} | group (r.(nation.*n.n_regionkey) & nation.*n.n_nationkey)
  let c = {{c_nationkey: single customer.*c.c_nationkey}} | group (n.(customer.*c.c_nationkey) & customer.*c.c_custkey)
  let o = {{nation: single c.(orders.*o.o_custkey).c_nationkey}} | group (c.(orders.*o.o_custkey) && 19960101 <= orders.*o.o_orderdate && orders.*o.o_orderdate < 19970101 & orders.*o.o_orderkey)
  let s = {{s_nationkey: single supplier.*s.s_nationkey}} | group supplier.*s.s_suppkey
  sort ({{n_name: single n.(s.(lineitem.*l.l_suppkey).s_nationkey).n_name, revenue: sum ({_REVENUE})}} | group (o.(lineitem.*l.l_orderkey).nation == s.(lineitem.*l.l_suppkey).s_nationkey & s.(lineitem.*l.l_suppkey).s_nationkey)) "revenue" 1""",
    f"SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND {ASIA_1996} GROUP BY 1")
add("q6", "sum (lineitem.*l.l_shipdate >= 19960101 && lineitem.*l.l_shipdate < 19970101 && lineitem.*l.l_discount >= 0.05 && lineitem.*l.l_discount <= 0.07 && lineitem.*l.l_quantity < 24 & lineitem.*l.l_extendedprice * lineitem.*l.l_discount)",
    "SELECT round(sum(l_extendedprice * l_discount), 2) AS value FROM lineitem WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01' AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24")
add("q7", f"""let pair = (nation.*a.n_name == "NATION_1" && nation.*b.n_name == "NATION_2") || (nation.*a.n_name == "NATION_2" && nation.*b.n_name == "NATION_1")
  let sn = nation.(supplier.(lineitem.*l.l_suppkey).s_nationkey).n_name
  let cn = nation.(customer.(orders.(lineitem.*l.l_orderkey).o_custkey).c_nationkey).n_name
  {{supp_nation: single sn, cust_nation: single cn, l_year: single (year lineitem.*l.l_shipdate), revenue: sum ({_REVENUE})}} | group [((sn == "NATION_1" && cn == "NATION_2") || (sn == "NATION_2" && cn == "NATION_1")) & sn, cn, year lineitem.*l.l_shipdate]""",
    "SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate)::INTEGER AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) GROUP BY 1, 2, 3")
add("q8", f"""let y = year orders.(lineitem.*l.l_orderkey).o_orderdate
  let nat = nation.(supplier.(lineitem.*l.l_suppkey).s_nationkey).n_name
  {{o_year: single y, mkt_share: (sum (nat == "NATION_3" & {_REVENUE})) / (sum ({_REVENUE}))}} | group (part.(lineitem.*l.l_partkey).p_type == "ECONOMY" && region.(nation.(customer.(orders.(lineitem.*l.l_orderkey).o_custkey).c_nationkey).n_regionkey).r_name == "AMERICA" & y)""",
    "SELECT year(o_orderdate)::INTEGER AS o_year, round(coalesce(sum(CASE WHEN n2.n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) END), 0) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY' GROUP BY 1", 6)
add("q9", f"""let nat = nation.(supplier.(lineitem.*l.l_suppkey).s_nationkey).n_name
  let y = year orders.(lineitem.*l.l_orderkey).o_orderdate
  {{nation: single nat, o_year: single y, sum_profit: sum ({_REVENUE})}} | group [(like part.(lineitem.*l.l_partkey).p_name "%red%") & nat, y]""",
    "SELECT n_name AS nation, year(o_orderdate)::INTEGER AS o_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_profit FROM part, supplier, lineitem, orders, nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%' GROUP BY 1, 2")
add("q10", f"""let o = {{c: single orders.*o.o_custkey}} | group (19961001 <= orders.*o.o_orderdate && orders.*o.o_orderdate < 19970101 & orders.*o.o_orderkey)
  let k = o.(lineitem.*l.l_orderkey).c
  sort ({{c_custkey: single k, c_name: single customer.(k).c_name, revenue: sum ({_REVENUE}), c_acctbal: single customer.(k).c_acctbal, n_name: single nation.(customer.(k).c_nationkey).n_name}}
  | group [lineitem.*l.l_returnflag == "R" & k]) "revenue" 1 "c_custkey" 0""",
    "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(c_acctbal, 2) AS c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= date '1996-10-01' AND o_orderdate < date '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, c_custkey LIMIT 20", limit=20)
add("q11", """let v = {lineitem.*l.l_partkey: sum? lineitem.*l.l_extendedprice}; let total = sum lineitem.*m.l_extendedprice; {v.*p > total * 0.0008 & *p: v.*p}""",
    "SELECT l_partkey AS key, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1 HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.0008 FROM lineitem)")
add("q12", """let p = orders.(lineitem.*l.l_orderkey).o_orderpriority
  {flag: single lineitem.*l.l_returnflag, high: sum (ifElse (p == "1-URGENT" || p == "2-HIGH") 1 0), low: sum (ifElse (p != "1-URGENT" && p != "2-HIGH") 1 0)} | group (19960101 <= lineitem.*l.l_shipdate && lineitem.*l.l_shipdate < 19970101 && p & lineitem.*l.l_returnflag)""",
    "SELECT l_returnflag AS flag, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01' GROUP BY 1")
add("q13", """let lines = {lineitem.*l.l_orderkey: count lineitem.*l.l_linenumber}; let per = {orders.*o.o_orderkey: single (lines.(orders.*o.o_orderkey) || 0)}; {c_count: single per.*k, custdist: count per.*k} | group per.*k""",
    "SELECT c_count, count(*) AS custdist FROM (SELECT o_orderkey, count(l_orderkey) AS c_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1")
add("q14", f"""let hit = lineitem.*l.l_shipdate >= 19960901 && lineitem.*l.l_shipdate < 19961001
  100 * (sum ((like part.(lineitem.*l.l_partkey).p_type "PROMO%") && hit & {_REVENUE})) / (sum (hit & {_REVENUE}))""",
    "SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= date '1996-09-01' AND l_shipdate < date '1996-10-01'", 6)
add("q15", f"""let revenue = {{lineitem.*l.l_shipdate >= 19960101 && lineitem.*l.l_shipdate < 19960401 & lineitem.*l.l_suppkey: sum ({_REVENUE})}}
  let top = max revenue.*k
  array (revenue.(supplier.*s.s_suppkey) == top & {{s_suppkey: supplier.*s.s_suppkey, s_name: supplier.*s.s_name, total_revenue: revenue.(supplier.*s.s_suppkey)}})""",
    "WITH r AS (SELECT l_suppkey AS k, sum(l_extendedprice * (1 - l_discount)) AS t FROM lineitem WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-04-01' GROUP BY 1) SELECT s_suppkey, s_name, round(t, 2) AS total_revenue FROM supplier JOIN r ON k = s_suppkey WHERE t = (SELECT max(t) FROM r)")
add("q2", """let eu = single region.*r.r_regionkey | group (region.*r.r_name == "EUROPE" & region.*r.r_regionkey)
  let s = {s_name: single supplier.*s.s_name, s_acctbal: single supplier.*s.s_acctbal} | group (eu.(nation.(supplier.*s.s_nationkey).n_regionkey) & supplier.*s.s_suppkey)
  let cheapest = min? lineitem.*l.l_extendedprice | group (s.(lineitem.*l.l_suppkey) && part.(lineitem.*l.l_partkey).p_size == 15 & lineitem.*l.l_partkey)
  sort (array (s.(lineitem.*m.l_suppkey) && cheapest.(lineitem.*m.l_partkey) == lineitem.*m.l_extendedprice & {s_acctbal: s.(lineitem.*m.l_suppkey).s_acctbal, s_name: s.(lineitem.*m.l_suppkey).s_name, p_partkey: lineitem.*m.l_partkey, cost: lineitem.*m.l_extendedprice})) "s_acctbal" 1 "s_name" 0 "p_partkey" 0""",
    "WITH e AS (SELECT l_partkey, l_extendedprice, s_acctbal, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey WHERE r_name = 'EUROPE' AND p_size = 15) SELECT round(s_acctbal, 2) AS s_acctbal, s_name, l_partkey AS p_partkey, round(l_extendedprice, 2) AS cost FROM e WHERE l_extendedprice = (SELECT min(l_extendedprice) FROM e f WHERE f.l_partkey = e.l_partkey)")
add("q16", """let bad = {supplier.*s.s_acctbal < 0 & supplier.*s.s_suppkey: count supplier.*s.s_suppkey}
  let p = part.(lineitem.*l.l_partkey)
  let per = {brand: single p.p_brand, size: single p.p_size, suppliers: {lineitem.*l.l_suppkey: count? lineitem.*l.l_suppkey}} | group [(isUndef bad.(lineitem.*l.l_suppkey)) && p.p_size < 10 & p.p_brand, p.p_size]
  array {brand: per.*g.brand, size: per.*g.size, supplier_cnt: count per.*g.suppliers.*s2}""",
    "SELECT p_brand AS brand, p_size AS size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1, 2")
add("q17", """let a = {lineitem.*l.l_partkey: (sum lineitem.*l.l_quantity) / (count lineitem.*l.l_quantity)}
  (sum (part.(lineitem.*m.l_partkey).p_brand == "Brand#23" && lineitem.*m.l_quantity < 0.2 * a.(lineitem.*m.l_partkey) & lineitem.*m.l_extendedprice)) / 7""",
    "SELECT round(coalesce(sum(l_extendedprice), 0) / 7.0, 2) AS value FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = part.p_partkey)")
add("q18", """let big = {lineitem.*l.l_orderkey: sum lineitem.*l.l_quantity}
  sort (array (big.(orders.*o.o_orderkey) > 300 & {c_name: customer.(orders.*o.o_custkey).c_name, o_orderkey: orders.*o.o_orderkey, o_orderdate: orders.*o.o_orderdate, o_totalprice: orders.*o.o_totalprice, sum_qty: big.(orders.*o.o_orderkey)})) "o_totalprice" 1 "o_orderdate" 0""",
    "SELECT c_name, o_orderkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice, round(q, 2) AS sum_qty FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE q > 300 ORDER BY orders.o_totalprice DESC, o_orderdate LIMIT 100", limit=100)
add("q19", f"""let p = part.(lineitem.*l.l_partkey)
  sum ((part.(lineitem.*l.l_partkey).p_size <= 5 && lineitem.*l.l_quantity <= 11) || (part.(lineitem.*l.l_partkey).p_size <= 10 && lineitem.*l.l_quantity >= 40) & {_REVENUE})""",
    "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS value FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_size <= 5 AND l_quantity <= 11) OR (p_size <= 10 AND l_quantity >= 40))")
add("q20", """let used = {lineitem.*l.l_shipdate >= 19960101 && lineitem.*l.l_shipdate < 19970101 && part.(lineitem.*l.l_partkey).p_size > 40 & lineitem.*l.l_suppkey: sum lineitem.*l.l_quantity}
  array (used.(supplier.*s.s_suppkey) > 100 && nation.(supplier.*s.s_nationkey).n_regionkey == 2 & {s_name: supplier.*s.s_name, qty: used.(supplier.*s.s_suppkey)})""",
    "SELECT s_name, round(q, 2) AS qty FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01' AND p_size > 40 GROUP BY 1) ON l_suppkey = s_suppkey WHERE n_regionkey = 2 AND q > 100")
add("q21", """let all = {lineitem.*l.l_orderkey: {lineitem.*l.l_suppkey: count? lineitem.*l.l_suppkey}}
  let late = {lineitem.*r.l_returnflag == "R" & lineitem.*r.l_orderkey: {lineitem.*r.l_suppkey: count? lineitem.*r.l_suppkey}}
  let suppliers = {*o: count all.*o.*s}
  let returned = {*q: count late.*q.*t}
  {s_name: single supplier.(lineitem.*m.l_suppkey).s_name, numwait: count lineitem.*m.l_orderkey} | group (lineitem.*m.l_returnflag == "R" && suppliers.(lineitem.*m.l_orderkey) > 1 && returned.(lineitem.*m.l_orderkey) == 1 & lineitem.*m.l_suppkey)""",
    "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem m ON s_suppkey = m.l_suppkey WHERE m.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = m.l_orderkey AND x.l_suppkey <> m.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = m.l_orderkey AND x.l_suppkey <> m.l_suppkey AND x.l_returnflag = 'R') GROUP BY s_suppkey, s_name")
add("q22", """let recent = {19960101 <= orders.*o.o_orderdate && orders.*o.o_orderdate < 19960401 & orders.*o.o_custkey: count orders.*o.o_orderkey}
  let average = (sum (customer.*d.c_acctbal > 0 & customer.*d.c_acctbal)) / (count (customer.*d.c_acctbal > 0))
  {code: single (substr customer.*c.c_name 9 11), numcust: count customer.*c.c_custkey, totacctbal: sum customer.*c.c_acctbal} | group (customer.*c.c_acctbal > average && (isUndef recent.(customer.*c.c_custkey)) & (substr customer.*c.c_name 9 11))""",
    "SELECT substr(c_name, 10, 2) AS code, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= date '1996-01-01' AND o_orderdate < date '1996-04-01') GROUP BY 1")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
