"""Queries of the document operators over the test tables (``QUERIES``) and their SQL (``SQL``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfold.functions import compare as c
from quillfold.functions import scalar as s
from quillfold.operators import aggregates as a
from quillfold.operators import changes, constraints, rows
from quillfold.sources.collection import Store
from quillfold.sources.readers import json_documents, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(source: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a function of one or more tables (``source``: names divided by blanks)."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf: f(*(table(spark, sf, n) for n in source.split()))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _nv() -> Column:
    """``event_type`` with nulls in it."""
    return F.nullif(F.col("event_type"), F.lit("error"))


def _one(like: DataFrame, row: Row | None) -> DataFrame:
    """A row, or none, as a table."""
    return like.sparkSession.createDataFrame([row] if row else [], like.schema)


def _capped() -> Column:
    """``value`` with nulls in it."""
    return F.when(F.col("value") > 100, F.lit(None)).otherwise(F.col("value"))


_NV = "(SELECT event_id, nullif(event_type, 'error') AS nv FROM events)"
_CAP = "(SELECT event_id, event_type, CASE WHEN value > 100 THEN NULL ELSE value END AS nv FROM events)"


# scans and lookups -----------------------------------------------------------------------------


@query("nation", "SELECT * FROM nation")
def scan_find_all(nation):
    return nation


@query("orders", "SELECT * FROM orders WHERE o_orderkey = 42")
def find_by_id(orders):
    return rows.find_by_id(orders, "o_orderkey", 42)


@query("orders", "SELECT * FROM orders WHERE o_orderkey IN (1, 5, 9)")
def find_many_ids(orders):
    return rows.find_by_ids(orders, "o_orderkey", [1, 5, 9, 9, None])


@query("orders", "SELECT * FROM orders WHERE o_orderkey = 42 AND o_totalprice > 0")
def pk_plus_predicate(orders):
    return orders.where(c.and_(c.eq(F.col("o_orderkey"), 42), c.gt(F.col("o_totalprice"), 0)))


# predicates ------------------------------------------------------------------------------------


@query("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def pred_eq_ne(orders):
    return orders.where(c.ne(F.col("o_orderstatus"), "F")).select("o_orderkey")


@query("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000")
def pred_range(orders):
    price = F.col("o_totalprice")
    return orders.where(c.and_(c.ge(price, 100000), c.lt(price, 200000))).select("o_orderkey")


@query("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000")
def pred_or_union(orders):
    return orders.where(c.or_(c.eq(F.col("o_orderstatus"), "P"), c.gt(F.col("o_totalprice"), 400000))).select("o_orderkey")


@query("orders", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice < 50000) OR o_orderpriority = '1-URGENT'")
def pred_nested_logic(orders):
    cheap = c.and_(c.eq(F.col("o_orderstatus"), "F"), c.lt(F.col("o_totalprice"), 50000))
    return orders.where(c.or_(cheap, c.eq(F.col("o_orderpriority"), "1-URGENT"))).select("o_orderkey")


@query("orders", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000)")
def pred_not(orders):
    return orders.where(c.not_(c.or_(c.eq(F.col("o_orderstatus"), "F"), c.gt(F.col("o_totalprice"), 100000)))).select("o_orderkey")


@query("events", f"SELECT event_id FROM {_NV} WHERE nv IS NULL OR nv < 'purchase'")
def null_lt(events):
    return events.where(c.lt(_nv(), "purchase")).select("event_id")


@query("events", f"SELECT event_id FROM {_NV} WHERE nv IS NULL OR nv <= 'purchase'")
def null_le(events):
    return events.where(c.le(_nv(), "purchase")).select("event_id")


@query("events", f"SELECT event_id FROM {_NV} WHERE nv IS DISTINCT FROM 'purchase'")
def null_ne(events):
    return events.where(c.ne(_nv(), "purchase")).select("event_id")


@query("events", f"SELECT event_id FROM {_CAP} WHERE NOT coalesce(nv > 50, false)")
def null_not_gt(events):
    return events.where(c.not_(c.gt(_capped(), 50))).select("event_id")


@query("events", f"SELECT event_id FROM {_CAP} WHERE NOT coalesce(nv >= 50, false)")
def null_not_ge(events):
    return events.where(c.not_(c.ge(_capped(), 50))).select("event_id")


@query("events", f"SELECT count(*) AS n FROM {_NV} WHERE nv IS NOT DISTINCT FROM NULL")
def null_eq_null(events):
    return a.summarise(events.where(c.eq(_nv(), None)), n=a.count())


@query("events", "SELECT event_id FROM (SELECT event_id, nullif(event_type, 'error') AS x, nullif(event_type, 'click') AS y FROM events) WHERE (x IS NULL AND y IS NOT NULL) OR coalesce(x < y, false)")
def column_lt_column(events):
    return events.where(c.lt(_nv(), F.nullif(F.col("event_type"), F.lit("click")))).select("event_id")


@query("events", f"SELECT event_id FROM {_NV} WHERE nv IS NULL")
def is_null(events):
    return events.where(c.is_null(_nv())).select("event_id")


@query("events", f"SELECT event_id FROM {_NV} WHERE nv IS NOT NULL")
def is_not_null(events):
    return events.where(c.holds(_nv(), "string")).select("event_id")


@query("events", f"SELECT event_id FROM {_NV} WHERE nv IS NULL OR nv IN ('click', 'view')")
def in_list_with_null(events):
    return events.where(c.is_in(_nv(), ["click", "view", None])).select("event_id")


@query("part", "SELECT p_partkey FROM part WHERE contains(p_name, 'widget')")
def str_contains(part):
    return part.where(c.contains(F.col("p_name"), "widget")).select("p_partkey")


@query("part", "SELECT p_partkey FROM part WHERE contains(lower(p_name), lower('WIDGET'))")
def str_contains_ignore_case(part):
    return part.where(c.contains(F.col("p_name"), "WIDGET", ignore_case=True)).select("p_partkey")


@query("orders", "SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1-')")
def str_starts(orders):
    return orders.where(c.starts_with(F.col("o_orderpriority"), "1-")).select("o_orderkey")


@query("customer", "SELECT c_custkey FROM customer WHERE ends_with(c_name, '7')")
def str_ends(customer):
    return customer.where(c.ends_with(F.col("c_name"), "7")).select("c_custkey")


@query("customer", "SELECT c_custkey FROM customer WHERE c_name LIKE '%00000001%'")
def like_forms(customer):
    return customer.where(c.like(F.col("c_name"), "%00000001%")).select("c_custkey")


@query(
    "customer",
    "SELECT c_custkey, c_name LIKE 'Customer#0000000%' AS a, c_name LIKE '%7' AS b, c_name = 'Customer#000000003' AS e, true AS every FROM customer",
)
def like_other_forms(customer):
    name = F.col("c_name")
    return rows.project(customer, c_custkey="c_custkey", a=c.like(name, "Customer#0000000%"), b=c.like(name, "%7"), e=c.like(name, "Customer#000000003"), every=c.like(name, "%"))


@query("events", "SELECT event_id FROM (SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN chr(9) || ' ' ELSE event_type END AS nv FROM events) WHERE nv IS NULL OR trim(nv, chr(9) || ' ') = ''")
def fn_null_or_blank(events):
    kind = F.col("event_type")
    nv = F.when(kind == "error", F.lit(None)).when(kind == "click", F.lit("\t ")).otherwise(kind)
    return events.where(c.null_or_blank(nv)).select("event_id")


@query("events", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value > 50 END AS flag FROM events) WHERE coalesce(flag, false)")
def bare_boolean(events):
    return events.where(c.holds(F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value") > 50), "boolean")).select("event_id")


@query("orders", "SELECT count(*) AS n, 0 AS more FROM orders WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL")
def unlike_types(orders):
    """A text is never above a number, nor equal to it, and a number never below a text."""
    text, number = F.col("o_orderpriority"), F.col("o_totalprice")
    never = c.or_(c.gt(text, 1), c.eq(text, 1), c.lt(number, "5"), c.ge(number, text))
    return a.summarise(orders, n=a.count(c.not_(never)), more=F.count_if(never).cast("int"))


@query("events", "SELECT count(*) AS past FROM events WHERE ts < now()")
def now_today(events):
    return a.summarise(events.where(c.and_(c.lt(F.col("ts"), s.now()), c.le(s.today(), s.now()))), past=a.count())


@query("events", "SELECT event_id FROM (SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN '' ELSE event_type END AS nv FROM events) WHERE nv IS NULL OR nv = ''")
def fn_null_or_empty(events):
    kind = F.col("event_type")
    nv = F.when(kind == "error", F.lit(None)).when(kind == "click", F.lit("")).otherwise(kind)
    return events.where(c.null_or_empty(nv)).select("event_id")


@query("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND starts_with(o_orderpriority, '1-')")
def where_text_with_parameters(orders):
    view = orders.createOrReplaceTempView("orders_by_text") or orders.sparkSession
    return view.sql("SELECT o_orderkey FROM orders_by_text WHERE o_totalprice >= :least AND startswith(o_orderpriority, :mark)", args={"least": 1000, "mark": "1-"})


# functions -------------------------------------------------------------------------------------


@query("nation", "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, trim('  ' || n_name || chr(9)  || ' ', ' ' || chr(9)) AS tr FROM nation")
def fn_lower_upper_trim(nation):
    name = F.col("n_name")
    return rows.project(nation, n_nationkey="n_nationkey", lo=F.lower(name), up=F.upper(name), tr=s.trim(F.concat(F.lit("  "), name, F.lit("\t "))))


@query("customer", "SELECT c_custkey, substring(c_name, 1, 4) AS s, replace(c_name, 'Customer', 'C') AS r, CAST(length(c_name) AS INTEGER) AS len FROM customer")
def fn_substring_replace(customer):
    name = F.col("c_name")
    return rows.project(customer, c_custkey="c_custkey", s=s.substring(name, 0, 4), r=s.replace(name, "Customer", "C"), len=F.length(name))


@query("events", "SELECT event_id, concat(coalesce(nullif(event_type, 'error'), ''), '!') AS c FROM events")
def fn_concat_null(events):
    return rows.project(events, event_id="event_id", c=s.concat(_nv(), "!"))


@query("part", "SELECT p_partkey, CAST(p_size AS BIGINT) + 5 AS a, CAST(p_size AS BIGINT) * 2 - 1 AS m, CAST(p_size AS BIGINT) // 3 AS d, -p_size AS n FROM part")
def arith_int(part):
    size = F.col("p_size")
    return rows.project(part, p_partkey="p_partkey", a=s.add(size, 5), m=s.subtract(s.multiply(size, 2), 1), d=s.divide(size, 3), n=s.negate(size))


@query("part", "SELECT p_partkey, round_even(p_retailprice / 10, 0) AS r FROM part")
def arith_round_even(part):
    return rows.project(part, p_partkey="p_partkey", r=s.round_even(s.divide(F.col("p_retailprice"), 10, integral=False)))


@query("customer", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f FROM customer")
def arith_abs_ceil_floor(customer):
    x = F.col("c_acctbal")
    return rows.project(customer, c_custkey="c_custkey", a=s.absolute(x), c=s.ceiling(x), f=s.floor(x))


@query("part", "SELECT p_partkey, CAST(least(p_size, 10) AS DOUBLE) AS mn, CAST(greatest(p_size, 10) AS DOUBLE) AS mx, pow(p_size, 2) AS pw, sqrt(p_size) AS sq FROM part")
def arith_min_max_pow_sqrt(part):
    x = F.col("p_size")
    return rows.project(part, p_partkey="p_partkey", mn=s.smaller(x, 10), mx=s.larger(x, 10), pw=s.power(x, 2), sq=s.square_root(x))


@query("orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS k FROM orders")
def ternary(orders):
    return rows.project(orders, o_orderkey="o_orderkey", k=c.if_else(c.gt(F.col("o_totalprice"), 200000), "big", "small"))


@query("part", "SELECT p_partkey, CAST(round_even(p_retailprice, 0) AS INTEGER) AS i, CAST(p_size AS DOUBLE) AS d FROM part")
def convert_rounds(part):
    return rows.project(part, p_partkey="p_partkey", i=s.to_integer(F.col("p_retailprice")), d=F.col("p_size").cast("double"))


@query(
    "events",
    "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, "
    "CAST(dayofweek(ts) AS INTEGER) AS w, CAST(date_trunc('day', ts) AS TIMESTAMP) AS t FROM events",
)
def date_parts(events):
    ts = F.col("ts")
    parts = {n[0]: s.date_part(ts, n) for n in ("year", "month", "day", "hour")}
    return rows.project(events, event_id="event_id", **parts, w=s.day_of_week(ts), t=s.date_of(ts))


@query("events", "SELECT event_id, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS se, CAST(event_id AS VARCHAR) AS t FROM events")
def time_parts_and_text(events):
    ts = F.col("ts")
    return rows.project(events, event_id="event_id", mi=s.date_part(ts, "minute"), se=s.date_part(ts, "second"), t=s.text(F.col("event_id")))


@query("orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate + INTERVAL 36 HOUR AS h FROM orders")
def date_add(orders):
    at = F.col("o_orderdate")
    return rows.project(orders, o_orderkey="o_orderkey", m=s.add_months(at, months=1), h=s.add_time(at, days=1.5))


@query("embeddings", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, list_contains(embedding, CAST(0 AS FLOAT)) AS has0 FROM embeddings")
def array_ops(embeddings):
    e = F.col("embedding")
    return rows.project(embeddings, vec_id="vec_id", n=s.array_count(e), has0=s.array_has(e, F.lit(0.0).cast("float")))


@query("embeddings", "SELECT vec_id, list_max(embedding) AS mx, list_min(embedding) AS mn FROM embeddings")
def array_agg_rows(embeddings):
    e = F.col("embedding")
    return rows.project(embeddings, vec_id="vec_id", mx=F.array_max(e), mn=F.array_min(e))


@query("embeddings", "SELECT vec_id, round(coalesce(list_sum(embedding), 0), 3) + 0.0 AS total, round(coalesce(list_sum(embedding) / len(embedding), 0), 3) + 0.0 AS mean FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def array_sum_average(embeddings):
    e = F.col("embedding")
    return rows.project(embeddings, vec_id="vec_id", total=F.round(s.array_sum(e), 3), mean=F.round(s.array_average(e), 3))


@query("events", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def json_field(events):
    return rows.project(events, event_id="event_id", k=s.json_field(F.col("props"), "k").cast("int"))


_VARIANT = """SELECT event_id, CASE k WHEN 0 THEN 'null' WHEN 1 THEN 'number' WHEN 2 THEN '"' || event_type || '"' ELSE 'true' END AS v,
  CAST(CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 2 END AS INTEGER) AS rank, CASE k WHEN 1 THEN value WHEN 3 THEN 1.0 END AS number,
  CASE k WHEN 2 THEN event_type END AS text FROM (SELECT *, event_id % 4 AS k FROM events) ORDER BY rank, number, text, event_id"""


@query("events", _VARIANT)
def variant_order(events):
    """Mixed types in one field sort by type first."""
    k = F.col("event_id") % 4
    doc = F.when(k == 0, F.lit("null")).when(k == 1, F.col("value").cast("string")).when(k == 2, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(F.lit("true"))
    mixed = events.withColumn("v", F.parse_json(doc))
    keyed = mixed.withColumn("k", s.value_order(F.col("v"))).orderBy("k", "event_id")
    shown = F.when(F.col("k.rank") == 3, F.lit("number")).otherwise(F.to_json("v"))
    return keyed.select("event_id", shown.alias("v"), "k.rank", "k.number", "k.text")


# projection, order, pages ----------------------------------------------------------------------


@query("orders", "SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_orderstatus = 'O'")
def sql_select_alias(orders):
    return rows.project(orders.where(c.eq(F.col("o_orderstatus"), "O")), id="o_orderkey", total="o_totalprice")


@query("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def sql_order_limit_offset(orders):
    return rows.page(orders.where(c.ge(F.col("o_totalprice"), 1000)).select("o_orderkey", "o_totalprice"), ["-o_totalprice"], 5, 10, tie="o_orderkey")


@query("orders", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 25")
def sql_tiebreak(orders):
    return rows.page(orders.select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], 0, 25, tie="o_orderkey")


@query("customer", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 40")
def order_multi(customer):
    return rows.page(customer.select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment", "-c_acctbal", "c_custkey"], 0, 40)


@query("events", f"SELECT event_id, nv FROM {_NV} ORDER BY nv NULLS FIRST, event_id LIMIT 20")
def topk_nulls_first(events):
    return rows.page(rows.project(events, event_id="event_id", nv=_nv()), ["nv", "event_id"], 0, 20)


@query("events", f"SELECT event_id, nv FROM {_CAP} ORDER BY nv DESC NULLS LAST, event_id LIMIT 20")
def topk_nulls_last_desc(events):
    return rows.page(rows.project(events, event_id="event_id", nv=_capped()), ["-nv", "event_id"], 0, 20)


@query("orders", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20) ORDER BY o_orderkey OFFSET 5")
def take_then_skip(orders):
    return rows.take_then_skip(orders.select("o_orderkey"), ["o_orderkey"], 20, 5)


@query("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def last_element(orders):
    return _one(orders.select("o_orderkey"), rows.last(orders.select("o_orderkey"), ["o_orderkey"]))


@query("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 7")
def element_at(orders):
    return _one(orders.select("o_orderkey"), rows.element_at(orders.select("o_orderkey"), ["o_orderkey"], 7))


@query("orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def first_element(orders):
    keys = orders.select("o_orderkey", "o_totalprice")
    return _one(keys, rows.first(keys, ["o_totalprice", "o_orderkey"])).select("o_orderkey")


@query("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 ORDER BY o_orderkey LIMIT 5 OFFSET 10")
def find_skip_limit(orders):
    return rows.find(orders, c.ge(F.col("o_totalprice"), 1000), 10, 5, "o_orderkey").select("o_orderkey")


@query("orders", "SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 7 OFFSET 3")
def page_with_total(orders):
    return rows.page_with_total(orders.where(c.eq(F.col("o_orderstatus"), "P")).select("o_orderkey"), ["o_orderkey"], 3, 7)


# aggregates ------------------------------------------------------------------------------------


@query("orders", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def count_pred(orders):
    return a.summarise(orders, n=a.count(c.gt(F.col("o_totalprice"), 100000)))


@query("orders", "SELECT bool_or(o_totalprice > 400000) AS any_big, bool_and(o_totalprice > 0) AS all_pos FROM orders")
def any_all(orders):
    price = F.col("o_totalprice")
    return rows.any_all(orders, c.gt(price, 400000), c.gt(price, 0), ("any_big", "all_pos"))


@query("orders", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct_scalar(orders):
    return a.distinct(orders, "o_orderpriority")


@query("orders", "SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_count(orders):
    return a.group(orders, {"k": "o_orderstatus"}, n=a.count())


@query("orders", "SELECT o_orderstatus AS k, round(sum(o_totalprice), 2) AS s, min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders GROUP BY o_orderstatus")
def group_sum_min_max(orders):
    x = F.col("o_totalprice")
    return a.group(orders, {"k": "o_orderstatus"}, s=F.round(a.exact_total(x), 2), mn=F.min(x), mx=F.max(x))


@query("events", f"SELECT event_type AS k, round(coalesce(sum(nv), 0) / count(*), 6) AS a FROM {_CAP} GROUP BY event_type")
def group_avg_counts_nulls(events):
    return a.group(events, {"k": "event_type"}, a=F.round(a.average(_capped()), 6))


@query("orders", "SELECT o_orderstatus AS k, round(sum(o_totalprice / 1000) / count(*), 6) AS a FROM orders GROUP BY o_orderstatus")
def group_avg_thousandths(orders):
    return a.group(orders, {"k": "o_orderstatus"}, a=F.round(a.average(F.col("o_totalprice") / 1000), 6))


@query("part", "SELECT CAST(sum(CAST(p_size AS HUGEINT) * 1000000000000000) AS DOUBLE) AS s FROM part")
def sum_of_large(part):
    return a.summarise(part, s=a.exact_total(F.col("p_size") * F.lit(1e15)))


@query("events", f"SELECT nv AS k, count(*) AS n FROM {_NV} GROUP BY nv")
def group_null_key(events):
    return a.group(events, {"k": _nv()}, n=a.count())


@query("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_composite(lineitem):
    return a.group(lineitem, {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}, n=a.count(), q=a.exact_total(F.col("l_quantity")))


@query("orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def group_then_filter(orders):
    return a.group(orders, {"o_custkey": "o_custkey"}, n=a.count()).where(c.gt(F.col("n"), 10))


@query("orders", "SELECT o_orderpriority AS k, count(*) FILTER (WHERE o_totalprice > 100000) AS n FROM orders GROUP BY o_orderpriority")
def group_count_pred(orders):
    return a.group(orders, {"k": "o_orderpriority"}, n=a.count(c.gt(F.col("o_totalprice"), 100000)))


@query("orders", "SELECT coalesce(sum(o_totalprice), 0) AS s FROM orders WHERE o_totalprice < 0")
def sum_empty_is_zero(orders):
    return a.summarise(orders.where(c.and_(c.is_not_null(F.col("o_totalprice")), c.lt(F.col("o_totalprice"), 0))), s=a.total(F.col("o_totalprice")))


# references and constraints --------------------------------------------------------------------


@query("orders customer", "SELECT o.o_orderkey, o.o_custkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def include_one(orders, customer):
    return rows.include(orders, "o_custkey", customer, "c_custkey", "customer").select("o_orderkey", "o_custkey", F.col("customer.c_name").alias("c_name"))


@query("orders customer", "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey < 50) c ON o.o_custkey = c.c_custkey")
def include_missing_ref(orders, customer):
    some = customer.where("c_custkey < 50")
    return rows.include(orders, "o_custkey", some, "c_custkey", "customer").select("o_orderkey", F.col("customer.c_name").alias("c_name"))


@query("orders customer", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_custkey < 50)")
def fk_violations(orders, customer):
    return constraints.dangling(orders, "o_custkey", customer.where("c_custkey < 50"), "c_custkey").select("o_orderkey")


@query("orders", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def unique_violations(orders):
    return constraints.duplicates(orders, "o_custkey").withColumnRenamed("o_custkey", "k")


@query("events", f"SELECT nv AS k, count(*) AS n FROM {_NV} WHERE nv IS NOT NULL GROUP BY nv HAVING count(*) > 1")
def unique_violations_sparse(events):
    return constraints.duplicates(rows.project(events, k=_nv()), "k", sparse=True)


@query("region", "SELECT r_regionkey, r_name, 0 AS population FROM region")
def schema_defaults(region):
    schema = T.StructType([*region.schema.fields, constraints.field("population", "int", required=True)])
    return constraints.with_defaults(region, schema)


@query("region", "SELECT 'create table \"region\" (' || chr(10) || '  \"r_regionkey\" \"int\",' || chr(10) || '  \"r_name\" \"string\"' || chr(10) || ');' AS ddl")
def schema_ddl(region):
    """DDL text of a declared schema, one row."""
    return region.sparkSession.createDataFrame([(constraints.ddl("region", region.schema),)], "ddl string")


@query("region", "SELECT r_name, CAST(row_number() OVER (ORDER BY r_regionkey) + 4 AS INTEGER) AS id FROM region WHERE r_regionkey < 3")
def identity_ids(region):
    taken = region.select(F.col("r_regionkey").alias("id"))
    return constraints.numbered(region.where("r_regionkey < 3").orderBy("r_regionkey").select("r_name"), taken, "id")


# changes ---------------------------------------------------------------------------------------


@query("region", "SELECT * FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def dml_insert(region):
    return changes.insert(region, region.sparkSession.createDataFrame([(99, "ATLANTIS")], "r_regionkey int, r_name string"))


@query("customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(customer):
    return changes.set_where(customer, c.lt(F.col("c_acctbal"), 0), "c_custkey", c_mktsegment="DEBT").select("c_custkey", "c_mktsegment")


@query("orders", "SELECT o_orderkey, CASE WHEN o_orderkey < 5 THEN TIMESTAMP '2024-02-29 00:00:00' ELSE o_orderdate END AS o_orderdate, CASE WHEN o_orderkey < 5 THEN 12 ELSE o_totalprice END AS o_totalprice FROM orders")
def dml_update_coerced(orders):
    """A text becomes a date, a text of a number the number."""
    new = changes.set_where(orders, c.lt(F.col("o_orderkey"), 5), "o_orderkey", o_orderdate="2024-02-29", o_totalprice="12")
    return new.select("o_orderkey", "o_orderdate", "o_totalprice")


@query("nation", "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'CANUCK' ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_replace(nation):
    new = nation.where("n_nationkey = 3").withColumn("n_name", F.lit("CANUCK"))
    return changes.update(nation, new.unionByName(new.withColumn("n_nationkey", F.lit(1000))), "n_nationkey")


@query("orders", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def dml_delete(orders):
    return changes.delete_where(orders, c.eq(F.col("o_orderstatus"), "F")).select("o_orderkey")


@query("orders", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (1, 2, 3)")
def dml_delete_ids(orders):
    return changes.delete(orders, orders.sparkSession.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "o_orderkey long"), "o_orderkey").select("o_orderkey")


@query("region", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (1, 77) UNION ALL SELECT * FROM (VALUES (1, 'NEW'), (77, 'ADDED')) t(a, b)")
def dml_upsert(region):
    return changes.upsert(region, region.sparkSession.createDataFrame([(1, "NEW"), (77, "ADDED")], "r_regionkey int, r_name string"), "r_regionkey")


@query("nation", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (0, 1) UNION ALL SELECT 1, 'OVERLAID' UNION ALL SELECT 500, 'PENDING'")
def txn_overlay(nation):
    pending = nation.sparkSession.createDataFrame(
        [(0, None, 1, True), (1, "FIRST", 2, False), (1, "OVERLAID", 3, False), (500, "PENDING", 4, False)], "n_nationkey int, n_name string, seq int, gone boolean"
    )
    return changes.overlay(nation.select("n_nationkey", "n_name"), pending, "n_nationkey", "seq", "gone")


# collections on storage ------------------------------------------------------------------------


def _store(spark: SparkSession) -> Store:
    """A new store in the shared folder; a local one only in local mode where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillfold-")
    return Store(spark, f"{base.rstrip('/')}/stores/{uuid.uuid4().hex}")


@query("nation", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'LOW' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 99, 'NOWHERE', 0")
def store_changes(nation):
    """Insert, update, delete and upsert, each written as a version and read back."""
    c_ = _store(nation.sparkSession).collection("nation", "n_nationkey", layout=["n_regionkey"])
    c_.insert(nation)
    c_.set_where(c.lt(F.col("n_nationkey"), 5), n_name="LOW")
    c_.delete([7, 7, None])
    c_.upsert(nation.where("n_nationkey = 8").unionByName(nation.sparkSession.createDataFrame([(99, "NOWHERE", 0)], nation.schema)))
    return c_.find_all()


@query("customer orders", "SELECT o_orderkey, CASE WHEN o_custkey = 1 THEN 'RENAMED' ELSE c_name END AS c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 300000")
def store_transaction(customer, orders):
    """Chains of changes of two collections, each chain written as one version; then references loaded."""
    store = _store(customer.sparkSession)
    people = store.collection("customer", "c_custkey", customer.schema)
    bought = store.collection("orders", "o_orderkey", orders.schema, references={"o_custkey": people})
    people.apply(
        lambda t: changes.insert(t, customer),
        lambda t: changes.set_where(t, c.eq(F.col("c_custkey"), 1), "c_custkey", c_name="RENAMED"),
    )
    bought.apply(lambda t: changes.insert(t, orders), lambda t: changes.delete_where(t, c.lt(F.col("o_totalprice"), 300000)))
    return bought.include("o_custkey", "customer").select("o_orderkey", F.col("customer.c_name").alias("c_name"))


@query("orders", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def store_sql(orders):
    """SQL text with parameters over a stored collection."""
    store = _store(orders.sparkSession)
    store.collection("shop_orders", "o_orderkey").insert(orders)
    return store.sql("SELECT o_orderstatus, count(*) AS n FROM shop_orders WHERE o_totalprice > :least GROUP BY o_orderstatus", least=1000)


@query("nation", "SELECT 'kept' AS name, 25 AS rows_, 1 AS versions, true AS there, false AS gone, 'NATION_0' AS one UNION ALL SELECT 'packed', 23, 3, true, false, NULL")
def store_catalogue(nation):
    """Names, statistics, existence, dropping, compacting, finding one."""
    store = _store(nation.sparkSession)
    for name in ("dropped", "kept", "packed"):
        store.collection(name, "n_nationkey").insert(nation)
    store.drop("dropped")
    packed = store.collection("packed", "n_nationkey")
    packed.delete([0, 1])
    packed.compact(1)
    first = {n: store.collection(n, "n_nationkey").find_one(c.eq(F.col("n_nationkey"), 0)) for n in store.names()}
    facts = [(n, store.exists(n), store.exists("dropped"), r.n_name if r else None) for n, r in first.items()]
    known = nation.sparkSession.createDataFrame(facts, "name string, there boolean, gone boolean, one string")
    return known.join(store.statistics(), "name").select("name", F.col("rows").cast("int").alias("rows_"), "versions", "there", "gone", "one")


@query("events", "SELECT event_id, event_type, CAST(props->>'k' AS INTEGER) AS k FROM events")
def json_ingest(events):
    """JSON lines written as text and read with a schema."""
    path = f"{_store(events.sparkSession).path}/lines"
    events.select(F.to_json(F.struct("event_id", "event_type", "props")).alias("value")).write.text(path)
    read = json_documents(events.sparkSession, path, "event_id long, event_type string, props string")
    return read.select("event_id", "event_type", s.json_field(F.col("props"), "k").cast("int").alias("k"))


@query("orders", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_totalprice >= 1000 ORDER BY o_orderstatus, o_orderkey LIMIT 5 OFFSET 2")
def store_sql_page(orders):
    """A page in SQL text over a stored collection, the key under another name and as the tie-break."""
    stored = _store(orders.sparkSession).collection("paged_orders", "o_orderkey")
    stored.insert(orders)
    return stored.sql("SELECT o_orderkey AS id, o_orderstatus FROM paged_orders WHERE o_totalprice >= :least ORDER BY o_orderstatus, id LIMIT 5 OFFSET 2", least=1000)


@query("orders customer", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def store_include_page(orders, customer):
    """References of one page only."""
    store = _store(orders.sparkSession)
    people = store.collection("customer", "c_custkey")
    people.insert(customer)
    bought = store.collection("orders", "o_orderkey", references={"o_custkey": people})
    bought.insert(orders)
    page = bought.include("o_custkey", "customer", c.ge(F.col("o_totalprice"), 1000), ["-o_totalprice"], take=5)
    return page.select("o_orderkey", F.col("customer.c_name").alias("c_name"))
