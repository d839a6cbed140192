"""Document semantics: truth tables, literal scenarios, plans, collections, and SQL comparison."""

from __future__ import annotations

from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from quillfold.functions import compare as c
from quillfold.functions import scalar as s
from quillfold.operators import aggregates as a
from quillfold.operators import changes, constraints, rows
from quillfold.plans import catalogue
from quillfold.sources.collection import Store
from quillfold.sources.readers import json_documents
from quillfold.streaming.windows import windowed

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# comparison ------------------------------------------------------------------------------------


def model(op, x, y):
    """Null is the lowest value and equals itself."""
    k = lambda v: (0, 0) if v is None else (1, v)
    return {"eq": k(x) == k(y), "ne": k(x) != k(y), "lt": k(x) < k(y), "le": k(x) <= k(y), "gt": k(x) > k(y), "ge": k(x) >= k(y)}[op]


@pytest.mark.parametrize("op", ["eq", "ne", "lt", "le", "gt", "ge"])
def test_truth_tables(spark, op):
    values = [None, 1, 2]
    df = spark.createDataFrame(list(product(values, values)), "x int, y int")
    f = getattr(c, op)
    for r in df.select("x", "y", f(F.col("x"), F.col("y")).alias("v"), c.not_(f(F.col("x"), F.col("y"))).alias("n")).collect():
        assert r.v is model(op, r.x, r.y) and r.n is (not r.v)
    for y in values:
        for r in df.select("x", f(F.col("x"), y).alias("v"), c.not_(f(F.col("x"), y)).alias("n")).collect():
            assert r.v is model(op, r.x, y) and r.n is (not r.v), (r, y)


def test_filters_reach_the_reader(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    price = F.col("o_totalprice")
    for condition, pushed in (
        (c.lt(price, 5), "LessThan(o_totalprice,5.0)"),
        (c.ge(price, 5), "GreaterThanOrEqual(o_totalprice,5.0)"),
        (c.not_(c.gt(price, 5)), "LessThanOrEqual(o_totalprice,5.0)"),
        (c.eq(F.col("o_orderstatus"), "F"), "EqualNullSafe(o_orderstatus,F)"),
        (c.starts_with(F.col("o_orderpriority"), "1-"), "StringStartsWith(o_orderpriority,1-)"),
        (c.is_in(F.col("o_orderkey"), [1, 2]), "o_orderkey"),
    ):
        text = plan(orders.where(condition).select("o_orderkey"))
        assert pushed in text.split("PushedFilters")[1].split("\n")[0], text
        assert "o_orderdate" not in text.split("ReadSchema")[1]


def test_pages_are_one_top_k(spark):
    df = rows.page(spark.read.parquet(f"{SF}/orders.parquet"), ["-o_totalprice"], 5, 10, tie="o_orderkey")
    assert "TakeOrderedAndProject" in plan(df) and len(df.collect()) == 10


def test_totals_need_no_join(spark):
    df = rows.page_with_total(spark.read.parquet(f"{SF}/orders.parquet"), ["o_orderkey"], 3, 7)
    assert "Join" not in plan(df) and "Cartesian" not in plan(df) and {r.total for r in df.collect()} == {1500}


def test_strings(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \t"), (4, "certificate"), (5, "Abc")], "id int, t string")
    ids = lambda cond: [r.id for r in df.where(cond).orderBy("id").collect()]
    t = F.col("t")
    assert ids(c.null_or_empty(t)) == [1, 2] and ids(c.not_(c.null_or_blank(t))) == [4, 5]
    assert ids(c.contains(t, "tif")) == [4] and ids(c.not_(c.contains(t, "tif"))) == [1, 2, 3, 5]
    assert ids(c.starts_with(t, "aB", ignore_case=True)) == [5] and ids(c.like(t, "%ate")) == [4] and ids(c.like(t, "Abc")) == [5]
    assert ids(c.like(t, "%")) == [1, 2, 3, 4, 5] and ids(c.is_in(t, ["Abc", None])) == [1, 5]
    for bad in ("a%b", "a_b"):
        with pytest.raises(ValueError):
            c.like(t, bad)


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        s.round_even(F.lit(2.5)).alias("r"), s.divide(F.lit(-7), 2).alias("d"), s.divide(F.lit(1.0), 0, integral=False).alias("i"), s.substring(F.lit("hello"), 1, 3).alias("t"),
        s.concat(F.lit(None), "a").alias("c"), s.smaller(F.lit(None), 3).alias("m"), s.to_integer(F.lit(2.7)).alias("n"), s.trim(F.lit("　 x\n")).alias("w"),
        s.array_average(F.array(F.lit(1), F.lit(None))).alias("a"), s.add(F.lit(9007199254740992), 1).alias("b"), c.if_else(F.lit(None).cast("boolean"), 1, 2).alias("q"),
    ).first()
    assert tuple(row) == (2.0, -3, float("inf"), "ell", "a", 0.0, 3, "x", 0.5, 9007199254740993, None)


# scenarios -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(i, f"User_{i}", 20 + i % 50) for i in range(1, 101)], "id int, name string, age int")


def test_users(users):
    assert users.where(c.gt(F.col("age"), 60)).count() == 18
    hit = users.where(c.and_(c.ge(F.col("age"), 65), c.starts_with(F.col("name"), "User_9")))
    assert [r.id for r in hit.orderBy("id").collect()] == [95, 96, 97, 98, 99]
    assert [r.id for r in rows.page(hit, ["-age"], 1, 2, tie="id").collect()] == [98, 97]
    assert changes.set_where(users, c.eq(F.col("age"), 25), "id", name="x").where("name = 'x'").count() == 2
    assert changes.delete_where(users, c.eq(F.col("age"), 26)).count() == 98
    with pytest.raises(ValueError):
        changes.set_where(users, F.lit(True), "id", id=3)
    with pytest.raises(ValueError):
        changes.set_where(users, F.lit(True), "id", age=4.5)


def test_products(spark):
    data = [(1, "Apple", "Fruit", 1.5), (2, "Banana", "Fruit", 0.5), (3, "Orange", "Fruit", 2.0), (4, "Carrot", "Vegetable", 0.8), (5, "Broccoli", "Vegetable", 1.2), (6, "Milk", "Dairy", 3.0)]
    df = spark.createDataFrame(data, "id int, name string, category string, price double")
    got = {r.k: (r.n, r.s, r.a) for r in a.group(df, {"k": "category"}, n=a.count(), s=a.exact_total(F.col("price")), a=a.average(F.col("price"))).collect()}
    assert len(got) == 3 and got["Fruit"] == (3, 4.0, pytest.approx(4 / 3))
    empty = a.summarise(df.limit(0), s=a.total(F.col("price")), a=a.average(F.col("price")), m=F.max("price"), n=a.count()).first()
    assert tuple(empty) == (0.0, 0.0, None, 0)
    assert rows.first(df, ["-price"]).name == "Milk" and rows.last(df, ["-price"]).name == "Banana" and rows.element_at(df, ["id"], 2).id == 3
    assert rows.single(df.where("id = 4")).name == "Carrot" and rows.single(df.where("id = 40")) is None
    with pytest.raises(ValueError):
        rows.single(df)


def test_nan_sorts_between_null_and_values(spark):
    df = spark.createDataFrame([(1, 3.0), (2, float("nan")), (3, None), (4, -1.0)], "id int, v double")
    assert [r.id for r in rows.page(df, ["v"]).collect()] == [3, 2, 4, 1]
    assert [r.id for r in rows.page(df, ["-v"]).collect()] == [1, 4, 2, 3]


def test_variants_sort_by_type(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"v": "b"}\n{"v": 10}\n\n{"v": true}\n{"v": null}\n{"v": 2.5}\n{"v": "a"}\n')
    docs = json_documents(spark, str(tmp_path / "d.json")).select(F.variant_get("doc", "$.v", "variant").alias("v"))
    assert [r.v for r in docs.orderBy(s.value_order(F.col("v"))).select(F.to_json("v").alias("v")).collect()][1:] == ["true", "2.5", "10", '"a"', '"b"']
    assert json_documents(spark, str(tmp_path / "d.json"), "v string").count() == 6


# collections -----------------------------------------------------------------------------------


def test_collection_life(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    people = store.collection("people", "id", T.StructType([constraints.field("id", "int", required=True, key=True), constraints.field("name", "string"), constraints.field("level", "int", default=7)]))
    orders = store.collection("orders", "id", unique=[["number"]], references={"person": people})
    make = lambda data, schema: spark.createDataFrame(data, schema)
    people.insert(make([(1, "Ann"), (2, "Bo")], "id int, name string"))
    assert people.count() == 2 and people.find_by_id(2).name == "Bo" and people.find_by_id(9) is None
    assert {r.level for r in people.find_all().collect()} == {7}
    with pytest.raises(constraints.ConstraintError):
        people.insert(make([(1, "Again")], "id int, name string"))
    kind = "id int, number string, person int"
    orders.insert(make([(10, "a", 1), (11, "b", None)], kind))
    with pytest.raises(constraints.ConstraintError):
        orders.insert(make([(12, "c", 99)], kind))
    with pytest.raises(constraints.ConstraintError):
        orders.insert(make([(12, "a", 1)], kind))
    loaded = {r.id: r.owner for r in orders.include("person", "owner").collect()}
    assert loaded[10].name == "Ann" and loaded[11] is None
    assert orders.upsert(make([(11, "bb", 2), (12, "c", 2)], kind)) == (1, 1)
    assert orders.update(make([(12, "cc", 1), (77, "no", 1)], kind)) == 1 and orders.count() == 3
    assert orders.set_where(c.eq(F.col("number"), "cc"), person=2) == 1 and orders.count(c.eq(F.col("person"), 2)) == 2
    assert [r.id for r in orders.sql("SELECT id FROM orders WHERE person = :p ORDER BY id", p=2).collect()] == [11, 12]
    page, total = orders.find_page(F.lit(True), ["-number"], 0, 1)
    assert total == 3 and page.first().number == "cc"
    assert orders.delete([10, 10, None]) == 1 and orders.delete_where(c.eq(F.col("number"), "bb")) == 1
    assert store.names() == ["orders", "people"] and {r.name: r.rows for r in store.statistics().collect()} == {"orders": 1, "people": 2}

    people.apply(  # each step sees the ones before it, and one version is written
        lambda t: changes.insert(t, make([(3, "Cy")], "id int, name string")),
        lambda t: changes.set_where(t, c.eq(F.col("id"), 3), "id", name="Cyd"),
        lambda t: changes.delete_where(t, c.eq(F.col("name"), "Bo")),
    )
    assert people.find_by_id(3).name == "Cyd" and people.count() == 2
    (tmp_path / "store" / "people" / "v00000009").mkdir()  # a write that broke off
    people.set_where(c.eq(F.col("id"), 3), name="Cyn")
    assert people.version() == "v00000010" and people.find_by_id(3).name == "Cyn"
    (tmp_path / "store" / "broken" / "v00000001").mkdir(parents=True)
    assert store.sql("SELECT name FROM people WHERE id = 3").first().name == "Cyn"
    assert {r.name: r.rows for r in store.statistics().collect()} == {"broken": 0, "orders": 1, "people": 2}
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path / "store"), read_only=True).collection("people", "id").delete([1])
    store.drop("orders")
    assert not store.exists("orders")


def test_collections_that_refer_to_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "two"))
    make = lambda data, schema: spark.createDataFrame(data, schema)
    people = store.collection("people", "id", T.StructType([T.StructField("id", T.StringType()), T.StructField("mail", T.StringType())]), sparse=[["mail"]], layout=["mail"])
    orders = store.collection("orders", "id", T.StructType([T.StructField("id", T.IntegerType()), T.StructField("who", T.StringType())]), references={"who": people})
    people.insert(make([("u", None), ("v", None)], "id string, mail string"))
    orders.insert(make([(1, "u")], "id int, who string"))
    version = people.version()
    people.insert(make([("w", "m")], "id string, mail string"))  # appended, not rewritten
    assert people.version() == version and people.count() == 3
    for bad in ([("x", "m")], [("w", None)], [("x", "n"), ("y", "n")]):
        with pytest.raises(constraints.ConstraintError):
            people.insert(make(bad, "id string, mail string"))
    with pytest.raises(constraints.ConstraintError):
        orders.insert(make([(2, "nobody")], "id int, who string"))
    with pytest.raises(constraints.ConstraintError):
        people.upsert(make([("u", "m"), ("v", "m")], "id string, mail string"))
    assert people.count() == 3 and orders.count() == 1
    orders.insert(make([(2, "w"), (3, None)], "id int, who string"))
    page = orders.include("who", "person", condition=c.ge(F.col("id"), 2), order=["id"], take=1).collect()
    assert [(r.id, r.person.mail) for r in page] == [(2, "m")]
    assert people.delete(["w", "w", None, "zz"]) == 1
    assert store.sql("SELECT o.id FROM orders o JOIN people p ON o.who = p.id WHERE p.id = :who", who="u").count() == 1
    assert store.copy_to(str(tmp_path / "copy")).names() == ["orders", "people"]
    people.compact(1)
    assert people.count() == 2


def test_unlike_types_are_never_in_order(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "10", None), (3, None, 7)], "id int, t string, n int")
    ids = lambda cond: [r.id for r in df.where(cond).orderBy("id").collect()]
    t, n = F.col("t"), F.col("n")
    for f in (c.gt, c.ge, c.eq):
        assert ids(f(t, 5)) == [] and ids(f(n, "5")) == []
    assert ids(c.lt(t, 5)) == ids(c.le(t, 5)) == [3] and ids(c.lt(n, "x")) == [2]  # null is below everything
    assert ids(c.ne(t, 10)) == [1, 2, 3] and ids(c.eq(t, n)) == [] and ids(c.lt(t, n)) == [3] and ids(c.gt(t, n)) == [2]
    assert ids(c.eq(n, 5.0)) == [1] and ids(c.eq(t, "10")) == [2]


def test_sums_are_exact(spark):
    small = spark.createDataFrame([(0.004,), (0.004,), (None,)], "x double")
    assert small.agg(a.average(F.col("x"))).first()[0] == pytest.approx(0.008 / 3)
    assert small.agg(a.exact_total(F.col("x"))).first()[0] == 0.008
    large = spark.createDataFrame([(1e17,), (-1e17,), (0.5,), (3e27,)], "x double")
    assert large.agg(a.exact_total(F.col("x"))).first()[0] == 3e27
    assert small.limit(0).agg(a.average(F.col("x"))).first()[0] == 0


def test_values_are_coerced_to_their_fields(spark):
    df = spark.createDataFrame([(1, None, None, None)], "id int, at timestamp_ntz, d date, n bigint")
    got = changes.set_where(df, F.lit(True), "id", at="2024-02-29T10:00:00", d="2024-02-29", n="12").first()
    assert str(got.at) == "2024-02-29 10:00:00" and str(got.d) == "2024-02-29" and got.n == 12
    for bad in ({"n": "4.5"}, {"n": "x"}, {"d": "soon"}):
        with pytest.raises(ValueError):
            changes.set_where(df, F.lit(True), "id", **bad)


def test_schema_text_and_ids(spark):
    schema = T.StructType([constraints.field("id", "int", required=True, key=True), constraints.field("n", "string", default="x")])
    assert constraints.ddl("t", schema) == 'create table "t" (\n  "id" "int" pk required,\n  "n" "string" default \'x\'\n);'
    df = spark.createDataFrame([(5,), (None,)], "id int")
    assert [r.n for r in constraints.with_defaults(df, schema).collect()] == ["x", "x"] and constraints.violations(df, schema).count() == 1
    with pytest.raises(constraints.ConstraintError):
        constraints.violations(df.withColumn("odd", F.lit(1)), schema, strict=True)
    new = constraints.numbered(spark.range(0, 20, 1, 4).select(F.col("id").alias("v")), df, "id")
    assert sorted(r.id for r in new.collect()) == list(range(6, 26))
    ids = [r.k for r in constraints.object_ids(spark.range(3), "k").collect()]
    assert len(set(ids)) == 3 and all(len(i) == 24 for i in ids) and constraints.random_ids(spark.range(2), "k").distinct().count() == 2
    v7 = [r.k for r in constraints.ordered_ids(spark.range(3), "k").collect()]
    assert len(set(v7)) == 3 and all(len(k) == 36 and k[14] == "7" for k in v7)


def test_windows_stream_as_they_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    batch = windowed(events, "ts", "1 day", "1 day", "event_type", value="value")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream, "ts", "1 day", "1 day", "event_type", value="value").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("windows").collect())) == sorted(map(str, batch.collect()))


# all queries against SQL -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name not in catalogue.SQL:
        assert df.count() > 0
        return
    got, want = df.toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    text = lambda x: sorted(map(tuple, x[order].astype(str).values.tolist()))
    assert text(got) == text(want)


def test_variant_order_returns_every_row_in_order(spark):
    events = spark.createDataFrame([(i, (i * 37 % 11) - 4.5, f"t{i * 7 % 5}") for i in range(300)], "event_id long, value double, event_type string")
    got = [(r.event_id, r.rank, r.number, r.text) for r in catalogue.variant_order(events.repartition(4)).collect()]
    of = lambda i: [(1, None, None), (3, (i * 37 % 11) - 4.5, None), (7, None, f"t{i * 7 % 5}"), (2, 1.0, None)][i % 4]
    want = sorted(((i, *of(i)) for i in range(300)), key=lambda r: (r[1], r[2] or 0, r[3] or "", r[0]))
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
