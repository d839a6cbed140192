"""Random conditions: compiled columns against a model in Python."""

from __future__ import annotations

from itertools import product

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillfold.functions import compare as c

VALUES = [None, 0, 1, 2]
ROWS = list(product(VALUES, VALUES))
OPS = ("eq", "ne", "lt", "le", "gt", "ge")

leaf = st.one_of(
    st.tuples(st.sampled_from(OPS), st.sampled_from(["x", "y"]), st.sampled_from(["x", "y", None, 0, 1, 2])),
    st.tuples(st.just("in"), st.sampled_from(["x", "y"]), st.lists(st.sampled_from(VALUES), max_size=3).map(tuple)),
    st.tuples(st.sampled_from(["null", "there"]), st.sampled_from(["x", "y"]), st.none()),
)
tree = st.recursive(leaf, lambda t: st.one_of(st.tuples(st.just("not"), t, st.none()), st.tuples(st.sampled_from(["and", "or"]), t, t)), max_leaves=6)


def compiled(t):
    op, a, b = t
    if op == "not":
        return c.not_(compiled(a))
    if op in ("and", "or"):
        return (c.and_ if op == "and" else c.or_)(compiled(a), compiled(b))
    x = F.col(a)
    if op in ("null", "there"):
        return c.is_null(x) if op == "null" else c.holds(x, "int")
    return c.is_in(x, b) if op == "in" else getattr(c, op)(x, F.col(b) if isinstance(b, str) else b)


def expected(t, row):
    op, a, b = t
    if op == "not":
        return not expected(a, row)
    if op in ("and", "or"):
        l, r = expected(a, row), expected(b, row)  # noqa: E741
        return (l and r) if op == "and" else (l or r)
    x = row[a]
    if op in ("null", "there"):
        return (x is None) == (op == "null")
    if op == "in":
        return x in b
    low = lambda v: (0, 0) if v is None else (1, v)
    p, q = low(x), low(row[b] if isinstance(b, str) else b)
    return {"eq": p == q, "ne": p != q, "lt": p < q, "le": p <= q, "gt": p > q, "ge": p >= q}[op]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(tree, min_size=8, max_size=8))
def test_random_conditions(spark, trees):
    df = spark.createDataFrame(ROWS, "x int, y int")
    got = df.select("x", "y", *(compiled(t).alias(f"c{i}") for i, t in enumerate(trees))).collect()
    for r in got:
        row = {"x": r.x, "y": r.y}
        for i, t in enumerate(trees):
            assert r[f"c{i}"] is expected(t, row), (t, row)
            assert r[f"c{i}"] is not None
