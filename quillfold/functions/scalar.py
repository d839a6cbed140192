"""Scalar functions with the reference semantics where Spark's own differ; null in, null out unless said."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfold.functions.compare import SPACES


def _col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# strings
def trim(x: Column) -> Column:
    """Removes every kind of white space at both ends."""
    return F.btrim(x, F.lit(SPACES))


def substring(x: Column, start: int, length: int | None = None) -> Column:
    """Counts from 0; outside the string it gives what there is."""
    return F.substring(x, start + 1, length if length is not None else 2**31 - 1)


def replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new)) if old else x


def concat(*parts: Any) -> Column:
    """Null parts count as empty."""
    return F.concat(*(F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts))


def text(x: Column) -> Column:
    return x.cast("string")


# arithmetic: integers as 64 bit
def _wide(x: Any, integral: bool) -> Column:
    return _col(x).cast("bigint") if integral else _col(x)


def add(a: Any, b: Any, integral: bool = True) -> Column:
    return _wide(a, integral) + _wide(b, integral)


def subtract(a: Any, b: Any, integral: bool = True) -> Column:
    return _wide(a, integral) - _wide(b, integral)


def multiply(a: Any, b: Any, integral: bool = True) -> Column:
    return _wide(a, integral) * _wide(b, integral)


def divide(a: Any, b: Any, integral: bool = True) -> Column:
    """Integers truncate and a zero divisor raises; doubles give infinity or NaN."""
    x, y = _wide(a, integral), _wide(b, integral)
    if integral:
        return F.call_function("div", x, y)
    x, y = x.cast("double"), y.cast("double")
    endless = F.when(x == 0, F.lit(float("nan"))).when(F.isnan(x), x).otherwise(F.signum(x) * F.lit(float("inf")))
    return F.when(y == 0, endless).otherwise(F.try_divide(x, y))


def negate(x: Column) -> Column:
    return -x


def absolute(x: Column) -> Column:
    """Null counts as 0."""
    return F.abs(F.coalesce(x, F.lit(0)))


def ceiling(x: Column) -> Column:
    return F.ceil(F.coalesce(x, F.lit(0))).cast("double")


def floor(x: Column) -> Column:
    return F.floor(F.coalesce(x, F.lit(0))).cast("double")


def round_even(x: Column, digits: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(x, digits)


def smaller(a: Any, b: Any) -> Column:
    """As a double; 0 if either is null."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    return F.when(x.isNull() | y.isNull(), F.lit(0.0)).otherwise(F.least(x, y))


def larger(a: Any, b: Any) -> Column:
    """As a double; 0 if either is null."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    return F.when(x.isNull() | y.isNull(), F.lit(0.0)).otherwise(F.greatest(x, y))


def power(x: Any, y: Any) -> Column:
    return F.pow(F.coalesce(_col(x).cast("double"), F.lit(0.0)), F.coalesce(_col(y).cast("double"), F.lit(0.0)))


def square_root(x: Column) -> Column:
    return F.sqrt(F.coalesce(x.cast("double"), F.lit(0.0)))


def to_integer(x: Column, kind: str = "int") -> Column:
    """Conversion rounds halves to even instead of truncating."""
    return F.bround(x.cast("double"), 0).cast(kind)


# dates
def date_part(x: Column, part: str) -> Column:
    """``year month day hour minute second``, as int."""
    return getattr(F, part)(x).cast("int")


def date_of(x: Column) -> Column:
    """Midnight of the day, still without a time zone."""
    return F.date_trunc("day", x).cast("timestamp_ntz")


def day_of_week(x: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(x) - 1


def add_time(x: Column, days: float = 0, hours: float = 0, minutes: float = 0, seconds: float = 0) -> Column:
    total = days * 86400 + hours * 3600 + minutes * 60 + seconds
    return x + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(total).cast("decimal(18,6)"))


def add_months(x: Column, months: int = 0, years: int = 0) -> Column:
    return x + F.make_ym_interval(F.lit(years), F.lit(months))


def now() -> Column:
    """The time of the query, the same for all its rows, without a time zone."""
    return F.localtimestamp()


def today() -> Column:
    """Midnight of the query's day, without a time zone."""
    return F.date_trunc("day", F.localtimestamp()).cast("timestamp_ntz")


# arrays and JSON
def array_count(x: Column) -> Column:
    return F.size(x)


def array_has(x: Column, value: Any) -> Column:
    return F.coalesce(F.array_contains(x, value), F.lit(False))


def array_sum(x: Column) -> Column:
    """Null elements add 0; an empty array gives 0."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))


def array_average(x: Column) -> Column:
    """The sum over the number of all elements, nulls included; 0 for an empty array."""
    return F.when(F.size(x) == 0, F.lit(0.0)).otherwise(array_sum(x) / F.size(x))


def json_field(x: Column, path: str) -> Column:
    return F.get_json_object(x, f"$.{path}")


def value_order(x: Column) -> Column:
    """A sortable key of a ``variant`` of mixed types: null < boolean < number < string < the rest.

    The ranks are fixed values: those by which documents order values of different types.
    """
    kind = F.schema_of_variant(x)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    rank = F.when(x.isNull() | (kind == "VOID"), 1).when(kind == "BOOLEAN", 2).when(number, 3).when(kind == "STRING", 7).otherwise(11)
    return F.struct(
        rank.alias("rank"),
        F.when(number, F.try_variant_get(x, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double")).alias("number"),
        F.when((rank == 7) | (rank == 11), F.try_variant_get(x, "$", "string")).alias("text"),
    )
