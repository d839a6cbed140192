"""Filtering, ordering, paging, element access, projection and reference loading on DataFrames."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def find(df: DataFrame, condition: Column | str, skip: int | None = None, limit: int | None = None, key: str | None = None) -> DataFrame:
    """Rows for which ``condition`` is true; with ``skip`` or ``limit`` in the order of ``key``."""
    for n in (skip, limit):
        if n is not None and n < 0:
            raise ValueError("skip and limit must not be negative")
    rows = df.where(condition)
    if skip is None and limit is None:
        return rows
    return page(rows, [key] if key else [], skip or 0, limit)


def find_by_id(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key).eqNullSafe(F.lit(value)))


def find_by_ids(df: DataFrame, key: str, values: list[Any]) -> DataFrame:
    """Few ids become a pushed-down ``IN``; many a semi join."""
    ids = [v for v in dict.fromkeys(values) if v is not None]
    if len(ids) <= 256:
        return df.where(F.col(key).isin(ids))
    return df.join(df.sparkSession.createDataFrame([(v,) for v in ids], [key]), key, "left_semi")


def sort_keys(df: DataFrame, order: list[str], tie: str | None = None) -> list[Column]:
    """Sort columns from names, a leading ``-`` for descending.

    Null comes first, then NaN, then values; all reversed if descending.  ``tie`` (the key) ends the
    order unless it is in it already, which makes pages stable.
    """
    names = [n.lstrip("-") for n in order]
    out = []
    for name, way in [*zip(names, [n.startswith("-") for n in order], strict=True), *([(tie, False)] if tie and tie not in names else [])]:
        c = F.col(name)
        for k in [F.when(c.isNull(), 0).when(F.isnan(c), 1).otherwise(2), c] if dict(df.dtypes).get(name) in ("double", "float") else [c]:
            out.append(k.desc_nulls_last() if way else k.asc_nulls_first())
    return out


def page(df: DataFrame, order: list[str], skip: int = 0, take: int | None = None, tie: str | None = None) -> DataFrame:
    """A page in a stable order; sort, offset and limit are one top-k node in the plan."""
    keys = sort_keys(df, order, tie)
    rows = df.orderBy(*keys) if keys else df
    if skip > 0:
        rows = rows.offset(skip)
    return rows if take is None else rows.limit(max(0, take))


def take_then_skip(df: DataFrame, order: list[str], take: int, skip: int) -> DataFrame:
    return df.orderBy(*sort_keys(df, order)).limit(max(0, take)).offset(max(0, skip))


def page_with_total(df: DataFrame, order: list[str], skip: int, take: int, name: str = "total") -> DataFrame:
    """A page whose rows carry the number of all rows, which a scalar subquery counts."""
    return page(df, order, skip, take).withColumn(name, df.agg(F.count(F.lit(1))).scalar())


def first(df: DataFrame, order: list[str]) -> Row | None:
    return next(iter(df.orderBy(*sort_keys(df, order)).take(1)), None)


def last(df: DataFrame, order: list[str]) -> Row | None:
    return first(df, [n[1:] if n.startswith("-") else f"-{n}" for n in order])


def single(df: DataFrame) -> Row | None:
    """The only row, or none; raises if there are more."""
    rows = df.take(2)
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0] if rows else None


def element_at(df: DataFrame, order: list[str], index: int) -> Row | None:
    return next(iter(df.orderBy(*sort_keys(df, order)).offset(index).take(1)), None) if index >= 0 else None


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def exists(df: DataFrame, condition: Column) -> bool:
    return bool(df.where(condition).take(1))


def any_all(df: DataFrame, any_of: Column, all_of: Column, names: tuple[str, str]) -> DataFrame:
    """One row; over no rows: false and true."""
    return df.agg(
        F.coalesce(F.bool_or(F.coalesce(any_of, F.lit(False))), F.lit(False)).alias(names[0]),
        F.coalesce(F.bool_and(F.coalesce(all_of, F.lit(False))), F.lit(True)).alias(names[1]),
    )


def project(df: DataFrame, **columns: str | Column) -> DataFrame:
    return df.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))


def include(df: DataFrame, foreign_key: str, target: DataFrame, key: str, name: str) -> DataFrame:
    """Load references: a left join that puts the row ``key = foreign_key`` into a struct column.

    A reference to nothing stays null.  Spark picks a broadcast or a shuffle join by the target's size.
    """
    nested = target.select(F.col(key).alias("_ref"), F.struct(*target.columns).alias(name))
    return df.join(nested, F.col(foreign_key) == F.col("_ref"), "left").drop("_ref")
